import base64

import pytest
from pyspark.sql import functions as F

from factgraph.functions.tokens import token_benchmark, with_token_counts
from factgraph.operators import metrics

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def test_counts_and_reductions(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    count = lambda t: len(tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t))
    texts = [("A", "class A { public int B() { return 1; } }", "B()"), ("C", "class C { } // <|endoftext|> ümlaut", "C"), ("E", "", "x"), ("N", None, None)]
    rows = spark.createDataFrame(texts, "name string, source string, response string")
    found = {r.name: r.n for r in with_token_counts(rows, {"source": "n"}, path, P.PATTERN).collect()}
    assert found == {n: None if s is None else count(s) for n, s, _ in texts}
    bench = token_benchmark(rows, path, P.PATTERN)
    assert {r.name: round(r.reduction, 9) for r in bench.collect()} == {n: round(1 - count(a) / count(s), 9) for n, s, a in texts[:2]}
    total = metrics.token_reduction(bench.select(F.col("response_tokens").alias("response"), F.col("source_tokens").alias("source"))).first()
    assert total.n == 2 and abs(total.pooled_reduction - (1 - sum(count(a) for *_, a in texts[:2]) / sum(count(s) for _, s, _ in texts[:2]))) < 1e-9
    largest = max(texts[:2], key=lambda t: count(t[1]))[0]
    assert [r.name for r in metrics.largest(bench, "source_tokens", 1).collect()] == [largest]
    assert with_token_counts(rows.limit(0), {"source": "n"}, path, P.PATTERN).count() == 0
