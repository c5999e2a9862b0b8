"""Token counts of texts by a byte-level vocabulary of ranks.

The vocabulary is a file (base64 of the bytes, a space, the rank a line) and the pattern
that splits a text before merging; both are parameters, as `o200k_base` isn't available
everywhere. The library that merges is optional.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def with_token_counts(rows: DataFrame, columns: dict[str, str], ranks: str, pattern: str) -> DataFrame:
    """rows with a count for each text column: columns maps a text's column to that of its count. A null text has none.

    Arrow batches, no shuffle; the vocabulary is read once a task. Special tokens are ordinary text.
    """
    kept, wanted = rows.columns, dict(columns)
    schema = StructType(list(rows.schema.fields) + [StructField(n, LongType()) for n in wanted.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [pa.array([None if t is None else len(encode(t)) for t in batch.column(c).to_pylist()], pa.int64()) for c in wanted]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*kept, *wanted.values()])

    return rows.mapInArrow(run, schema)


def token_benchmark(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(name, source_tokens, response_tokens, reduction) of rows (name, source, response); empty sources are left out.

    metrics.token_reduction and metrics.largest sum it up.
    """
    counted = with_token_counts(rows.select("name", "source", "response"), {"source": "source_tokens", "response": "response_tokens"}, ranks, pattern)
    return counted.filter("source_tokens > 0").select("name", "source_tokens", "response_tokens", (1 - F.col("response_tokens") / F.col("source_tokens")).alias("reduction"))
