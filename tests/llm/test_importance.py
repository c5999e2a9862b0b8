import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from factgraph.llm import importance
from tests.llm.helpers import documents, odd_texts


def grams(text, longest=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def expected(ids, texts, target, percent=25, least=20, longest=2, buckets=10_000):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, some in ((s, texts), (t, target)):
        for text in some:
            for g in grams(text, longest)[1]:
                counts[place(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in zip(ids, texts):
        words, found = grams(text, longest)
        weight = math.floor(sum(gain[place(g)] for g in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


def found(docs, target, **options):
    return sorted(map(tuple, importance.resample(docs, target, **options).collect()), key=repr)


TARGET = ["the of and w1 w2 über", None, "", "W3 w4. w5, 日本 edit", "it's x1"]


@pytest.mark.parametrize("options", [{}, {"longest": 1, "percent": 100}, {"longest": 4, "buckets": 97, "least": 5}, {"percent": 0}, {"buckets": 100_000, "percent": 60}])
def test_against_brute_force(spark, odd, options, monkeypatch):
    texts = odd_texts()
    given = {"least_words" if k == "least" else k: v for k, v in options.items()}
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    monkeypatch.setattr(importance, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(importance, "SPLIT_BYTES", 100)
    assert found(odd, target, **given) == expected(range(len(texts)), texts, TARGET, **options)


def test_runs_are_those_of_sorted_suffixes():
    r = random.Random(3)
    for _ in range(200):
        ids = np.array([r.choice((0, 1, 2, 3)) for _ in range(r.randint(0, 30))], np.int32)
        depth = r.randint(1, 4)
        order, lcp = importance.suffix_runs(ids, depth)
        head = lambda i: [*ids[i : i + depth], *[0] * depth][:depth]
        heads = [head(i) for i in order]
        assert sorted(order.tolist()) == list(range(len(ids))) and heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], lcp[1:].tolist()):
            same = 0
            while same < depth and a[same] == b[same] != 0:
                same += 1
            assert n == same


def test_ids_may_be_null_or_repeated(spark):
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(25)) for i in range(12)] + ["few words", None]
    ids = [3, 3, 3, None, None, 1, 2, 4, 5, 6, 7, 8, 9, None]
    result = importance.resample(documents(spark, texts, ids), documents(spark, texts[:2]), percent=50).collect()
    rows = expected(ids, texts, texts[:2], percent=50)
    assert sorted((repr(tuple(r)[:5]) for r in result)) == sorted(repr(r[:5]) for r in rows)
    drawn = sorted((r for r in result if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 7)) and [r.score for r in drawn] == sorted((r[4] for r in rows if r[5]), reverse=True)


def test_equal_rows_and_ties(spark):
    """Equal rows have one score and are drawn each on its own."""
    docs = documents(spark, ["a b c " * 10] * 8, [5] * 8).repartition(3)
    ranks = sorted((r.rank for r in importance.resample(docs, docs.limit(0), percent=50).collect() if r.rank))
    assert ranks == [1, 2, 3, 4]


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, ["one two three " * 10, ""])
    assert found(none, none) == [] and found(none, some) == []
    assert found(some, none, percent=100) == expected([0, 1], ["one two three " * 10, ""], [], percent=100)
