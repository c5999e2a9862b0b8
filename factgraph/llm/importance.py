"""Importance resampling towards a target: hashed n-gram features of a corpus and of a target, and a draw by weight.

A task turns the words of a run of documents into one array of word numbers and sorts
its suffixes as deep as the longest n-gram. How many words neighbours in that order share
(LCP) says where the runs of each n-gram begin, so an n-gram is hashed once a run, and its
bucket is scattered back to all places where it stands. Bucket counts of corpus and target
give each bucket a gain, a document weighs the mean gain of its features, and Gumbel noise
from a hash of its id makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import numbered, table, written

#: A to Z become a to z; other ASCII that is neither digit nor small letter parts words. By bytes, as both touch ASCII alone.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Bytes of text whose suffixes are sorted together (a longer document is alone), and of those that are split into words at once.
CHUNK_BYTES, SPLIT_BYTES = 8 << 20, 1 << 20


def folded(text: str | None) -> bytes:
    """The text with words parted by spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


class Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def word_numbers(raw: bytes, known: Numbers) -> np.ndarray:
    """The words of a folded text as numbers; split in parts, as a word is several times its bytes."""
    parts, at = [np.empty(0, np.int32)], 0
    while at < len(raw):
        end = raw.find(b" ", at + SPLIT_BYTES)
        end = len(raw) if end < 0 else end
        found = raw[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(parts)


def suffix_runs(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` words, how many of these each shares with the one before it).

    ids: words as numbers from 1, a 0 at the end of each document. Nothing is shared from
    a 0 on, so no run goes beyond a document's end. The first suffix shares -1.
    """
    ahead = [np.concatenate([ids[k:], np.zeros(min(k, len(ids)), ids.dtype)]) for k in range(depth)]
    order = np.lexsort(ahead[::-1])
    lcp = np.full(len(order), -1, np.int32)
    lcp[1:] = 0
    same = np.ones(max(len(order) - 1, 0), bool)
    for column in ahead:
        here = column[order]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        lcp[1:] += same
    return order, lcp


def feature_buckets(texts: list[bytes], longest: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(words, buckets of all runs of 1 to `longest` of them, repeats included) of each folded text.

    A feature's bucket is the crc32 of its words joined by one space, modulo `buckets`.
    """
    known = Numbers()
    numbers = [word_numbers(raw, known) for raw in texts]
    end = np.zeros(1, np.int32)
    ids = np.concatenate([x for n in numbers for x in (n, end)])
    spelling = [b"", *known]
    size = np.array([len(n) for n in numbers], np.int64)
    ends = np.cumsum(size + 1) - 1
    left = np.repeat(ends, size + 1) - np.arange(len(ids))  # words from here to the document's end
    order, lcp = suffix_runs(ids, longest)
    of = []
    for k in range(1, longest + 1):
        held = left[order] >= k
        at, begins = order[held], lcp[held] < k
        first = at[begins]
        grams = zip(*[ids[first + j].tolist() for j in range(k)])
        hashed = np.fromiter((zlib.crc32(b" ".join([spelling[w] for w in gram])) for gram in grams), np.int64, len(first)) % buckets
        scattered = np.zeros(len(ids), np.int32)
        scattered[at] = hashed[np.cumsum(begins) - 1]
        of.append(scattered)
    out = []
    for begin, stop, n in zip((ends - size).tolist(), ends.tolist(), size.tolist()):
        out.append((n, np.concatenate([x[begin : max(begin, stop - k)] for k, x in enumerate(of)])))
    return out


def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, longest: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, n_words, n_features, buckets): of every whole text; buckets: binary, an unsigned number a feature."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
            found = feature_buckets(texts, longest, buckets)
            counts = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64())]
            blobs = pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *counts, blobs], names=["id", "n_words", "n_features", "buckets"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                ids.append(some.column(0))
                for text in some.column(1).to_pylist():
                    texts.append(folded(text))
                    held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield done(ids, texts)

    row = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(row.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a task adds up its own rows first, and the driver sees a number a bucket."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier a bucket is in the target, both with one more of each bucket; floors."""
    s_all, t_all, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    ratios = [(t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(document: str, seed: int) -> int:
    """A thousandfold Gumbel draw from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{document}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (id, n_words, n_features, weight, score, place): place tells rows apart."""
    own = features(docs, longest, buckets, id_col, text_col)
    aim = features(target.select(F.lit(0).alias("id"), text_col), longest, buckets, "id", text_col)
    gain, kind = gains(bucket_counts(own, buckets), bucket_counts(aim, buckets)), _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(b.as_buffer(), kind)].sum()) for b in batch.column(4)]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column(3).to_pylist())]
            score = [w + noise(d, seed) for w, d in zip(weight, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["id", "n_words", "n_features", "weight", "score"])

    rows = own.select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "n_words", "n_features", "buckets")
    out = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long, score long")
    return written(out.withColumn("place", F.monotonically_increasing_id()), "scores")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight, score, rank.

    Of the N rows with at least `least_words` words the N * percent / 100 (rounded down)
    with the highest scores are drawn, ties to the smaller id, null ids last; rank counts
    them from 1, the others' is null. A null or empty text has no features and weight 0. A
    null id is written as nothing in the hash; rows that repeat an id share its noise, each
    is weighed by its own text, and equal rows are drawn each on its own. An empty target
    gives gains by the corpus alone; an empty table no rows. Very long texts count whole. Extra columns are ignored.

    Scores are whole thousandths between about -50,000 and 70,000 whatever the size of the
    corpus, so the driver finds the last score that is drawn from a number a score; rows at or
    above it are sorted by ranges of score and id together.
    """
    rows = scored(docs, target, longest, buckets, seed, id_col, text_col)
    able = F.col("n_words") >= least_words
    counts = {r["score"]: r["n"] for r in rows.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw, seen, last = sum(counts.values()) * percent // 100, 0, None
    for score in sorted(counts, reverse=True):
        if seen >= draw:
            break
        seen, last = seen + counts[score], score
    near = F.lit(False) if last is None else able & (F.col("score") >= last)
    key = F.struct((-F.col("score")).alias("score"), F.col("id").isNull().alias("none"), F.col("id"), F.col("place"))
    above = numbered(rows.filter(near).withColumn("key", key), "key", "place", "rank")
    above = above.withColumn("rank", F.when(F.col("rank") < draw, F.col("rank") + 1))
    out = above.drop("key").unionByName(rows.filter(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH c AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)
), x AS (
  SELECT 'd' AS tab, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark
), w AS (
  SELECT tab, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM x
), f AS (
  SELECT tab, r, unnest(l) AS g FROM w
  UNION ALL
  SELECT tab, r, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM w WHERE len(l) > 1
), n AS (
  SELECT tab, r, g, count(*) AS n FROM f GROUP BY ALL
), h AS (
  SELECT g, strlen(g) AS len, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM n)
), b AS (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])))::BIGINT % 10000 AS bucket
  FROM h CROSS JOIN c
), s AS (
  SELECT bucket, sum(n) FILTER (WHERE tab = 'd') AS s, sum(n) FILTER (WHERE tab = 'b') AS t FROM n JOIN b USING (g) GROUP BY bucket
), z AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM s
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s CROSS JOIN z
), m AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN b USING (g) JOIN gain USING (bucket) WHERE tab = 'd' GROUP BY r
), o AS (
  SELECT id AS doc_id, r, len(l) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(CAST(id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN m USING (r) WHERE tab = 'd'
), p AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM o LEFT JOIN p USING (r)
"""
