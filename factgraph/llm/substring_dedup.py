"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

Documents lie in blocks of ascending ids. Each block hashes every window of its
documents and sends its distinct hashes, sorted, to buckets by their top bits; a bucket
sees, for each hash, all blocks that hold it and sends back to each block one bit a hash:
set where an earlier block holds the same window. A block knows its own repeats, so with
the bits it knows every window that also starts earlier, merges those into maximal
intervals of words, and cuts them out. A passage in every document costs a bucket one
entry a block, so no bucket is hot; text is shuffled once, a window as 8 bytes once.

Two different windows are taken as equal only if 64 bits of rolling hash and the bits
of the bucket's number, taken from a second hash of the same words, all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import IdBlocks, mixed, numbered, own_ids, partitions, table, text_bytes
from factgraph.llm.words import Powers, window_hashes, word_hashes, word_list

#: Text that a block holds, and bytes of hashes that a bucket gets, about.
BLOCK_BYTES, BUCKET_BYTES = 6_000_000, 12_000_000


def block_rows(block: pa.Table, id_col: str = "id") -> tuple[pa.Array, list[list[bytes]]]:
    """A block's ids and words, in the order of ids (null first), then texts."""
    texts = block.column("text").to_pylist()
    ids = block.column("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, texts[i] or ""))
    return block.column("id").combine_chunks().take(pa.array(order, pa.int64())), [word_list(texts[i]) for i in order]


def block_windows(words: list[list[bytes]], length: int, buckets: int, powers: Powers):
    """(bucket, hash, number of the window) of all windows, and how many each document has."""
    counts = np.array([max(0, len(w) - length + 1) for w in words], np.int64)
    main, second = [], []
    for w in words:
        if len(w) >= length:
            h = word_hashes(w)
            main.append(window_hashes(h, length, powers))
            second.append(window_hashes(mixed(h, 7), length, powers))
    if not main:
        return np.empty(0, np.int64), np.empty(0, np.uint64), counts
    return (np.concatenate(second) % np.uint64(buckets)).astype(np.int64), np.concatenate(main), counts


def distinct(bucket: np.ndarray, hashed: np.ndarray):
    """Order by (bucket, hash, place), and a flag for the first of each equal run."""
    order = np.lexsort((hashed, bucket))
    b, h = bucket[order], hashed[order]
    first = np.r_[True, (b[1:] != b[:-1]) | (h[1:] != h[:-1])] if len(order) else np.empty(0, bool)
    return order, first


def intervals(repeated: np.ndarray, length: int, n_words: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by repeated windows, as (start, end)."""
    if not repeated.any():
        return []
    cover = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeated)
    cover[at] += 1
    cover[: n_words + 1] -= np.bincount(at + length, minlength=n_words + 1)[: n_words + 1]
    inside = np.cumsum(cover)[:n_words] > 0
    edge = np.diff(np.r_[0, inside.view(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def repeated_passages(
    docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_words, removed array<struct<start, end>>, kept.

    A window is `length` consecutive words of one document. Every word that lies in a
    window whose words also start earlier (in a smaller id, or earlier in the document)
    is removed; windows are judged on the input. removed: the maximal intervals, in
    words; kept: the words that stay, joined by one space. A null text has no words.
    Ids are numbers. Null ids come first; rows with the same id are separate documents,
    in the order of a hash of their text, so however many there are they fill several
    blocks. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text_col)
    blocks, buckets = size // BLOCK_BYTES + 1, size // BUCKET_BYTES * 3 // 2 + 1
    own = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    unique = own_ids(own, "name")
    own = own.withColumn("id", F.col("name")) if unique else numbered(own, "name", "text", "id", nulls_first=True)
    kind = own.schema["id"].dataType.simpleString()
    rows = own.select("id", "text", IdBlocks(own, "id", blocks).column().alias("block"))
    rows = rows.repartition(max(partitions(spark), min(blocks, 20_000)), "block")

    def emit(block: pa.Table) -> pa.Table:
        words = block_rows(block)[1]
        bucket, hashed, _ = block_windows(words, length, buckets, Powers())
        order, first = distinct(bucket, hashed)
        bucket, hashed = bucket[order][first], hashed[order][first]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(bucket)] if len(bucket) else cut
        own = block.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(bucket[cut], pa.int64()),
                "block": pa.array([own] * len(cut), pa.int64()),
                "hashes": pa.array([hashed[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            }
        )

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        parts = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        everything = np.concatenate(parts)
        order = np.argsort(everything, kind="stable")  # equal hashes stay in the order of blocks
        ordered = everything[order]
        seen = np.zeros(len(everything), bool)
        seen[order[1:]] = ordered[1:] == ordered[:-1]
        rows = [(b, i, np.packbits(seen[e - len(p) : e]).tobytes()) for b, i, p, e in zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), parts, ends.tolist()) if seen[e - len(p) : e].any()]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "seen": pa.array([r[2] for r in rows], pa.binary())})

    hashes = rows.groupBy("block").applyInArrow(emit, "bucket long, block long, hashes binary")
    # a bucket has a bounded share of the windows, so their number grows with the input, and so must the tasks
    hashes = hashes.repartition(max(partitions(spark), min(buckets, 20_000)), "bucket")
    seen = hashes.groupBy("bucket").applyInArrow(compare, "block long, bucket long, seen binary")

    def cut_out(block: pa.Table, seen: pa.Table) -> pa.Table:
        ids, words = block_rows(block)
        bucket, hashed, counts = block_windows(words, length, buckets, Powers())
        order, first = distinct(bucket, hashed)
        repeated = np.zeros(len(order), bool)
        repeated[order[~first]] = True
        heads = order[first]
        named = seen.column("bucket").to_numpy()
        lows, highs = (np.searchsorted(bucket[heads], named, side).tolist() for side in ("left", "right"))
        for low, high, bits in zip(lows, highs, seen.column("seen").to_pylist()):
            own = heads[low:high]
            earlier = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
            repeated[own[earlier]] = True
        # a window that an earlier block holds is repeated wherever it stands in this one
        group = np.cumsum(first) - 1
        from_before = repeated[heads]
        repeated[order] |= from_before[group] if len(order) else False
        ends = np.cumsum(counts)
        removed = [intervals(repeated[e - c : e], length, len(w)) for w, c, e in zip(words, counts.tolist(), ends.tolist())]
        kept = []
        for w, cuts in zip(words, removed):
            for a, b in reversed(cuts):
                del w[a:b]
            kept.append(b" ".join(w).decode())
        n = [len(w) + sum(b - a for a, b in cuts) for w, cuts in zip(words, removed)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans = pa.array([[{"start": a, "end": b} for a, b in cuts] for cuts in removed], kind)
        return pa.table({"id": ids, "n_words": pa.array(n, pa.int64()), "removed": spans, "kept": pa.array(kept, pa.string())})

    done = rows.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(
        cut_out, f"id {kind}, n_words long, removed array<struct<start: long, end: long>>, kept string"
    )
    if not unique:
        done = done.join(own.select("id", "name"), "id").withColumn("id", F.col("name")).drop("name")
    return done.withColumnRenamed("id", id_col)


def op5_window_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda p: array_to_string(w[p:p + 19], ' '))) AS g FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY sha256(g) ORDER BY doc_id, p) > 1 AS again FROM x),
g AS (SELECT DISTINCT doc_id, p + unnest(range(20)) AS p FROM f WHERE again),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
