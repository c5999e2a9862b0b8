"""Sharding by jump consistent hashing. DataFrame operations only.

A key walks through the bucket numbers at which it would jump as shards are added, and
stays at the last one below the number of shards. No ring and no table is kept, and one
more shard takes 1/(n+1) of the rows, all of them into itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import IdBlocks, table

#: Fixed values of the published algorithm: the 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64
HIGH = 1 << 33

#: Rows that one task numbers; a shard is cut into blocks of about this size.
ROWS_A_BLOCK = 50_000


def jumps(key: Column, most: int) -> Column:
    """All buckets on the key's walk, as array<int>, until `most` shards are reached.

    key: a long, read as an unsigned 64-bit number; null as 0. The products need 126
    bits, so they are decimals; a walk has about ln(most) steps. A first fold takes a few
    times as many, and only a walk that isn't over by then goes on in a second one.
    """
    unsigned = F.coalesce(key.cast("long"), F.lit(0).cast("long")).cast("decimal(20,0)")
    unsigned = F.when(unsigned < 0, (unsigned + F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(unsigned)
    multiplier, modulus = F.lit(str(MULTIPLIER)).cast("decimal(19,0)"), F.lit(str(MODULUS)).cast("decimal(20,0)")

    def step(state: Column, _: Column) -> Column:
        product = (state["k"] * multiplier).cast("decimal(38,0)")
        k = F.pmod((product + F.lit(1).cast("decimal(1,0)")).cast("decimal(38,0)"), modulus).cast("decimal(20,0)")
        high = F.floor((k / F.lit(str(HIGH)).cast("decimal(10,0)")).cast("decimal(38,15)")).cast("double")
        j = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        nxt = F.struct(k.alias("k"), j.alias("j"), F.concat(state["walk"], F.array(state["j"].cast("int"))).alias("walk"))
        return F.when(state["j"] < most, nxt).otherwise(state)

    start = F.struct(unsigned.alias("k"), F.lit(0).cast("long").alias("j"), F.array().cast("array<int>").alias("walk"))
    # the first step from bucket 0 is the walk's own start: every key passes bucket 0
    soon = min(most, 16 + 4 * math.ceil(math.log(most + 1)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(soon)), start, step)
    if soon == most:
        return walked["walk"]
    # a walk that is over has no more steps
    more = F.when(walked["j"] < most, F.sequence(F.lit(1), F.lit(most - soon))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, walked, step)["walk"]


def shard_of(walk: Column, shards: int) -> Column:
    """The last bucket of the walk below the number of shards."""
    return F.element_at(F.filter(walk, lambda b: b < shards), -1).cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot, grown_shard.

    The key is the id, and it and the number of shards alone decide. size: UTF-8 bytes
    of the text (null: none) plus 8. slot: the row's place in its shard in the order of
    ids, from 0 without gaps; repeated ids are ordered by their text's checksum and
    size. grown_shard: the shard if there were one more. Ids are numbers; a null id has
    the key 0 and comes first. Extra columns are ignored; an empty table gives no rows. No text is shuffled; a shard is numbered in blocks of ids, whose counts
    are added up beforehand, so no task sees a whole shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    block = IdBlocks(docs, id_col, max(1, n // (ROWS_A_BLOCK * shards) + 1)).column()
    crc, parts = F.crc32(text.cast("binary")), n // ROWS_A_BLOCK + 1
    # rows without an id all have one key: they are dealt by the checksum that orders them
    part = F.when(F.col(id_col).isNull(), F.floor(crc / F.lit(float(1 << 32)) * parts).cast("int")).otherwise(F.lit(parts))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        crc.alias("text_crc32"),
        jumps(F.col(id_col), shards + 1).alias("_walk"),
        F.struct(block.alias("block"), part.alias("part")).alias("_block"),
    ).select(
        id_col, "size", "text_crc32", "_block",
        shard_of(F.col("_walk"), shards).alias("shard"),
        shard_of(F.col("_walk"), shards + 1).alias("grown_shard"),
    )
    # one row per shard and block: their number is about rows / ROWS_A_BLOCK, no matter how rows are dealt
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "_block"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard"
    )


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


SQL = r"""
WITH RECURSIVE c AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), t AS (
  SELECT doc_id, n + 8 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
  FROM d CROSS JOIN c
), w(doc_id, k, b, j) AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2, j FROM w WHERE j < 25)
), s AS (
  SELECT doc_id, max(b) FILTER (WHERE b < 24)::INT AS shard, max(b) FILTER (WHERE b < 25)::INT AS grown_shard FROM w GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM t JOIN s USING (doc_id)
"""
