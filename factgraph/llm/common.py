"""What the operators of this subpackage share: inputs, scratch tables, id blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.sources.scratch import drop_scratch, remove, scratch, scratch_dir, stored, written  # noqa: F401

#: One of these separates words everywhere in this subpackage: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own: none is null, none occurs twice."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows"))
    return ids.filter("id IS NULL OR rows > 1").isEmpty()


def numbered(docs: DataFrame, id_col: str, text_col: str, name: str, nulls_first: bool = False) -> DataFrame:
    """docs with a column `name`: rows counted from 0 in the order of id, then of a hash of the text.

    The rows are sorted and written once, so the numbers stay when tasks are repeated;
    the driver sees a count a partition.
    """
    order = F.col(id_col).asc_nulls_first() if nulls_first else F.col(id_col).asc_nulls_last()
    # a group of equal ids, however large, is split by the hash
    ordered = docs.orderBy(order, F.xxhash64(text_col))
    place = free_name(docs, "_place")
    rows = written(ordered.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (part + 1).cast("int"))
    return rows.withColumn(name, offset + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(place)


def with_own_ids(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs and a column `name` that tells its rows apart and follows the order of their ids, null ones last.

    That is the id itself, unless ids are null or repeated; then it is the row's number.
    """
    return docs.withColumn(name, F.col(id_col)) if own_ids(docs, id_col) else numbered(docs, id_col, text_col, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that related inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


class IdBlocks:
    """Blocks of ascending ids with about equally many rows.

    The bounds are quantiles of the id column, at most MOST_BOUNDS of them, so the
    expression stays small at any scale; each span is then divided evenly into
    `parts`. A block number never decreases with the id, so the order of blocks is
    the order of ids. A null id goes to block 0.
    """

    MOST_BOUNDS = 512

    def __init__(self, df: DataFrame, id_col: str, blocks: int):
        bounds = max(1, min(self.MOST_BOUNDS, blocks))
        self.parts = math.ceil(blocks / bounds)
        found = df.agg(
            F.percentile_approx(id_col, [i / bounds for i in range(bounds + 1)], 20_000).alias("q")
        ).first()["q"]
        self.bounds = sorted(set(found or []))
        self.id_col = id_col

    def column(self) -> Column:
        c = F.col(self.id_col).cast("long")
        if len(self.bounds) < 2:
            return F.lit(0).cast("long")
        edges = F.array(*[F.lit(b).cast("long") for b in self.bounds])
        inner = self.bounds[1:-1]
        # a balanced tree of comparisons: log2(bounds) steps per row
        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo).cast("long")
            mid = (lo + hi) // 2
            return F.when(c < inner[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

        span = pick(0, len(inner))
        if self.parts == 1:
            return F.coalesce(span, F.lit(0).cast("long"))
        low = F.element_at(edges, (span + 1).cast("int"))
        high = F.element_at(edges, (span + 2).cast("int"))
        share = (c.cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0))
        part = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(0.999999999)) * self.parts)
        return F.coalesce(span * self.parts + part, F.lit(0).cast("long"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole column."""
    return int(df.agg(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit(""))))).first()[0] or 0)
