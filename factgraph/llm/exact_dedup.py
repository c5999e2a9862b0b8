"""Exact deduplication against a persistent digest index. DataFrame operations only.

The index is a table of (digest, keep_id, rows), bucketed and sorted by the digest. A
batch is reduced to digests (32 bytes a document, no text is shuffled), deduplicated
against the index by a sort-merge anti-join on the digest, and the digests that are new
are appended. Because the table is bucketed by the join key, only the batch is shuffled,
however large the index has grown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from factgraph.llm.common import SPACE, free_name, partitions, table, with_own_ids, written


def normalised(text: Column) -> Column:
    """Each run of space characters as one space; a null text as an empty one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): binary SHA-256 of the normalised text in UTF-8."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("_digest"),
    )


class DigestIndex:
    """Digests seen so far, in a bucketed and sorted table that outlives the session's data.

    name: the table; it is created, empty, if it isn't there. buckets: fixed when the
    table is made; about 128 MB of digests a bucket is a good size. Each entry names the
    batch that brought it, so a batch that is added again, as by a job that is repeated
    after a failure, gets the answers of the first time and adds nothing twice.
    """

    SCHEMA = "digest binary, keep_id {kind}, rows long, batch string"

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)
        if self.exists():  # a table keeps the buckets that it was made with
            said = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()
            self.buckets = int(said["data_type"]) if said else self.buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def append(self, found: DataFrame) -> None:
        """Adds (digest, keep_id, rows, batch); digests in it must be new to the index."""
        (
            found.select("digest", "keep_id", "rows", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def decide(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Of rows (_id, _digest): (digest, keep_id, rows, is_new), which the index holds from then on."""
        groups = written(
            rows.groupBy(F.col("_digest").alias("digest")).agg(F.min("_id").alias("keep_id"), F.count("*").alias("rows")), "batch-digests"
        )
        if batch is None:  # the same digests of the same ids are the same batch
            said = groups.agg(F.count("*"), F.sum(F.xxhash64("digest", "keep_id", "rows").cast("decimal(38,0)"))).first()
            batch = f"{said[0]}:{said[1]}"
        if not self.exists():  # empty at first, so that every batch takes the same way
            kind = groups.schema["keep_id"].dataType.simpleString()
            self.append(self.spark.createDataFrame([], self.SCHEMA.format(kind=kind)))
        known = self.read().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))
        before = self.read().filter(F.col("batch") == batch).select("digest")
        new = written(groups.join(known.hint("merge"), "digest", "left_anti"), "new-digests")
        # read before the index grows, so that it doesn't meet this batch's own digests
        met = groups.select("digest", "rows").join(known.hint("merge"), "digest")
        old = written(met.select("digest", F.col("known_id").alias("keep_id"), "rows", F.lit(False).alias("is_new")), "known-digests")
        self.append(new.join(before.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch)))
        return new.withColumn("is_new", F.lit(True)).unionByName(old)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates a batch and adds what is new in it to the index.

        Returns a row for each row of docs: id, digest, keep_id, group_size (of the
        batch's rows with that text) and is_new (no other batch brought the text before).
        The first of a new text is the row with the smallest id; for a text known
        before, keep_id is the id that the index holds. batch: its name; without one,
        batches with the same texts under the same ids count as one, given again. Null
        ids sort last and null texts count as empty; repeated rows belong to the same
        group. An empty batch gives no rows. Extra columns are ignored.
        """
        rows = written(digests(docs, id_col, text_col), "digests")
        decided = self.decide(rows, batch)
        return rows.join(decided, rows["_digest"] == decided["digest"]).select(
            F.col("_id").alias(id_col), "digest", "keep_id", F.col("rows").alias("group_size"), "is_new"
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of space characters has
    become one space. kept: the row is the one of its group that stays. index: the
    table of earlier calls, to deduplicate against and to add to. Without it docs are
    taken in two batches, the upper half of the ids after the lower one, through an
    index that is dropped at the end. Null ids come last, null texts count as empty. Of
    repeated rows with the same id all count as kept; kept_documents tells them apart.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(digests(docs, id_col, text_col), "digests")
    if index:
        groups = DigestIndex(spark, index).decide(rows)
    else:
        # ids that are no numbers have no cheap median: all of them make the upper batch
        half = rows.agg(F.percentile_approx("_id", 0.5)).first()[0] if isinstance(rows.schema["_id"].dataType, NumericType) else None
        lower = F.coalesce(F.col("_id") < F.lit(half), F.lit(False))
        held = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
        try:
            both = [held.decide(rows.filter(part), name) for part, name in ((lower, "lower"), (~lower, "upper"))]
        finally:
            held.drop()  # the answers are written by now
        groups = both[0].unionByName(both[1]).groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"), F.sum("rows").alias("rows"), F.bool_or("is_new").alias("is_new")
        )
    groups = written(groups, "groups")  # both sides of the join are plain shuffles, so Spark can split the rows of a large group
    return rows.join(groups, rows["_digest"] == groups["digest"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("rows").cast("long").alias("group_size"),
        (F.col("is_new") & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, with the columns they came with.

    One row of each text stays, that with the smallest id, null ids last; null texts
    count as empty. Rows are told apart by themselves: ids can be null, and be repeated
    with the same text or others. Columns of any name are kept as they are; an empty
    table gives no rows.
    """
    row = free_name(docs, "_row")
    rows = with_own_ids(docs, id_col, text_col, row)
    drop = exact_dedup(rows, row, text_col).filter(~F.col("kept")).select(row)
    return rows.join(drop.hint("merge"), row, "left_anti").select(*docs.columns)  # the same way at every size


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON d.h = g.h
"""
