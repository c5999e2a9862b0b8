"""A stored table of documents that a feed of changes keeps up to date, with writes as large as the changes.

The base lies in hash buckets of the path. A micro-batch adds a delta: the last change of each
path, in the same buckets. Reading joins the two bucket by bucket. Folding rewrites only
buckets that have deltas, into a new version, and a small manifest that is written last says
which version of each bucket counts and up to which batch it holds the deltas. A
batch or a fold that is repeated writes the same folder again, so neither can count twice, and
readers see a fold whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.sources.scratch import remove
from factgraph.streaming.feed import FEED, latest_per_path

_MANIFEST = "bucket int, version long, folded long"
_DELTA = f"{FEED}, batch long, bucket int"


class ChangedTable:
    """documents (file_path, text, ...) below a path that drivers and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, documents: DataFrame, path: str, buckets: int = 64) -> ChangedTable:
        """Stores documents as version 0; buckets should be a few hundred megabytes each."""
        table = cls(documents.sparkSession, path)
        table._store(documents.withColumn("bucket", _bucket(F.col("file_path"), buckets)), f"{path}/base/version=0", buckets)
        rows = table.spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("version"), F.lit(-1).cast("long").alias("folded"))
        table._point(rows, 0)
        return table

    @staticmethod
    def _store(rows: DataFrame, where: str, parts: int) -> None:
        # all of a bucket in one task, so that it is one file
        rows.repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)

    def _point(self, rows: DataFrame, number: int) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/number={number}")

    def manifest(self) -> tuple[int, list]:
        """(number, rows of bucket, version, folded) of the last manifest: a row a bucket."""
        rows = self.spark.read.schema(f"{_MANIFEST}, number long").parquet(f"{self.path}/manifest")
        last = rows.agg(F.max("number")).first()[0]
        return last, rows.filter(F.col("number") == last).drop("number").collect()

    @staticmethod
    def _where(rows: list, by: str, test) -> Column:
        """A filter on folders: for each value of `by` its buckets, so other folders are never opened."""
        groups: dict[int, list[int]] = {}
        for r in rows:
            groups.setdefault(r[by], []).append(r["bucket"])
        out = F.lit(False)
        for value, held in groups.items():
            out = out | (test(value) & F.col("bucket").isin(held))
        return out

    def _base(self, rows: list) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/base")
        return found.filter(self._where(rows, "version", lambda v: F.col("version") == v)).drop("version")

    def deltas(self, rows: list) -> DataFrame:
        """Changes that the base of these buckets doesn't hold yet."""
        none = self.spark.createDataFrame([], _DELTA)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return none
        found = self.spark.read.schema(_DELTA).parquet(f"{self.path}/delta")
        return found.filter(self._where(rows, "folded", lambda n: F.col("batch") > n))

    def _merged(self, rows: list) -> DataFrame:
        base = self._base(rows)
        new = latest_per_path(self.deltas(rows), order=("changed", "seq", "batch")).select("bucket", F.col("path").alias("file_path"), F.col("text").alias("_new"), F.lit(True).alias("_changed"))
        # a change to no text is a change
        return base.join(new, ["bucket", "file_path"], "left").withColumn("text", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("text"))).select(*base.columns)

    def read(self) -> DataFrame:
        """The documents as they are now; changes of unknown paths are ignored, nothing is deleted."""
        return self._merged(self.manifest()[1]).drop("bucket")

    def apply(self, changes: DataFrame, number: int) -> None:
        """Adds a batch of changes (path, text, changed, seq): what is written is its last change of each path."""
        buckets = len(self.manifest()[1])
        new = latest_per_path(changes).withColumn("bucket", _bucket(F.col("path"), buckets))
        self._store(new.select("path", "text", "changed", "seq", "bucket"), f"{self.path}/delta/batch={number}", min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def fold(self, upto: int) -> list[int]:
        """Rewrites the buckets that have deltas of batches up to a number, and points at them; gives these buckets."""
        last, rows = self.manifest()
        touched = {r["bucket"] for r in self.deltas(rows).filter(F.col("batch") <= upto).select("bucket").distinct().collect()}
        if not touched:
            return []
        mine = [r for r in rows if r["bucket"] in touched]
        self._store(self._merged(mine), f"{self.path}/base/version={last + 1}", len(touched))
        now = [(r["bucket"], last + 1, upto) if r["bucket"] in touched else (r["bucket"], r["version"], r["folded"]) for r in rows]
        self._point(self.spark.createDataFrame(now, _MANIFEST), last + 1)
        return sorted(touched)

    def vacuum(self) -> None:
        """Removes versions of buckets and batches that no reader of the last manifest needs."""
        last, rows = self.manifest()
        used = {(r["version"], r["bucket"]) for r in rows}
        held = self.spark.read.parquet(f"{self.path}/base").select("version", "bucket").distinct().collect()
        for r in held:
            if (r["version"], r["bucket"]) not in used:
                remove(self.spark, f"{self.path}/base/version={r['version']}/bucket={r['bucket']}")
        folded = {r["bucket"]: r["folded"] for r in rows}
        for r in self.deltas([{"bucket": b, "folded": -1} for b in folded]).select("batch", "bucket").distinct().collect():
            if r["batch"] <= folded[r["bucket"]]:
                remove(self.spark, f"{self.path}/delta/batch={r['batch']}/bucket={r['bucket']}")
        for n in range(last):
            remove(self.spark, f"{self.path}/manifest/number={n}")


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def keep_up_to_date(feed: DataFrame, table: ChangedTable, checkpoint: str, trigger: dict | None = None, fold_every: int = 16) -> StreamingQuery:
    """Applies each micro-batch of a feed to the table, and folds deltas into it every few batches."""

    def apply(batch: DataFrame, number: int) -> None:
        here = ChangedTable(batch.sparkSession, table.path)
        here.apply(batch, number)
        if number % fold_every == fold_every - 1:
            here.fold(number)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
