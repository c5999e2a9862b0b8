"""A feed of changed files, applied to a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators.resolve import last_by

FEED = "path string, text string, changed timestamp, seq long"


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of changes (path, text, changed, seq) from Parquet files as they arrive; files that vanish are passed over."""
    return spark.readStream.schema(FEED).option("ignoreMissingFiles", "true").parquet(folder)


def latest_per_path(changes: DataFrame, path: str = "path", order: tuple[str, ...] = ("changed", "seq")) -> DataFrame:
    """The last change of each path; the same on a batch and inside a micro-batch."""
    return last_by(changes, [path], [F.col(c) for c in order])


def upsert(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents with the texts of known paths replaced; changes of unknown paths are ignored, nothing is deleted."""
    new = latest_per_path(changes).select(F.col("path").alias("file_path"), F.col("text").alias("_new"))
    return documents.join(new, "file_path", "left").withColumn("text", F.coalesce("_new", "text")).select(*documents.columns)


def affected_projects(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects of which a document changed: what must be computed anew, their dependents not included."""
    return documents.join(changes.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("project").distinct()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n): an extension for feeds with times; rows later than `late` are dropped by the watermark."""
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), key, "n")
