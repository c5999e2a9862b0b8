"""Tables that cut lineage, in the folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary folder
    is made, set as the checkpoint folder, and removed at exit; on a cluster it would be
    another folder on each machine, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not shared:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            shared = found.get()
        elif not re.fullmatch(r"local(\[[\d*,\s]+\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            shared = tempfile.mkdtemp(prefix="factgraph-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
            sc.setCheckpointDir(shared)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/factgraph-{sc.applicationId}"


def stored(df: DataFrame, what: str, by: str | None = None) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read back, and where; by: a column to make a folder a value of."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.add(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Whether Spark removes the shuffle files of a job of SQL as soon as it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is read from its files from then on, so its shuffle files go at once: else those of all rounds lie on disk until the driver collects garbage."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before) if before is not None else spark.conf.unset(CLEANED)


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """df, stored and read back.

    This cuts lineage, and a lost executor costs only the tasks that it ran: the
    committed files do not change when a later task is repeated.
    """
    return stored(df, what, by)[0]


#: What the scratch() blocks that are open have to remove.
_OPEN: list[set[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Tables that are stored inside are removed at the end, but for those taken out of the set that this gives."""
    made: set[str] = set()
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table that written() made in this application, once results are stored elsewhere."""
    remove(spark, scratch_dir(spark))


#: How much larger a table is in memory than its Parquet files, for Spark's choice of joins: columns of few
#: values take next to nothing on disk, and by that size tables of millions of rows went through the driver.
UNPACKED = "spark.sql.sources.fileCompressionFactor", 100.0


#: Up to how many bytes a side of a join is broadcast, be they guessed or seen at run time. Each broadcast goes through the driver, an
#: operator of many rounds has some hundred joins, and what is guessed of a union or a semi-join can be a quarter of what comes.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "512k"


def honest_sizes(spark: SparkSession) -> None:
    """Lets Spark take files for UNPACKED times their size and broadcast up to BROADCAST, where the session says nothing of its own."""
    name, factor = UNPACKED
    if float(spark.conf.get(name, "1.0")) == 1.0:
        spark.conf.set(name, str(factor))
    name, most = BROADCAST
    if spark.conf.get(name) == "10485760b":
        spark.conf.set(name, most)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a stored round of an operator."""
    honest_sizes(df.sparkSession)
    return written(df, "round")


def in_order(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with its rows counted from 0 in the order of `by`, in a column `name`.

    Ranges are sorted apart and stored once, so the numbers stay when tasks are repeated; the
    driver sees a count a range.
    """
    from pyspark.sql import functions as F

    rows = written(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [sum(counts.get(p, 0) for p in range(q)) for q in range(max(counts, default=0) + 1)]
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (part + 1).cast("int"))
    return rows.withColumn(name, offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
