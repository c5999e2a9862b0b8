import datetime as dt
import os

from pyspark.sql import functions as F

from factgraph.streaming import feed
from factgraph.streaming.settle import settled, state_store
from factgraph.streaming.table import ChangedTable, keep_up_to_date
from tests.conftest import rows


def changes(spark, *given):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, t, day, i) for i, (p, t) in enumerate(given)], feed.FEED)


def test_upsert_replaces_known_paths_only(spark):
    docs = spark.createDataFrame([("P", "a", "old"), ("Q", "b", "old")], "project string, file_path string, text string")
    c = changes(spark, ("a", "1"), ("a", "2"), ("new", "x"))
    assert rows(feed.upsert(docs, c)) == [("P", "a", "2"), ("Q", "b", "old")]
    assert rows(feed.affected_projects(docs, c)) == [("P",)]


def documents(spark, n, text="old"):
    return spark.createDataFrame([(f"P{i % 3}", f"f{i}", f"{text} {i}" * 50) for i in range(n)], "project string, file_path string, text string")


def parquet_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def now(table):
    return {r.file_path: r.text for r in table.read().collect()}


def test_a_stream_adds_deltas(spark, tmp_path):
    made = ChangedTable.create(documents(spark, 2000), f"{tmp_path}/t", 8)
    base, want = parquet_bytes(f"{tmp_path}/t/base"), now(made)
    for i, batch in enumerate(([("f1", "1"), ("f2", "2"), ("f1", "3")], [("f1", None), ("nobody", "x")], [("f7", "7")])):
        changes(spark, *batch).withColumn("seq", F.col("seq") + 10 * i).write.mode("append").parquet(f"{tmp_path}/feed")
        keep_up_to_date(feed.read_feed(spark, f"{tmp_path}/feed"), made, f"{tmp_path}/checkpoint", fold_every=99).awaitTermination(60)
    want |= {"f1": None, "f2": "2", "f7": "7"}
    assert now(made) == want and made.read().columns == ["project", "file_path", "text"]
    assert parquet_bytes(f"{tmp_path}/t/base") == base and parquet_bytes(f"{tmp_path}/t/delta/batch=1") < base / 4


def test_a_fold_rewrites_what_changed(spark, tmp_path):
    made = ChangedTable.create(documents(spark, 500), f"{tmp_path}/t", 8)
    want = now(made)
    made.apply(changes(spark, ("f1", "a"), ("f2", "b")), 0)
    made.apply(changes(spark, ("f1", "c")), 1)
    touched = made.fold(1)
    assert 1 <= len(touched) <= 2 and {n for n in os.listdir(f"{tmp_path}/t/base/version=1") if n.startswith("bucket")} == {f"bucket={b}" for b in touched}
    want |= {"f1": "c", "f2": "b"}
    assert now(made) == want and made.fold(1) == []
    # a batch that comes again, before and after its fold, changes nothing
    made.apply(changes(spark, ("f1", "c")), 1)
    assert now(made) == want
    made.apply(changes(spark, ("f3", "d")), 2)
    made.apply(changes(spark, ("f3", "d")), 2)
    want["f3"] = "d"
    assert now(made) == want
    # a fold that broke off before it pointed at its version isn't seen, and the next one takes its place
    made._store(made._merged(made.manifest()[1]).withColumn("text", F.lit("half")), f"{tmp_path}/t/base/version=2", 8)
    assert now(made) == want
    made.fold(2)
    made.vacuum()
    assert now(made) == want and os.listdir(f"{tmp_path}/t/manifest") == ["number=2"]
    assert made.deltas(made.manifest()[1]).count() == 0 and made.read().count() == 500


def settle(spark, tmp_path, *batches):
    day = dt.datetime(2024, 1, 1)
    for i, batch in enumerate(batches):
        rows = [(p, f"{p}{n}", day + dt.timedelta(seconds=s), n) for p, s, n in batch]
        spark.createDataFrame(rows, feed.FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        with state_store(spark):
            out = settled(feed.read_feed(spark, f"{tmp_path}/feed"), "10 seconds")
            out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    return rows_of(spark.read.schema(feed.FEED).parquet(f"{tmp_path}/out"))


def rows_of(df):
    return sorted((r.path, r.text, r.changed.second + 60 * r.changed.minute, r.seq) for r in df.collect())


def test_bursts_settle_across_batches(spark, tmp_path):
    """Each burst gives its last change once; what was delivered before is dropped; what may go on is held."""
    found = settle(spark, tmp_path, [("a", 0, 1), ("a", 5, 2), ("b", 3, 1)], [("a", 5, 2), ("a", 12, 3), ("b", 4, 1), ("c", 40, 1)], [("a", 41, 3), ("a", 60, 4), ("c", 45, 2), ("c", 45, 2)])
    assert found == [("a", "a3", 12, 3), ("b", "b1", 3, 1), ("c", "c2", 45, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_windows_drop_late_rows(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "x"), (dt.datetime(2024, 1, 1, 0, 6), "x"), (dt.datetime(2024, 1, 1, 1, 0), "x")], "ts timestamp, k string")
    assert [r.n for r in feed.windowed_counts(e, "ts", "k").orderBy("window_start").collect()] == [2, 1]
