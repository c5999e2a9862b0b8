"""Near duplicates: fast similarity sketching, banding, exact verification.

1. Each text becomes the set of its distinct word shingles and a sketch of it. Texts
   with the same set are one class, represented by the smallest id; only
   representatives go on.
2. Representatives that share a band of their sketches meet in a bucket. Each member is
   compared with its bucket's first one, by a join; the components of the pairs that
   could reach the wanted similarity are labels. Where a bucket's members have several
   labels, members of different ones are compared with each other, and a spanning forest
   of the pairs found is kept: at most one row a member, never all pairs. Its components
   are regions; no link leads out of one, but for a chance of about 1e-7 that a linked
   pair shares no band and of 1e-9 that its sketches look too different.
3. In a region the full sets are fetched. All members are checked against the region's
   first one; where some fail, those are compared with the others as before, on full
   sets, so no link is lost to the choice of a first member.
4. Components of the confirmed links give each document its class.

A large group of near copies is thus joined with its first member, which any number of
tasks can share; what differs from it meets the others part by part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from factgraph.llm.common import free_name, numbered, own_ids, partitions, table, with_own_ids, written
from factgraph.llm.components import connected_components
from factgraph.llm.sketch import bands, shingles, similar_enough, sketch
from factgraph.llm.words import Powers

#: Coordinates of a sketch, and how many make a band.
COORDINATES, ROWS = 128, 4
#: Bytes and rows of one kind that meet in a task before a bucket or region is cut into parts.
PART_BYTES, PART_ROWS = 24_000_000, 1000


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set, marks, bands): set names the shingle set, marks is a byte a coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                n, name, marks, keys = [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingles(text, k, powers)
                    n.append(len(s))
                    name.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                    c = sketch(s, COORDINATES) if len(s) else None
                    marks.append(c.astype(np.uint8).tobytes() if len(s) else None)
                    keys.append(bands(c, ROWS).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n", "set", "marks", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, set binary, marks binary, bands array<long>")


def in_parts(rows: DataFrame, key: str, bytes_col: str, groups: int) -> DataFrame:
    """Adds g, i, j: rows of a key meet in one task, or, if they are too many, part by part.

    rows have `main`: members that are known to be joined to each other. Keys are dealt
    to `groups` tasks. Members that aren't main are cut into parts of about PART_BYTES
    and PART_ROWS, and main ones into parts of as many rows as there are others, but
    neither more than PART_ROWS nor less than an eighth of it, so the copies of the others
    are about as many as the main ones. Each part of the others meets every part, parts
    of main members don't meet each other. Keys with main members alone have no rows.
    """
    main = F.col("main")
    parts = lambda own, most: F.greatest(
        F.ceil(F.sum(F.when(own, F.col(bytes_col))) / F.lit(PART_BYTES)), F.ceil(F.count_if(own) / most), F.lit(0)
    ).cast("int")
    few = F.greatest(F.least(F.count_if(~main), F.lit(PART_ROWS)), F.lit(-(-PART_ROWS // 8)))
    sizes = rows.groupBy(key).agg(F.sum(bytes_col).alias("_bytes"), parts(~main, F.lit(PART_ROWS)).alias("_rest"), parts(main, few).alias("_main")).filter("_rest > 0")
    sizes = written(sizes, "part-sizes")  # so that the join below is of two plain shuffles, which Spark can split
    groups = max(groups, int((sizes.agg(F.sum("_bytes")).first()[0] or 0) // (PART_BYTES // 2)) + 1)
    dealt = rows.join(sizes.drop("_bytes"), key)
    draw = F.pmod(F.xxhash64("id"), F.when(main, F.col("_main")).otherwise(F.col("_rest"))).cast("int")
    own = F.when(main, F.col("_rest") + draw).otherwise(draw)
    # a single part of the rest meets itself wherever it meets another one
    first = F.when(main | (F.col("_rest") > 1) | (F.col("_main") == 0), 0).otherwise(1)
    last = F.when(main, F.col("_rest") - 1).otherwise(F.col("_rest") + F.col("_main") - 1)
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(first, last)))
    return dealt.select(
        *rows.columns,
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("g"),
        F.least("_own", "_other").alias("i"),
        F.greatest("_own", "_other").alias("j"),
    )


def spanning(labels: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that join members of different labels as far as they are linked; alike(x, others) flags those linked with x.

    Members of the commonest label wait for the others. Each of these is compared with
    what isn't joined to it yet, so a group that hangs together takes one comparison a
    member, and one in which only a few differ little more.
    """
    joined, n = np.unique(labels, return_inverse=True, return_counts=True)[1:]
    out, open_, most = [], np.ones(len(labels), bool), int(n.argmax())
    left = len(n)
    for x in np.flatnonzero(joined != most).tolist():
        if left < 2:
            break
        open_[x] = False  # those before x were compared with it, or are joined to it
        rest = np.flatnonzero(open_ & (joined != joined[x]))
        if not len(rest):
            continue
        hit = rest[alike(x, rest)]
        if len(hit):
            found, at = np.unique(joined[hit], return_index=True)
            out += [(x, y) for y in hit[at].tolist()]
            joined[np.isin(joined, found)] = joined[x]
            left -= len(found)
    return out


def split_by(keys: np.ndarray) -> list[np.ndarray]:
    """Places of each key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else []
    return [x for x in np.split(order, cut[1:]) if len(x) > 1] if len(keys) else []


def alike_to_first(buckets: DataFrame, least: int, kind: str) -> DataFrame:
    """(a, b): members of buckets (bucket, id, marks) whose sketch shares at least `least` coordinates with the bucket's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, first = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                near = batch.filter(pa.array((own == first).sum(1) >= least))
                yield pa.RecordBatch.from_arrays([near.column(0), near.column(1)], names=["a", "b"])

    first = buckets.groupBy("bucket").agg(F.min(F.struct("id", "marks")).alias("f")).select("bucket", F.col("f.id").alias("a"), F.col("f.marks").alias("first"))
    first = written(first, "first-members")  # both sides of the join are plain shuffles, whose large partitions Spark can split
    return buckets.join(first, "bucket").filter("id != a").select("a", "id", "marks", "first").mapInArrow(run, f"a {kind}, b {kind}")


def sketch_forest(buckets: DataFrame, least: int, kind: str, groups: int) -> DataFrame:
    """(a, b) of buckets (bucket, id, marks, label, main): pairs of different labels whose sketches share at least `least` coordinates."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks()
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        labels = np.unique(np.array(group.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        left, right = [], []
        for p in split_by(group.column("bucket").to_numpy()):
            own = marks[p]
            for x, y in spanning(labels[p], lambda x, rest: (own[rest] == own[x]).sum(1) >= least):
                left.append(int(p[x]))
                right.append(int(p[y]))
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    rows = in_parts(buckets.withColumn("_size", F.lit(COORDINATES + 16)), "bucket", "_size", groups)
    found = rows.select("g", "i", "j", "bucket", "id", "marks", "label").groupBy("g", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def regions_of(buckets: DataFrame, least: int, kind: str, groups: int) -> DataFrame:
    """(id, region) of the members of buckets (bucket, id, marks) that may be linked with another one."""
    links = written(alike_to_first(buckets, least, kind), "alike")
    labels = written(connected_components(links), "labels")
    labelled = buckets.join(labels.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = written(labelled, "labelled")
    # of two members the join has said all; so it has where all are joined by now
    several = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    several = written(several.filter("n > 2 AND low != high").select("bucket", "low"), "open-buckets")
    rest = labelled.join(several, "bucket").withColumn("main", F.col("label") == F.col("low")).drop("low")
    more = written(sketch_forest(rest, least, kind, groups), "forest")
    if more.isEmpty():
        return labels.select("id", F.col("component").alias("region"))
    stars = labels.select(F.col("component").alias("a"), F.col("id").alias("b"))
    return connected_components(stars.unionByName(more)).select("id", F.col("component").alias("region"))


def shingle_sets(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """(id, region, sizes, shingles): the full sets, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                sets = [shingles(t, k, powers).tobytes() for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("region"), pa.array(sets, pa.binary())], names=["id", "region", "shingles"])

    return docs.select("id", "region", "text").mapInArrow(run, f"id {kind}, region {kind}, shingles binary")


def first_links(sets: DataFrame, percent: int) -> DataFrame:
    """(id, region, linked): whether a member is linked with its region's first one."""
    first = sets.filter("id = region").select("region", F.col("shingles").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("shingles").to_pylist(), batch.column("first").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("region"), pa.array(linked, pa.bool_())], names=["id", "region", "linked"])

    kind = sets.schema["id"].dataType.simpleString()
    joined = sets.filter("id != region").join(first, "region").select("id", "region", "shingles", "first")
    return joined.mapInArrow(run, f"id {kind}, region {kind}, linked boolean")


def full_forest(sets: DataFrame, percent: int, kind: str, groups: int) -> DataFrame:
    """(a, b) of sets (region, id, shingles, label, main): a spanning forest of the exact links between different labels."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks()
        blobs = group.column("shingles").to_pylist()
        left, right = [], []
        regions, labels = (np.unique(np.array(group.column(c).to_pylist(), dtype=object), return_inverse=True)[1] for c in ("region", "label"))
        for p in split_by(regions):
            members = [np.frombuffer(blobs[i], np.uint64) for i in p]
            size = np.array([len(m) for m in members], np.int64)
            names = np.unique(np.concatenate(members), return_inverse=True)[1].astype(np.int32)
            begin = np.cumsum(size) - size
            mask = np.zeros(int(names.max()) + 1, np.int32)

            def alike(x: int, rest: np.ndarray) -> np.ndarray:
                own = names[begin[x] : begin[x] + size[x]]
                # only sizes that can be similar enough, and only as many at once as stay small
                can = (100 * size[rest] >= percent * size[x]) & (100 * size[x] >= percent * size[rest])
                out, near = np.zeros(len(rest), bool), rest[can]
                if not len(near):
                    return out
                mask[own] = 1
                both = np.empty(len(near), np.int64)
                for low in range(0, len(near), 256):
                    some = near[low : low + 256]
                    ends = np.cumsum(size[some])
                    where = np.repeat(begin[some] - ends + size[some], size[some]) + np.arange(ends[-1])
                    both[low : low + 256] = np.add.reduceat(mask[names[where]], ends - size[some])
                mask[own] = 0
                out[can] = 100 * both >= percent * (size[x] + size[near] - both)
                return out

            for x, y in spanning(labels[p], alike):
                left.append(int(p[x]))
                right.append(int(p[y]))
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    rows = in_parts(sets.withColumn("_size", F.octet_length("shingles")), "region", "_size", groups)
    return rows.select("g", "i", "j", "region", "id", "shingles", "label").groupBy("g", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n_shingles, component) for each row of docs (id, text), whose ids are unique and not null."""
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    groups = max(1, 2 * partitions(spark))
    all_rows = written(sketches(docs, k, "id", "text"), "sketches")
    # one member for each distinct set: the smallest id, with its bands
    chosen = all_rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"))
    own = all_rows.join(chosen.select("id"), "id", "left_semi").select("id", "marks", "bands")
    # sketches travel only to buckets with several members
    own = written(own, "representatives")
    keyed = own.select("id", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = written(keyed.join(shared, "bucket").join(own.select("id", "marks"), "id"), "buckets")
    regions = written(regions_of(buckets, similar_enough(COORDINATES, percent / 100), kind, groups), "regions")
    sets = written(shingle_sets(docs.join(regions, "id"), k, kind), "sets")
    first = written(first_links(sets, percent), "first-links")
    open_regions = first.groupBy("region").agg(F.bool_and("linked").alias("done")).filter("NOT done").select("region")
    linked = F.coalesce("linked", F.col("id") == F.col("region"))  # the first one is joined to itself
    rest = sets.join(open_regions, "region", "left_semi").join(first.select("id", "linked"), "id", "left")
    rest = rest.withColumn("main", linked).withColumn("label", F.when(linked, F.col("region")).otherwise(F.col("id"))).drop("linked")
    links = first.filter("linked").select(F.col("region").alias("a"), F.col("id").alias("b")).union(full_forest(rest, percent, kind, groups))
    found = written(connected_components(links), "components")
    class_of = chosen.join(found, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    return all_rows.select("id", "n", "set").join(class_of, "set", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are split at space and \\t to \\r, A to Z in lower case; a set is the distinct
    runs of k words, or the whole text if it has fewer. Documents are linked when
    100 * |intersection| >= percent * |union|; component_id is the smallest id that
    links reach, and kept marks the rows that have it. A text without words (null
    too) is linked with nothing. Rows that share an id are documents of their own: each
    has the class of its text. Rows without an id are documents too, after all others;
    their component_id is null only if links reach no row with an id. Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text"))
    if own_ids(rows, "name"):
        found = classes(rows.select(F.col("name").alias("id"), "text"), k, percent).withColumn("name", F.col("id"))
    else:
        rows = numbered(rows, "name", "text", "id")
        names = rows.select("id", "name")
        found = classes(rows.select("id", "text"), k, percent).join(names, "id").join(
            names.select(F.col("id").alias("component"), F.col("name").alias("first")), "component"
        )
        found = found.withColumn("component", F.col("first"))
    return found.select(
        F.col("name").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("name")).alias("kept")
    )


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, with the columns they came with.

    That with the smallest id stays, null ids last. Rows are told apart by themselves:
    ids can be null, and be repeated with the same text or others. Texts without words,
    null ones too, belong to no class and stay. Columns of any name are kept as they
    are; an empty table gives no rows.
    """
    row = free_name(docs, "_row")
    rows = with_own_ids(docs, id_col, text_col, row)
    found = classes(rows.select(F.col(row).alias("id"), F.col(text_col).alias("text")), k, percent)
    drop = found.filter("id != component").select(F.col("id").alias(row))
    return rows.join(drop.hint("merge"), row, "left_anti").select(*docs.columns)  # the same way at every size


def op7_fast_sketch_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, ' | ' ORDER BY g)) AS h FROM s GROUP BY doc_id),
m AS (SELECT h, min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY h),
u AS (SELECT s.* FROM s JOIN m USING (doc_id)),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN m x ON a = x.doc_id JOIN m y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, low) AS (SELECT doc_id, doc_id FROM m UNION SELECT e.b, low FROM r JOIN e ON id = e.a),
k AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.low, d.doc_id) AS component_id, coalesce(k.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON n.h = m.h LEFT JOIN k ON m.doc_id = k.id
"""
