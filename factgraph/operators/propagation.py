"""Labels that go round a graph in blocks of nodes: what never changes stays where it is, and a round sends labels alone.

Nodes are dealt to blocks by their number. A bucketed table holds a row a node with its
neighbours; these are no ids, but places (slots) among the labels that the block is sent. It also says for each
pair of blocks which labels go from one to the other. Both blocks know these in the same order,
as each edge lies on both sides, so a round shuffles one number for each node and each block that has
neighbours of it, and no task has more than a block. Within a block numpy adds up the weights of a node's labels.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.sources.scratch import remove, shuffles_dropped, stored

#: Neighbours (an edge has two) that a block has at most on average, and at least where there are fewer than _BLOCKS blocks.
_MOST, _LEAST, _BLOCKS = 2_000_000, 100_000, 64


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all lists of a column, one after the other."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, "int64")])


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.value_lengths().to_numpy(zero_copy_only=False), "int64") for c in column.chunks] or [np.zeros(0, "int64")])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def heaviest(node: np.ndarray, label: np.ndarray, weight: np.ndarray, by_label: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): of each node the label with the greatest sum of weights; ties to the least label, or else to the one that stands first. A node's rows lie together, in order of nodes."""
    if not len(node):
        return node, label
    names, rank = np.unique(label, return_inverse=True) if label.max() >= 1 << 31 or label.min() < 0 else (None, label)
    key = node.astype("int64") << 32 | rank.astype("int64")
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total, key = np.add.reduceat(weight[order], begin), key[begin]
    of = key >> 32
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    best = total == np.repeat(np.maximum.reduceat(total, new), np.diff(np.concatenate([new, [len(of)]])))
    if by_label:  # keys are in the order of labels
        at = np.flatnonzero(best)
    else:
        first = np.where(best, np.minimum.reduceat(order, begin), np.iinfo("int64").max)
        at = np.flatnonzero(first == np.repeat(np.minimum.reduceat(first, new), np.diff(np.concatenate([new, [len(of)]]))))
    at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
    found = key[at] & 0xFFFFFFFF
    return of[at], found if names is None else names[found]


def laid_out(table: pa.Table, blocks: int) -> pa.Table:
    """The rows of one block (block, id, others, weights, before) as the bucketed table has them: others as slots, and what goes from the block to which."""
    ids = table.column("id").to_numpy()
    table, ids = table.take(np.argsort(ids)), np.sort(ids)
    others, counts = flat(table.column("others")), lengths(table.column("others"))
    met, slot = np.unique(others, return_inverse=True)
    node = np.repeat(np.arange(len(ids)), counts)
    weights, before = table.column("weights"), table.column("before")
    if weights.null_count:  # neighbours stand there as often as they are met
        pairs, times = np.unique(node << 32 | slot, return_counts=True)
        node, slot = pairs >> 32, pairs & 0xFFFFFFFF
        counts, others = np.bincount(node, minlength=len(ids)), met[slot]
        weights, before = (pa.chunked_array([lists(x, counts, column.type.value_type)]) for x, column in ((times, weights), (others < ids[node], before)))
    place = np.empty(len(met), "int64")
    place[np.argsort(met % blocks, kind="stable")] = np.arange(len(met))  # block by block, there by number
    sent = np.unique((others % blocks) * len(ids) + node)
    to, many = np.unique(sent // len(ids), return_counts=True)
    n, m, block = len(ids), len(to), table.column("block")[0].as_py()
    return pa.table({
        "block": pa.array(np.full(n + m, block), pa.int32()),
        "id": pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(m, pa.int64())]),
        "slots": pa.concat_arrays([lists(place[slot], counts, pa.int32()), pa.nulls(m, pa.list_(pa.int32()))]),
        "weights": pa.chunked_array([*weights.chunks, pa.nulls(m, weights.type)]),
        "before": pa.chunked_array([*before.chunks, pa.nulls(m, before.type)]),
        "to": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(to, pa.int32())]),
        "at": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists(sent % len(ids), many, pa.int32())]),
    })


def received(near: pa.Table, sent: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of a block: its rows in order, what it has itself, what its slots hold, and of each neighbour the place of its node and the slot."""
    near = near.take(np.argsort(near.column("id").to_numpy()))
    sent = sent.take(np.argsort(sent.column("source").to_numpy()))  # -1, the block itself, is first
    what = [n for n in ("label", "last", "moved") if n in sent.column_names]
    own, others = sent.slice(0, 1), sent.slice(1)
    counts = lengths(near.column("slots"))
    pick = lambda rows: {n: flat(rows.column(n)) for n in what}
    return near, pick(own), pick(others), np.repeat(np.arange(len(counts)), counts), flat(near.column("slots"))


def _neighbours(edges: DataFrame, in_place: bool) -> DataFrame:
    """(id, others, weights) of edges, each of which counts both ways."""
    counted = F.sum("weight") if "weight" in edges.columns else F.count("*")
    more = [c for c in ("weight", "met") if c in edges.columns and (in_place or c != "met")]
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    end = lambda a, b, out: F.struct(a.alias("id"), b.alias("other"), *([F.lit(out).alias("out")] if in_place and "met" not in more else []))
    kept = edges.filter("src IS NOT NULL AND dst IS NOT NULL" if in_place else "src != dst")
    # a node's rows go to one task before all aggregates: there is next to nothing to add up before
    both = kept.select(*more, F.inline(F.array(end(src, dst, True), end(dst, src, False)))).repartition("id")
    if not in_place:
        rows = both.groupBy("id", "other").agg(counted.alias("weight")).groupBy("id").agg(F.collect_list(F.struct("other", "weight")).alias("r"))
    else:
        a, b = F.when(F.col("out"), F.col("id")).otherwise(F.col("other")), F.when(F.col("out"), F.col("other")).otherwise(F.col("id"))
        met = "met" if "met" in more else F.struct(a.alias("a"), b.alias("b"))
        both = both.groupBy("id", "other").agg(counted.alias("weight"), F.min(met).alias("met"))
        rows = both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("met", "other", "weight"))).alias("r"))
    return rows.select("id", F.col("r.other").alias("others"), F.col("r.weight").alias("weights"))


def _members(groups: DataFrame) -> DataFrame:
    """(id, others, weights) of members: others as often as they are met, weights null. A row a member goes to its task, not one a pair."""
    each = groups.select(F.col("members").cast("array<long>").alias("members")).select("members", F.explode("members").alias("id")).filter("id IS NOT NULL")
    others = F.filter("members", lambda x: x != F.col("id"))
    rows = each.select("id", others.alias("others")).filter("size(others) > 0").repartition("id").groupBy("id").agg(F.flatten(F.collect_list("others")).alias("others"))
    return rows.withColumn("weights", F.lit(None).cast("array<int>"))


class Blocks:
    """A graph of numbers in blocks, until drop(). edges: src, dst, maybe weight (else 1 a row) and met (the place where an edge is met).

    Edges count both ways and weights of repeated ones add up. in_place: a node's neighbours are held in the order of met, without
    one by src and dst, with loops; else there is no order, and no loops. Instead of src and dst there can be members, an
    array of different numbers, each of which has an edge to each larger one.
    """

    def __init__(self, edges: DataFrame, in_place: bool):
        self.spark, self.in_place, self.name = edges.sparkSession, in_place, f"around_{uuid.uuid4().hex}"
        rows, path = stored(_members(edges) if "members" in edges.columns else _neighbours(edges, in_place), "around")
        said = rows.agg(
            F.sum(F.size("others")).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.array_max("weights")).alias("most"), F.min(F.array_min("weights")).alias("least")
        ).first()
        n = self.blocks = max((said.n or 0) // _MOST, min((said.n or 0) // _LEAST, _BLOCKS), 1)
        small = lambda low, high: "int" if low is not None and -(2**31) <= low and high < 2**31 else "bigint"
        self.kind = small(said.low, said.high)
        weight = rows.schema["weights"].dataType.elementType.simpleString()
        weight = small(said.least, said.most) if weight == "bigint" else weight
        weights = F.col("weights").cast(f"array<{weight}>").alias("weights")
        before = F.when(F.col("weights").isNotNull(), F.transform("others", lambda x: x < F.col("id"))) if in_place else F.lit(None).cast("array<boolean>")
        rows = rows.select(self.block().alias("block"), "id", F.col("others").cast(f"array<{self.kind}>").alias("others"), weights, before.alias("before"))
        held = rows.repartition(n, "block").groupBy("block").applyInArrow(
            lambda table: laid_out(table, n), f"block int, id long, slots array<int>, weights array<{weight}>, before array<boolean>, to int, at array<int>"
        )
        with shuffles_dropped(self.spark):
            held.write.format("parquet").option("compression", "zstd").bucketBy(n, "block").saveAsTable(self.name)
        remove(self.spark, path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def block(self) -> Column:
        return F.pmod("id", F.lit(self.blocks)).cast("int")

    @property
    def near(self) -> DataFrame:
        return self.spark.table(self.name).filter("id IS NOT NULL").select("block", "id", "slots", "weights", *(["before"] if self.in_place else []))

    def start(self) -> DataFrame:
        """Each node with its own number for a label: (id, label)."""
        return self.spark.table(self.name).filter("id IS NOT NULL").select("id", F.col("id").alias("label"))

    def sent(self, state: DataFrame) -> DataFrame:
        """What each block gets: a row from each block that has neighbours of its nodes, and one (source -1) from itself. state: id, label, maybe last and moved."""
        what = [c for c in ("label", "last", "moved") if c in state.columns]
        held = state.groupBy(self.block().alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", *what))).alias("r"))
        held = held.select("block", *[F.col(f"r.{c}").cast("array<boolean>" if c == "moved" else f"array<{self.kind}>").alias(c) for c in what])
        sends = self.spark.table(self.name).filter("to IS NOT NULL").select("block", "to", "at")
        picked = lambda c: F.transform("at", lambda x: F.get(c, x)).alias(c)
        across = sends.join(held.hint("shuffle_hash"), "block").select(F.col("to").alias("block"), F.col("block").alias("source"), *map(picked, what))
        return across.unionByName(held.select("block", F.lit(-1).alias("source"), *what))

    def together(self, state: DataFrame, found, schema: str) -> DataFrame:
        """found(rows of a block, what it gets), block by block."""
        return self.near.groupBy("block").cogroup(self.sent(state).groupBy("block")).applyInArrow(found, schema)

    def sync_round(self, state: DataFrame) -> DataFrame:
        """state (id, label) after a round in which all nodes take the heaviest label around them at once; moved: whether it is another one."""

        def found(near: pa.Table, sent: pa.Table) -> pa.Table:
            near, own, others, node, slot = received(near, sent)
            of, best = heaviest(node, others["label"][slot], flat(near.column("weights")), True)
            label = own["label"].astype("int64")
            label[of] = best
            return pa.table({"id": near.column("id"), "label": label, "moved": label != own["label"]})

        return self.together(state, found, "id long, label long, moved boolean")

    def pass_in_place(self, state: DataFrame, beside: str) -> DataFrame:
        """state (id, last, label, moved) after a pass in which nodes next to a moved one choose again, as if those before them kept what they have.

        Those after a node, and itself, count with what they had after the last round. beside: which of a node's neighbours
        have to have moved, those `before` it, those `after` it or `any`.
        """

        def found(near: pa.Table, sent: pa.Table) -> pa.Table:
            near, own, others, node, slot = received(near, sent)
            before = flat(near.column("before")).astype(bool)
            asked = np.zeros(len(own["label"]), bool)
            asked[node[others["moved"][slot].astype(bool) & ((beside == "any") | (before == (beside == "before")))]] = True
            take = asked[node]
            node, slot, before = node[take], slot[take], before[take]
            of, best = heaviest(node, np.where(before, others["label"][slot], others["last"][slot]), flat(near.column("weights"))[take], False)
            label = own["label"].astype("int64")
            label[of] = best
            return pa.table({"id": near.column("id"), "last": own["last"].astype("int64"), "label": label, "moved": label != own["label"]})

        return self.together(state, found, "id long, last long, label long, moved boolean")

    def inside(self, state: DataFrame) -> DataFrame:
        """(label, total, intra): how many neighbours the nodes of a label have, and how many of these have the label too."""

        def found(near: pa.Table, sent: pa.Table) -> pa.Table:
            near, own, others, node, slot = received(near, sent)
            names, at = np.unique(own["label"][node], return_inverse=True)
            same = np.bincount(at, others["label"][slot] == own["label"][node], len(names))
            return pa.table({"label": names.astype("int64"), "total": np.bincount(at, minlength=len(names)).astype("int64"), "intra": same.astype("int64")})

        return self.together(state, found, "label long, total long, intra long").groupBy("label").agg(F.sum("total").alias("total"), F.sum("intra").alias("intra"))
