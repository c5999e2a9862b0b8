"""Benchmark decontamination by q-gram lemma filtering.

An item of L characters that stands in a text with at most e edits shares at least
L - q + 1 - q e of its q-grams with that place, and all of them on diagonals (place in
the text minus place in the item) that differ by at most e. Shared q-grams are counted
in diagonal bands of width 2 (e + 1) that overlap by half, so one band has them all;
bands that meet the bound are verified by banded alignment with free ends in the text.
For short items that may have edits the bound can be nothing; they have shorter q-grams.
Documents are scanned in place, without a shuffle. The items are a stated set of queries
that all rows are held against: they go to the workers in blocks of a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from factgraph.llm.common import table, written

#: Characters of items that the driver holds and the workers get at once; each takes some 40 bytes there.
BLOCK_CHARS = 2_000_000
#: log2 of the places of the table that q-grams are looked up in first.
FILTER_BITS = 22

_GAP = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9FB21C651E98DF25)


def plain(text: str | None) -> str:
    """Lower case; each run of what is neither letter nor digit is one space; trimmed."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram, built from those of half the length."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        have = {1: points.astype(np.uint64) + np.uint64(1)}
        size = 1
        while 2 * size <= q:
            h = have[size]
            have[2 * size] = h[:-size] * _power(size) + h[size:]
            size *= 2
        out, done = have[size], size
        while done < q:
            step = max(s for s in have if s <= q - done)
            n = len(points) - done - step + 1
            out = out[:n] * _power(step) + have[step][done : done + n]
            done += step
        return out * np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Grams:
    """The g-grams of some items, and where they stand, ready to be looked up."""

    def __init__(self, g: int, items: np.ndarray, texts: list[str]):
        grams = [gram_hashes(code_points(texts[i]), g) for i in items.tolist()]
        item = np.repeat(items, [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        self.g, (self.grams, self.first, self.count) = g, np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[slots(self.grams)] = True


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Items:
    """q-grams of a block of items, ready to be looked up.

    rate: edits allowed as a share of an item's characters. Where the lemma asks for no
    shared q-gram at that many edits, the item is looked up by the longest shorter grams
    for which it does, size / (edits + 1).
    """

    def __init__(self, ids: list, texts: list[str], q: int, rate: float):
        self.ids, self.texts = ids, [plain(t) for t in texts]
        size = np.array([len(t) for t in self.texts], np.int64)
        #: items without q-grams, by the number of their words: plain form -> items
        self.short: dict[int, dict[str, list[int]]] = {}
        for i in np.flatnonzero((size > 0) & (size < q)).tolist():
            self.short.setdefault(self.texts[i].count(" ") + 1, {}).setdefault(self.texts[i], []).append(i)
        self.edits = np.maximum(0, np.minimum((size * rate).astype(np.int64), size - 1))
        gram = np.where(size < q, 0, np.minimum(q, size // (self.edits + 1)))
        self.least = np.maximum(1, size - gram + 1 - gram * self.edits)
        #: one table for each length of grams; as plain values, for workers that don't have this module
        self.tables = [vars(Grams(int(g), np.flatnonzero(gram == g), self.texts)) for g in np.unique(gram[gram > 0])]

    def candidates(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that meet the bound."""
        return [found for table in self.tables for found in self.candidates_of(table, points)]

    def candidates_of(self, table: dict, points: np.ndarray) -> list[tuple[int, int]]:
        grams = gram_hashes(points, table["g"])
        at = np.flatnonzero(table["filter"][slots(grams)])
        found = np.searchsorted(table["grams"], grams[at])
        found[found == len(table["grams"])] = 0
        hit = table["grams"][found] == grams[at]
        at, found = at[hit], found[hit]
        n = table["count"][found]
        where = np.repeat(table["first"][found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = table["item"][where], np.repeat(at, n) - table["place"][where]
        width = self.edits[item] + 1
        band = diagonal // width
        # shifted to be positive: a band of a text starts at its item's length before it
        key = item.astype(np.int64) << 40 | (band + (1 << 32))
        keys, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item, band = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 32)
        enough = counts >= self.least[item]
        return list(zip(item[enough].tolist(), (band * (self.edits[item] + 1))[enough].tolist()))

    def verify(self, item: int, low: int, text: str, points: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best place on the band's diagonals, within its budget."""
        e, wanted = int(self.edits[item]), self.texts[item]
        begin, stop = max(0, low - e), low + 2 * (e + 1) + len(wanted) + e
        exact = text.find(wanted, begin, max(0, stop))
        if exact >= 0:
            return 0, exact, exact + len(wanted)
        return aligned(code_points(wanted), points, low - e, 2 * (e + 1) + 2 * e, e)


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Banded alignment: the whole item against text, ends of the text free.

    Column d of row i stands for text place low + d + i. Returns (edits, start, end) with
    the fewest edits, or None if they exceed the budget.
    """
    place = low + np.arange(width)
    far = np.int64(1 << 30)
    cost = np.where((place >= 0) & (place <= len(text)), 0, far).astype(np.int64)
    start = place.copy()
    step = np.arange(width, dtype=np.int64)
    for i, c in enumerate(item.tolist()):
        at = place + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        keep = np.where(inside, cost + ~same, far)
        skip = np.r_[cost[1:] + 1, far]  # the item's character is missing in the text
        best = np.minimum(keep, skip)
        origin = np.where(keep <= skip, start, np.r_[start[1:], 0])
        # characters of the text that the item lacks: a running minimum along the row
        slack = best - step
        low_so_far = np.minimum.accumulate(slack)
        new = np.where(slack == low_so_far, step, 0)
        source = np.maximum.accumulate(new)
        cost, start = low_so_far + step, origin[source]
        cost = np.where((place + i + 1 >= 0) & (place + i + 1 <= len(text)), cost, far)
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    return int(cost[d]), int(start[d]), int(place[d] + len(item))


def matches(texts: list[str], items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (edits, start, end) of the best place; texts in plain form."""
    whole = "\x00".join(texts)  # q-grams across texts match nothing
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    points = code_points(whole)
    for item, low in items.candidates(points):
        e, wanted = int(items.edits[item]), len(items.texts[item])
        # each text that the band crosses is aligned by itself: an item can be cut off at its ends
        first = max(0, int(np.searchsorted(starts, low - e, "right")) - 1)
        last = int(np.searchsorted(starts, low + 2 * (e + 1) + wanted + e, "left"))
        for row in (first + np.flatnonzero(size[first:last] >= wanted - e)).tolist():
            start = int(starts[row])
            here = items.verify(item, low - start, texts[row], points[start : start + len(texts[row])])
            if here and here[0] <= e:
                best[row, item] = min(best.get((row, item), here), here)
    for row, text in enumerate(texts if items.short else ()):
        words = text.split(" ")
        for n, wanted in items.short.items():
            runs = words if n == 1 else map(" ".join, zip(*(words[k:] for k in range(n))))
            for found in wanted.keys() & set(runs):
                start = f" {text} ".index(f" {found} ")
                best |= {(row, item): (0, start, start + len(found)) for item in wanted[found]}
    return best


def shipped(spark: SparkSession, items: Items) -> Callable[[], Items]:
    """Sends a block of items to the workers, once each; called there, gives the block."""
    sent = spark.sparkContext.broadcast(vars(items))  # bounded by BLOCK_CHARS

    def unpack() -> Items:
        found = Items.__new__(Items)
        found.__dict__.update(sent.value)
        return found

    return unpack


def scan(docs: DataFrame, items: Items, item_type: DataType, id_col: str, text_col: str) -> DataFrame:
    get, item_arrow = shipped(docs.sparkSession, items), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = get()
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                some = batch.slice(low, 128)
                best = matches([plain(t) for t in some.column(1).to_pylist()], items)
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array([r for (r, _), _ in rows], pa.int64())), pa.array([items.ids[i] for (_, i), _ in rows], item_arrow)]
                    + [pa.array([x[k] for _, x in rows], pa.int64()) for k in range(3)]
                    + [pa.array([len(items.texts[i]) for (_, i), _ in rows], pa.int64())],
                    names=["id", "item_id", "edits", "start", "end", "item_chars"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, item_id {item_type.simpleString()}, edits long, start long, end long, item_chars long")


def item_blocks(benchmark: DataFrame, q: int, rate: float, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Items]:
    """The items, in blocks of about BLOCK_CHARS characters; the driver holds one at a time."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block")
    if blocks > 1:  # read once, then a folder a block
        items = items.select("*", block)
        items = written(items, "items", "block")
    for i in range(blocks):
        rows = (items.filter(F.col("block") == i) if blocks > 1 else items).orderBy("id", "text").collect()  # about BLOCK_CHARS characters
        yield Items([r["id"] for r in rows], [r["text"] for r in rows], q, rate)


def leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.08, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item that stands in it: id, item_id, edits, start, end, item_chars.

    Texts are compared in lower case with each run of other characters than letters and
    digits as one space; start and end are code points of that form. An item counts as
    present with at most rate * item_chars edits, whatever its length from q characters on; of several places the one with the
    fewest edits, then the first, is given. Items shorter than q characters have no
    q-grams: they are looked up exactly, as whole words; those without any letter or
    digit have no plain form and are not searched. Ids of items may be of any type. Null
    texts are empty; repeated rows and items are reported each; extra columns are
    ignored; an empty table gives no rows. A benchmark of more than BLOCK_CHARS
    characters is searched in blocks, each with a scan of docs whose hits are written
    before the next, so neither the driver nor a worker holds more than one.
    """
    kind = benchmark.schema[item_col].dataType
    found, last = [], None
    for items in item_blocks(benchmark, q, rate, item_col, item_text_col):
        if last is not None:
            found.append(written(last, "leaks"))
        last = scan(docs, items, kind, id_col, text_col)
    return reduce(DataFrame.union, [*found, last]).withColumnRenamed("id", id_col).withColumnRenamed("item_id", item_col)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs without those that hold an item, with the columns they came with.

    Each row is judged by its own text, where it is read, whatever its id; nothing is
    shuffled. Null and empty texts hold nothing and stay; an empty benchmark removes
    nothing. Columns of any name are kept as they are; an empty table gives no rows. Of
    a benchmark in several blocks each is another such scan of what the last one left.
    """
    text_at = docs.columns.index(text_col)

    def without(docs: DataFrame, items: Items) -> DataFrame:
        get = shipped(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = get()
            for batch in batches:
                for low in range(0, batch.num_rows, 128):
                    some = batch.slice(low, 128)
                    keep = np.ones(some.num_rows, bool)
                    keep[[row for row, _ in matches([plain(t) for t in some.column(text_at).to_pylist()], items)]] = False
                    yield some.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    last = None
    for items in item_blocks(benchmark, q, rate, item_col, item_text_col):
        last = without(docs if last is None else written(last, "clean"), items)
    return last


def op10_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
