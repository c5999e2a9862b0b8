"""Packing by concatenate and cut.

All token streams are thought of as one, and the one is cut into windows of a fixed
size. Two passes find where each document lies: the first writes every document's ids
with its start inside its partition, the second adds the prefix sums over the
partitions' totals, which are all that the driver sees (8 bytes a partition). From the
global start a document's pieces follow without looking at any other row; a document
that crosses a window's end gives one boundary record for each window it touches. Only
the last window needs padding.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factgraph.llm.common import table, written

#: Runs without a split point are sure to be shorter than twice this in texts for the fast encoder; its merges are quadratic.
STRIDE = 1500


def may_run_on(text: str) -> bool:
    """Whether some stride of the text has no space, or nothing else; looks at a few characters a stride."""
    return any(text.find(" ", at, at + STRIDE) < 0 or text[at : at + STRIDE].isspace() for at in range(0, len(text) - STRIDE + 1, STRIDE))


def byte_to_unicode() -> dict[int, str]:
    """The public table of byte-level BPE: printable Latin-1 stays, the others move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def little_endian(ids: list[int]) -> bytes:
    """ids as 32-bit numbers, least byte first."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ByteBpe:
    """ids of a byte-level BPE file of the tokenizers library.

    Where ids are in the order of merges the same vocabulary runs on ranks, which is
    several times as fast and gives the same ids (the tests compare both); otherwise,
    and for very long runs without a split point, the library encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.fast = spec["model"]["vocab"], None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        in_order = [vocab["".join(m)] for m in merges] == list(range(256, 256 + len(merges)))
        if in_order and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            import tiktoken
            from public_tokenizers import PATTERN

            back = {c: b for b, c in byte_to_unicode().items()}
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or may_run_on(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


def token_table(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Writes (id, part, part_start, tokens, ids): ids as little-endian 32-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, part, start = encoder(), TaskContext.get().partitionId(), 0
        tail = [] if end_id is None else [end_id]
        tail_blob = little_endian(tail)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 256):  # bounded memory, however large the batch
                blobs, counts = [], []
                for text in texts.slice(low, 256).to_pylist():
                    ids = run(text or "")
                    blobs.append(little_endian(ids) + tail_blob)
                    counts.append(len(ids) + len(tail))
                ends = np.cumsum(counts, dtype=np.int64) + start
                starts, start = ends - counts, int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(low, 256), pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["id", "part", "part_start", "tokens", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(encode, f"id {kind}, part int, part_start long, tokens long, ids binary"), "tokens")


def pack(
    docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], window: int = 2048,
    end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    encoder makes, in the worker, the function from a text to its ids. Each document's
    ids are followed by end_id (None: by nothing). start: ids of the document before the
    piece; offset: of the sequence before it; ids: binary, little-endian 32-bit. Every
    sequence but the last is full. A null text counts as empty and gives the end id
    alone; without an end id it gives no row. Repeated rows are packed each on its own,
    extra columns are ignored, an empty table gives no rows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    tokens = token_table(docs, encoder, end_id, id_col, text_col)
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    before = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        before[part + 1] = n
    before = np.cumsum(before)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                part, inside, n = (some.column(i).to_numpy() for i in (1, 2, 3))
                begin = before[part] + inside
                first, last = begin // window, (begin + n - 1) // window
                pieces = np.where(n > 0, last - first + 1, 0)
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] + nth
                at = np.maximum(sequence * window, begin[row])
                end = np.minimum((sequence + 1) * window, (begin + n)[row])
                blobs = some.column(4).to_pylist()
                starts = at - begin[row]
                cuts = [blobs[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), starts.tolist(), (starts + end - at).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row)), pa.array(starts), pa.array(end - at), pa.array(n[row]), pa.array(sequence), pa.array(at - sequence * window), pa.array(cuts, pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(cut, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids array<int> of exactly `window` ids, n_tokens: the packed rows to train on."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            full = [np.pad(r, (0, window - len(r)), constant_values=pad_id) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(full, pa.list_(pa.int32())), pa.array([len(r) for r in rows], pa.int64())], names=["sequence_id", "ids", "n_tokens"]
            )

    laid = pieces.groupBy("sequence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]).alias("parts"))
    return laid.mapInArrow(lay, "sequence_id long, ids array<int>, n_tokens long")


def public_bpe(name: str = "byte_bpe_50k.json", path: str | None = None) -> Callable[[], ByteBpe]:
    """Makes the encoder in the worker; path: of the vocabulary file, else the installed public one."""

    def make() -> ByteBpe:
        if path:
            return ByteBpe(path)
        import public_tokenizers

        return ByteBpe(public_tokenizers.path(name))

    return make


def packed_columns() -> dict[str, Column]:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return {n: F.crc32("ids") if n == "ids_crc32" else F.col(n) for n in names}


def packed_rows(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(*[c.alias(n) for n, c in packed_columns().items()])


def training_rows(pieces: DataFrame) -> DataFrame:
    """packed_rows with the ids themselves; a sequence is its pieces in the order of offset, as sequences() lays them."""
    return pieces.select(*[c.alias(n) for n, c in packed_columns().items()], "ids")


def op1_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(pack(table(spark, sf_dir, "documents"), public_bpe(), 2048, 1))
