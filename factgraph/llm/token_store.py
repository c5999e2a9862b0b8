"""Token ids in binary files, each document a zstandard frame of its own.

One dictionary, trained on serialised id arrays, serves all documents, so that short ones
compress as parts of long files do. A file is the frames of a range of documents in the
order of their ids, and behind them an index frame: each document's id, the length of its
frame and its number of ids, the width of an id and the digest of the dictionary. Frames
are parted by empty skippable frames and the index is a skippable one, so a file is a plain
stream for any zstandard reader that has the dictionary. Spark's own writer makes the
files, so they can lie in any store that Spark reaches, and a task that is repeated leaves
no second copy.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factgraph.llm.common import remove, scratch, scratch_dir, table, written
from factgraph.llm.packing import public_bpe

#: Fixed values of the zstandard format: skippable frames begin with one of 16 numbers and their size.
EMPTY_FRAME = b"P*M\x18\x00\x00\x00\x00"
INDEX_MAGIC = b"Q*M\x18"
#: What an index frame ends with: length of its table, bytes an id, digest of the dictionary, name of the format.
TRAILER = "<QB32s8s"
FORMAT = b"FGTOKEN1"

#: The sample that a dictionary is trained on: so many documents of at most so many bytes, and so many bytes of ids together.
SAMPLE_DOCS, SAMPLE_TEXT, SAMPLE_BYTES = 2000, 65_536, 6_000_000


@dataclass(frozen=True)
class TokenStore:
    """Where a store lies, and its dictionary; empty bytes: none."""

    path: str
    dictionary: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()


def id_width(size: int) -> int:
    """Bytes that an id of a vocabulary takes."""
    return 2 if size <= 1 << 16 else 4


def serialised(ids: list[int], width: int) -> bytes:
    return np.array(ids, f"<u{width}").tobytes()


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; samples too few to train on are one as they are."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _zstd(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def make_dictionary(docs: DataFrame, encoder: Callable, end_id: int | None, text_col: str = "text", size: int = 65_536) -> bytes:
    """A dictionary for the id arrays of docs, from a bounded sample; it decides about sizes of files, never about their contents."""
    n = docs.count()
    if not n:
        return b""
    some = docs.filter(F.octet_length(text_col) <= SAMPLE_TEXT).sample(min(1.0, 16 * SAMPLE_DOCS / n), 11).select(text_col).take(SAMPLE_DOCS)
    run, held, samples = encoder(), 0, []
    for (text,) in some:
        ids = serialised(list(run(text)) + ([] if end_id is None else [end_id]), id_width(run.size))
        held += len(ids)
        if held > SAMPLE_BYTES:
            break
        samples.append(ids)
    return trained(samples, size)


def _frames(docs: DataFrame, encoder: Callable, end_id: int | None, dictionary: bytes, level: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (id, tie, place, width, n_tokens, size, frame): every whole text encoded and compressed, in the order of scanning."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        run, place = encoder(), TaskContext.get().partitionId() << 33
        width, tail = id_width(run.size), [] if end_id is None else [end_id]
        packer = zstandard.ZstdCompressor(level=level, dict_data=_zstd(dictionary), write_checksum=True, write_content_size=True)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # bounded memory, however large the batch
                some = batch.slice(low, 256)
                frames, counts = [], []
                for text in some.column(2).to_pylist():
                    ids = list(run(text or "")) + tail
                    counts.append(len(ids))
                    frames.append(packer.compress(serialised(ids, width)))
                n = len(counts)
                columns = [some.column(0), some.column(1), pa.array(np.arange(place, place + n)), pa.array(np.full(n, width, np.int32)), pa.array(counts, pa.int64())]
                place += n
                yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, frames), pa.int64()), pa.array(frames, pa.binary())], names=["id", "tie", "place", "width", "n_tokens", "size", "frame"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(encode, f"id {kind}, tie long, place long, width int, n_tokens long, size long, frame binary"), "frames")


def write_tokens(
    docs: DataFrame, path: str, encoder: Callable, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    dictionary: bytes | None = None, dictionary_size: int = 65_536, level: int = 3, file_bytes: int = 32 << 20,
) -> TokenStore:
    """Writes the ids of all texts below path: data (the files), dictionary, and index (Parquet).

    encoder makes, in the worker, the function from a text to its ids, with its vocabulary's
    `size`. Documents lie in ascending order of ids, null ids last, repeated ones in the order
    of a hash of their texts; each row is kept, equal ones too. A null text counts as empty and is its
    end id alone, without one a frame of no ids. dictionary: one of an earlier store, None:
    trained on a sample of at most 2,000 documents. file_bytes: of a file, about; a longer
    document has one of its own size. Texts are read once; what is sorted and shuffled is
    frames. Extra columns are ignored; an empty table gives a store without files.
    """
    spark = docs.sparkSession
    if dictionary is None:
        dictionary = make_dictionary(docs, encoder, end_id, text_col, dictionary_size)
    store = TokenStore(path, dictionary)
    digest = store.digest

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, counts, width = [], [], [], 4
        for batch in batches:
            if not batch.num_rows:
                continue
            width = batch.column(1)[0].as_py()
            ids.append(batch.column(0))
            counts.append(batch.column(2))
            lengths.append(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(4)], names=["frame"])
        if not ids:
            return
        held = pa.table({"id": pa.chunked_array(ids), "length": pa.chunked_array(lengths), "n_tokens": pa.chunked_array(counts)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        raw = sink.getvalue().to_pybytes()
        body = raw + struct.pack(TRAILER, len(raw), width, digest, FORMAT)
        yield pa.RecordBatch.from_arrays([pa.array([INDEX_MAGIC + struct.pack("<I", len(body)) + body], pa.binary())], names=["frame"])

    with scratch(spark):
        frames = _frames(docs, encoder, end_id, dictionary, level, id_col, text_col)
        files = 1 + int(frames.agg(F.sum("size")).first()[0] or 0) // file_bytes
        order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("place")]
        ordered = frames.repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "width", "n_tokens", "size", "frame")
        # a string column carries any bytes to the writer of texts, and what parts its lines is an empty frame
        laid = ordered.mapInArrow(lay, "frame binary").select(F.col("frame").cast("string").alias("value"))
        laid.write.mode("errorifexists").option("lineSep", EMPTY_FRAME.decode()).text(f"{path}/data")
    spark.createDataFrame([(digest.hex(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    _index(spark, store, docs.schema[id_col].dataType.simpleString()).write.parquet(f"{path}/index")
    return store


def open_tokens(spark: SparkSession, path: str) -> TokenStore:
    """A store that was written earlier."""
    found = spark.read.parquet(f"{path}/dictionary").first()
    store = TokenStore(path, bytes(found["dictionary"]))
    if store.digest.hex() != found["sha256"]:
        raise ValueError(f"the dictionary in {path} isn't the one that its digest names")
    return store


def footer(content: bytes, digest: bytes) -> tuple[pa.Table, int]:
    """The index (id, length, n_tokens) of a file, and the bytes of an id; an error if it was made with another dictionary."""
    end = len(content) - len(EMPTY_FRAME)
    size, width, made_with, name = struct.unpack_from(TRAILER, content, end - struct.calcsize(TRAILER))
    if name != FORMAT:
        raise ValueError("not a file of token ids")
    if made_with != digest:
        raise ValueError(f"written with the dictionary {made_with.hex()}, not with {digest.hex()}")
    at = end - struct.calcsize(TRAILER) - size
    return pa.ipc.open_stream(pa.py_buffer(content[at : at + size])).read_all(), width


def _files(spark: SparkSession, store: TokenStore, parts: list[int] | None = None) -> DataFrame:
    """(part, content): a file's number is that of the range that it holds."""
    glob = "part-*" if parts is None else "part-{" + ",".join(f"{p:05d}" for p in parts) + "}-*"
    part = F.regexp_extract(F.col("path"), r"part-(\d+)-[^/]*$", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{store.path}/data").filter("length > 0").select(part.alias("part"), "content")


def _index(spark: SparkSession, store: TokenStore, kind: str) -> DataFrame:
    """(id, part, offset, length, inside, n_tokens): where each frame lies, and how many ids of its file come before it."""
    digest = store.digest

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, _ = footer(batch.column(1)[i].as_buffer(), digest)
                n, length = held["n_tokens"].to_numpy(), held["length"].to_numpy()
                offset = np.cumsum(length + len(EMPTY_FRAME)) - length - len(EMPTY_FRAME)
                part = np.full(len(n), batch.column(0)[i].as_py(), np.int32)
                columns = [held["id"].combine_chunks(), pa.array(part), pa.array(offset), pa.array(length), pa.array(np.cumsum(n) - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "offset", "length", "inside", "n_tokens"])

    return _files(spark, store).mapInArrow(read, f"id {kind}, part int, offset long, length long, inside long, n_tokens long")


def read_tokens(spark: SparkSession, store: TokenStore) -> DataFrame:
    """(id, start, n_tokens, ids): every document as it is in the files; ids: binary, little-endian 32-bit; start: ids of all documents before it.

    The driver sees one number a file.
    """
    index = spark.read.parquet(f"{store.path}/index")
    totals = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        before[part + 1] = n
    before = np.cumsum(before)
    digest, dictionary = store.digest, store.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                held, width = footer(content, digest)
                n, length = held["n_tokens"].to_numpy(), held["length"].to_numpy()
                offset = np.cumsum(length + len(EMPTY_FRAME)) - length - len(EMPTY_FRAME)
                start = before[batch.column(0)[i].as_py()] + np.cumsum(n) - n
                own = held["id"].combine_chunks()
                for low in range(0, len(n), 256):
                    high = min(low + 256, len(n))
                    raw = [unpacker.decompress(content[int(o) : int(o + s)]) for o, s in zip(offset[low:high], length[low:high])]
                    ids = [np.frombuffer(r, f"<u{width}").astype("<u4").tobytes() for r in raw]
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([own.slice(low, high - low), pa.array(start[low:high]), counts, pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    kind = index.schema["id"].dataType.simpleString()
    return _files(spark, store).mapInArrow(read, f"id {kind}, start long, n_tokens long, ids binary")


def fetch(spark: SparkSession, store: TokenStore, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids) of the documents with the ids of `wanted`, by the index: only files that hold one are opened, only their frames unpacked.

    A null id isn't found. The driver sees the numbers of the files. What is wanted of a
    file is at most all of it, so no row outgrows a file's index.
    """
    index = spark.read.parquet(f"{store.path}/index")
    places = index.join(wanted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    places = written(places.select("id", "part", "offset", "length"), "places")
    parts = sorted(r["part"] for r in places.select("part").distinct().collect())
    kind = index.schema["id"].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"id {kind}, n_tokens long, ids binary")
    digest, dictionary = store.digest, store.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                _, width = footer(content, digest)
                own, offset, length = batch.column(0)[i].values.flatten()
                ids = [np.frombuffer(unpacker.decompress(content[o : o + s]), f"<u{width}").astype("<u4").tobytes() for o, s in zip(offset.to_pylist(), length.to_pylist())]
                yield pa.RecordBatch.from_arrays([own, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    held = places.groupBy("part").agg(F.collect_list(F.struct("id", "offset", "length")).alias("found"))
    return held.join(_files(spark, store, parts), "part").select("found", "content").mapInArrow(read, f"id {kind}, n_tokens long, ids binary")


def op11_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the rows are read from there; drop_scratch removes them."""
    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    store = write_tokens(table(spark, sf_dir, "documents"), path, public_bpe(), 2)
    return read_tokens(spark, store).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
