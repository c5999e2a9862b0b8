"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages with one label. Every passage is encoded; gated
attention, learned from the documents' labels alone, says how much each passage counts;
the weighted mean of the encodings gives the score. A passage's features are counts of
hashed pairs of bytes, shares of kinds of characters, and how often words repeat in it,
so they depend on the text only.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import table, written

#: Words of a passage, hashed pair counts, hidden units, and units of the attention gate.
PASSAGE, PAIRS, HIDDEN, GATE = 100, 256, 24, 16
WIDTH = PAIRS + 8


def pair_table() -> np.ndarray:
    """Which of the PAIRS counts a pair of bytes goes to."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % PAIRS


def kind_table() -> np.ndarray:
    """0 lower case and beyond ASCII, 1 upper case, 2 digit, 3 mark, 4 space."""
    out = np.zeros(256, np.int64)
    out[65:91], out[48:58], out[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1, 2, 3
    out[[32, *range(9, 14)]] = 4
    return out


class Encoder:
    def __init__(self):
        self.pair, self.kind = pair_table(), kind_table()

    def __call__(self, text: str | None) -> np.ndarray:
        """float32 features of a text's passages, one row each; a text without words has one row of zeros."""
        words = (text or "").encode().split()
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]
        blobs = [b" ".join(p) + b" " for p in parts]
        size = np.array([len(b) for b in blobs], np.int64)
        raw = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(len(parts)), size)
        out = np.zeros((len(parts), WIDTH), np.float32)
        pairs = self.pair[(raw[:-1] << 8) | raw[1:]] + row[:-1] * PAIRS
        out[:, :PAIRS] = np.sqrt(np.bincount(pairs, minlength=len(parts) * PAIRS).reshape(-1, PAIRS) / size[:, None])
        kinds = np.bincount(self.kind[raw] + row * 5, minlength=len(parts) * 5).reshape(-1, 5) / size[:, None]
        out[:, PAIRS : PAIRS + 4] = kinds[:, 1:] * 4
        n = np.array([len(p) for p in parts])
        out[:, PAIRS + 4] = [len(set(p)) / len(p) for p in parts]
        out[:, PAIRS + 5] = [len(set(zip(p, p[1:]))) / max(1, len(p) - 1) for p in parts]
        out[:, PAIRS + 6] = size / n / 10
        out[:, PAIRS + 7] = n / PASSAGE
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedAttention:
    """Weights of the model; every method takes passages of several documents at once.

    starts: the first passage of each document.
    """

    NAMES = ("encode", "encode_b", "gate_v", "gate_u", "attend", "out", "out_b")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.encode = r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN))
        self.encode_b = np.zeros(HIDDEN)
        self.gate_v = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE))
        self.gate_u = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE))
        self.attend = r.normal(0, 1 / np.sqrt(GATE), GATE)
        self.out, self.out_b = r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.shift, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        x = (x - self.shift) * self.scale
        h = np.tanh(x @ self.encode + self.encode_b)
        v, u = np.tanh(h @ self.gate_v), sigmoid(h @ self.gate_u)
        energy = (v * u) @ self.attend
        n = np.diff(np.r_[starts, len(x)])
        weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), n))
        weight /= np.repeat(np.add.reduceat(weight, starts), n)
        bag = np.add.reduceat(weight[:, None] * h, starts)
        return x, h, v, u, weight, n, bag, sigmoid(bag @ self.out + self.out_b)

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        x, h, v, u, weight, n, bag, p = self.forward(x, starts)
        d = (p - label) / len(label)
        g = {"out": bag.T @ d, "out_b": np.array([d.sum()])}
        d_bag = np.repeat(d[:, None] * self.out, n, axis=0)
        d_h = weight[:, None] * d_bag
        d_weight = (d_bag * h).sum(1)
        d_energy = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, starts), n))
        g["attend"] = (v * u).T @ d_energy
        d_v = d_energy[:, None] * self.attend * u * (1 - v * v)
        d_u = d_energy[:, None] * self.attend * v * u * (1 - u)
        g["gate_v"], g["gate_u"] = h.T @ d_v, h.T @ d_u
        d_h += d_v @ self.gate_v.T + d_u @ self.gate_u.T
        d_h *= 1 - h * h
        g["encode"], g["encode_b"] = x.T @ d_h, d_h.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], label: np.ndarray, epochs: int = 25, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        """Adam on the log loss, in batches of 64 documents; bags may be of half precision, only a batch is widened."""
        r = np.random.default_rng(seed)
        count, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for low in range(0, len(bags), 256):
            some = np.concatenate(bags[low : low + 256]).astype(np.float64)
            count, total, squares = count + len(some), total + some.sum(0), squares + (some * some).sum(0)
        self.shift = total / count
        self.scale = 1 / np.maximum(np.sqrt(np.maximum(squares / count - self.shift**2, 0)), 0.02)
        first = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        second, t = {k: np.zeros_like(v) for k, v in first.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for low in range(0, len(order), 64):
                some = order[low : low + 64]
                n = np.array([len(bags[i]) for i in some])
                g = self.gradients(np.concatenate([bags[i] for i in some]).astype(np.float32), np.cumsum(n) - n, label[some])
                t += 1
                step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k in self.NAMES:
                    w = getattr(self, k)
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    setattr(self, k, w - step * first[k] / (np.sqrt(second[k]) + 1e-8) - step * decay * w)
        return self


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 10_000, most_passages: int = 150_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> GatedAttention | None:
    """Fits the model on a bounded sample of labelled documents outside the held-out fold.

    The sample is taken in the order of a hash of the id: at most `most` documents, each
    text whole, as far as they fit into `most_passages` passages together; one that
    doesn't fit is passed over. Its features, half a KB a passage, are all that the
    driver collects. Of rows with the same id the one with the least text counts, of
    several labels the greatest; null labels and ids are left out, extra columns
    ignored. None, with a warning, if no document is left.
    """
    usable = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    )
    chosen = usable.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Encoder()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                rows = [run(t).astype(np.float16) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["id", "label", "passages", "features"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id"
    )  # at most `most` rows
    texts = named.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("id", "label", "text")
    encoded = written(texts.mapInArrow(encode, f"id {kind}, label int, passages long, features binary"), "sample")
    sizes = encoded.select("id", "passages").orderBy(F.xxhash64("id"), "id").collect()  # at most `most` narrow rows
    picked, room = [], most_passages
    for r in sizes:
        if r["passages"] <= room:
            picked.append((r["id"],))
            room -= r["passages"]
    if not picked:
        warnings.warn("no labelled document to learn from: every score will be 0.5", stacklevel=2)
        return None
    wanted = docs.sparkSession.createDataFrame(picked, f"id {kind}")
    found = encoded.join(F.broadcast(wanted), "id", "left_semi").select("id", "label", "features").toArrow()  # at most `most` rows of `most_passages` passages
    rows = sorted(zip(found.column("id").to_pylist(), found.column("label").to_pylist(), found.column("features").to_pylist()))
    del found
    bags = [np.frombuffer(f, np.float16).reshape(-1, WIDTH) for _, _, f in rows]
    return GatedAttention().fit(bags, np.array([float(y) for _, y, _ in rows]))


def scores(
    docs: DataFrame, model: GatedAttention | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is an input. Null and empty texts get the score of a passage without
    features; without a model all scores are 0.5. Repeated rows are scored each, extra
    columns ignored. No shuffle; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                if model is None:
                    got = np.full(some.num_rows, 0.5)
                else:
                    bags = [encode(t) for t in some.column(1).to_pylist()]
                    n = np.array([len(b) for b in bags])
                    got = model.score(np.concatenate(bags), np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that the model, trained on them and the labels, does not reject; columns unchanged.

    Rows are filtered where they are read, each by its own text, whatever its id; nothing
    is shuffled. Null and empty texts have one score and stay or go together. Without a
    labelled document to learn from all rows stay. Columns of any name are kept as they
    are; an empty table gives no rows.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    if model is None:
        return docs
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                bags = [encode(t) for t in some.column(text_at).to_pylist()]
                n = np.array([len(b) for b in bags])
                yield some.filter(pa.array(model.score(np.concatenate(bags), np.cumsum(n) - n) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
