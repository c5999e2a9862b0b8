"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbols. In a round every pre-token finds its
lowest-rank adjacent pair, all of its occurrences are merged at once, for all pre-tokens
together, until none has a pair left. The surviving symbols are the tokens. Each
distinct pre-token is merged once; its count is kept in a bounded table of the worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import table
from factgraph.llm.packing import byte_to_unicode

NO_RANK = np.int32(1 << 30)


class WordBpe:
    """Counts as a BPE file with word ends of the tokenizers library gives them.

    kept: distinct pre-tokens whose counts the worker remembers.
    """

    def __init__(self, path: str, kept: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model.get("end_of_word_suffix") != "</w>" or not split.get("invert") or model.get("ignore_merges"):
            raise ValueError("not a BPE with word ends")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], np.arange(len(merges), dtype=np.int32)[order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.first = np.array([vocab[c] for _, c in sorted(byte_to_unicode().items())], np.int32)
        self.last = np.array([vocab[c + "</w>"] for _, c in sorted(byte_to_unicode().items())], np.int32)
        self.back = {c: b for b, c in byte_to_unicode().items()}
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.beyond = re.compile("[^\x00-ɏ]")
        self.counts: dict[str, int] = {}
        self.kept = kept

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings.

        Up to U+024F lower case and the pattern give what the library does; beyond, where
        versions of Unicode differ and texts may not be composed, the library itself splits.
        """
        if not self.beyond.search(text):
            return self.words.findall(text.lower())
        back, split = self.back, self.library.pre_tokenizer.pre_tokenize_str
        return [bytes(back[c] for c in w).decode() for w, _ in split(self.library.normalizer.normalize_str(text))]

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The words of a text, and how many special strings stand in it."""
        if "<|" not in text or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.split(p)], len(parts) - 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.ranks[at], NO_RANK)

    def merged(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        blobs = [w.encode() for w in words]
        size = np.array([len(b) for b in blobs], np.int64)
        raw = np.frombuffer(b"".join(blobs), np.uint8)
        symbol, word = self.first[raw], np.repeat(np.arange(len(blobs)), size)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[raw[ends]]
        out, rank = size.copy(), None
        while len(symbol) > 1:
            if rank is None:
                rank = np.full(len(symbol), NO_RANK, np.int32)
                inner = np.flatnonzero(word[1:] == word[:-1])
                rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, begin)
            going = lowest < NO_RANK
            if not going.all():  # words without a pair are done
                length = np.diff(np.r_[begin, len(word)])
                out[word[begin[~going]]] = length[~going]
                keep = np.repeat(going, length)
                symbol, word, rank = symbol[keep], word[keep], rank[keep]
                if not len(symbol):
                    break
                lowest = lowest[going]
                begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[begin, len(word)])
            hit = rank == np.repeat(lowest, length)
            # of overlapping occurrences (a a a) every other one counts, from the left
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) > 1]
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[nth % 2 == 0]
            symbol[at] = self.made[rank[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, word, rank, changed = symbol[~gone], word[~gone], rank[~gone], changed[~gone]
            # pairs beside a merged symbol get their ranks anew
            stale = changed.copy()
            stale[:-1] |= changed[1:]
            spot = np.flatnonzero(stale)
            rank[spot] = NO_RANK
            spot = spot[spot < len(symbol) - 1]
            spot = spot[word[spot] == word[spot + 1]]
            rank[spot] = self.rank(symbol[spot], symbol[spot + 1])
        if len(symbol) == 1:
            out[word[0]] = 1
        return out

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        if len(self.counts) > self.kept:
            self.counts.clear()
        new = list({w for words, _ in split for w in words if w not in self.counts})
        for low in range(0, len(new), 20_000):
            some = new[low : low + 20_000]
            self.counts.update(zip(some, self.merged(some).tolist()))
        get = self.counts.__getitem__
        return [sum(map(get, words)) + special for words, special in split]


def token_counts(
    docs: DataFrame, limit: int = 2048, name: str = "word_bpe_49k.json", path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    path: of the vocabulary file, else the installed public one of that name. Whole
    texts are counted, without begin, end or padding; special strings inside a text are
    one token each. A null text counts as empty: 0 bytes, 0 tokens. No shuffle; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path:
            bpe = WordBpe(path)
        else:
            import public_tokenizers

            bpe = WordBpe(public_tokenizers.path(name))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                texts = [t or "" for t in some.column(1).to_pylist()]
                size = [len(t.encode()) for t in texts]
                n = bpe.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op2_rank_merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
