import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factgraph.llm import packing, token_counts
from tests.llm.helpers import by_id, documents, odd_texts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RUNS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\taA'é")), max_size=60)


@pytest.fixture(scope="module")
def tools():
    return Tokenizer.from_file(BYTE), packing.ByteBpe(BYTE), Tokenizer.from_file(WORD), token_counts.WordBpe(WORD)


@settings(max_examples=300, deadline=None)
@given(RUNS)
def test_both_count_like_the_library(tools, text):
    byte, fast, word, count = tools
    for t in (text, f"<|endoftext|>{text}'s<|startoftext|>", text * 3):
        assert fast(t) == byte.encode(t, add_special_tokens=False).ids
        assert count.count([t]) == [len(word.encode(t, add_special_tokens=False).ids)]


def test_odd_texts_count_like_the_library(tools):
    byte, fast, word, count = tools
    texts = [t or "" for t in odd_texts()] + ["ab" * 40_000, " " * 5000, "aaa aaaa aaaaa"]
    assert [fast(t) for t in texts] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.count(texts) == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_given_documents_count_like_the_library(spark, tools):
    """Every id of every text of sf0.01, for both tokenizers."""
    byte, fast, word, count = tools
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [fast(t) for t in texts] == [x.ids for x in byte.encode_batch(texts, add_special_tokens=False)]
    assert count.count(texts) == [len(x.ids) for x in word.encode_batch(texts, add_special_tokens=False)]


def test_overlapping_pairs_merge_from_the_left(tools):
    word, count = tools[2], tools[3]
    texts = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 9)]
    assert count.count(texts) == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts(odd, tools):
    texts = odd_texts()
    found = by_id(token_counts.token_counts(odd, limit=100))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        n = len(tools[2].encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 100)


def pieces_hold(pieces, texts, byte, window, end):
    streams, rows = {}, sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in rows:  # gapless, in one stream
        assert p.sequence_id * window + p.offset == at and p.length > 0 and p.offset + p.length <= window
        at += p.length
        assert len(p.ids) == 4 * p.length
        streams.setdefault(p.doc_id, []).append(p)
    for i, t in enumerate(texts):
        ids = byte.encode(t or "", add_special_tokens=False).ids + ([end] if end is not None else [])
        own = sorted(streams.get(i, []), key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own]).tolist()][: len(own)]
        assert all(p.doc_tokens == len(ids) for p in own)
    return at


@pytest.mark.parametrize("window, end", [(2048, 1), (64, 1), (1, 1), (50, None)])
def test_packing(odd, tools, window, end):
    docs = odd if window > 1 else odd.filter("doc_id < 12")
    texts = odd_texts() if window > 1 else odd_texts()[:12]
    total = pieces_hold(packing.pack(docs, packing.public_bpe(), window, end), texts, tools[0], window, end)
    laid = packing.sequences(packing.pack(docs, packing.public_bpe(), window, end), window).collect()
    assert len(laid) == -(-total // window) and all(len(s.ids) == window for s in laid)
    assert sorted(s.n_tokens for s in laid)[1:] == [window] * (len(laid) - 1)


def test_packed_rows_have_checksums(odd, tools):
    some = odd.filter("doc_id IN (0, 4, 10)")
    for r in packing.packed_rows(packing.pack(some, packing.public_bpe())).collect():
        ids = tools[0].encode(odd_texts()[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_empty_and_null_ids(spark):
    none = documents(spark, [])
    assert packing.pack(none, packing.public_bpe()).count() == 0
    assert token_counts.token_counts(none).count() == 0
    twice = documents(spark, ["a b", "a b", None], [None, None, 7])
    assert packing.pack(twice, packing.public_bpe()).count() == 3
    assert token_counts.token_counts(twice).count() == 3
    with pytest.raises(ValueError):
        packing.pack(none, packing.public_bpe(), 0)
