import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from factgraph.llm import token_store as ts
from factgraph.llm.packing import public_bpe
from tests.llm.helpers import documents, odd_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded(library, text, end=2):
    return library.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def blob(ids):
    return np.array(ids, "<u4").tobytes()


def data_files(store):
    folder = f"{store.path}/data"
    return [f"{folder}/{n}" for n in sorted(os.listdir(folder)) if n.startswith("part-")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    texts = odd_texts()
    ids = [7 * i % len(texts) for i in range(len(texts))]  # the order of rows isn't that of ids
    path = f"file:{tmp_path_factory.mktemp('store')}/tokens"
    store = ts.write_tokens(documents(spark, texts, ids).repartition(5), path, public_bpe(), 2, file_bytes=300)
    return ts.TokenStore(path.removeprefix("file:"), store.dictionary), dict(zip(ids, texts))


def test_files_hold_all_ids_in_order(spark, written, library):
    store, texts = written
    assert len(data_files(store)) > 5
    found = sorted(ts.read_tokens(spark, store).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == sorted(texts)
    at = 0
    for r in found:
        ids = encoded(library, texts[r.id])
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), blob(ids))
        at += len(ids)


def test_a_file_is_a_plain_stream(written, library):
    """Any reader of the format gets the ids of all files one after the other."""
    store, texts = written
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(store.dictionary))
    ids = []
    for path in data_files(store):
        with open(path, "rb") as f:
            ids += np.frombuffer(reader.stream_reader(io.BytesIO(f.read()), read_across_frames=True).read(), "<u2").tolist()
    assert ids == [i for _, t in sorted(texts.items()) for i in encoded(library, t)]


def test_index_finds_each_frame(spark, written, library):
    store, texts = written
    index = spark.read.parquet(f"{store.path}/index").collect()
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(store.dictionary))
    files = {int(os.path.basename(p)[5:10]): p for p in data_files(store)}
    assert len(index) == len(texts)
    for r in index:
        with open(files[r.part], "rb") as f:
            f.seek(r.offset)
            assert reader.decompress(f.read(r.length)) == np.array(encoded(library, texts[r.id]), "<u2").tobytes()


def test_fetch_opens_what_is_asked(spark, written, library):
    store, texts = written
    wanted = [0, 3, 11, 3, 10_000, None]
    found = ts.fetch(spark, ts.open_tokens(spark, store.path), spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()
    assert {r.id: bytes(r.ids) for r in found} == {i: blob(encoded(library, texts[i])) for i in (0, 3, 11)} and len(found) == 3
    assert ts.fetch(spark, store, spark.createDataFrame([], "doc_id long")).count() == 0


def test_another_dictionary_is_refused(spark, written):
    store, _ = written
    with pytest.raises(Exception, match="written with the dictionary"):
        ts.read_tokens(spark, ts.TokenStore(store.path, store.dictionary[:-1])).collect()


def test_null_and_repeated_ids(spark, library, tmp_path):
    texts, ids = ["b", "a", None, "", "b", "long " * 30_000, "b"], [None, 1, 1, None, 1, 2, 1]
    store = ts.write_tokens(documents(spark, texts, ids).repartition(3), str(tmp_path / "s"), public_bpe(), 2, file_bytes=50)
    found = sorted(ts.read_tokens(spark, store).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == [1, 1, 1, 1, 2, None, None]
    assert sorted((repr(r.id), bytes(r.ids)) for r in found) == sorted((repr(i), blob(encoded(library, t))) for i, t in zip(ids, texts))
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found[:-1]]).tolist()


def test_no_end_id_and_string_ids(spark, library, tmp_path):
    docs = spark.createDataFrame([("b", ""), ("a", "one two"), ("ü", None)], "key string, body string")
    store = ts.write_tokens(docs, str(tmp_path / "s"), public_bpe(), None, "key", "body", dictionary=b"")
    found = sorted(ts.read_tokens(spark, store).collect(), key=lambda r: r.id)
    assert [(r.id, bytes(r.ids)) for r in found] == [("a", blob(encoded(library, "one two", None))), ("b", b""), ("ü", b"")]


def test_empty_table(spark, tmp_path):
    store = ts.write_tokens(documents(spark, []), str(tmp_path / "s"), public_bpe(), 2)
    assert ts.read_tokens(spark, store).collect() == [] and store.dictionary == b""


def test_wide_ids_and_dictionary():
    assert ts.id_width(65_536) == 2 and ts.id_width(65_537) == 4
    samples = [np.random.default_rng(i).integers(0, 300, 400).astype("<u2").tobytes() for i in range(200)]
    assert 0 < len(ts.trained(samples, 4096)) <= 4096
    assert ts.trained([b"12345678"], 4096) == b"12345678" and ts.trained([b"", b"1"], 4096) == b""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_op11(spark, library):
    found = sorted(ts.op11_zstd_token_files(spark, "/root/testdata/sf0.001").collect())
    at = 0
    for r, d in zip(found, sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()), strict=True):
        ids = encoded(library, d.text)
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(blob(ids)))
        at += len(ids)
