import math
import os
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factgraph.llm import common, decontaminate, quality
from tests.llm.helpers import documents, odd_texts, words
from tests.llm.test_dedup import brute_near
from tests.llm.test_rest import distance_inside, edited, prose

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
QUALITY, EXACT, NEAR, LEAKS, PACK = (f for _, f in corpus_pipeline.STAGES)


@given
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        docs = docs.cache()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < before
    texts = [r.text for r in docs.collect()]
    assert len({" ".join(words(t)) for t in texts}) == len(texts)
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(i in decontaminate.plain(t) for i in items for t in texts)
    pieces = PACK(spark, docs, FOLDER)
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.groupBy().sum("length").first()[0] == sum(len(byte.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    # the same documents and ids; how many pieces they are cut into depends on the order in which they are laid
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").sum("length").collect()))
    assert tokens(corpus_pipeline.run(spark, FOLDER)) == tokens(pieces)
    assert all(total == n for _, total, n in tokens(pieces))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@given
def test_stages_leave_only_the_tokens_behind(spark):
    folder = Path(common.scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.is_dir() else set()
    out = corpus_pipeline.run(spark, FOLDER)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["tokens"]
    assert out.filter("octet_length(ids) != 4 * length OR crc32(ids) != ids_crc32").isEmpty()


# --- each stage against brute force, on rows of all kinds --------------------------------------


ITEMS = [prose(25, 40 + i) for i in range(4)]


def rows_of_all_kinds():
    """(id, text): null and repeated ids, with the same and with other texts, copies, near copies, leaks, odd texts."""
    r = random.Random(8)
    texts = odd_texts()
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[10]), (None, None), (None, "only here, without an id"), (None, "only here, without an id")]
    rows += [(30, texts[10]), (30, "another text under id thirty"), (30, "another text under id thirty"), (33, texts[20]), (0, texts[60])]
    rows += [(1000 + i, f"{prose(12, i)} {edited(t, 2 * i, i)} {prose(12, 9 + i)}") for i, t in enumerate(ITEMS)]
    rows += [(1000, ITEMS[0]), (2000, ITEMS[1].upper()), (2001, ITEMS[2][: len(ITEMS[2]) // 2]), (2002, "THIS!!! IS!!! LOUD!!! " * 30)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    loud = [(i, f"{prose(60, i)}." if i % 3 else prose(60, i).upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(5000, 5240)]
    ids, texts = zip(*rows_of_all_kinds(), *[(i, t) for i, t, _ in loud])
    documents(spark, texts, ids).repartition(4).write.parquet(f"{out}/documents.parquet")
    labels = [(i, y, 0) for i, _, y in loud] + [(None, 1, 0), (30, None, 0), (5000, None, 0), (5001, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    items = [(i, t, "x", "y") for i, t in enumerate([*ITEMS, None, "", "??", "mc2 is 7"])]
    spark.createDataFrame(items, "item_id long, text string, doc_id string, id string").write.parquet(f"{out}/benchmark.parquet")
    return out


def told(df):
    return sorted((tuple((x is None, x) for x in (r.doc_id, r.text)) for r in df.collect()), key=repr)


def all_docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain_score(model, text):
    """The model's formula, a number at a time."""
    tokens = (text or "").encode().split()
    passages = [tokens[i : i + quality.PASSAGE] for i in range(0, len(tokens), quality.PASSAGE)] or [[]]
    pair, kind = quality.pair_table(), quality.kind_table()
    encoded, energies = [], []
    for p, after in zip(passages, [*passages[1:], None]):
        x = [0.0] * quality.WIDTH
        if p:
            raw = b" ".join(p) + b" "
            for a, b in zip(raw, raw[1:] + (after[0][:1] if after else b"")):  # the space at the end makes a pair with what follows
                x[pair[a << 8 | b]] += 1 / len(raw)
            x[: quality.PAIRS] = [math.sqrt(v) for v in x[: quality.PAIRS]]
            for k in range(4):
                x[quality.PAIRS + k] = 4 * sum(kind[c] == k + 1 for c in raw) / len(raw)
            x[quality.PAIRS + 4 :] = [len(set(p)) / len(p), len(set(zip(p, p[1:]))) / max(1, len(p) - 1), len(raw) / len(p) / 10, len(p) / quality.PASSAGE]
        x = [(v - s) * c for v, s, c in zip(x, model.shift, model.scale)]
        column = lambda w, k, v: sum(v[i] * w[i][k] for i in range(len(v)))
        h = [math.tanh(column(model.encode, k, x) + model.encode_b[k]) for k in range(quality.HIDDEN)]
        gate = [math.tanh(column(model.gate_v, k, h)) / (1 + math.exp(-column(model.gate_u, k, h))) for k in range(quality.GATE)]
        encoded.append(h)
        energies.append(math.exp(sum(g * a for g, a in zip(gate, model.attend))))
    bag = [sum(e * h[k] for e, h in zip(energies, encoded)) / sum(energies) for k in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(b * w for b, w in zip(bag, model.out)) + model.out_b[0])))


def test_quality_stage(spark, folder):
    docs = all_docs(spark, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    expected = [r for r in docs.collect() if plain_score(model, r.text) >= 0.3]
    got = QUALITY(spark, docs, folder)
    assert got.columns == docs.columns and 100 < len(expected) < docs.count()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected))
    some = [r for r in quality.scores(docs, model).collect()]
    scored = {}
    for r in docs.collect():
        scored.setdefault(r.doc_id, []).append(plain_score(model, r.text))
    by_id = {}
    for r in some:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert all(np.allclose(sorted(by_id[i]), sorted(s), atol=1e-5) for i, s in scored.items())


def in_order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_exact_stage(spark, folder):
    docs = all_docs(spark, folder)
    seen, expected = set(), []
    for r in in_order(docs.collect()):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if norm not in seen:
            expected.append((r.doc_id, norm))
        seen.add(norm)
    got = EXACT(spark, docs, folder)
    assert got.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in got.collect()), key=key) == sorted(expected, key=key)


def test_near_stage(spark, folder):
    docs = all_docs(spark, folder)
    rows = in_order(docs.collect())
    got = NEAR(spark, docs, folder)
    assert got.columns == docs.columns
    # one row a class, that with the smallest id; rows of one id and class hold texts that are as good
    classes = brute_near([r.text for r in rows], 5, 80)
    first = {c: rows[c].doc_id for _, c, _ in classes}
    found = {}
    for r in got.collect():
        own = {c for (_, c, _), x in zip(classes, rows) if (x.doc_id, x.text) == (r.doc_id, r.text)}
        assert len(own) == 1 or not (r.text or "").split()
        found.setdefault(min(own), []).append(r.doc_id)
    wordless = [r for r in rows if not (r.text or "").split()]
    assert all(len(v) == 1 and v[0] == first[c] for c, v in found.items() if (rows[c].text or "").split())
    assert sum(map(len, found.values())) == len(first) and sum(not (r.text or "").split() for r in got.collect()) == len(wordless)


def test_leak_stage(spark, folder):
    docs = all_docs(spark, folder)
    items = [decontaminate.plain(t) for t in [*ITEMS, "mc2 is 7"]]

    def held(text):
        t = decontaminate.plain(text)
        return any(distance_inside(i, t) <= int(len(i) * 0.08) for i in items)

    small = docs.filter("text IS NULL OR length(text) < 3000")
    expected = [r for r in small.collect() if not held(r.text)]
    got = LEAKS(spark, small, folder)
    assert got.columns == docs.columns and small.count() - len(expected) >= 5
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected))


def test_packing_stage(spark, folder):
    docs = all_docs(spark, folder)
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    streams = sorted(((r.doc_id is None, r.doc_id or 0), (*byte.encode(r.text or "", add_special_tokens=False).ids, 1)) for r in docs.collect())
    pieces = sorted(PACK(spark, docs, folder).collect(), key=lambda p: (p.sequence_id, p.offset))
    found, now = [], []
    for p in pieces:
        assert len(p.ids) == 4 * p.length and (p.start > 0) == bool(now)
        now += np.frombuffer(p.ids, "<u4").tolist()
        if p.start + p.length == p.doc_tokens:
            found.append(((p.doc_id is None, p.doc_id or 0), tuple(now)))
            now = []
    assert sorted(found) == streams
    assert [p.sequence_id * 2048 + p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces]).tolist()][:-1]


def test_stages_on_an_empty_table(spark, folder):
    none = all_docs(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, folder)
        assert got.count() == 0 and (name == "packing" or got.columns == none.columns), name
