import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import decontaminate, quality, sharding
from factgraph.llm.common import IdBlocks
from tests.llm.helpers import by_id, documents, odd_texts

# --- shards ---------------------------------------------------------------------------------


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 5000])
def test_shards(odd, n):
    texts = odd_texts()
    found = by_id(sharding.shard(odd, n))
    slots = {}
    for i in range(len(texts)):
        r, raw = found[i], (texts[i] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), jump(i, n), jump(i, n + 1))
        assert r.slot == slots.get(r.shard, 0) and r.grown_shard in (r.shard, n)
        slots[r.shard] = r.slot + 1


def test_slots_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 5)
    ids = [*range(-50, 50), *range(10**12, 10**12 + 400), 2**62, -(2**63), 2**63 - 1]
    rows = sharding.shard(documents(spark, ["t"] * len(ids), ids).repartition(5), 3).collect()
    for s in range(3):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.doc_id)
        assert [r.slot for r in own] == list(range(len(own)))
    assert all(r.shard == jump(r.doc_id, 3) for r in rows)


def test_slots_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 7)
    texts = [f"text {i % 30}" for i in range(60)] + ["a", "b"]
    rows = sharding.shard(documents(spark, texts, [None] * 60 + [0, -3]).repartition(4), 2).collect()
    own = sorted((r for r in rows if r.shard == jump(0, 2)), key=lambda r: r.slot)
    assert [r.slot for r in own] == list(range(len(own))) and len(own) >= 61
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
    assert keys == sorted(keys)


def test_shard_edges(spark):
    assert sharding.shard(documents(spark, []), 4).count() == 0
    rows = sharding.shard(documents(spark, [None, "a", "a"], [None, 3, 3]), 1).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2]
    with pytest.raises(ValueError):
        sharding.shard(documents(spark, []), 0)


def test_blocks_follow_the_ids(spark):
    ids = [None, *range(0, 3000, 3), *range(10**15, 10**15 + 50)]
    df = documents(spark, ["t"] * len(ids), ids)
    for n in (1, 7, 2000):
        got = sorted((r.doc_id, r.b) for r in df.select("doc_id", IdBlocks(df, "doc_id", n).column().alias("b")).collect() if r.doc_id is not None)
        assert [b for _, b in got] == sorted(b for _, b in got) and got[0][1] == 0
        if n == 7:
            assert max(np.bincount([b for _, b in got])) < 3 * len(ids) / 7


# --- leaks ------------------------------------------------------------------------------------


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "item_id long, text string, doc_id string, edits int")


def edited(text, n, seed):
    r, s = random.Random(seed), list(text)
    for _ in range(n):
        p, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s[p] = "q"
        elif kind == 1:
            s.insert(p, "q")
        else:
            s.pop(p)
    return "".join(s)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_leaks(spark):
    items = [(i, prose(30, i)) for i in range(6)]
    plain = [decontaminate.plain(t) for _, t in items]
    texts = {
        0: f"{prose(50, 90)} {items[0][1]} {prose(50, 91)}",
        1: items[1][1].upper().replace(" ", " -- "),
        2: f"{prose(9, 92)} {edited(plain[2], int(len(plain[2]) * 0.08), 3)} {prose(9, 93)}",
        3: f"{items[3][1]} {items[4][1]}",
        4: prose(400, 94),
        5: plain[5][: len(plain[5]) // 2],
        6: edited(plain[5], int(len(plain[5]) * 0.3), 4),
        7: None,
        8: "",
        9: items[0][1],
    }
    docs = documents(spark, list(texts.values()), list(texts)).repartition(3)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, benchmark(spark, items)).collect()}
    assert sorted(found) == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 4), (9, 0)]
    for (d, i), r in found.items():
        assert r.item_chars == len(plain[i]) and (r.edits == 0) == (d != 2)
        if r.edits == 0:
            assert decontaminate.plain(texts[d])[r.start : r.end] == plain[i]
    clean = decontaminate.clean_documents(docs, benchmark(spark, items))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7, 8]


def distance_inside(item, text):
    """Fewest edits that turn the item into some part of text: the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_the_filter_loses_nothing():
    texts = [decontaminate.plain(prose(25, 100 + i)) for i in range(40)]
    items = decontaminate.Items(list(range(40)), texts, 8, 0.08)
    near = 0
    for i, t in enumerate(texts):
        for e in (0, int(items.edits[i]) // 2, int(items.edits[i]), int(items.edits[i]) + 6):
            text = f"{prose(20, 200 + i)} {edited(t, e, i)} {prose(20, 300 + i)}"
            found = decontaminate.matches([text], items)
            d = distance_inside(t, text)
            assert ((0, i) in found) == (d <= items.edits[i])
            if (0, i) in found:
                edits, start, end = found[0, i]
                assert edits == d and distance_inside(t, text[start:end]) == d
                near += 1
    assert near >= 120


def test_items_of_every_length_are_found_with_their_edits(spark):
    """All edits that the rate allows, also where a q-gram lemma of the full length asks for nothing."""
    r, rows, texts, held = random.Random(8), [], [], []
    for size in range(8, 41):
        for k in range(3):
            item = decontaminate.plain(prose(12, 1000 * size + k)[:size].strip().ljust(size, "z"))
            rows.append((len(rows), item))
            for e in range(int(len(item) * 0.08) + 2):
                texts.append(decontaminate.plain(f"{prose(6, 7 * size + e)} {edited(item, e, r.random())} {prose(6, 9 * size + k)}"))
                held.append(len(rows) - 1)
    expected = set()
    for d, (text, own) in enumerate(zip(texts, held)):
        expected |= {(d, i) for i, t in rows[max(0, own - 2) : own + 3] if distance_inside(t, text) <= int(len(t) * 0.08)}
    docs, items = documents(spark, texts), benchmark(spark, rows)
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, items).collect()}
    assert expected <= found and all(distance_inside(rows[i][1], texts[d]) <= int(len(rows[i][1]) * 0.08) for d, i in found)
    assert {len(rows[i][1]) for d, i in expected if distance_inside(rows[i][1], texts[d])} >= {13, 14, 15, 16, 25}
    clean = {x.doc_id for x in decontaminate.clean_documents(docs, items).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in found}


def test_a_leak_cut_at_an_end_of_its_document_is_found_wherever_the_document_stands():
    item, other = decontaminate.plain(prose(30, 1)), prose(12, 60)
    items = decontaminate.Items([1], [item], 8, 0.08)
    for cut in range(1, int(items.edits[0]) + 1):
        for text in (item[cut:], f"{item[cut:]} {other}", item[:-cut], f"{other} {item[:-cut]}"):
            alone = decontaminate.matches([text], items)[0, 0]
            assert alone[0] == distance_inside(item, text) == cut
            for texts in ([other, text], [other, text, other], [item[:cut], text, item[-cut:]], ["", text, ""]):
                assert decontaminate.matches(texts, items) == {(1, 0): alone}


def test_short_items_are_found_exactly_as_whole_words(spark):
    one = benchmark(spark, [(1, "E = mc2"), (2, "x+1"), (3, "Cat"), (4, "cat!"), (5, "??"), (6, None), (7, prose(30, 1))])
    texts = ["so e=mc2 holds", "concatenate x 12", "a cat, x + 1", "cat", None, "", "max 1 cats", f"{prose(30, 1)} cat"]
    docs = documents(spark, texts)
    found = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end, r.item_chars) for r in decontaminate.leaks(docs, one).collect())
    at = len(decontaminate.plain(prose(30, 1)))
    assert found == [
        (0, 1, 0, 3, 8, 5), (2, 2, 0, 6, 9, 3), (2, 3, 0, 2, 5, 3), (2, 4, 0, 2, 5, 3), (3, 3, 0, 0, 3, 3), (3, 4, 0, 0, 3, 3),
        (7, 3, 0, at + 1, at + 4, 3), (7, 4, 0, at + 1, at + 4, 3), (7, 7, 0, 0, at, at),
    ]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, one).collect()) == [1, 4, 5, 6]


def test_leak_edges(spark):
    one = benchmark(spark, [(1, prose(30, 1)), (2, None), (3, "short"), (None, prose(30, 2))])
    assert decontaminate.leaks(documents(spark, []), one).count() == 0
    assert decontaminate.leaks(documents(spark, ["a"]), benchmark(spark, [])).count() == 0
    twice = documents(spark, [prose(30, 1), prose(30, 1), f"{prose(30, 2)} {prose(30, 2)}"], [5, 5, None])
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.leaks(twice, one).collect()) == [(0, 0), (5, 1), (5, 1)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    items = [(i, prose(30, i)) for i in range(6)]
    docs = documents(spark, [f"{prose(9, 50 + i)} {t}" for i, t in items])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark(spark, items)).collect()) == [(i, i) for i in range(6)]


def test_items_with_names_for_ids(spark, monkeypatch):
    items = [(f"set-{i}", prose(30, i)) for i in range(5)] + [(None, prose(30, 9))]
    docs = documents(spark, [f"{prose(9, 50 + i)} {t}" for i, (_, t) in enumerate(items)])
    for most in (10**6, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", most)
        found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id string, text string"))
        assert dict(found.dtypes)["item_id"] == "string"
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, n) for i, (n, _) in enumerate(items)]
        assert decontaminate.clean_documents(docs, spark.createDataFrame(items[:3], "item_id string, text string")).count() == 3


# --- quality -----------------------------------------------------------------------------------


def sample(spark, n=400):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        body = prose(r.randint(5, 300), 1000 + i)
        texts.append(body.capitalize() + "." if good else body.upper().replace(" ", "!! "))
        labels.append((i, int(good), 0))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_quality_on_the_held_out_fold(spark):
    docs, labels, truth = sample(spark)
    model = quality.train(docs, labels)
    found = quality.scores(docs, model).withColumn("held", quality.held_out()).collect()
    held = [r for r in found if r.held]
    assert [r.doc_id for r in sorted(held)] == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in found if r.predicted}


def test_held_out_labels_are_not_learned(spark):
    docs, labels, truth = sample(spark)
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = by_id(quality.scores(docs, quality.train(docs, labels)))
    b = by_id(quality.scores(docs, quality.train(docs, wrong)))
    assert all(a[i].score == b[i].score for i in a)


def test_quality_edges(spark, odd):
    docs, labels, _ = sample(spark, 60)
    model = quality.train(docs, labels)
    odd_scores = quality.scores(odd, model).collect()
    assert len(odd_scores) == len(odd_texts()) and all(0 <= r.score <= 1 for r in odd_scores)
    assert quality.scores(documents(spark, []), model).count() == 0
    none = labels.limit(0)
    assert quality.train(docs, none) is None
    assert {r.score for r in quality.scores(docs, None).collect()} == {0.5}
    assert quality.good_documents(docs, none).count() == 60
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.train(docs, odd_labels) is not None


def test_a_document_that_does_not_fit_is_passed_over(spark):
    docs, labels, truth = sample(spark, 120)
    long = documents(spark, [" ".join(["Words"] * 100 * 400)] * 3, [900, 901, 902])
    more = labels.union(spark.createDataFrame([(i, 1, 0) for i in (900, 901, 902)], labels.schema))
    model = quality.train(docs.union(long), more, most_passages=300)
    assert np.mean([r.predicted == truth[r.doc_id] for r in quality.scores(docs, model).collect()]) > 0.9
    assert quality.train(docs, labels, most=1, most_passages=1000) is not None
    with pytest.warns(UserWarning, match="no labelled document"):
        assert quality.train(long, more, most_passages=300) is None


def test_repeated_ids_do_not_fill_the_sample(spark):
    docs, labels, _ = sample(spark, 80)
    hot = documents(spark, [f"x {i}" for i in range(500)], [1] * 500)
    one = quality.train(docs.filter("doc_id != 1").union(hot), labels, most=40)
    least = documents(spark, ["x 0"], [1])
    same = quality.train(docs.filter("doc_id != 1").union(least), labels, most=40)
    assert all(np.array_equal(getattr(one, n), getattr(same, n)) for n in one.NAMES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_quality_of_the_given_labels(spark):
    """Held-out accuracy, recall of label 0, and the share of pairs that scores order rightly."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = quality.op8_attention_quality(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("quality", "predicted", "score"))
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print(f"held out {len(y)}: accuracy {(y == p).mean():.4f}, recall of 0 {(p[y == 0] == 0).mean():.4f}, AUC {auc:.4f}")
    assert len(y) > 500 and (y == p).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.95 and auc > 0.995


def test_gradients_are_right():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(1)
    x, starts, y = r.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.score(x, starts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in m.gradients(x, starts, y).items():
        w = getattr(m, name)
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)]:
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-6


def test_attention_finds_the_bad_passage():
    encode = quality.Encoder()
    good = [prose(400, i) + "." for i in range(60)]
    mixed = [f"{prose(100, 500 + i)} {prose(100, 600 + i).upper().replace(' ', '!! ')} {prose(100, 700 + i)}" for i in range(60)]
    bags = [encode(t) for t in good + mixed]
    m = quality.GatedAttention().fit(bags, np.array([1.0] * 60 + [0.0] * 60))
    weight = m.forward(bags[70], np.array([0]))[4]
    assert weight.argmax() == 1
