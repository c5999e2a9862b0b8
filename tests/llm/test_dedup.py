import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from factgraph.llm import exact_dedup, near_dedup, sketch, substring_dedup
from factgraph.llm.components import connected_components
from factgraph.llm.sketch import bands
from factgraph.llm.words import Powers, window_hashes, word_hashes
from tests.llm.helpers import by_id, documents, odd_texts, words

# --- windows -----------------------------------------------------------------------------


def brute_windows(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            x = tuple(w[j : j + length])
            if x in seen:
                gone[j : j + length] = [True] * length
            seen.add(x)
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("length", [20, 3, 1])
@pytest.mark.parametrize("size", [(6_000_000, 12_000_000), (3000, 500)])
def test_windows(odd, monkeypatch, length, size):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", size[0])
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", size[1])
    found = by_id(substring_dedup.repeated_passages(odd, length))
    expected = brute_windows(odd_texts(), length)
    assert len(found) == len(expected)
    for i, (n, gone, kept) in expected.items():
        assert (found[i].n_words, sum(s.end - s.start for s in found[i].removed), found[i].kept) == (n, gone, kept), i


def test_intervals_are_maximal():
    repeated = np.array([1, 0, 0, 1, 1, 0, 0, 0, 0, 1], bool)
    assert substring_dedup.intervals(repeated, 2, 11) == [(0, 2), (3, 6), (9, 11)]
    assert substring_dedup.intervals(np.zeros(0, bool), 20, 3) == []


def test_windows_with_null_and_repeated_ids(spark):
    found = substring_dedup.repeated_passages(documents(spark, ["a b c", "a b c", "a b c"], [None, 5, 5]), 3).collect()
    assert sorted((r.doc_id is not None, len(r.removed)) for r in found) == [(False, 0), (True, 1), (True, 1)]
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_windows_of_rows_without_ids_fill_several_blocks(spark, monkeypatch):
    """Each text counts once for what it repeats, whichever of the rows without an id comes first."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 400)
    texts = [f"{i} one two three four {i}" for i in range(60)] + [f"{i} a b c d {i}" for i in range(40)] + ["u v w", "x one two three"]
    ids = [None] * 60 + [7] * 40 + [8, 9]
    found = substring_dedup.repeated_passages(documents(spark, texts, ids).repartition(4), 4).collect()
    assert sum(len(r.removed) for r in found if r.doc_id is None) == 59 and sum(len(r.removed) for r in found if r.doc_id == 7) == 39
    assert len(found) == 102 and all(not r.removed for r in found if r.doc_id == 8)


def test_rolling_hashes_depend_on_the_words_alone():
    h = word_hashes([b"x", b"a", b"b", b"c", b"y", b"a", b"b", b"c"])
    w = window_hashes(h, 3, Powers())
    assert w[1] == w[5] and len(set(w.tolist())) == 5
    assert len(window_hashes(h, 9, Powers())) == 0


# --- exact ---------------------------------------------------------------------------------


def test_exact(odd, spark):
    texts = odd_texts()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    found = by_id(exact_dedup.exact_dedup(odd))
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert tuple(found[i])[1:] == (same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(norm))


def test_exact_against_an_index(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_test", 3)
    index.drop()
    first = by_id(index.add(documents(spark, ["a", "b", "a"], [4, 5, 6])))
    assert [(first[i].keep_id, first[i].group_size, first[i].is_new) for i in (4, 5, 6)] == [(4, 2, True), (5, 1, True), (4, 2, True)]
    second = by_id(index.add(documents(spark, ["a", "c", "c"], [1, 3, 2])))
    assert [(second[i].keep_id, second[i].is_new) for i in (1, 2, 3)] == [(4, False), (2, True), (2, True)]
    third = by_id(exact_dedup.exact_dedup(documents(spark, ["c", "d"], [8, 9]), index="digests_of_test"))
    assert [(third[i].keep_id, third[i].kept) for i in (8, 9)] == [(2, False), (9, True)]
    assert index.read().count() == 4
    index.drop()


def test_a_batch_added_again_gets_the_same_answers(spark):
    index = exact_dedup.DigestIndex(spark, "digests_added_again", 3)
    index.drop()
    index.add(documents(spark, ["a", "b"], [1, 2]))
    answers = [sorted(index.add(documents(spark, ["b", "c", "c", None], [3, 4, 5, 6])).collect()) for _ in range(2)]
    assert answers[0] == answers[1] and [r.is_new for r in answers[0]] == [False, True, True, True]
    named = [sorted(index.add(documents(spark, ["c", "d"], [7, 8]), batch="third").collect()) for _ in range(2)]
    assert named[0] == named[1] and [r.is_new for r in named[0]] == [False, True]
    assert index.read().count() == 5
    index.drop()


def test_a_half_appended_batch_is_completed(spark):
    """A job that died after a part of its append: what is missing is added, nothing twice."""
    index = exact_dedup.DigestIndex(spark, "digests_half_added", 2)
    index.drop()
    docs = documents(spark, ["a", "b", "c"], [1, 2, 3])
    index.add(docs, batch="x")
    whole = sorted(tuple(r) for r in index.read().collect())
    index.drop()
    index.append(spark.createDataFrame(whole[:1], "digest binary, keep_id long, rows long, batch string"))
    assert all(r.is_new for r in index.add(docs, batch="x").collect())
    assert sorted(tuple(r) for r in index.read().collect()) == whole
    index.drop()


def test_exact_leaves_no_table_behind(spark):
    before = len(spark.catalog.listTables())
    texts = ["a", "b", "a", "c", "b", "b"]
    found = by_id(exact_dedup.exact_dedup(documents(spark, texts, [10, 20, 30, 40, 50, 60])))
    assert [(found[i].keep_id, found[i].group_size, found[i].kept) for i in (10, 20, 30, 40, 50, 60)] == [
        (10, 2, True), (20, 3, True), (10, 2, False), (40, 1, True), (20, 3, False), (20, 3, False)
    ]
    assert len(spark.catalog.listTables()) == before


def test_exact_with_names_for_ids(spark):
    docs = spark.createDataFrame([("x", "a"), ("b", "a"), (None, "c")], "doc_id string, text string")
    found = by_id(exact_dedup.exact_dedup(docs))
    assert [(found[i].keep_id, found[i].kept) for i in ("x", "b", None)] == [("b", False), ("b", True), (None, True)]


def test_a_first_batch_meets_the_index_by_an_anti_join(spark, monkeypatch):
    plans, write = {}, exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, what: plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString()) and write(df, what))
    assert exact_dedup.exact_dedup(documents(spark, ["a", "b", "a"])).filter("kept").count() == 2
    plan = plans["new-digests"]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    found = exact_dedup.exact_dedup(documents(spark, [None, "", "x"], [None, 3, 3])).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in found) == [(0, 3, False), (3, 3, True), (3, 3, True)]


def test_exact_like_sql(spark, odd, tmp_path):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.SQL})").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.op9_exact_dedup(spark, str(tmp_path)).collect()) == expected


def test_kept_documents_go_by_rows(spark):
    """Null ids, ids with several texts, and the same row twice: one row of each text stays."""
    texts = ["q r s t u v", "x y z a b c", "q r s t u v", "n m l k j i", "n m l k j i", "q r s t u v", "o p o p o p o p", "o p o p o p o p"]
    docs = documents(spark, texts, [1, 2, 2, 3, 3, None, None, None]).repartition(3)
    expected = [(1, "q r s t u v"), (2, "x y z a b c"), (3, "n m l k j i"), (None, "o p o p o p o p")]
    for kept in (exact_dedup.kept_documents(docs), near_dedup.kept_documents(docs)):
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)


# --- near -----------------------------------------------------------------------------------


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_near(texts, k, percent):
    sets = []
    for t in texts:
        w = words(fold(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near(odd, k, percent):
    found = by_id(near_dedup.near_duplicates(odd, k, percent))
    assert [tuple(found[i])[1:] for i in range(len(found))] == brute_near(odd_texts(), k, percent)


def test_a_chain_around_its_first_member_is_whole(spark):
    # 0 and 1 are linked with neither's neighbour's neighbour: links go through the middle
    w = [f"a{i}" for i in range(120)]
    texts = []
    for step in range(6):
        v = list(w)
        v[: 3 * step] = [f"b{i}" for i in range(3 * step)]
        texts.append(" ".join(v))
    order = [5, 0, 3, 1, 4, 2]
    texts = [texts[i] for i in order]
    found = by_id(near_dedup.near_duplicates(documents(spark, texts), 3, 85))
    assert [tuple(found[i])[1:] for i in range(6)] == brute_near(texts, 3, 85)


def test_near_in_parts(spark, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_BYTES", 2000)
    found = by_id(near_dedup.near_duplicates(odd, 3, 85))
    assert [tuple(found[i])[1:] for i in range(len(found))] == brute_near(odd_texts(), 3, 85)


def chains(seed=4):
    """Texts that move away from a first one step by step, several chains from one start, beside far ones."""
    r = random.Random(seed)
    start, texts = [f"a{i}" for i in range(100)], []
    for chain in range(4):
        w = list(start)
        for step in range(12):
            texts.append(" ".join(w))
            for _ in range(2):
                w[r.randrange(100)] = f"{chain}x{step}{r.random()}"
    texts += [" ".join(r.sample(start, 100)) for _ in range(12)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("rows, percent", [(2000, 85), (3, 85), (1, 85), (3, 90)])
def test_near_chains(spark, monkeypatch, rows, percent):
    monkeypatch.setattr(near_dedup, "PART_ROWS", rows)
    texts = chains()
    found = by_id(near_dedup.near_duplicates(documents(spark, texts).repartition(5), 3, percent))
    assert [tuple(found[i])[1:] for i in range(len(found))] == brute_near(texts, 3, percent)


def test_parts_meet(spark, monkeypatch):
    """Every pair with a member that isn't main meets in some task, pairs of main members need not."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 4)
    rows = [(k, i, i < main, 1) for k, (n, main) in enumerate([(1, 0), (7, 0), (9, 7), (30, 1), (30, 29), (12, 12), (3, 3)]) for i in range(n)]
    dealt = near_dedup.in_parts(spark.createDataFrame(rows, "k int, id int, main boolean, size int"), "k", "size", 5).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.k, r.g, r.i, r.j), []).append((r.id, r.main))
    met = {(k, *sorted((a, b))) for (k, *_), found in tasks.items() for a, _ in found for b, _ in found}
    assert {(k, *sorted((a, b))) for k, a, m, _ in rows for l, b, n, _ in rows if k == l and not (m and n)} <= met
    assert not any(k in (5, 6) for k, *_ in tasks) and max(len({i for i, _ in found}) for found in tasks.values()) <= 16


def test_spanning_joins_what_is_linked():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(2, 14)
        link = {(i, j) for i in range(n) for j in range(i) if r.random() < r.choice([0.05, 0.2])}
        labels = np.array([r.randrange(n) for _ in range(n)])
        alike = lambda x, rest: np.array([(max(x, y), min(x, y)) in link for y in rest.tolist()])
        pairs = near_dedup.spanning(labels, alike)
        assert all((max(p), min(p)) in link for p in pairs)

        def parts(edges):
            root = list(range(n))
            for a, b in edges:
                root = [root[a] if x == root[b] else x for x in root]
            return [root.index(x) for x in root]

        same = [(i, j) for i in range(n) for j in range(i) if labels[i] == labels[j]]
        assert parts(same + pairs) == parts(same + list(link))
        assert len(pairs) == len(set(labels.tolist())) - len(set(parts(same + pairs)))


def test_near_with_repeated_ids(spark):
    """Rows that share an id have the classes of their own texts."""
    texts = ["a b c d e f", "a b c d e f", "x y z u v w", None, "x y z u v w", "q r s t", "q r s t", "m n o p"]
    ids = [1, 5, 5, 5, None, None, None, 7]
    found = near_dedup.near_duplicates(documents(spark, texts, ids).repartition(3), 3, 85).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in found], key=key) == sorted(
        [(1, 4, 1, True), (5, 4, 1, False), (5, 4, 5, True), (5, 0, 5, True), (None, 4, 5, False), (None, 2, None, True), (None, 2, None, True), (7, 2, 7, True)], key=key
    )


def test_near_edges(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    found = near_dedup.near_duplicates(documents(spark, [None, "", "x y", "x y"], [1, 2, None, 7])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [(0, 7), (1, 1), (2, 2), (7, 7)]
    lone = near_dedup.near_duplicates(documents(spark, ["q r s"], [None])).first()
    assert (lone.component_id, lone.kept) == (None, True)
    kept = near_dedup.kept_documents(documents(spark, ["a b c", "A b c", None, ""]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    for n in (1, 2, 10, 500, 5000):
        s = sketch.sketch(r.integers(0, 1 << 63, n).astype(np.uint64))
        assert len(s) == 128 and (s >> np.uint64(48)).max() <= 256
    errors = []
    for _ in range(40):
        x = r.integers(0, 1 << 63, 1100).astype(np.uint64)
        errors.append((sketch.sketch(x[:1000]) == sketch.sketch(x[100:])).mean() - 900 / 1100)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    a = sketch.sketch(x[:1000])
    assert len(np.unique(bands(a, 4))) == 32 and (bands(a, 4) == bands(a.copy(), 4)).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 100), (7, 7), (50, 60), (60, 50)] + [(200, 201 + i) for i in range(30)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(found) == 21 + 3 + 2 + 31
    assert all(found[i] == 0 for i in range(21)) and found[102] == 100 and found[60] == 50 and found[230] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
