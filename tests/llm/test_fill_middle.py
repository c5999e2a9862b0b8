import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgraph.llm import fill_middle as fm
from tests.llm.helpers import documents, odd_texts

PATTERN = {"codepoints": r"[\s\S]", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}


def expected(doc_id, text, unit="codepoints"):
    """Units by a pattern, pieces by joining them."""
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = odd_texts() + ["<P>", "a<S>b", "x <M", "<P<S<M", ">P><", "\n\n", "a\n", "\na\n\nb", "🙂\n🙂 ", "é", "<" * 50] * 3


@pytest.mark.parametrize("unit", fm.UNITS)
def test_against_brute_force(spark, unit):
    found = fm.fill_middle(documents(spark, TEXTS).repartition(3), unit).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(TEXTS) and {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i])[1:6] == expected(i, text, unit), (i, text)
        assert rows[i].back == (text or "")


@given(st.text(st.sampled_from("ab \n\t<>PSM🙂é́"), max_size=40), st.sampled_from(fm.UNITS))
def test_units_are_whole(text, unit):
    units = re.findall(PATTERN[unit], text)
    places = fm.boundaries(__import__("numpy").frombuffer(text.encode("utf-32-le"), "<u4"), unit).tolist()
    assert places == [0] + [sum(map(len, units[: i + 1])) for i in range(len(units))]


@given(st.text(st.sampled_from("ab<>PSM"), max_size=12), st.integers(0, 500))
def test_markers_never_meet_pieces(text, doc_id):
    """Ends of pieces and markers together make no other marker, so the first of a kind is the one put there."""
    draw = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    _, form, a, m, out = fm.cut(text, draw, "codepoints", 100, 20, fm.MARKERS)
    if form == "psm":
        prefix, rest = out.removeprefix("<P>").split("<S>", 1)
        suffix, middle = rest.split("<M>", 1)
        assert prefix + middle + suffix == text and (len(prefix), len(middle)) == (a, m)


def test_ids_may_be_null_or_repeated(spark):
    texts, ids = ["same text", "same text", "another", None, "no id"], [5, 5, 5, None, None]
    found = fm.fill_middle(documents(spark, texts, ids)).drop("doc_id").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(expected(i, t)) for i, t in zip(ids, texts))


def test_shares_and_names(spark):
    docs = spark.createDataFrame([(f"k{i}", "some words here") for i in range(400)], "n string, body string")
    kinds = lambda **a: {r.form for r in fm.fill_middle(docs.withColumnRenamed("n", "key"), id_col="key", text_col="body", **a).collect()}
    assert kinds(plain_percent=100) == {"plain"} and kinds(plain_percent=0, spm_percent=100) == {"spm"} and kinds(plain_percent=0, spm_percent=0) == {"psm"}
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "P<", "<M>")):
        with pytest.raises(ValueError):
            fm.fill_middle(docs, markers=bad, text_col="body", id_col="n")


def test_empty_table(spark):
    assert fm.fill_middle(documents(spark, [])).count() == 0
