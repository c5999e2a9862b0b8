"""Look-ups by the index give what a scan gives, and read their keys' buckets alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators import resolve
from factgraph.operators.name_index import SHORT, NameIndex, near_keys, trigrams
from tests.test_operators import symbols

R = random.Random(9)
LONG = "AbstractVeryLongFactoryBuilderProviderAdapterBean"
NAMES = ["", "a", "ab", "Ab", "abc", "Äpfel", "äpfelchen", "日本語の名", "x*y", "a.b", LONG, LONG.lower(), LONG + "s", LONG[1:], LONG[:20] + "X" + LONG[21:], LONG[:9] + LONG[10:30] + LONG[31:]]
NAMES += ["".join(R.choice("abCd") for _ in range(R.randint(0, 7))) for _ in range(150)]
NAMES += ["".join(R.choice("ab") for _ in range(SHORT + R.randint(-2, 3))) for _ in range(10)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(n,) for n in [*NAMES[:80], None, *NAMES[:5]]], "name string")
    made = NameIndex.create(rows, f"{tmp_path_factory.mktemp('index')}/names", buckets=32)
    later = spark.createDataFrame([(n,) for n in NAMES[40:]], "name string")
    made.append(later)
    before = made._rows().count()
    made.append(later)  # adds nothing
    assert made._rows().count() == before
    return made


@pytest.fixture(scope="module")
def scanned(spark):
    return spark.createDataFrame([(n,) for n in set(NAMES)], "name string").cache()


@pytest.mark.parametrize("pattern", ["abc", "ABC", "", "nothing", "*", "*a*", "?b", "ab*", "*cd", "*abc*", "a?b*c", "ÄPF*", "*FACTORY*bean?", "日本*", "x*y", "*.b", "a.b", "????", "b*b"])
def test_patterns(index, scanned, pattern):
    found = [r.name for r in index.matching(pattern).collect()]
    assert sorted(found) == sorted(r.name for r in scanned.filter(tx.name_matches(F.col("name"), pattern)).collect())


@pytest.mark.parametrize("name", ["abc", "abcd", "ba", "", "abCdab", "bbbbbbb", "äpfel", LONG, LONG[:5] + LONG[7:], "x" + LONG, "ab" * 20, "ab" * 21, "a" + "ab" * 20])
@pytest.mark.parametrize("most", [None, 1, 2])
def test_near_names(index, scanned, name, most):
    budget = tx.fuzzy_budget(name) if most is None else most
    scan = scanned.withColumn("distance", tx.edit_distance(F.col("name"), F.lit(name), budget)).filter("distance > 0")
    assert sorted(map(tuple, index.near(name, most).collect())) == sorted(map(tuple, scan.collect()))


def test_only_buckets_of_keys_are_read(index):
    for found, kind, keys in ((index.matching("*factory*"), "gram", trigrams("*factory*")), (index.matching("abc"), "name", {"abc"}), (index.near("abc", 1), "near", near_keys("abc", 1))):
        pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", found._jdf.queryExecution().toString())
        buckets = re.search(r"bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", pruned[1])
        assert f"= {kind})" in pruned[1] and 1 <= len((buckets[1] or buckets[2]).split(",")) <= len(keys) < 32
        assert "key" in pruned[2]


def test_symbols(spark, index):
    rows = symbols(spark, {"name": "abc"}, {"name": "ABC", "type_kind": "interface"}, {"name": "abcd", "kind": "Method"})
    index.append(rows)
    for ask in (("abc",), ("ab*",), ("ABC", "interface"), ("a*", "method")):
        assert sorted(map(repr, index.find_symbol(rows, *ask).collect())) == sorted(map(repr, resolve.find_symbol(rows, *ask).select(*index.find_symbol(rows, *ask).columns).collect()))
    with pytest.raises(ValueError):
        index.near("abc", 3)
