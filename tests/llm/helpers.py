"""Small tables with everything that texts can be."""

import random
import re

import pytest

EXTRA = "_row string, name string, component string, place int, id string, block long, region string, bucket int, part int, label int, _id int, _block int, shard string, n int, low int, salt int, item_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, texts, ids=None):
    """(doc_id, text) and columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    extra = ("w", "m", "c", 1, "x", 1, "r", 1, 1, 1, 1, 1, "s", 1, 1, 1, "i")
    rows = [(i, t, *extra) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


def odd_texts(seed=5):
    """Copies, near copies, nulls, empty and very long texts, shared passages, odd characters."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Ümlaut", "naïve", "x1", "data—dash", "it's", "über", "日本", "🙂"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(200)
    out = [None, "", "   ", "\t\n\x0b\x0c\r", "one", "One", "one two", "one  two", "a b c", "A B C", base, base, base.upper(), base.replace(" ", "\n")]
    for _ in range(8):
        w = base.split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [f"{text(30)} {passage} {text(20)}" for _ in range(4)] + [f"{passage} {passage}"]
    out += [text(r.randint(1, 120)) for _ in range(30)]
    out += [text(5000), "word " * 3000, "z" * 20_000, "a\x00b \x1f c", "same " * 19, "same " * 20, "same " * 21, "<|endoftext|> x", "<|startoftext|><|endoftext|>"]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, odd_texts()).repartition(3).cache()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
