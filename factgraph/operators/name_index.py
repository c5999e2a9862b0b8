"""A stored inverted index of names, for globs, parts of names and near names.

Each name has keys: itself, its trigrams between marks for its begin and end, and its thirds, or of a short
one what is left when up to two characters are deleted. They lie in folders by kind and by bucket of the key's checksum, and
the keys of a question are few and known beforehand, so a look-up opens the buckets of its keys and
nothing else. What comes back is verified by the very predicates that a scan uses, so
both give the same rows. Names that are added later are appended.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import text as tx
from factgraph.operators.resolve import first_by

BEGIN, END = "\x02", "\x03"
#: Names up to this length have a key for each deletion of up to two characters, 37 at most; longer ones have their thirds, of which two edits leave one.
SHORT = 8
_SCHEMA = "key string, name string, kind string, bucket int"


def trigrams(pattern: str) -> set[str]:
    """The trigrams that every name has which a glob (or a whole name) means."""
    parts = re.split(r"[*?]", f"{BEGIN}{pattern.lower()}{END}")
    return {p[i : i + 3] for p in parts for i in range(len(p) - 2)}


def deletions(name: str, most: int) -> set[str]:
    out = {name}
    for n in range(1, min(most, len(name)) + 1):
        out |= {"".join(c for i, c in enumerate(name) if i not in gone) for gone in combinations(range(len(name)), n)}
    return out


def thirds(length: int) -> list[tuple[int, int]]:
    cut = [0, length // 3, 2 * length // 3, length]
    return list(zip(cut, cut[1:]))


def near_keys(name: str, most: int) -> set[str]:
    """Keys of which every name within `most` (up to 2) edits has one."""
    name = name.lower()
    keys = deletions(name, most) if len(name) <= SHORT + most else set()
    for length in range(max(SHORT + 1, len(name) - most), len(name) + most + 1):
        for i, (a, b) in enumerate(thirds(length)):
            keys |= {f"{length}\0{i}\0{name[a + shift : b + shift]}" for shift in range(-most, most + 1) if a + shift >= 0 and b + shift <= len(name)}
    return keys


class NameIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def create(cls, names: DataFrame, path: str, column: str = "name", buckets: int = 64) -> NameIndex:
        """Indexes the distinct names of a table; a null has none."""
        index = cls(names.sparkSession, path, buckets)
        index._write(names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct())
        return index

    def append(self, names: DataFrame, column: str = "name") -> None:
        """Adds the names that aren't there yet; the same again adds nothing."""
        new = names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct()
        self._write(new.join(self._all(), "name", "left_anti"))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.crc32(key.cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, names: DataFrame) -> None:
        low = F.lower("name")
        marked = F.concat(F.lit(BEGIN), low, F.lit(END))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3))))
        grams = F.when(F.length(marked) < 3, F.array().cast("array<string>")).otherwise(grams)
        without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        once = F.when(F.length(low) == 0, F.array().cast("array<string>")).otherwise(without(low))
        twice = F.flatten(F.transform(once, lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(without(s))))
        n = F.length(low)
        cut = [F.lit(0), F.floor(n / 3), F.floor(n * 2 / 3), n]
        third = F.array(*[F.concat_ws("\0", n.cast("string"), F.lit(str(i)), F.substring(low, (cut[i] + 1).cast("int"), (cut[i + 1] - cut[i]).cast("int"))) for i in range(3)])
        near = F.when(n <= SHORT, F.array_distinct(F.concat(F.array(low), once, twice))).otherwise(third)
        of_kind = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
        kinds = F.concat(of_kind("name", F.array(low)), of_kind("gram", grams), of_kind("near", near))
        # spread over a fixed number of tasks: names are few bytes, so Spark would make all their keys in one. By a hash, as an
        # exchange by name itself is left out after one that distinct makes
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        rows = names.repartition(parts, F.xxhash64("name")).select("name", F.inline(kinds)).withColumn("bucket", self._bucket(F.col("key")))
        # a folder's rows in one task, so that it gets one file a write
        rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "key").write.mode("append").partitionBy("kind", "bucket").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def _all(self) -> DataFrame:
        return self._rows().filter("kind = 'name'").select("name")

    def _with(self, kind: str, keys: Iterable[str]) -> DataFrame:
        """(key, name) of some keys, from their buckets alone."""
        keys = sorted(keys)
        held = sorted({zlib.crc32(k.encode()) % self.buckets for k in keys})
        return self._rows().filter((F.col("kind") == kind) & F.col("bucket").isin(held) & F.col("key").isin(keys)).select("key", "name")

    def matching(self, pattern: str) -> DataFrame:
        """(name) of all names that are equal to a pattern ignoring case, or that it means as a glob.

        A glob without three characters in a row, its ends counted, is held against all names.
        """
        if not tx.is_glob(pattern):
            found = self._with("name", [pattern.lower()]).select("name")
        elif grams := trigrams(pattern):
            found = self._with("gram", grams).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("name")
        else:
            found = self._all()
        return found.filter(tx.name_matches(F.col("name"), pattern))

    def near(self, name: str, most: int | None = None) -> DataFrame:
        """(name, distance) of the names that differ from one by 1 to `most` edits ignoring case; None: by the budget of its length, at most 2."""
        most = tx.fuzzy_budget(name) if most is None else most
        if not 0 < most <= 2:
            raise ValueError("an index knows names within 1 or 2 edits")
        found = self._with("near", near_keys(name, most)).select("name").distinct()
        return found.withColumn("distance", tx.edit_distance(F.col("name"), F.lit(name), most)).filter("distance > 0")

    def find_symbol(self, symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
        """resolve.find_symbol by the index: symbols are joined with the names that are meant."""
        return first_by(symbols.join(self.matching(name), "name", "left_semi").filter(tx.kind_matches(kind)), ["display"], ["sym_ord"])
