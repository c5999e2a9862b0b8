"""Finding symbols by name: exact, by glob, fuzzy, with disambiguation, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as tx


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order: one partial aggregate, no sort of groups."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in an order: a later write wins."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_last"))
        .select(*keys, "_last.*")
        .select(*df.columns)
    )


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols with that name, ignoring case, or by glob; one row for each display string, the first scanned."""
    return first_by(symbols.filter(tx.name_matches(F.col("name"), name) & tx.kind_matches(kind)), ["display"], ["sym_ord"])


def fuzzy_search(symbols: DataFrame, name: str, kind: str | None = None, projects: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Exact matches, or else partial and near ones: symbols with match_quality and score, best first.

    Partial: the part after the last dot is a symbol's name; 1 if the display string
    holds the whole dotted name, 2 otherwise. Near: only for names without a dot, and
    only up to the first project in which anything was found; 3 + edit distance.
    """
    exact = find_symbol(symbols, name, kind).withColumn("match_quality", F.lit("exact")).withColumn("score", F.lit(0))
    rows = symbols.filter(tx.kind_matches(kind))
    if projects is not None:
        rows = rows.join(projects.select("project", F.col("ord").alias("_project_ord")), "project", "left")
    else:
        rows = rows.withColumn("_project_ord", F.lit(0))
    rows = rows.withColumn("_project_ord", F.coalesce("_project_ord", F.lit(0)))
    short = name.rsplit(".", 1)[-1]
    same_short = F.lower(F.col("name")) == short.lower()
    if "." in name:
        score = F.when(same_short & F.contains(F.lower("display"), F.lit(name.lower())), 1).when(same_short, 2)
    else:
        distance = tx.edit_distance(F.col("name"), F.lit(name), tx.fuzzy_budget(name))
        score = F.when(distance > 0, 3 + distance)
    near = rows.withColumn("score", score).filter("score IS NOT NULL")
    if "." not in name:
        first = near.agg(F.min("_project_ord").alias("_first"))
        near = near.join(F.broadcast(first), F.col("_project_ord") == F.col("_first")).drop("_first")
    quality = F.when(F.col("score") == 1, "partial_namespace").when(F.col("score") == 2, "short_name").otherwise("fuzzy")
    # of a display string the candidate scanned first counts, whatever its score
    near = first_by(near.withColumn("match_quality", quality), ["display"], ["_project_ord", F.col("score") > 2, "sym_ord"]).drop("_project_ord")
    none = exact.limit(1).groupBy().agg(F.count("*").alias("_exact"))
    near = near.join(F.broadcast(none), F.col("_exact") == 0).drop("_exact")
    # the cut is for near matches; exact ones all stay
    top = near.select(*exact.columns).orderBy("score", "sym_ord", "display").limit(most)
    return exact.unionByName(top)


def resolve(symbols: DataFrame, name: str, kind: str | None = None, file: str | None = None, line: int | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The one symbol that a name means: exact before fuzzy; of several the one in that file, else on that line, else the first."""
    found = fuzzy_search(symbols, name, kind, projects)
    rank = F.lit(2)
    if line is not None:
        rank = F.when(F.col("line") == line, 1).otherwise(rank)
    if file:
        rank = F.when(tx.path_ends_with(F.col("file"), file), 0).otherwise(rank)
    # fuzzy candidates are taken by score alone
    rank = F.when(F.col("match_quality") == "exact", F.coalesce(rank, F.lit(2))).otherwise(2)
    return found.orderBy("score", rank, "sym_ord", "display").limit(1)


def resolve_method(symbols: DataFrame, method: str, class_name: str | None = None) -> DataFrame:
    """The first method of that name, in the class of that simple name if one is given."""
    rows = symbols.filter(tx.kind_matches("method") & tx.name_matches(F.col("name"), method))
    if class_name:
        rows = rows.filter(tx.equals_ignore_case(F.col("container_name"), class_name))
    return rows.orderBy("sym_ord", "display").limit(1)


def _queries(spark, values: str) -> DataFrame:
    rows = [(i, v) for i, v in enumerate(tx.comma_list(values))]
    return spark.createDataFrame(rows, "pos int, query string")


def _asked(symbols: DataFrame, names: str) -> DataFrame:
    """symbols with the place `pos` of each query that means them: by an equi-join on names, and a filter for each glob."""
    plain = [(i, v.lower()) for i, v in enumerate(tx.comma_list(names)) if not tx.is_glob(v)]
    exact = symbols.sparkSession.createDataFrame(plain, "pos int, _key string")
    # as many rows as the caller typed
    found = symbols.withColumn("_key", F.lower("name")).join(F.broadcast(exact), "_key").select("pos", *symbols.columns)
    for i, v in enumerate(tx.comma_list(names)):
        if tx.is_glob(v):
            found = found.unionByName(symbols.filter(tx.name_matches(F.col("name"), v)).select(F.lit(i).alias("pos"), *symbols.columns))
    return found


def find_symbols_batch(symbols: DataFrame, names: str, kind: str | None = None) -> DataFrame:
    """Each name of a comma list on its own: (pos, query, matches array<string>, error). No match is a success."""
    found = _asked(symbols.filter(tx.kind_matches(kind)).select("name", "display", "sym_ord"), names)
    each = first_by(found.select("pos", "display", "sym_ord"), ["pos", "display"], ["sym_ord"])
    listed = each.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("sym_ord", "display"))), lambda x: x["display"]).alias("matches"))
    return _queries(symbols.sparkSession, names).join(listed, "pos", "left").select(
        "pos", "query", F.coalesce("matches", F.array().cast("array<string>")).alias("matches"), F.lit(None).cast("string").alias("error")
    )


def batch_totals(batch: DataFrame) -> DataFrame:
    return batch.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def _first_match(symbols: DataFrame, names: str) -> DataFrame:
    found = _asked(symbols, names)
    return found.groupBy("pos").agg(F.min_by(F.struct(*[F.col(c) for c in symbols.columns]), F.struct("sym_ord", "display")).alias("s"))


def public_api_batch(symbols: DataFrame, type_names: str) -> DataFrame:
    """Public members of each type of a comma list: (pos, query, type, members, error)."""
    from factgraph.operators.inspect import public_members

    asked = _queries(symbols.sparkSession, type_names)
    types = _first_match(symbols.filter(F.lower("kind") == "type"), type_names).select("pos", F.col("s.display").alias("type"))
    members = public_members(symbols, "batch").join(F.broadcast(types), F.col("container") == F.col("type"))
    one = F.struct("sym_ord", "name", "kind", "signature", "return_type")
    listed = members.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(one)), lambda m: F.concat_ws(" ", m["kind"], m["signature"])).alias("members"))
    return asked.join(types, "pos", "left").join(listed, "pos", "left").select(
        "pos", "query", "type",
        F.when(F.col("type").isNotNull(), F.coalesce("members", F.array().cast("array<string>"))).alias("members"),
        F.when(F.col("type").isNull(), F.concat(F.lit("Type not found: "), "query")).alias("error"),
    )


def symbol_detail_batch(symbols: DataFrame, names: str) -> DataFrame:
    """The first exact match of each name: (pos, query, display, kind, return_type, file, line, error)."""
    asked = _queries(symbols.sparkSession, names)
    found = _first_match(symbols, names)
    return asked.join(found, "pos", "left").select(
        "pos", "query", F.col("s.display").alias("display"), F.lower("s.kind").alias("kind"), F.col("s.return_type").alias("return_type"),
        F.col("s.file").alias("file"), F.col("s.line").alias("line"),
        F.when(F.col("s.display").isNull(), F.concat(F.lit("Symbol not found: "), "query")).alias("error"),
    )


def near_pairs(names: DataFrame, column: str = "name", most: int = 2) -> DataFrame:
    """(a, b, distance) of different names, a < b, at most `most` (1 or 2) edits apart, ignoring case.

    By deletion neighbourhoods: two names that near share a string that is left of each
    after at most `most` deletions, so they meet in an equi-join on it, and only names
    that meet are compared.
    """
    own = names.select(F.col(column).alias("n")).filter("n IS NOT NULL").distinct()
    shorter = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    left = F.array(F.lower("n"))
    for _ in range(most):
        left = F.array_distinct(F.concat(left, F.flatten(F.transform(left, shorter))))
    keyed = own.select("n", F.explode(left).alias("k"))
    met = keyed.alias("x").join(keyed.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.n") < F.col("y.n"))).select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct()
    return met.withColumn("distance", tx.edit_distance(F.col("a"), F.col("b"), most)).filter(F.col("distance").between(1, most))
