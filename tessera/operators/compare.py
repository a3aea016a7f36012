"""Comparing equivalences: static against dynamic, whole against part; library code against the rest.

Groups are given by token: (app, name, item, rep), rep being the group's first item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import by_size, connected_components, tied
from tessera.runtime import small, written

KEYS = ["app", "name"]


def token_heads(tokens: DataFrame) -> DataFrame:
    """(app, name, item, rep): every token with the least token of its group; the head is joined back, not windowed. Heads
    are counted and, if few, come to the tokens, which are read twice: give written ones."""
    item = F.struct("source_id", "pos")
    heads = small(written(tokens.groupBy(*KEYS, "rep").agg(F.min(item).alias("head"))))
    return tokens.join(heads, [*KEYS, "rep"]).select(*KEYS, item.alias("item"), F.col("head").alias("rep"))


def non_subset_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(app, name, rep, item): pairs together in ``small`` but apart in ``large``; missing there is one place of its own."""
    a = large.select(*KEYS, F.col("item").alias("rep"), F.col("rep").alias("_r1"))
    b = large.select(*KEYS, "item", F.col("rep").alias("_r2"))
    joined = small.join(a, [*KEYS, "rep"], "left").join(b, [*KEYS, "item"], "left")
    return joined.where(~F.col("_r1").eqNullSafe(F.col("_r2"))).select(*KEYS, "rep", "item")


def is_subset(small: DataFrame, large: DataFrame) -> DataFrame:
    """(app, subset): is every pair of ``small`` a pair of ``large``? An item unknown there is not."""
    unknown = small.join(large.select(*KEYS, "item"), [*KEYS, "item"], "left_anti").select(*KEYS, "rep", "item")
    bad = non_subset_pairs(small, large).unionByName(unknown).groupBy("app").agg(F.count(F.lit(1)).alias("_n"))
    return small.select("app").distinct().join(bad, "app", "left").select("app", F.col("_n").isNull().alias("subset"))


def compare_by_name(whole: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs together in ``other`` but apart in ``whole``, for names that both have."""
    return non_subset_pairs(other.join(whole.select(*KEYS).distinct(), KEYS, "left_semi"), whole)


def tokens_with_objects(tokens: DataFrame, expr_ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Property tokens with the run-time objects of their base; unknown expression ids fall out."""
    of_base = expr_ids.select("app", "source_id", F.col("node_id").alias("base_node"), "expr_id")
    return tokens.join(of_base, ["app", "source_id", "base_node"]).join(aliases.select("app", "expr_id", "obj"), ["app", "expr_id"]).drop("expr_id").distinct()


def objects_at(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("app", "expr_id").agg(F.array_sort(F.collect_set("obj")).alias("objects"))


def flows_to(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("app", "obj").agg(F.array_sort(F.collect_set("expr_id")).alias("expressions"))


def dynamic_components(token_objects: DataFrame) -> DataFrame:
    """(app, name, item, rep): tokens of a name that share an object are together, through any chain. A token comes in a row
    for each obj, or in one with the list objs.

    Names of few rows are dealt out by name. In the others each object ties its tokens to the least of them: a star, however
    many tokens it has.
    """
    lists = "objs" in token_objects.columns
    ties = "objs" if lists else "obj"
    rows = written(token_objects.select(*KEYS, ties, F.struct("source_id", "pos").alias("item")))
    few, wide = by_size(rows, KEYS, F.size(ties) if lists else None)
    parts = [tied(few, KEYS, "item", ties)] if few is not None else []
    if wide is not None:
        parts.append(_by_stars(wide.select(*KEYS, F.explode(ties).alias("obj"), "item") if lists else wide))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("node", "item")


def _by_stars(rows: DataFrame) -> DataFrame:
    least = rows.groupBy(*KEYS, "obj").agg(F.min("item").alias("src"))
    edges = rows.join(least, [*KEYS, "obj"]).select(*KEYS, "src", F.col("item").alias("dst")).distinct()
    return connected_components(edges, "src", "dst", KEYS)


def suspicious_static_pairs(static: DataFrame, dynamic: DataFrame, show_dead: bool = False) -> DataFrame:
    """Pairs that types put together but run-time objects put apart.

    Only names with a live token; a pair is dead when one of its tokens has no object, and dead ones are hidden by default.
    """
    dynamic = written(dynamic)  # met three times
    names = small(dynamic.select(*KEYS).distinct())
    static = static.join(names, KEYS, "left_semi")
    # heads are as few as groups: only they are looked for as heads, and tokens move once, to their own run-time groups
    heads = written(static.select(*KEYS, "rep").distinct())
    met = dynamic.select(*KEYS, F.col("item").alias("rep"), F.col("rep").alias("_r1")).join(small(heads), [*KEYS, "rep"])
    joined = static.join(dynamic.select(*KEYS, "item", F.col("rep").alias("_r2")), [*KEYS, "item"], "left").join(small(written(met)), [*KEYS, "rep"], "left")
    marked = joined.where(~F.col("_r1").eqNullSafe(F.col("_r2")))
    marked = marked.select(*KEYS, "rep", "item", (F.col("_r1").isNull() | F.col("_r2").isNull()).alias("dead"))
    return marked if show_dead else marked.where(~F.col("dead"))


def token_coverage(tokens: DataFrame, token_objects: DataFrame, keys: list[str]) -> DataFrame:
    """Per app, percent of tokens with at least one object."""
    seen = token_objects.select(*keys).distinct().withColumn("_seen", F.lit(1))
    rows = tokens.select(*keys).distinct().join(seen, keys, "left")
    return rows.groupBy("app").agg((F.lit(100.0) * F.count("_seen") / F.count(F.lit(1))).alias("coverage"))


def _begins(path: Column, prefix: Column, boundary: bool) -> Column:
    return path.startswith(prefix) & (F.lit(True) if not boundary else (F.length(path) == F.length(prefix)) | (F.substring(path, F.length(prefix) + 1, F.lit(1)) == "/"))


def prefixes_of(sources: DataFrame, libs: DataFrame, path_boundary: bool = False) -> DataFrame:
    """The sources that lie in a library: an equi-join on each of the lengths that library paths have, so no theta join."""
    lengths = libs.select(F.length("path_prefix").alias("n")).distinct()
    lengths = lengths.agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    each = sources.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("lengths"))  # one row: the distinct lengths
    cut = each.where(F.length("path") >= F.col("_n")).withColumn("path_prefix", F.substring(F.col("path"), F.lit(1), F.col("_n")))
    met = cut.join(libs.select("app", "path_prefix").distinct(), ["app", "path_prefix"], "left_semi")
    return met.where(_begins(F.col("path"), F.col("path_prefix"), path_boundary)).select(*sources.columns).distinct()


def in_library(sources: DataFrame, libs: DataFrame, path_boundary: bool = False) -> DataFrame:
    return prefixes_of(sources, libs, path_boundary)


def without_library(sources: DataFrame, libs: DataFrame, path_boundary: bool = False) -> DataFrame:
    inside = prefixes_of(sources, libs, path_boundary).select("app", "path").distinct()
    return sources.join(inside, ["app", "path"], "left_anti")


def only_library(sources: DataFrame, libs: DataFrame, key: str) -> DataFrame:
    return prefixes_of(sources, libs.where(F.col("key") == key))


def compare_isolated(whole: DataFrame, isolated: DataFrame) -> DataFrame:
    """(app, effect, delta, suspicious): tokens typed with and without the rest of the program."""
    from tessera.operators import tokens as K

    whole, isolated = written(whole), written(isolated)  # read for their statistics and for their heads
    stats = lambda t: K.app_stats(K.name_stats(K.group_sizes(t)))
    delta = K.effect_delta(stats(whole), stats(isolated))
    pairs = compare_by_name(token_heads(whole), token_heads(isolated)).groupBy("app").agg(F.count(F.lit(1)).alias("suspicious"))
    return delta.join(pairs, "app", "left").select("app", "effect", "delta", F.coalesce("suspicious", F.lit(0)).alias("suspicious"))


def compare_counted(groups: DataFrame) -> DataFrame:
    """``compare_isolated`` for tokens that come counted: (app, name, whole, part, n, head), n tokens whose class is ``whole``
    with the rest of the program and ``part`` without, head the least of them. A part's pairs lead from its least token, so
    those that the whole puts apart are its tokens of other classes there."""
    from tessera.operators import tokens as K

    groups = written(groups.groupBy(*KEYS, "whole", "part").agg(F.sum("n").alias("n"), F.min("head").alias("head")))
    stats = lambda of: K.app_stats(K.name_stats(groups.groupBy(*KEYS, F.col(of).alias("rep")).agg(F.sum("n").alias("size"))))
    delta = K.effect_delta(stats("whole"), stats("part"))
    apart = groups.groupBy(*KEYS, "part").agg((F.sum("n") - F.min_by("n", "head")).alias("apart"))
    pairs = apart.groupBy("app").agg(F.sum("apart").alias("suspicious"))
    return delta.join(pairs, "app", "left").select("app", "effect", "delta", F.coalesce("suspicious", F.lit(0)).alias("suspicious"))
