"""Relations as tables: binary (k, v) and ternary (k, l, v), their set algebra and keyed merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relation(rows: DataFrame) -> DataFrame:
    """Distinct bindings."""
    return rows.distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def adds(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: would the union with b change a?"""
    return _any(b.join(a, a.columns, "left_anti"), "changed")


def removes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: would subtracting b change a?"""
    return _any(a.join(b, a.columns, "left_semi"), "changed")


def _any(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg((F.count(F.lit(1)) > 0).alias(name))


def remove_keys(a: DataFrame, keys: DataFrame, on: Sequence[str] = ("k",)) -> DataFrame:
    return a.join(keys, list(on), "left_anti")


def retain_keys(a: DataFrame, keys: DataFrame, on: Sequence[str] = ("k",)) -> DataFrame:
    return a.join(keys, list(on), "left_semi")


def filter_keys(a: DataFrame, pred: Column) -> DataFrame:
    return a.where(pred)


def inverse(a: DataFrame) -> DataFrame:
    """(k, v) becomes (v, k), (k, l, v) becomes (v, l, k), columns named as before."""
    names = a.columns
    return a.select(*[F.col(c).alias(n) for n, c in zip(names, [names[-1], *names[1:-1], names[0]], strict=True)])


def swap_keys(a: DataFrame) -> DataFrame:
    """(k, l, v) becomes (l, k, v)."""
    k, l_, v = a.columns
    return a.select(F.col(l_).alias(k), F.col(k).alias(l_), v)


def key_set(a: DataFrame) -> DataFrame:
    return a.select(a.columns[0]).distinct()


def value_set(a: DataFrame) -> DataFrame:
    return a.select(a.columns[-1]).distinct()


def contains(a: DataFrame, bindings: DataFrame) -> DataFrame:
    """The bindings that a has."""
    return bindings.join(a, bindings.columns, "left_semi")


def contains_key(a: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that have a binding."""
    return keys.join(a, keys.columns, "left_semi")


def submap_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: has b all bindings of a?"""
    return a.join(b, a.columns, "left_anti").agg((F.count(F.lit(1)) == 0).alias("submap"))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: same bindings? Both sides are summed once, by a count of each binding's sides."""
    sides = a.distinct().withColumn("_s", F.lit(1)).unionByName(b.distinct().withColumn("_s", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.sum("_s").alias("_s")).agg((F.count_if(F.col("_s") != 3) == 0).alias("equal"))


def image(a: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, values): sorted set of values of each asked key, empty if there is none."""
    k, v = a.columns[0], a.columns[-1]
    sets = a.join(keys, k, "left_semi").groupBy(k).agg(F.array_sort(F.collect_set(v)).alias("values"))
    return keys.distinct().join(sets, k, "left").withColumn("values", F.coalesce("values", F.array().cast(sets.schema["values"].dataType)))


def filter_images(a: DataFrame, pred: Callable[[Column], Column]) -> DataFrame:
    """Ternary: whole first keys whose image, an array of (l, v), satisfies the predicate."""
    k, l_, v = a.columns
    images = a.groupBy(k).agg(F.collect_set(F.struct(l_, v)).alias("image"))
    return images.where(pred(F.col("image"))).select(k, F.inline("image"))


def merge_relations(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, value, changed): all keys of both; common ones combined; changed where the result is not the left value."""
    a, b = left.select(*on, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), right.select(*on, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, list(on), "full_outer")
    out = F.when(F.col("_in_a").isNull(), F.col("_b")).when(F.col("_in_b").isNull(), F.col("_a")).otherwise(combine(F.col("_a"), F.col("_b")))
    return both.select(*on, out.alias(value), (F.col("_in_a").isNull() | ~out.eqNullSafe(F.col("_a"))).alias("changed"))


def upsert(old: DataFrame, rows: DataFrame, on: Sequence[str], value: str, order: str) -> DataFrame:
    """Last row (by ``order``) of each key wins over the old value."""
    new = rows.groupBy(*on).agg(F.max_by(value, order).alias("_new"))
    return old.join(new, list(on), "full_outer").select(*on, F.coalesce("_new", value).alias(value))


def update(old: DataFrame, keys: DataFrame, on: Sequence[str], value: str, f: Callable[[Column], Column]) -> DataFrame:
    """f over the old value, or over null where there is none, at the given keys."""
    marked = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return old.join(marked, list(on), "full_outer").select(*on, F.when(F.col("_hit"), f(F.col(value))).otherwise(F.col(value)).alias(value))


def lookup(old: DataFrame, keys: DataFrame, on: Sequence[str], value: str, default: Column) -> DataFrame:
    return keys.join(old, list(on), "left").select(*keys.columns, F.coalesce(value, default).alias(value))
