"""Ordered lists of keys that may hold any share of all rows: numbered and cut into chunks, so no task holds a key's list.

Rows are dealt by ranges of key and order, so a hot key lies in many ranges and a range holds no more than its share. A row's
place is its place in its range and the number of its key's rows in the ranges before, which is a row a key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import partitions, written


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "place") -> DataFrame:
    """Rows with their 1-based place in their key's order; rows of one order have places in no order. Null keys are one key."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_key", F.struct(*keys)))  # ranges hold from here on, whatever is lost
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order))
    met = ranged.withColumn("_inside", inside).join(counts.drop("_n"), ["_key", "_part"])
    return met.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(place))


def chunked(rows: DataFrame, keys: Sequence[str], value: str, size: int, order: Sequence[str] | None = None) -> DataFrame:
    """(keys, chunk, values): the values of each key in order, by default their own, ``size`` of them a row; chunks from 0."""
    placed = numbered(rows, keys, order or [value], "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size))
    lists = placed.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("_place", F.col(value).alias("value")))).alias("_l"))
    return lists.select(*keys, "chunk", F.transform("_l", lambda x: x["value"]).alias("values"))
