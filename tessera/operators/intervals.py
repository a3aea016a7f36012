"""Points in intervals by an equi-join.

Every interval lies in one aligned bin: the smallest of a power of two of places that holds it whole. A point lies in one
bin of each size, so it is offered once a size and meets only intervals that lie in its bins; no interval is copied, and no
point meets all intervals of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of bins, as powers of two; places are below the last.
SIZES = range(33)


def _size(start: Column, end: Column) -> Column:
    """How many binary digits from the right two places differ in."""
    return F.when(start == end, 0).otherwise(F.length(F.bin(start.cast("long").bitwiseXOR(end.cast("long")))))


def holding(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Points with every interval of their keys that holds them, both ends included. Columns other than keys do not clash."""
    where = F.col(at).cast("long")
    sizes = points.sparkSession.range(0, len(SIZES), 1, 1).select(F.col("id").cast("int").alias("_size"))  # joined, so that the planner sees points grow
    offered = points.crossJoin(F.broadcast(sizes)).withColumn("_bin", F.call_function("shiftright", where, F.col("_size")))
    placed = intervals.withColumn("_size", _size(F.col(start), F.col(end))).withColumn("_bin", F.expr(f"shiftright(CAST({start} AS BIGINT), _size)"))
    return offered.join(placed, [*keys, "_size", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_size", "_bin")
