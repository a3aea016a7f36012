"""Column functions over arrays: values computed once inside lambdas, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where it would be computed anew at each step of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sum (or another ``op``) of an array, itself included: in blocks of the square root of its size, as an
    accumulated list is copied at every step."""

    def scan(a: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
        return bound(a, lambda v: F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1), step))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        return bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda j: scan(F.slice(v, j * w + 1, w))))

    def joined(blocks: Column) -> Column:
        totals = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
        raised = lambda t, b, j: F.when(j == 0, b).otherwise(bound(F.get(t, j - 1), lambda base: F.transform(b, lambda x: op(base, x))))
        return bound(totals, lambda t: F.flatten(F.transform(blocks, lambda b, j: raised(t, b, j))))

    return bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(bound(whole(v), joined)))
