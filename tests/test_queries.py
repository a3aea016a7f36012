"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.jobs import registry

@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


def spelled(rows, columns):
    return sorted(tuple(f"{r[c]:.6f}" if isinstance(r[c], float) else repr(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf, duck):
    found = registry.QUERIES[name](spark, sf)
    got = duck.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in got.description)
    want = [dict(zip([c[0] for c in got.description], r, strict=True)) for r in got.fetchall()]
    assert sorted(found.columns) == columns
    assert spelled([r.asDict() for r in found.collect()], columns) == spelled(want, columns)


def test_every_query_is_registered_with_its_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_questions_of_all_names(spark, sf):
    """Every name of the tokens is asked for, and every token stands in one question."""
    from tessera.jobs import bindings

    tokens = bindings.tokens(spark, sf).select("app", "name", "source_id")
    for name, asked in (("a3_property_questions", tokens.where("source_id % 5 != 0")), ("e6_order_questions", tokens)):
        found = registry.QUERIES[name](spark, sf).selectExpr("app", "name", "size(split(tokens, '[, ]')) AS n").groupBy("app", "name").sum("n")
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in asked.groupBy("app", "name").count().collect()}


def test_chained_components(spark, sf):
    """The objects are those of all line items but a share, and some components are more than the tokens of one object."""
    from pyspark.sql import functions as F

    from tessera.jobs import bindings, compare_jobs

    tokens, found = bindings.tokens(spark, sf), compare_jobs._chained(spark, sf)
    assert found.select("app", "name", "source_id", "pos").distinct().count() == tokens.where("source_id % 10 != 0").count()
    most = found.groupBy("app", "name", "obj").agg(F.count_distinct("source_id", "pos").alias("n")).groupBy("app", "name").agg(F.max("n").alias("most"))
    sizes = registry.QUERIES["a18_chained_components"](spark, sf).groupBy("app", "name", "rep").count()
    assert sizes.join(most, ["app", "name"]).where("count > most").count() > 0
