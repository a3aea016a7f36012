"""Queries over relations: line items and orders as (k, v) and (k, l, v) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs.token_jobs import Q
from tessera.operators import relations as R
from tessera.operators.chunks import chunked
from tessera.runtime import table

QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Q) -> Q:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def ab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    item = table(spark, d, "lineitem")
    a = item.where("l_quantity <= 25").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"))
    b = item.where("l_quantity >= 20").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"))
    return R.relation(a), R.relation(b)


AB = "WITH a AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS v FROM lineitem WHERE l_quantity <= 25), b AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS v FROM lineitem WHERE l_quantity >= 20)"


def triples(spark: SparkSession, d: str) -> DataFrame:
    return R.relation(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("v")))


T = "WITH t AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS l, l_suppkey AS v FROM lineitem)"


@query("r1_relation", f"{AB} SELECT * FROM a")
def r1(spark, d):
    return ab(spark, d)[0]


@query("r2_union", f"{AB} SELECT * FROM a UNION SELECT * FROM b")
def r2(spark, d):
    return R.union(*ab(spark, d))


@query("r2_union_changed", f"{AB} SELECT count(*) > 0 AS changed FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def r2c(spark, d):
    return R.adds(*ab(spark, d))


@query("r3_subtract", f"{AB} SELECT * FROM a EXCEPT SELECT * FROM b")
def r3(spark, d):
    return R.subtract(*ab(spark, d))


@query("r3_subtract_changed", f"{AB} SELECT count(*) > 0 AS changed FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def r3c(spark, d):
    return R.removes(*ab(spark, d))


@query("r4_remove_keys", f"{AB} SELECT * FROM a WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def r4(spark, d):
    return R.remove_keys(ab(spark, d)[0], table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("k")))


@query("r4_retain_keys", f"{AB} SELECT * FROM a WHERE k IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def r4r(spark, d):
    return R.retain_keys(ab(spark, d)[0], table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("k")))


@query("r4_filter_keys", f"{AB} SELECT * FROM a WHERE k % 7 = 3")
def r4f(spark, d):
    return R.filter_keys(ab(spark, d)[0], F.col("k") % 7 == 3)


@query("r5_inverse", f"{T} SELECT v AS k, l, k AS v FROM t")
def r5(spark, d):
    return R.inverse(triples(spark, d))


@query("r5_swap_keys", f"{T} SELECT l AS k, k AS l, v FROM t")
def r5s(spark, d):
    return R.swap_keys(triples(spark, d))


@query("r6_key_set", f"{AB} SELECT DISTINCT k FROM a")
def r6k(spark, d):
    return R.key_set(ab(spark, d)[0])


@query("r6_value_set", f"{AB} SELECT DISTINCT v FROM a")
def r6v(spark, d):
    return R.value_set(ab(spark, d)[0])


@query("r7_contains", f"{AB} SELECT * FROM b INTERSECT SELECT * FROM a")
def r7(spark, d):
    a, b = ab(spark, d)
    return R.contains(a, b)


@query("r7_contains_key", f"{AB} SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT k FROM a)")
def r7k(spark, d):
    return R.contains_key(ab(spark, d)[0], table(spark, d, "part").select(F.col("p_partkey").alias("k")))


@query("r7_submap_and_equals", f"{AB}, u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM u)) = 0 AS submap, (SELECT count(*) FROM a) = (SELECT count(*) FROM u) AS equal")
def r7s(spark, d):
    a, b = ab(spark, d)
    both = R.union(a, b)
    return R.submap_of(a, both).crossJoin(R.equals(a, both))  # one row each


@query("r8_image", f"{AB} SELECT p_partkey AS k, coalesce(s, '') AS image FROM part LEFT JOIN (SELECT k, string_agg(v, ',' ORDER BY v) AS s FROM a GROUP BY k) ON k = p_partkey")
def r8(spark, d):
    found = R.image(ab(spark, d)[0], table(spark, d, "part").select(F.col("p_partkey").alias("k")))
    return found.select("k", F.array_join("values", ",").alias("image"))


@query("r8_image_chunks", "WITH r AS (SELECT l_returnflag AS k, l_orderkey * 10 + l_linenumber AS v FROM lineitem), n AS (SELECT k, v, (row_number() OVER (PARTITION BY k ORDER BY v) - 1) // 500 AS chunk FROM r) SELECT k, chunk, string_agg(v, ',' ORDER BY v) AS image FROM n GROUP BY k, chunk")
def r8_chunks(spark, d):
    """Images of three keys that hold all line items, 500 values a row."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"))
    return chunked(rows, ["k"], "v", 500).select("k", "chunk", F.array_join("values", ",").alias("image"))


@query("r9_filter_images", f"{T} SELECT k, l, v FROM t WHERE k IN (SELECT k FROM t GROUP BY k HAVING max(v) - min(v) > 90)")
def r9(spark, d):
    wide = lambda x: F.array_max(F.transform(x, lambda s: s["v"])) - F.array_min(F.transform(x, lambda s: s["v"])) > 90
    return R.filter_images(triples(spark, d), wide)


@query("r9_filtered", f"{T} SELECT * FROM t WHERE l = 2 AND v % 2 = 0")
def r9f(spark, d):
    return triples(spark, d).where("l = 2 AND v % 2 = 0")


_MERGE = "WITH x AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 3 != 0), y AS (SELECT o_orderkey AS k, o_totalprice / 2 AS p FROM orders WHERE o_orderkey % 3 != 1)"


@query("j14_merge_relations", f"{_MERGE} SELECT k, CASE WHEN x.p IS NULL THEN y.p WHEN y.p IS NULL THEN x.p ELSE greatest(x.p, y.p) END AS p, x.p IS NULL OR greatest(x.p, coalesce(y.p, x.p)) != x.p AS changed FROM x FULL JOIN y USING (k)")
def j14(spark, d):
    o = table(spark, d, "orders")
    x = o.where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    y = o.where("o_orderkey % 3 != 1").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 2).alias("p"))
    return R.merge_relations(x, y, ["k"], "p", F.greatest)


_PRICES = "WITH p AS (SELECT l_partkey AS k, l_suppkey AS l, max(l_extendedprice) AS v FROM lineitem WHERE l_linenumber < 3 GROUP BY ALL)"


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linenumber < 3").groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("l")).agg(F.max("l_extendedprice").alias("v"))


@query("j15_upsert", f"{_PRICES}, n AS (SELECT l_partkey AS k, l_suppkey AS l, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS v FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL) SELECT k, l, coalesce(n.v, p.v) AS v FROM p FULL JOIN n USING (k, l)")
def j15(spark, d):
    new = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("l"), F.col("l_extendedprice").alias("v"), F.struct("l_shipdate", "l_orderkey", "l_extendedprice").alias("at"))
    return R.upsert(_prices(spark, d), new, ["k", "l"], "v", "at")


@query("j15_update", f"{_PRICES}, n AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS l FROM lineitem WHERE l_linenumber = 3) SELECT coalesce(p.k, n.k) AS k, coalesce(p.l, n.l) AS l, CASE WHEN n.k IS NULL THEN p.v ELSE coalesce(p.v + 1, 0) END AS v FROM p FULL JOIN n ON p.k = n.k AND p.l = n.l")
def j15u(spark, d):
    keys = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("l"))
    return R.update(_prices(spark, d), keys, ["k", "l"], "v", lambda v: F.coalesce(v + 1, F.lit(0)))


@query("j16_lookup", f"{_PRICES} SELECT l_orderkey AS o, l_partkey AS k, l_suppkey AS l, coalesce(v, -1) AS v FROM lineitem LEFT JOIN p ON l_partkey = k AND l_suppkey = l")
def j16(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("l"))
    return R.lookup(_prices(spark, d), keys, ["k", "l"], "v", F.lit(-1.0))
