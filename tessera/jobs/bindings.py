"""Operator inputs drawn from the given tables: line items as name tokens, orders as a graph, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table

REP_MODULUS = 16


def tokens(spark: SparkSession, sf_dir: str, modulus: int = REP_MODULUS, by: str | None = None) -> DataFrame:
    """Distinct (app, name, rep, obj, source_id, pos): one big type class and three small ones for each name.
    ``by`` names a column to deal rows out by before they are made distinct."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = item.select(
        F.concat("l_returnflag", "l_linestatus").alias("app"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 1000).cast("string")).alias("name"),
        F.least(F.col("l_suppkey") % modulus, F.lit(3)).alias("rep"),
        F.col("l_suppkey").alias("obj"),
        F.col("l_orderkey").alias("source_id"),
        ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).cast("long").alias("pos"),
    )
    return (rows.repartition(by) if by else rows).distinct()


def token_sql(modulus: int = REP_MODULUS, name: str = "tok") -> str:
    return f"""{name} AS (SELECT DISTINCT l_returnflag || l_linestatus AS app, 'p' || (l_partkey % 1000) AS name, least(l_suppkey % {modulus}, 3) AS rep,
  l_suppkey AS obj, l_orderkey AS source_id, (CAST(l_linenumber AS BIGINT) * 100000 + l_partkey) * 100000 + l_suppkey AS pos FROM lineitem)"""


GROUP_SQL = "grp AS (SELECT app, name, rep, count(*) AS size FROM tok GROUP BY app, name, rep)"
STATS_SQL = "ns AS (SELECT *, 100.0 * (search_replace - rename) / search_replace AS effect FROM (SELECT app, name, CAST(sum(size) AS BIGINT) - 1 AS search_replace, count(*) - 1 AS rename FROM grp GROUP BY app, name) WHERE search_replace > 0)"
T3 = f"WITH {token_sql()}, {GROUP_SQL}, {STATS_SQL}"
EFFECT = "CASE WHEN sum(search_replace) = 0 THEN 0.0 ELSE 100.0 * (sum(search_replace) - sum(rename)) / sum(search_replace) END"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the least to every other order of one part and week."""
    item = table(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "week"]
    rows = item.select("l_orderkey", "l_partkey", F.date_trunc("week", "l_shipdate").alias("week")).distinct()
    least = rows.groupBy(*keys).agg(F.min("l_orderkey").alias("src"))
    return rows.join(least, keys).where("src != l_orderkey").select("src", F.col("l_orderkey").alias("dst")).distinct()


GRAPH_SQL = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_orderkey AS dst, min(l_orderkey) OVER (PARTITION BY l_partkey, date_trunc('week', l_shipdate)) AS src FROM lineitem) WHERE src != dst)"""


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph from smaller to larger key, with some edges back."""
    edges = graph(spark, sf_dir)
    return edges.unionByName(edges.where("(src + dst) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


DIRECTED_SQL = f"{GRAPH_SQL}, d AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE (src + dst) % 3 = 0)"
