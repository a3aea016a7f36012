"""Queries over graphs and constraint tables drawn from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import bindings as B
from tessera.jobs.token_jobs import Q
from tessera.operators import closure as C
from tessera.operators import graph as G
from tessera.runtime import table, written

QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


CLOSED = "b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)"


@query("g1_connected_components", f"WITH RECURSIVE {B.GRAPH_SQL}, {CLOSED} SELECT x AS node, least(x, min(y)) AS rep FROM r GROUP BY x")
def g1(spark, d):
    return G.connected_components(B.graph(spark, d))


@query("g2_rep_from_groups", f"{B.T3} SELECT app, name, source_id AS item, min(source_id) OVER (PARTITION BY app, name, rep) AS rep FROM (SELECT DISTINCT app, name, rep, source_id FROM tok)")
def g2(spark, d):
    groups = B.tokens(spark, d).groupBy("app", "name", "rep").agg(F.array_sort(F.collect_set("source_id")).alias("members"))
    return G.rep_from_groups(groups.drop("rep"), keys=["app", "name"])


@query("g9_reachable", f"WITH RECURSIVE {B.DIRECTED_SQL}, r AS (SELECT DISTINCT src AS node FROM d WHERE src % 50 = 0 UNION SELECT dst FROM r JOIN d ON src = node) SELECT node FROM r")
def g9(spark, d):
    edges = B.directed(spark, d)
    return G.reachable(edges.where("src % 50 = 0").select(F.col("src").alias("node")), edges)


_SCC = f"WITH RECURSIVE {B.DIRECTED_SQL}, r AS (SELECT src AS x, dst AS y FROM d UNION SELECT r.x, d.dst FROM r JOIN d ON r.y = d.src), n AS (SELECT src AS node FROM d UNION SELECT dst FROM d), s AS (SELECT node, least(node, coalesce((SELECT min(p.y) FROM r p JOIN r q ON p.x = q.y AND p.y = q.x WHERE p.x = node), node)) AS rep FROM n)"


@query("g10_strong_components", f"{_SCC} SELECT node, rep FROM s")
def g10(spark, d):
    return G.strong_components(B.directed(spark, d))


@query("g11_component_edges", f"{_SCC} SELECT DISTINCT a.rep AS src, b.rep AS dst FROM d JOIN s a ON a.node = d.src JOIN s b ON b.node = d.dst WHERE a.rep != b.rep")
def g11(spark, d):
    edges = B.directed(spark, d)
    return G.component_edges(edges, G.strong_components(edges))


def constraints(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """eq and prop: orders unified by the graph, their line items as properties, whose values have one property more."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("app"))
    e = B.graph(spark, d)
    a, b = orders.select(F.col("o_orderkey").alias("src"), "app"), orders.select(F.col("o_orderkey").alias("dst"), "app")
    eq = e.join(a, "src").join(b, ["dst", "app"]).select("app", F.concat(F.lit("o"), "src").alias("a"), F.concat(F.lit("o"), "dst").alias("b"))
    item = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.concat(F.lit("c"), (F.col("o_custkey") % 5000).cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    rows = item.select("app", F.inline(F.array(
        F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("owner"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("prty"), value.alias("value")),
        F.struct(value.alias("owner"), F.lit("next").alias("prty"), F.concat(F.lit("k"), (F.col("o_custkey") % 700).cast("string")).alias("value")),
    )))
    return eq, rows.distinct()


def _met_twice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same with prop written once: for the closure, and for what is asked of it."""
    eq, prop = constraints(spark, d)
    return eq, written(prop)


_BASE = f"""{B.GRAPH_SQL},
eq AS (SELECT a.o_orderstatus AS app, 'o' || src AS a, 'o' || dst AS b FROM e JOIN orders a ON a.o_orderkey = src JOIN orders b ON b.o_orderkey = dst AND a.o_orderstatus = b.o_orderstatus),
li AS (SELECT o_orderstatus AS app, 'o' || l_orderkey AS o, 'f' || l_linenumber AS f, 'c' || (o_custkey % 5000) || '_' || l_linenumber AS c, 'k' || (o_custkey % 700) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
prop AS (SELECT DISTINCT app, o AS owner, f AS prty, c AS value FROM li UNION SELECT DISTINCT app, c, 'next', k FROM li)"""


def _level(name: str, edges: str, nodes: str) -> str:
    """Components of one level: reachable pairs, then the least."""
    return f"""{name}_b AS (SELECT app, a AS x, b AS y FROM {edges} UNION SELECT app, b, a FROM {edges}),
{name}_r AS (SELECT app, x, y FROM {name}_b UNION SELECT r.app, r.x, b.y FROM {name}_r r JOIN {name}_b b ON r.app = b.app AND r.y = b.x),
{name} AS (SELECT n.app, n.node, least(n.node, coalesce(min(r.y), n.node)) AS rep FROM ({nodes}) n LEFT JOIN {name}_r r ON r.app = n.app AND r.x = n.node GROUP BY n.app, n.node)"""


def _star(owners: str, prty: str) -> str:
    """Edges from the least value of a property of an owner's class to its other values."""
    return f"SELECT DISTINCT p.app, min(p.value) OVER (PARTITION BY p.app, o.rep, p.prty) AS a, p.value AS b FROM prop p JOIN {owners} o ON o.app = p.app AND o.node = p.owner WHERE p.prty {prty}"


CLOSURE_SQL = f"""WITH RECURSIVE {_BASE},
{_level('o1', 'eq', 'SELECT DISTINCT app, o AS node FROM li UNION SELECT app, a FROM eq UNION SELECT app, b FROM eq')},
s2 AS ({_star('o1', "!= 'next'")}),
{_level('c2', 's2', 'SELECT DISTINCT app, c AS node FROM li')},
s3 AS ({_star('c2', "= 'next'")}),
{_level('k3', 's3', 'SELECT DISTINCT app, k AS node FROM li')},
typing AS (SELECT * FROM o1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM k3)"""


@query("g3_congruence_closure", f"{CLOSURE_SQL} SELECT app, node, rep FROM typing")
def g3(spark, d):
    return C.congruence_closure(*constraints(spark, d))


@query("g4_namespaces", f"{CLOSURE_SQL} SELECT DISTINCT app, rep FROM typing WHERE node LIKE 'k%' AND substr(node, length(node)) = '7'")
def g4(spark, d):
    eq, prop = constraints(spark, d)
    marked = prop.where("prty = 'next' AND value LIKE '%7'").select("app", F.col("value").alias("node")).distinct()
    return C.namespaces(marked, C.congruence_closure(eq, prop))


@query("g6_type_properties", f"{CLOSURE_SQL} SELECT p.app, o.rep, string_agg(DISTINCT p.prty, ',' ORDER BY p.prty) AS names FROM prop p JOIN typing o ON o.app = p.app AND o.node = p.owner GROUP BY p.app, o.rep")
def g6(spark, d):
    eq, prop = _met_twice(spark, d)
    return C.type_properties(C.congruence_closure(eq, prop), prop).select("app", "rep", F.array_join("names", ",").alias("names"))


@query("g7_lookup_property", f"{CLOSURE_SQL}, rp AS (SELECT DISTINCT p.app, o.rep, p.prty, v.rep AS value_rep FROM prop p JOIN typing o ON o.app = p.app AND o.node = p.owner JOIN typing v ON v.app = p.app AND v.node = p.value) SELECT q.app, q.rep, 'f3' AS prty, rp.value_rep FROM (SELECT DISTINCT app, rep FROM o1) q LEFT JOIN rp ON rp.app = q.app AND rp.rep = q.rep AND rp.prty = 'f3'")
def g7(spark, d):
    eq, prop = _met_twice(spark, d)
    typing = C.congruence_closure(eq, prop)
    asked = typing.where("node LIKE 'o%'").select("app", "rep", F.lit("f3").alias("prty")).distinct()
    return C.lookup_property(typing, prop, asked)


@query("g8_describe_types", f"{CLOSURE_SQL}, n AS (SELECT p.app, o.rep, string_agg(DISTINCT p.prty, ',' ORDER BY p.prty) AS names FROM prop p JOIN typing o ON o.app = p.app AND o.node = p.owner GROUP BY p.app, o.rep) SELECT i.app, l_orderkey AS source_id, l_linenumber AS line, 'x' || l_partkey AS name, l_orderkey || ':' || l_linenumber || ' x' || l_partkey || ' :: {{' || coalesce(n.names, '') || '}}' AS described FROM (SELECT DISTINCT o_orderstatus AS app, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) i JOIN o1 ON o1.app = i.app AND o1.node = 'o' || l_orderkey LEFT JOIN n ON n.app = o1.app AND n.rep = o1.rep")
def g8(spark, d):
    eq, prop = _met_twice(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("app"))
    inits = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("app", F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node")).distinct()
    return C.describe_types(inits, C.congruence_closure(eq, prop), prop)
