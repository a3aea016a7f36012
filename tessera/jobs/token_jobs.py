"""Queries over name tokens (line items as tokens)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import bindings as B
from tessera.operators import tokens as O
from tessera.operators.chunks import chunked

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _stats(spark: SparkSession, d: str, modulus: int = B.REP_MODULUS) -> DataFrame:
    return O.name_stats(O.group_sizes(B.tokens(spark, d, modulus)))


@query("a1_name_frequency", f"{B.T3} SELECT app, name, count(*) AS n FROM tok GROUP BY app, name")
def a1(spark, d):
    return O.name_frequency(B.tokens(spark, d))


@query("a2_property_names", f"{B.T3} SELECT DISTINCT app, name FROM tok")
def a2(spark, d):
    return O.property_names(B.tokens(spark, d))


@query("n8_without_prototype", f"{B.T3} SELECT app, count(*) AS n FROM (SELECT app, CASE WHEN name = 'p7' THEN 'prototype' ELSE name END AS name FROM tok) WHERE name != 'prototype' GROUP BY app")
def n8(spark, d):
    renamed = B.tokens(spark, d).withColumn("name", F.when(F.col("name") == "p7", "prototype").otherwise(F.col("name")))
    return O.without_prototype(renamed).groupBy("app").agg(F.count(F.lit(1)).alias("n"))


@query("a3_property_questions", f"{B.T3} SELECT app, name, rep, string_agg(source_id || ':' || pos, ',' ORDER BY source_id, pos) AS tokens, count(*) AS size FROM tok WHERE source_id % 5 != 0 GROUP BY app, name, rep")
def a3(spark, d):
    """All names; only tokens outside the library count."""
    found = O.property_questions(B.tokens(spark, d), F.col("source_id") % 5 != 0)
    return found.select("app", "name", "rep", _spelled("tokens", ",").alias("tokens"), F.col("size").cast("long").alias("size"))


def _spelled(tokens: str, between: str) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws(":", t["source_id"].cast("string"), t["pos"].cast("string"))), between)


@query("a3_question_chunks", f"{B.T3}, n AS (SELECT app, rep, source_id, pos, (row_number() OVER (PARTITION BY app, rep ORDER BY source_id, pos, name) - 1) // 100 AS chunk FROM tok) SELECT app, rep, chunk, count(*) AS size, min((source_id, pos))[1] AS first_source, string_agg(source_id || ':' || pos, ',' ORDER BY source_id, pos) AS tokens FROM n GROUP BY app, rep, chunk")
def a3_chunks(spark, d):
    """Tokens of each type in order, 100 a row: one type of each program holds most of its tokens."""
    rows = B.tokens(spark, d).withColumn("place", F.struct("source_id", "pos"))
    found = chunked(rows, ["app", "rep"], "place", 100, ["source_id", "pos", "name"])
    return found.select("app", "rep", "chunk", F.size("values").cast("long").alias("size"), F.col("values")[0]["source_id"].alias("first_source"), _spelled("values", ",").alias("tokens"))


@query("a4_name_stats", f"{B.T3} SELECT * FROM ns")
def a4(spark, d):
    return _stats(spark, d)


@query("a5_app_stats", f"{B.T3} SELECT app, CAST(sum(search_replace) AS BIGINT) AS search_replace, CAST(sum(rename) AS BIGINT) AS rename, {B.EFFECT} AS effect FROM ns GROUP BY app")
def a5(spark, d):
    return O.app_stats(_stats(spark, d))


def _case(label: str, column: str, value: str) -> str:
    if label.endswith("+"):
        cond = f"{column} >= {label[:-1]}"
    elif ".." in label:
        a, b = label.split("..")
        cond = f"{column} BETWEEN {a} AND {b}"
    else:
        cond = f"{column} = {label}"
    return f'CAST(coalesce(sum(CASE WHEN {cond} THEN {value} END), 0) AS BIGINT) AS "{label}"'


@query("a6_group_size_histogram", f"{B.T3} SELECT app, {', '.join(_case(x, 'size', 'size') for x in O.SIZE_LABELS)} FROM grp GROUP BY app")
def a6(spark, d):
    return O.group_size_histogram(O.group_sizes(B.tokens(spark, d)))


@query(
    "a7_question_histogram",
    f"{B.T3}, n AS (SELECT app, sum(size) AS naive, count(*) AS rename FROM grp GROUP BY app, name HAVING sum(size) > 1),"
    " v AS (SELECT app, 'naive' AS tool, naive AS value, 1 AS s FROM n UNION ALL SELECT app, 'rename', rename, 1 FROM n UNION ALL SELECT app, 'rename', naive, -1 FROM n)"
    f" SELECT app, tool, {', '.join(_case(x, 'value', 's') for x in O.QUESTION_LABELS)} FROM v GROUP BY app, tool",
)
def a7(spark, d):
    return O.question_histogram(O.group_sizes(B.tokens(spark, d)))


@query("a8_group_distribution", f"{B.T3}, s AS (SELECT app, size FROM grp WHERE name NOT IN (SELECT name FROM grp GROUP BY name HAVING sum(size) < 2)) SELECT app, coalesce(sum(size) FILTER (size = 1), 0) / sum(size) AS one, coalesce(sum(size) FILTER (size = 2), 0) / sum(size) AS two, coalesce(sum(size) FILTER (size BETWEEN 3 AND 9), 0) / sum(size) AS to_nine, coalesce(sum(size) FILTER (size >= 10), 0) / sum(size) AS ten_up FROM grp GROUP BY app")
def a8(spark, d):
    return O.group_distribution(O.group_sizes(B.tokens(spark, d)))


@query("a9_solved_within", f"{B.T3} SELECT app, count(*) FILTER (search_replace <= 10) / count(*) AS search_replace, (count(*) FILTER (rename <= 10) - count(*) FILTER (search_replace <= 10)) / count(*) AS rename, (count(*) - count(*) FILTER (rename <= 10)) / count(*) AS neither FROM ns GROUP BY app")
def a9(spark, d):
    return O.solved_within(_stats(spark, d), 10)


@query("a10_cumulative_questions", f"{B.T3} SELECT t AS threshold, count(*) FILTER (search_replace <= t) AS search_replace, count(*) FILTER (rename <= t) - count(*) FILTER (search_replace <= t) AS rename FROM ns, (SELECT CAST(unnest(range(10)) AS INTEGER) AS t) WHERE app = 'NO' GROUP BY t")
def a10(spark, d):
    return O.cumulative_questions(_stats(spark, d), "NO")


@query("j12_cross_thresholds", f"{B.T3} SELECT app, name, t AS threshold, search_replace <= t AS within FROM ns, (SELECT CAST(unnest(range(10)) AS INTEGER) AS t)")
def j12(spark, d):
    return O.cross_thresholds(_stats(spark, d)).select("app", "name", "threshold", (F.col("search_replace") <= F.col("threshold")).alias("within"))


@query("a11_property_count", f"{B.T3} SELECT app, count(*) AS num FROM ns GROUP BY app")
def a11(spark, d):
    return O.property_count(_stats(spark, d))


LIB = "'lib' || (source_id % 3)"


def _library(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Effect by (app, library) in the app, which app uses which library, and effect of the library by itself."""
    tok = B.tokens(spark, d).withColumn("lib", F.concat(F.lit("lib"), (F.col("source_id") % 3).cast("string")))
    inside = tok.select(F.concat_ws("/", "app", "lib").alias("app"), "name", "rep", "lib")
    in_app = O.app_stats(O.name_stats(O.group_sizes(inside))).select(F.split("app", "/")[0].alias("app"), F.split("app", "/")[1].alias("lib"), "effect")
    alone = O.app_stats(O.name_stats(O.group_sizes(tok.select(F.col("lib").alias("app"), "name", "rep")))).select(F.col("app").alias("lib"), "effect")
    return in_app, tok.where("app != 'AF'").select("app", "lib").distinct(), alone


_LIB_SQL = f"""{B.T3}, lt AS (SELECT *, {LIB} AS lib FROM tok),
ia AS (SELECT app, lib, {B.EFFECT} AS effect FROM (SELECT app, lib, sum(size) - 1 AS search_replace, count(*) - 1 AS rename FROM (SELECT app, lib, name, rep, count(*) AS size FROM lt GROUP BY ALL) GROUP BY app, lib, name) WHERE search_replace > 0 GROUP BY app, lib),
al AS (SELECT lib, {B.EFFECT} AS effect FROM (SELECT lib, sum(size) - 1 AS search_replace, count(*) - 1 AS rename FROM (SELECT lib, name, rep, count(*) AS size FROM lt GROUP BY ALL) GROUP BY lib, name) WHERE search_replace > 0 GROUP BY lib),
ls AS (SELECT ia.lib, ia.app, ia.effect AS in_app, al.effect AS alone FROM ia JOIN al USING (lib) WHERE app != 'AF')"""


@query("j13_library_samples", f"{_LIB_SQL} SELECT * FROM ls")
def j13(spark, d):
    return O.library_samples(*_library(spark, d))


@query("a12_library_averages", f"{_LIB_SQL} SELECT lib, avg(in_app) AS mean_effect, avg(alone - in_app) AS mean_delta FROM ls GROUP BY lib")
def a12(spark, d):
    return O.library_averages(O.library_samples(*_library(spark, d)))


@query(
    "a13_effect_delta",
    f"{B.T3}, {B.token_sql(5, 'tok2')}, w AS (SELECT app, {B.EFFECT} AS effect FROM ns GROUP BY app),"
    f" o AS (SELECT app, {B.EFFECT} AS effect FROM (SELECT app, sum(size) - 1 AS search_replace, count(*) - 1 AS rename FROM (SELECT app, name, rep, count(*) AS size FROM tok2 GROUP BY ALL) GROUP BY app, name) WHERE search_replace > 0 GROUP BY app)"
    " SELECT app, w.effect, o.effect - w.effect AS delta FROM w JOIN o USING (app)",
)
def a13(spark, d):
    return O.effect_delta(O.app_stats(_stats(spark, d)), O.app_stats(_stats(spark, d, 5)))


@query("a15_most_frequent_name", f"{B.T3} SELECT app, name, n FROM (SELECT app, name, count(*) AS n, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, name) AS r FROM tok GROUP BY app, name) WHERE r = 1")
def a15(spark, d):
    return O.most_frequent_name(B.tokens(spark, d))


@query("a19_reduction", f"{B.T3}, z AS (SELECT app, name, search_replace - 8 AS a, rename AS b FROM ns) SELECT app, name, CASE WHEN a = 0 THEN 0.0 ELSE b / a END AS ratio, CASE WHEN a = 0 THEN 0.0 ELSE 100.0 * (a - b) / a END AS saved FROM z WHERE a >= 0")
def a19(spark, d):
    a, b = F.col("search_replace") - 8, F.col("rename")
    return _stats(spark, d).where(a >= 0).select("app", "name", O.reduction(a, b).alias("ratio"), O.percent(a, b).alias("saved"))


@query("a20_question_scatter", f"{B.T3} SELECT search_replace, rename, count(*) AS names FROM ns WHERE search_replace BETWEEN 0 AND 100 AND rename BETWEEN 0 AND 100 GROUP BY ALL")
def a20(spark, d):
    return O.question_scatter(_stats(spark, d))


_TARGETS = "t AS (SELECT app, name, min(source_id) AS source_id FROM tok WHERE name LIKE '%7' GROUP BY app, name)"


def _targets(tok: DataFrame) -> DataFrame:
    return tok.where(F.col("name").endswith("7")).groupBy("app", "name").agg(F.min(F.struct("source_id", "pos")).alias("t")).select("app", "name", "t.source_id", "t.pos")


@query("e2_questions_of_targets", f"{B.T3}, {_TARGETS} SELECT app, name, rep, count(*) AS size, min(source_id) AS first_source FROM tok JOIN (SELECT app, name FROM t) USING (app, name) GROUP BY ALL")
def e2(spark, d):
    tok = B.tokens(spark, d)
    return O.questions_of_targets(tok, _targets(tok)).select("app", "name", "rep", F.col("size").cast("long").alias("size"), F.col("tokens")[0]["source_id"].alias("first_source"))


@query(
    "e6_order_questions",
    f"{B.T3}, g AS (SELECT app, name, rep, min((CASE WHEN source_id = 100 THEN 0 ELSE 1 END, source_id, pos)) AS f, string_agg(source_id || ':' || pos, ' ' ORDER BY CASE WHEN source_id = 100 THEN 0 ELSE 1 END, source_id, pos) AS tokens FROM tok GROUP BY app, name, rep)"
    " SELECT app, name, rep, CAST(row_number() OVER (PARTITION BY app, name ORDER BY f) AS INTEGER) AS question, tokens FROM g",
)
def e6(spark, d):
    groups = O.property_questions(B.tokens(spark, d))
    return O.order_questions(groups, F.lit(100)).select("app", "name", "rep", "question", _spelled("tokens", " ").alias("tokens"))


@query(
    "e7_select_tokens",
    f"{B.T3}, t AS (SELECT app, name, min((source_id, pos)) AS t FROM tok WHERE name LIKE '%7' GROUP BY app, name), hit AS (SELECT DISTINCT k.app, k.name, k.rep FROM tok k JOIN t ON k.app = t.app AND k.name = t.name AND (k.source_id, k.pos) = t.t UNION SELECT DISTINCT app, name, rep FROM tok WHERE name LIKE '%7' AND rep = 2)"
    " SELECT app, name, rep, source_id, pos FROM tok JOIN hit USING (app, name, rep)",
)
def e7(spark, d):
    tok = B.tokens(spark, d)
    targets = _targets(tok)
    groups = O.questions_of_targets(tok, targets)
    return O.select_tokens(groups, targets, groups.select("app", "name", "rep", (F.col("rep") == 2).alias("yes")))


@query("e8_affected_documents", f"{B.T3} SELECT DISTINCT app, source_id FROM tok WHERE name = 'p17' AND app = 'NO'")
def e8(spark, d):
    return O.affected_documents(B.tokens(spark, d).where("name = 'p17'"), "project", app="NO")


_LABEL = "CASE WHEN size % 3 = 0 THEN CAST(size AS VARCHAR) WHEN size % 3 = 1 THEN size || '..' || (size + 2) ELSE size || '+' END"


@query(
    "e16_ranges",
    f"{B.T3}, l AS (SELECT DISTINCT size, {_LABEL} AS label FROM grp) SELECT label, CAST(size AS INTEGER) AS lo, CAST(CASE size % 3 WHEN 0 THEN size + 1 WHEN 1 THEN size + 3 ELSE 1000000 END AS INTEGER) AS hi, label AS again FROM l",
)
def e16(spark, d):
    size = F.col("size")
    label = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, F.concat_ws("..", size.cast("string"), (size + 2).cast("string"))).otherwise(F.concat(size.cast("string"), F.lit("+")))
    rows = O.group_sizes(B.tokens(spark, d)).select(label.alias("label")).distinct()
    low, high = O.parse_range(F.col("label"))
    return rows.select("label", low.alias("lo"), high.alias("hi")).withColumn("again", O.format_range(F.col("lo"), F.col("hi")))
