"""Syntax trees drawn from events: each event is a statement ``u<user>.k<k> = {v: <value>};``, every tenth also
``(function(p) {var t = this; return p;})(u<user>);``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import names as N
from tessera.runtime import partitions, table, written

STEP = 32
#: place, parent's place, role, ord, kind, op, name; user and key stand for the event's own.
STATEMENT = (
    (0, None, "statement", 0, "ExpressionStatement", None, None),
    (1, 0, "expression", 0, "Assignment", "=", None),
    (2, 1, "left", 0, "PropertyGet", None, None),
    (3, 2, "left", 0, "Name", None, "user"),
    (4, 2, "right", 0, "Name", None, "key"),
    (5, 1, "right", 0, "ObjectLiteral", None, None),
    (6, 5, "element", 0, "ObjectProperty", "init", None),
    (7, 6, "left", 0, "Name", None, "v"),
    (8, 6, "right", 0, "NumberLiteral", None, "value"),
)
CALL = (
    (9, None, "statement", 0, "ExpressionStatement", None, None),
    (10, 9, "expression", 0, "FunctionCall", None, None),
    (11, 10, "target", 0, "ParenthesizedExpression", None, None),
    (12, 11, "expression", 0, "FunctionNode", None, ""),
    (13, 12, "param", 0, "Name", None, "p"),
    (14, 12, "body", 0, "Block", None, None),
    (15, 14, "statement", 0, "VariableDeclaration", None, None),
    (16, 15, "variable", 0, "VariableInitializer", None, None),
    (17, 16, "target", 0, "Name", None, "t"),
    (18, 16, "initializer", 0, "KeywordLiteral", "this", None),
    (19, 14, "statement", 1, "ReturnStatement", None, None),
    (20, 19, "value", 0, "Name", None, "p"),
    (21, 10, "arg", 0, "Name", None, "user"),
)

#: ``k: {k: break k; continue k; function() {break k;}}``: the last one means no label.
LABELS = (
    (0, None, "statement", 0, "LabeledStatement", None, None),
    (1, 0, "label", 0, "Label", None, "key"),
    (2, 0, "statement", 0, "Block", None, None),
    (3, 2, "statement", 0, "LabeledStatement", None, None),
    (4, 3, "label", 0, "Label", None, "key"),
    (5, 3, "statement", 0, "BreakStatement", None, None),
    (6, 5, "value", 0, "Name", None, "key"),
    (7, 2, "statement", 1, "ContinueStatement", None, None),
    (8, 7, "value", 0, "Name", None, "key"),
    (9, 2, "statement", 2, "FunctionNode", None, ""),
    (10, 9, "body", 0, "BreakStatement", None, None),
    (11, 10, "value", 0, "Name", None, "key"),
)

#: ``u = k ? [u, u["k"]] : k && u || (k, <value>);``
OPERATORS = (
    (0, None, "statement", 0, "ExpressionStatement", None, None),
    (1, 0, "expression", 0, "Assignment", "=", None),
    (2, 1, "left", 0, "Name", None, "user"),
    (3, 1, "right", 0, "ConditionalExpression", None, None),
    (4, 3, "test", 0, "Name", None, "key"),
    (5, 3, "then", 0, "ArrayLiteral", None, None),
    (6, 5, "element", 0, "Name", None, "user"),
    (7, 5, "element", 1, "ElementGet", None, None),
    (8, 7, "target", 0, "Name", None, "user"),
    (9, 7, "element", 0, "StringLiteral", None, "key"),
    (10, 3, "else", 0, "InfixExpression", "||", None),
    (11, 10, "left", 0, "InfixExpression", "&&", None),
    (12, 11, "left", 0, "Name", None, "key"),
    (13, 11, "right", 0, "Name", None, "user"),
    (14, 10, "right", 0, "ParenthesizedExpression", None, None),
    (15, 14, "expression", 0, "InfixExpression", ",", None),
    (16, 15, "left", 0, "Name", None, "key"),
    (17, 15, "right", 0, "NumberLiteral", None, "value"),
)
#: ``k ? u : u || k;``: values that nobody uses
UNUSED = (
    (18, None, "statement", 0, "ExpressionStatement", None, None),
    (19, 18, "expression", 0, "ConditionalExpression", None, None),
    (20, 19, "test", 0, "Name", None, "key"),
    (21, 19, "then", 0, "Name", None, "user"),
    (22, 19, "else", 0, "InfixExpression", "||", None),
    (23, 22, "left", 0, "Name", None, "user"),
    (24, 22, "right", 0, "Name", None, "key"),
)

#: ``u.k.prototype = new u.k(<value>);``
CLASSES = (
    (0, None, "statement", 0, "ExpressionStatement", None, None),
    (1, 0, "expression", 0, "Assignment", "=", None),
    (2, 1, "left", 0, "PropertyGet", None, None),
    (3, 2, "left", 0, "PropertyGet", None, None),
    (4, 3, "left", 0, "Name", None, "user"),
    (5, 3, "right", 0, "Name", None, "key"),
    (6, 2, "right", 0, "Name", None, "prototype"),
    (7, 1, "right", 0, "NewExpression", None, None),
    (8, 7, "target", 0, "PropertyGet", None, None),
    (9, 8, "left", 0, "Name", None, "user"),
    (10, 8, "right", 0, "Name", None, "key"),
    (11, 7, "arg", 0, "NumberLiteral", None, "value"),
)
#: ``function k(p) {return {get v() {}, set v(w) {}, m: function f() {}};}``
ACCESSORS = (
    (12, None, "statement", 0, "FunctionNode", None, "key"),
    (13, 12, "param", 0, "Name", None, "p"),
    (14, 12, "body", 0, "Block", None, None),
    (15, 14, "statement", 0, "ReturnStatement", None, None),
    (16, 15, "value", 0, "ObjectLiteral", None, None),
    (17, 16, "element", 0, "ObjectProperty", "get", None),
    (18, 17, "left", 0, "Name", None, "v"),
    (19, 17, "right", 0, "FunctionNode", None, ""),
    (20, 19, "body", 0, "Block", None, None),
    (21, 16, "element", 1, "ObjectProperty", "set", None),
    (22, 21, "left", 0, "Name", None, "v"),
    (23, 21, "right", 0, "FunctionNode", None, ""),
    (24, 23, "param", 0, "Name", None, "w"),
    (25, 23, "body", 0, "Block", None, None),
    (26, 16, "element", 2, "ObjectProperty", "init", None),
    (27, 26, "left", 0, "Name", None, "m"),
    (28, 26, "right", 0, "FunctionNode", None, "f"),
    (29, 28, "body", 0, "Block", None, None),
)

#: ``function f() {return function(q) {return q;};}``
NESTED = (
    (22, None, "statement", 0, "FunctionNode", None, "f"),
    (23, 22, "body", 0, "Block", None, None),
    (24, 23, "statement", 0, "ReturnStatement", None, None),
    (25, 24, "value", 0, "FunctionNode", None, ""),
    (26, 25, "param", 0, "Name", None, "q"),
    (27, 25, "body", 0, "Block", None, None),
    (28, 27, "statement", 0, "ReturnStatement", None, None),
    (29, 28, "value", 0, "Name", None, "q"),
)


#: ``u.v;``
USES = (
    (0, None, "statement", 0, "ExpressionStatement", None, None),
    (1, 0, "expression", 0, "PropertyGet", None, None),
    (2, 1, "left", 0, "Name", None, "user"),
    (3, 1, "right", 0, "Name", None, "v"),
)
#: ``u.m = function() {this.v;}; function f() {u = k; new k.c();}``: without the second, u is no namespace, and its method shares its type.
PARTS = (
    (4, None, "statement", 0, "ExpressionStatement", None, None),
    (5, 4, "expression", 0, "Assignment", "=", None),
    (6, 5, "left", 0, "PropertyGet", None, None),
    (7, 6, "left", 0, "Name", None, "user"),
    (8, 6, "right", 0, "Name", None, "m"),
    (9, 5, "right", 0, "FunctionNode", None, ""),
    (10, 9, "body", 0, "Block", None, None),
    (11, 10, "statement", 0, "ExpressionStatement", None, None),
    (12, 11, "expression", 0, "PropertyGet", None, None),
    (13, 12, "left", 0, "KeywordLiteral", "this", None),
    (14, 12, "right", 0, "Name", None, "v"),
    (15, None, "statement", 0, "FunctionNode", None, "f"),
    (16, 15, "body", 0, "Block", None, None),
    (17, 16, "statement", 0, "ExpressionStatement", None, None),
    (18, 17, "expression", 0, "Assignment", "=", None),
    (19, 18, "left", 0, "Name", None, "user"),
    (20, 18, "right", 0, "Name", None, "key"),
    (21, 16, "statement", 1, "ExpressionStatement", None, None),
    (22, 21, "expression", 0, "NewExpression", None, None),
    (23, 22, "target", 0, "PropertyGet", None, None),
    (24, 23, "left", 0, "Name", None, "key"),
    (25, 23, "right", 0, "Name", None, "c"),
)


def _above(at: int, shape: tuple) -> list[tuple]:
    """The statement's nodes above a place, from the top."""
    by, out = {x[0]: x for x in shape}, []
    while by[at][1] is not None:
        at = by[at][1]
        out.insert(0, by[at])
    return out


SHAPE = "array<struct<at:bigint,up:bigint,role:string,ord:int,kind:string,op:string,name:string,depth:int,above:array<struct<id:bigint,kind:string,role:string,op:string>>,rare:boolean>>"


def _shape(spark: SparkSession, every: tuple, tenth: tuple) -> DataFrame:
    """The statements' nodes, a row each."""
    rows = []
    for x in (*every, *tenth):
        at, up, role, order, kind, op, name = x
        above = [{"id": a, "kind": k, "role": r, "op": o} for a, _, r, _, k, o, _ in _above(at, (*every, *tenth))]
        rows.append({"at": at, "up": up, "role": role, "ord": order, "kind": kind, "op": op, "name": name, "depth": len(above), "above": above, "rare": x in tenth})
    return spark.range(0, len(rows), 1, 1).select(F.get(F.from_json(F.lit(json.dumps(rows)), SHAPE), F.col("id").cast("int")).alias("x")).select("x.*")


def ast(spark: SparkSession, sf_dir: str, every: tuple = STATEMENT, tenth: tuple = CALL) -> DataFrame:
    """Trees with depth and ancestors, as a parser's dump would bring them: of ``every`` event, and more of each ``tenth``.

    Events are dealt out before they grow to nodes, and they grow by a join with the shape, whose size the planner sees (an
    explode counts as no growth: trees many times the size of the events would be broadcast)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), F.col("event_type").alias("app"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))).alias("key"), F.floor("value").cast("string").alias("value"))
    e = e.repartition(partitions(spark), "event_id")
    e = e.join(F.broadcast(_shape(spark, every, tenth)), ~F.col("rare") | (F.col("event_id") % 10 == 0))
    base = F.col("event_id") * STEP
    text = F.when(F.col("name") == "user", F.col("user")).when(F.col("name") == "key", F.col("key")).when(F.col("name") == "value", F.col("value")).otherwise(F.col("name"))
    # told place by place: a lambda is interpreted, row by row
    at = lambda i: F.get("above", F.lit(i))
    most = max(len(_above(x[0], (*every, *tenth))) for x in (*every, *tenth))
    above = F.slice(F.array(*[F.struct((base + at(i)["id"]).alias("id"), *[at(i)[c].alias(c) for c in ("kind", "role", "op")]) for i in range(max(1, most))]), F.lit(1), F.col("depth"))
    return e.select("app", "source_id", (base + F.col("at")).alias("node_id"), (base + F.col("up")).alias("parent_id"), "role", "ord", "kind", "op", text.alias("name"), (base + F.col("at")).alias("pos"), F.lit(1).alias("len"), F.col("event_id").cast("int").alias("line"), "depth", above.alias("ancestors"))


def trees(spark: SparkSession, sf_dir: str, every: tuple = STATEMENT, tenth: tuple = CALL) -> DataFrame:
    """The trees, written once: for jobs that read them more than once. Ancestors are then a column, not an expression that
    each use makes anew."""
    return written(ast(spark, sf_dir, every, tenth))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees with parents only."""
    return ast(spark, sf_dir).drop("depth", "ancestors")


def decls(rows: DataFrame) -> DataFrame:
    """Parameters and variables of the functions."""
    scope = N.enclosing()
    named = rows.where("role = 'param' OR (role = 'target' AND kind = 'Name')")
    return named.select("app", "source_id", scope.alias("scope_id"), "name").where("scope_id IS NOT NULL").distinct()


SQL_EVENTS = "ev AS (SELECT event_id, user_id, event_type AS app, 'u' || user_id AS usr, 'k' || coalesce(json_extract_string(props, '$.k'), '0') AS k, event_id * 32 AS base FROM events)"
