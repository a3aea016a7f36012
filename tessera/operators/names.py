"""Name tokens of syntax trees: what each name is, what it belongs to, where it stands.

``ast`` has one row a node: app, source_id, node_id (preorder number in the source), parent_id, role (slot in the
parent), ord, kind, op, name, pos, len, line and, from ``with_ancestors``, depth and ancestors (root to parent, each
with id, kind, role, op).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.intervals import holding
from tessera.runtime import dealt, partitions

NODE = ["app", "source_id", "node_id"]
SCOPES = ("FunctionNode", "CatchClause", "Block")
ANCESTORS = "array<struct<id:bigint,kind:string,role:string,op:string>>"


def with_ancestors(ast: DataFrame) -> DataFrame:
    """Depth and ancestors, by one exchange: a source's nodes come to a task in preorder, one after the other, and the nodes
    above the next one are a stack. Memory follows the depth of a tree, not the size of its source. A node whose parent
    does not come before it is left out, with what is below it."""
    columns = [c for c in ast.columns if c not in ("depth", "ancestors")]
    fields = {f.name: f for f in ast.schema.fields}
    schema = T.StructType([*[fields[c] for c in columns], T.StructField("depth", T.IntegerType()), T.StructField("ancestors", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("kind", "role", "op")]])))])
    dealt = ast.select(*columns).repartition(partitions(ast.sparkSession), "app", "source_id").sortWithinPartitions("app", "source_id", "node_id")
    above = ("id", "kind", "role", "op")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, source = [], None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("app", "source_id", "node_id", "parent_id", "kind", "role", "op")], strict=True)
            kept, ends, parts = [], [0], [[] for _ in above]
            for i, (app, source_id, node_id, parent_id, kind, role, op) in enumerate(rows):
                if (app, source_id) != source or parent_id is None:
                    stack, source = [], (app, source_id)
                while stack and stack[-1][0] != parent_id:
                    stack.pop()
                if parent_id is not None and not stack:
                    continue
                kept.append(i)
                for part, values in zip(parts, zip(*stack, strict=True), strict=bool(stack)):
                    part.extend(values)
                ends.append(ends[-1] + len(stack))
                stack.append((node_id, kind, role, op))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(parts[0], pa.int64()), *[pa.array(p, pa.string()) for p in parts[1:]]], names=above))
            whole = batch.take(pa.array(kept, pa.int64()))
            depth = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int32())
            yield pa.RecordBatch.from_arrays([*whole.columns, depth, lists], [*batch.schema.names, "depth", "ancestors"])

    return dealt.mapInArrow(walk, schema)


def parent(field: str, n: int = 1) -> Column:
    """A field of the n-th ancestor from below, null at the top."""
    return F.when(F.size("ancestors") >= n, F.element_at("ancestors", -n))[field]


def enclosing(kinds: tuple[str, ...] = ("FunctionNode",)) -> Column:
    """Id of the nearest ancestor of these kinds, null if there is none. One kind is found by its place, without a lambda,
    as lambdas are interpreted."""
    if len(kinds) == 1:
        at = F.array_position(F.reverse(F.col("ancestors")["kind"]), kinds[0]).cast("int")
        return F.when(at > 0, F.element_at("ancestors", -at))["id"]
    found = F.filter("ancestors", lambda a: a["kind"].isin(*kinds))
    return F.when(F.size(found) > 0, F.element_at(found, -1))["id"]


def in_scope() -> Column:
    """Does the node stand in any scope?"""
    return reduce(Column.__or__, [F.array_contains(F.col("ancestors")["kind"], k) for k in SCOPES])


def in_function() -> Column:
    """Does the node stand in any function? Found without a lambda; most nodes of a page do not, and no list is made for them."""
    return F.array_contains(F.col("ancestors")["kind"], "FunctionNode")


def ref_kind() -> Column:
    """Of name tokens: property, label or variable; null for other nodes."""
    key = (F.col("role") == "left") & (parent("kind") == "ObjectProperty")
    prop = ((F.col("role") == "right") & (parent("kind") == "PropertyGet")) | (key & (F.col("kind") != "NumberLiteral"))
    label = (F.col("kind") == "Label") | ((F.col("kind") == "Name") & parent("kind").isin("BreakStatement", "ContinueStatement"))
    return F.when(F.coalesce(prop, F.lit(False)), "property").when(F.coalesce(label, F.lit(False)), "label").when((F.col("kind") == "Name") & ~F.coalesce(key, F.lit(False)) & ~F.coalesce((F.col("role") == "name"), F.lit(False)), "variable")


def classify_names(ast: DataFrame) -> DataFrame:
    """Name tokens with their ref_kind."""
    return ast.withColumn("ref_kind", ref_kind()).where("ref_kind IS NOT NULL")


def base_expr(tokens: DataFrame, ast: DataFrame) -> DataFrame:
    """Adds base_node: the left operand of a property access, or the object literal of a key."""
    left = ast.where("role = 'left'").select("app", "source_id", F.col("parent_id").alias("_p"), F.col("node_id").alias("_left"))
    rows = tokens.withColumn("_p", F.when((F.col("ref_kind") == "property") & (F.col("role") == "right"), F.col("parent_id")))
    rows = rows.join(dealt(left), ["app", "source_id", "_p"], "left")
    return rows.withColumn("base_node", F.when(F.col("role") == "left", parent("id", 2)).otherwise(F.col("_left"))).drop("_p", "_left")


def resolve_scope(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """Adds scope_id to variables: the innermost enclosing scope that declares the name, null if it is global.

    ``arguments`` belongs to the enclosing function. Only ancestors that are scopes are exploded.
    """
    scopes = F.filter(F.transform("ancestors", lambda a, i: F.struct(a["id"].alias("scope_id"), i.alias("at"), a["kind"].alias("kind"))), lambda s: s["kind"].isin(*SCOPES))
    asked = tokens.where("ref_kind = 'variable' AND name != 'arguments'").where(in_scope()).select(*NODE, "name", F.inline(scopes))
    found = asked.join(dealt(decls.select("app", "source_id", "scope_id", "name").distinct()), ["app", "source_id", "scope_id", "name"]).groupBy(*NODE).agg(F.max_by("scope_id", "at").alias("_scope"))
    # told before the join, so that ancestors need not come along
    rows = tokens.withColumn("_function", F.when(F.col("name") == "arguments", enclosing())).join(dealt(found), NODE, "left")
    return rows.withColumn("scope_id", F.when(F.col("name") == "arguments", F.col("_function")).otherwise(F.col("_scope"))).drop("_scope", "_function")


def is_local() -> Column:
    return (F.col("ref_kind") == "variable") & F.col("scope_id").isNotNull()


def is_global() -> Column:
    return (F.col("ref_kind") == "variable") & F.col("scope_id").isNull()


def start_pos() -> Column:
    """Place of the name itself: past the quote of a string."""
    return F.when(F.col("kind") == "StringLiteral", F.col("pos") + 1).otherwise(F.col("pos"))


def absolute_line(tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds abs_line: the node's line in the page, for scripts cut out of one."""
    return tokens.join(sources.select("app", "source_id", "lineno"), ["app", "source_id"], "left").withColumn("abs_line", F.coalesce("lineno", F.lit(0)) + F.col("line")).drop("lineno")


def location() -> Column:
    return F.struct("source_id", "pos")


def token_at(ast: DataFrame, points: DataFrame) -> DataFrame:
    """points (app, source_id, at) with the innermost node around each: deepest, then latest."""
    nodes = ast.select(*NODE, "kind", "name", "depth", F.col("pos").alias("_from"), (F.col("pos") + F.col("len")).alias("_to"))
    met = holding(points, "at", nodes, "_from", "_to", ["app", "source_id"])
    return met.groupBy("app", "source_id", "at").agg(F.max_by(F.struct("node_id", "kind", "name"), F.struct("depth", "_from", "node_id")).alias("n")).select("app", "source_id", "at", "n.*")


def tokens_on_line(tokens: DataFrame, line: Column) -> DataFrame:
    """Property tokens on a 1-based line, numbered in order."""
    rows = tokens.where((F.col("ref_kind") == "property") & (F.col("abs_line") + 1 == line))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("app", "source_id").orderBy("pos", "node_id")))


def expr_ids(ast: DataFrame) -> DataFrame:
    """(app, source_id, expr_id, node_id): property gets, element gets and object literals numbered in preorder; the id names their left, their target, themselves."""
    kinds = {"PropertyGet": "left", "ElementGet": "target"}
    counted = ast.where(F.col("kind").isin(*kinds, "ObjectLiteral"))
    nth = F.row_number().over(Window.partitionBy("app", "source_id").orderBy("node_id")) - 1
    counted = counted.withColumn("expr_id", F.concat_ws("@", F.col("source_id").cast("string"), nth.cast("string"))).select("app", "source_id", "kind", F.col("node_id").alias("parent_id"), "expr_id")
    kids = ast.select("app", "source_id", "parent_id", "role", F.col("node_id").alias("_kid"))
    slot = F.when(F.col("kind") == "PropertyGet", "left").when(F.col("kind") == "ElementGet", "target")
    joined = counted.withColumn("role", slot).join(dealt(kids), ["app", "source_id", "parent_id", "role"], "left")
    return joined.select("app", "source_id", "expr_id", F.when(F.col("kind") == "ObjectLiteral", F.col("parent_id")).otherwise(F.col("_kid")).alias("node_id"))


def declared_functions_ordinals(ast: DataFrame, kill_keys: DataFrame) -> DataFrame:
    """(app, trial, source_id, node_id): killed functions. Functions are numbered from 2 in preorder, those inside a killed one get no number.

    The numbering depends on what was killed before, so a source's functions are walked in order.
    """
    functions = _extents(ast).select(*NODE, "last")
    keys = kill_keys.groupBy("app", "trial", "source_id").agg(F.collect_set("ordinal").alias("ordinals"))

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        source = None
        for app, trial, source_id, node_id, last, ordinals in rows:
            if (app, trial, source_id) != source:
                source, dead, n, wanted = (app, trial, source_id), -1, 2, set(ordinals)
            if node_id > dead:
                if n in wanted:
                    dead = last
                    yield app, trial, source_id, node_id
                n += 1

    joined = functions.join(dealt(keys), ["app", "source_id"])
    return _in_order(joined.select("app", "trial", "source_id", "node_id", "last", "ordinals"), walk)


def _in_order(functions: DataFrame, walk: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """(app, trial, source_id, node_id) that a walk finds: a task has its trials of sources one after the other, functions in
    preorder, and no more than a batch of them at a time. These are the first columns."""
    kept = ["app", "trial", "source_id", "node_id"]
    schema = T.StructType([functions.schema[c] for c in kept])

    def walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [f.type for f in batch.schema][: len(kept)]
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        found = walk(rows())
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*some, strict=True), types, strict=True)], kept)

    dealt_out = functions.repartition(partitions(functions.sparkSession), *kept[:3]).sortWithinPartitions(*kept)
    return dealt_out.mapInArrow(walk_batches, schema)


def _extents(ast: DataFrame) -> DataFrame:
    """(app, source_id, node_id, size, last): descendants of every function, and the last of them in preorder (itself, if it has none)."""
    above = F.filter("ancestors", lambda a: a["kind"] == "FunctionNode")
    inside = ast.where(in_function()).select("app", "source_id", F.col("node_id").alias("_at"), F.explode(F.transform(above, lambda a: a["id"])).alias("node_id"))
    counted = inside.groupBy(*NODE).agg(F.count(F.lit(1)).alias("size"), F.max("_at").alias("last"))
    functions = ast.where("kind = 'FunctionNode'").select(*NODE)
    return functions.join(dealt(counted), NODE, "left").select(*NODE, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("last", "node_id").alias("last"))


def subtree_sizes(ast: DataFrame) -> DataFrame:
    """(app, source_id, node_id, size): descendants of every function; those in nested ones count too."""
    return _extents(ast).drop("last")


def survivors(tokens: DataFrame, killed: DataFrame) -> DataFrame:
    """Tokens without a killed function above them; the killed node itself stays."""
    functions = F.filter("ancestors", lambda a: a["kind"] == "FunctionNode")
    under = tokens.select(*NODE, F.explode(F.transform(functions, lambda a: a["id"])).alias("_f"))
    dead = under.join(dealt(killed.select("app", "source_id", F.col("node_id").alias("_f"))), ["app", "source_id", "_f"], "left_semi").select(*NODE).distinct()
    return tokens.join(dealt(dead), NODE, "left_anti")


def in_bodies(ast: DataFrame, killed: DataFrame) -> DataFrame:
    """(NODE and further columns of killed): nodes in the body of a killed function. Its own parameters stay, and so does it."""
    above = F.filter(F.transform(F.filter("ancestors", lambda a: a["kind"] == "FunctionNode"), lambda a: a["id"]), lambda f: ~((F.col("role") == "param") & (f == F.col("parent_id"))))
    inside = ast.where(in_function()).select(*NODE, F.explode(above).alias("_f"))
    return inside.join(dealt(killed.withColumnRenamed("node_id", "_f")), ["app", "source_id", "_f"]).drop("_f").distinct()


def random_kill_set(ast: DataFrame, trials: int, ratio: float, seed: int = 0) -> DataFrame:
    """(app, trial, source_id, node_id): functions cut out at random, about 1 - ratio of a source's nodes.

    Functions are walked in preorder; immediately called ones and those of half the source or more are passed over;
    one is killed with probability need / remaining, and what lies inside goes with it. The chance comes from the MD5 of
    seed, program, source, node and trial, so a run can be repeated.
    """
    sizes = _extents(ast)
    totals = ast.groupBy("app", "source_id").agg(F.count(F.lit(1)).alias("total"))
    outer = F.filter(F.reverse("ancestors"), lambda a: a["kind"] != "ParenthesizedExpression")
    top = F.when(F.size(outer) > 0, outer[0])
    wraps = F.size("ancestors") - F.size(F.filter("ancestors", lambda a: a["kind"] != "ParenthesizedExpression"))
    slot = F.when(wraps == 0, F.col("role")).otherwise(F.element_at(F.filter("ancestors", lambda a: a["kind"] == "ParenthesizedExpression"), 1)["role"])
    one_shot = F.coalesce((top["kind"] == "FunctionCall") & (slot == "target"), F.lit(False))
    rows = ast.where("kind = 'FunctionNode'").select(*NODE, one_shot.alias("one_shot")).join(dealt(sizes), NODE).join(dealt(totals), ["app", "source_id"])
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = F.md5(F.concat_ws("/", F.lit(seed), "app", F.col("source_id").cast("string"), F.col("node_id").cast("string"), F.col("trial").cast("string")).cast("binary"))
    rows = rows.withColumn("chance", F.conv(F.substring(drawn, 1, 7), 16, 10).cast("double") / float(1 << 28))

    def walk(found: Iterator[tuple]) -> Iterator[tuple]:
        source = None
        for app, trial, source_id, node_id, one_shot, size, last, total, chance in found:
            if (app, trial, source_id) != source:
                source, dead, left, need = (app, trial, source_id), -1, total, total * (1 - ratio)
            if node_id <= dead:
                yield app, trial, source_id, node_id
            elif not one_shot and need > 0 and size < total / 2:
                kills, left = chance * left < need, left - size
                if kills:
                    need, dead = max(0, need - size), last
                    yield app, trial, source_id, node_id

    return _in_order(rows.select("app", "trial", "source_id", "node_id", "one_shot", "size", "last", "total", "chance"), walk)
