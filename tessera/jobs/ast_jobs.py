"""Queries over syntax trees drawn from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import ast_bindings as A
from tessera.jobs import bindings as B
from tessera.jobs.token_jobs import Q
from tessera.operators import closure as G
from tessera.operators import constraints as C
from tessera.operators import edits as E
from tessera.operators import names as N
from tessera.operators import tokens as K
from tessera.operators import trials as T

QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _shape() -> str:
    """The statements' nodes as a VALUES table: place, depth, path, kind, name."""
    nodes = {x[0]: x for x in (*A.STATEMENT, *A.CALL)}
    rows = []
    for n, x in nodes.items():
        path, up = [], x[1]
        while up is not None:
            path.insert(0, up)
            up = nodes[up][1]
        rows.append(f"({n}, {len(path)}, {path!r}::INTEGER[], '{x[4]}', {'NULL' if x[6] is None else repr(x[6])}, '{x[2]}')")
    return f"sh(n, depth, path, kind, name, role) AS (VALUES {', '.join(rows)})"


NODES = f"WITH {A.SQL_EVENTS}, {_shape()}, nd AS (SELECT ev.*, sh.n, sh.depth, sh.path, sh.kind, sh.role, CASE sh.name WHEN 'user' THEN usr WHEN 'key' THEN k ELSE sh.name END AS name, user_id AS source_id, base + n AS node_id FROM ev JOIN sh ON n < 9 OR event_id % 10 = 0)"


@query("n0_with_ancestors", f"{NODES} SELECT app, source_id, node_id, depth, array_to_string(list_transform(path, lambda p: base + p), '/') AS path FROM nd")
def n0(spark, d):
    return N.with_ancestors(A.nodes(spark, d)).select("app", "source_id", "node_id", "depth", F.array_join(F.transform("ancestors", lambda a: a["id"].cast("string")), "/").alias("path"))


_KIND = "CASE WHEN n IN (4, 7) THEN 'property' ELSE 'variable' END"
_TOKENS = "n IN (3, 4, 7, 13, 17, 20, 21)"


@query("n1_classify_names", f"{NODES} SELECT app, source_id, node_id, name, {_KIND} AS ref_kind FROM nd WHERE {_TOKENS}")
def n1(spark, d):
    return N.classify_names(A.ast(spark, d)).select("app", "source_id", "node_id", "name", "ref_kind")


@query("n2_base_expr", f"{NODES} SELECT app, source_id, node_id, base + CASE n WHEN 4 THEN 3 ELSE 5 END AS base_node FROM nd WHERE n IN (4, 7)")
def n2(spark, d):
    ast = A.ast(spark, d)
    return N.base_expr(N.classify_names(ast), ast).where("ref_kind = 'property'").select("app", "source_id", "node_id", "base_node")


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    ast = A.ast(spark, d)
    return N.resolve_scope(N.classify_names(ast), A.decls(ast))


@query("n3_resolve_scope", f"{NODES} SELECT app, source_id, node_id, name, CASE WHEN n IN (13, 17, 20) THEN base + 12 END AS scope_id, n IN (13, 17, 20) AS is_local, n IN (3, 21) AS is_global FROM nd WHERE {_TOKENS} AND n NOT IN (4, 7)")
def n3(spark, d):
    """Also N4: local and global flags."""
    return _scoped(spark, d).where("ref_kind = 'variable'").select("app", "source_id", "node_id", "name", "scope_id", N.is_local().alias("is_local"), N.is_global().alias("is_global"))


@query("n5_start_and_location", f"{NODES} SELECT app, node_id, base + n AS start_pos, source_id || '@' || (base + n) AS location FROM nd WHERE {_TOKENS}")
def n5(spark, d):
    """N5 and N7."""
    rows = N.classify_names(A.ast(spark, d))
    return rows.select("app", "node_id", N.start_pos().alias("start_pos"), F.concat_ws("@", N.location()["source_id"].cast("string"), N.location()["pos"].cast("string")).alias("location"))


@query("n6_absolute_line", f"{NODES} SELECT app, node_id, CAST(event_id + CASE WHEN source_id % 2 = 0 THEN source_id * 10 ELSE 0 END AS BIGINT) AS abs_line FROM nd")
def n6(spark, d):
    """All nodes; every other source is a script cut out of a page."""
    rows = A.nodes(spark, d)
    sources = rows.select("app", "source_id", F.when(F.col("source_id") % 2 == 0, F.col("source_id") * 10).alias("lineno")).distinct()
    return N.absolute_line(rows, sources).select("app", "node_id", F.col("abs_line").cast("long").alias("abs_line"))


@query("n9_token_at", f"{NODES} SELECT app, source_id, base + 3 AS at, base + 3 AS node_id, 'Name' AS kind, usr AS name FROM nd WHERE n = 0")
def n9(spark, d):
    ast = A.ast(spark, d)
    points = ast.where("kind = 'Assignment'").select("app", "source_id", (F.col("pos") + 2).alias("at"))
    return N.token_at(ast, points)


@query("n11_tokens_on_line", f"{NODES} SELECT app, source_id, node_id, name, CAST(CASE n WHEN 4 THEN 1 ELSE 2 END AS INTEGER) AS nth FROM nd WHERE n IN (4, 7) AND event_id = 4000")
def n11(spark, d):
    rows = N.classify_names(A.ast(spark, d)).withColumn("abs_line", F.col("line"))
    return N.tokens_on_line(rows, F.lit(4001)).select("app", "source_id", "node_id", "name", "nth")


@query("n13_expr_ids", f"{NODES} SELECT app, source_id, source_id || '@' || (row_number() OVER (PARTITION BY app, source_id ORDER BY node_id) - 1) AS expr_id, base + CASE n WHEN 2 THEN 3 ELSE 5 END AS node_id FROM nd WHERE n IN (2, 5)")
def n13(spark, d):
    return N.expr_ids(A.ast(spark, d))


def _first_kill(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ast = A.trees(spark, d)
    keys = ast.select("app", "source_id", F.lit(0).alias("trial"), F.lit(2).alias("ordinal")).distinct()
    return ast, N.declared_functions_ordinals(ast, keys)


@query("n14_killed_functions", f"{NODES} SELECT app, 0 AS trial, source_id, min(node_id) AS node_id FROM nd WHERE n = 12 GROUP BY app, source_id")
def n14(spark, d):
    return _first_kill(spark, d)[1]


@query("j7_survivors", f"{NODES}, f AS (SELECT app, source_id, min(node_id) AS dead FROM nd WHERE n = 12 GROUP BY app, source_id) SELECT nd.app, nd.source_id, node_id, name FROM nd LEFT JOIN f ON f.app = nd.app AND f.source_id = nd.source_id WHERE {_TOKENS} AND NOT coalesce(node_id > dead AND node_id <= dead + 8, false)")
def j7(spark, d):
    ast, killed = _first_kill(spark, d)
    return N.survivors(N.classify_names(ast), killed).select("app", "source_id", "node_id", "name")


@query("a16_subtree_sizes", f"{NODES} SELECT app, source_id, node_id, CAST(8 AS BIGINT) AS size FROM nd WHERE n = 12")
def a16(spark, d):
    return N.subtree_sizes(A.ast(spark, d))


def _n(i: int) -> str:
    return f"'n:' || user_id || ':' || (base + {i})"


def _s(letter: str = "s", i: int = 12) -> str:
    return f"'{letter}:' || user_id || ':' || (base + {i})"


_RULES = [
    (False, "C6", "eq", _n(1), "NULL", _n(2)), (False, "C6", "eq", _n(2), "NULL", _n(5)), (False, "C7", "prop", _n(3), "k", _n(2)), (False, "C14", "prop", "'g'", "usr", _n(3)), (False, "C15", "prop", _n(5), "'v'", _n(8)),
    (True, "C18", "eq", _n(11), "NULL", _n(12)), (True, "C4", "eq", _n(21), "NULL", _n(13)), (True, "C4", "prop", _s(), "'@return'", _n(10)), (True, "C4", "prop", _s(), "'@this'", "'g'"),
    (True, "C22", "prop", _n(12), "'prototype'", _s("t")), (True, "C22", "prop", _s(), "'@this'", _s("t")), (True, "C22", "prop", _s(), "'p'", _n(13)), (True, "C13", "prop", _s(), "'@this'", _n(18)),
    (True, "C21", "eq", _n(17), "NULL", _n(18)), (True, "C14", "prop", _s(), "'t'", _n(17)), (True, "C14", "prop", _s(), "'p'", _n(20)), (True, "C14", "prop", "'g'", "usr", _n(21)), (True, "C20", "prop", _s(), "'@return'", _n(20)),
]


_OPERATOR_RULES = [
    *[(False, "C14", "prop", "'g'", "usr", _n(i)) for i in (2, 6, 8, 13)], *[(False, "C14", "prop", "'g'", "k", _n(i)) for i in (4, 12, 16)],
    (False, "C6", "eq", _n(1), "NULL", _n(2)), (False, "C6", "eq", _n(2), "NULL", _n(3)), (False, "C2", "eq", _n(3), "NULL", _n(5)), (False, "C2", "eq", _n(3), "NULL", _n(10)),
    (False, "C1", "prop", _n(5), "'@array'", _n(6)), (False, "C1", "prop", _n(5), "'@array'", _n(7)), (False, "C3", "prop", _n(8), "k", _n(7)),
    (False, "C9", "eq", _n(11), "NULL", _n(13)), (False, "C10", "eq", _n(10), "NULL", _n(11)), (False, "C10", "eq", _n(10), "NULL", _n(14)), (False, "C18", "eq", _n(14), "NULL", _n(15)), (False, "C11", "eq", _n(15), "NULL", _n(17)),
    *[(True, "C14", "prop", "'g'", "usr", _n(i)) for i in (21, 23)], *[(True, "C14", "prop", "'g'", "k", _n(i)) for i in (20, 24)],
]

_CLASS_RULES = [
    (False, "C14", "prop", "'g'", "usr", _n(4)), (False, "C14", "prop", "'g'", "usr", _n(9)), (False, "C6", "eq", _n(1), "NULL", _n(2)), (False, "C6", "eq", _n(2), "NULL", _n(7)),
    (False, "C7", "prop", _n(3), "'prototype'", _n(2)), (False, "C7", "prop", _n(4), "k", _n(3)), (False, "C7", "prop", _n(9), "k", _n(8)), (False, "C5", "ns", _n(9), "NULL", "NULL"), (False, "C8", "ns", _n(4), "NULL", "NULL"),
    (True, "C19", "prop", "'g'", "k", _n(12)), (True, "C20", "prop", _s(), "'@return'", _n(16)), (True, "C22", "prop", _s(), "'p'", _n(13)), (True, "C22", "prop", _s("s", 23), "'w'", _n(24)),
    *[(True, "C22", "prop", _n(i), "'prototype'", _s("t", i)) for i in (12, 19, 23, 28)], *[(True, "C22", "prop", _s("s", i), "'@this'", _s("t", i)) for i in (12, 19, 23, 28)],
    *[(True, "C16", "prop", _s("s", f), "'@this'", _n(16)) for f in (19, 23)], *[(True, "C16", "prop", _n(16), "'v'", _s("u", e)) for e in (17, 21)], (True, "C16", "prop", _s("s", 19), "'@return'", _s("u", 17)),
    (True, "C17", "prop", _s("s", 23), "'w'", _s("u", 21)), (True, "C15", "prop", _n(16), "'m'", _n(28)), (True, "C15", "method", _n(16), "NULL", _s("t", 28)), (True, "C12", "prop", _s("s", 28), "'f'", _n(28)),
]


def _rules_sql(rules: list[tuple]) -> str:
    parts = [f"SELECT app, '{r}' AS rule, '{k}' AS kind, {a} AS a, {p} AS prty, {b} AS b FROM ev{' WHERE event_id % 10 = 0' if tenth else ''}" for tenth, r, k, a, p, b in rules]
    return f"WITH {A.SQL_EVENTS} " + " UNION ALL ".join(parts) + " UNION ALL SELECT DISTINCT app, 'C25', 'prop', 'g', 'window', 'g' FROM ev"


@query("c_constraints", _rules_sql(_RULES))
def c(spark, d):
    """All rules that these programs call for: C4, C6, C7, C13, C14, C15, C18, C20, C21, C22, C25."""
    ast = A.trees(spark, d)
    return C.constraints(ast, A.decls(ast))


@query("c_operator_constraints", _rules_sql(_OPERATOR_RULES))
def c_operators(spark, d):
    """C1, C2, C3, C9, C10, C11, with values that nobody uses."""
    ast = A.trees(spark, d, A.OPERATORS, A.UNUSED)
    return C.constraints(ast, A.decls(ast))


@query("c_class_constraints", _rules_sql(_CLASS_RULES))
def c_classes(spark, d):
    """C5, C8, C12, C16, C17, C19: namespaces, methods, accessors and named functions."""
    ast = A.trees(spark, d, A.CLASSES, A.ACCESSORS)
    return C.constraints(ast, A.decls(ast))


@query("c23_primitive", f"{NODES} SELECT app, source_id, node_id FROM nd WHERE n = 8")
def c23(spark, d):
    return C.primitive(A.trees(spark, d)).where("prim").select("app", "source_id", "node_id")


@query("c24_void", f"{NODES} SELECT app, source_id, node_id FROM nd WHERE n IN (1, 10, 17)")
def c24(spark, d):
    ast = A.trees(spark, d)
    return C.void(ast, C.primitive(ast, C.looked_at)).where("void").select("app", "source_id", "node_id")


_TYPED = f"WITH {A.SQL_EVENTS}, t AS (SELECT app, k AS name, 'u' || user_id AS cls FROM ev UNION ALL SELECT app, 'v', user_id || '/' || k FROM ev), g AS (SELECT app, name, cls, count(*) AS size FROM t GROUP BY ALL)"


@query("g5_infer_types", f"{_TYPED} SELECT app, name, search_replace, rename, 100.0 * (search_replace - rename) / search_replace AS effect FROM (SELECT app, name, CAST(sum(size) AS BIGINT) - 1 AS search_replace, count(*) - 1 AS rename FROM g GROUP BY app, name) WHERE search_replace > 0")
def g5(spark, d):
    """Trees to constraints, closure, typed tokens (J2), groups and statistics, end to end."""
    ast = A.trees(spark, d)
    return K.name_stats(K.group_sizes(C.property_tokens(ast, A.decls(ast))))


@query("j2_tokens_with_type", f"{_TYPED} SELECT app, name, CAST(size AS BIGINT) AS size, count(*) AS groups FROM g GROUP BY app, name, size")
def j2(spark, d):
    ast = A.trees(spark, d)
    return K.group_sizes(C.property_tokens(ast, A.decls(ast))).groupBy("app", "name", "size").agg(F.count(F.lit(1)).alias("groups"))


@query("e1_route", f"{NODES} SELECT app, source_id, node_id, CASE WHEN n IN (4, 7) THEN 'property' WHEN n IN (13, 17, 20) THEN 'local' ELSE 'global' END AS route FROM nd WHERE {_TOKENS}")
def e1(spark, d):
    return E.route(_scoped(spark, d).withColumn("base_is_global", F.lit(False))).select("app", "source_id", "node_id", "route")


@query("e3_local_questions", f"{NODES} SELECT app, source_id, base + 12 AS scope_id, name, string_agg(node_id, ',' ORDER BY node_id) AS tokens FROM nd WHERE n IN (13, 20) GROUP BY ALL")
def e3(spark, d):
    rows = _scoped(spark, d)
    return E.local_questions(rows, rows.where("name = 'p'")).select("app", "source_id", "scope_id", "name", F.array_join("tokens", ",").alias("tokens"))


@query("e4_global_questions", f"{NODES} SELECT app, name, 1 AS question, count(*) AS n, min(node_id) AS first FROM nd WHERE n IN (3, 21) GROUP BY app, name")
def e4(spark, d):
    rows = _scoped(spark, d).withColumn("base_is_global", F.lit(False))
    found = E.global_questions(rows, rows.where(N.is_global()))
    return found.select("app", "name", "question", F.size("tokens").cast("long").alias("n"), F.array_min(F.transform("tokens", lambda t: t["pos"])).alias("first"))


_LABELLED = "SELECT app, user_id AS source_id, base + {0} AS statement, k AS name, (base + {1}) || ',' || (base + {2}) AS tokens FROM ev"


@query("e5_label_questions", f"WITH {A.SQL_EVENTS} {_LABELLED.format(0, 1, 8)} UNION ALL {_LABELLED.format(3, 4, 6)} WHERE event_id % 2 = 1")
def e5(spark, d):
    """Asked: every outer use, and the inner ones of odd events; uses inside the function mean no label."""
    rows = A.ast(spark, d, A.LABELS, ())
    place = F.col("pos") % A.STEP
    asked = rows.where((place == 8) | (place == 11) | ((place == 6) & (F.col("line") % 2 == 1)))
    return E.label_questions(rows, asked).select("app", "source_id", "statement", "name", F.array_join("tokens", ",").alias("tokens"))


def _kill_sql(functions: str, nodes: str) -> str:
    """The walk over the functions of a source: state is the nodes still wanted, those still ahead, and where a killed function
    ends. ``functions`` has (app, source_id, node_id, size, called), ``nodes`` counts those of an event."""
    return f"""f AS ({functions}),
total AS (SELECT app, user_id AS source_id, sum({nodes}) AS total FROM ev GROUP BY ALL),
fn AS (SELECT f.*, total, trial, CAST(('0x' || substr(md5('0/' || f.app || '/' || f.source_id || '/' || node_id || '/' || trial), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE AS chance, row_number() OVER (PARTITION BY f.app, f.source_id, trial ORDER BY node_id) AS rn
  FROM f JOIN total t ON t.app = f.app AND t.source_id = f.source_id, (VALUES (0), (1), (2)) AS x(trial) WHERE NOT called),
w AS (SELECT app, source_id, trial, CAST(0 AS BIGINT) AS rn, total * 0.5::DOUBLE AS need, CAST(total AS BIGINT) AS ahead, CAST(-1 AS BIGINT) AS dead, CAST(NULL AS BIGINT) AS node_id FROM fn GROUP BY app, source_id, trial, total
  UNION ALL
  SELECT app, source_id, trial, rn, CASE WHEN kills THEN greatest(0, need - size) ELSE need END, CASE WHEN looks THEN ahead - size ELSE ahead END, CASE WHEN kills THEN place + size ELSE dead END, CASE WHEN kills OR inside THEN place END FROM
  (SELECT *, looks AND chance * ahead < need AS kills FROM (SELECT w.app, w.source_id, w.trial, fn.rn, need, ahead, dead, size, chance, fn.node_id AS place, fn.node_id <= dead AS inside, fn.node_id > dead AND need > 0 AND size < total / 2.0 AS looks
    FROM w JOIN fn ON fn.app = w.app AND fn.source_id = w.source_id AND fn.trial = w.trial AND fn.rn = w.rn + 1)))"""


_KILLED = _kill_sql("SELECT app, user_id AS source_id, base + 12 AS node_id, 8 AS size, true AS called FROM ev UNION ALL SELECT app, user_id, base + 22, 7, false FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, user_id, base + 25, 4, false FROM ev WHERE event_id % 10 = 0", "13 + CASE WHEN event_id % 10 = 0 THEN 8 ELSE 0 END")


@query("e13_random_kill_set", f"WITH RECURSIVE {A.SQL_EVENTS}, {_KILLED} SELECT app, CAST(trial AS INTEGER) AS trial, source_id, node_id FROM w WHERE node_id IS NOT NULL")
def e13(spark, d):
    """Every event calls a function at once, which stays; every tenth declares one with another inside."""
    return N.random_kill_set(A.trees(spark, d, A.CALL, A.NESTED), 3, 0.5)


def _parts_sql(links: str) -> str:
    """Types of the programs of USES and PARTS, for variants: ``links`` has (app, variant, usr, k), a row a function that ties a
    name to a key and makes a new object of it. Names tied together are one type, a namespace; a method of any other has its type.
    Wanted: tk (app, variant, of, name, usr, k, this, item), tokens with the variant that types them."""
    return f"""lk AS (SELECT DISTINCT app, variant, usr, k FROM ({links})),
ed AS (SELECT app, variant, usr AS x, k AS y FROM lk UNION SELECT app, variant, k, usr FROM lk),
rc AS (SELECT app, variant, x, y FROM ed UNION SELECT rc.app, rc.variant, rc.x, ed.y FROM rc JOIN ed ON ed.app = rc.app AND ed.variant = rc.variant AND ed.x = rc.y),
cm AS (SELECT app, variant, x, min(y) AS rep FROM rc GROUP BY ALL),
ty AS (SELECT tk.*, CASE WHEN tk.this AND cm.rep IS NOT NULL THEN 'this ' ELSE '' END || coalesce(cm.rep, tk.base) AS rep FROM tk LEFT JOIN cm ON cm.app = tk.app AND cm.variant = tk.of AND cm.x = tk.base),
hd AS (SELECT *, min(item) OVER (PARTITION BY app, variant, of, name, rep) AS head FROM ty),
wh AS (SELECT * FROM hd WHERE of = -1), pt AS (SELECT * FROM hd WHERE of != -1),
np AS (SELECT p.app, p.variant, count(*) AS n FROM pt p JOIN wh a ON a.app = p.app AND a.variant = p.variant AND a.name = p.name AND a.item = p.head JOIN wh b ON b.app = p.app AND b.variant = p.variant AND b.name = p.name AND b.item = p.item WHERE a.rep != b.rep GROUP BY ALL),
""" + ", ".join(f"{o} AS (SELECT app, variant, {B.EFFECT} AS effect FROM (SELECT app, variant, sum(size) - 1 AS search_replace, count(*) - 1 AS rename FROM (SELECT app, variant, name, rep, count(*) AS size FROM {t} GROUP BY ALL) GROUP BY app, variant, name) WHERE search_replace > 0 GROUP BY app, variant)" for o, t in (("we", "wh"), ("pe", "pt")))


_DELTA = "we.effect, pe.effect - we.effect AS delta, coalesce(n, 0) AS suspicious FROM we JOIN pe USING (app, variant) LEFT JOIN np USING (app, variant)"
_PART_TOKENS = "pk AS (SELECT app, user_id AS source_id, base + 3 AS item, 'v' AS name, usr AS base, false AS this, NULL AS inside FROM ev UNION ALL SELECT app, user_id, base + 8, 'm', usr, false, NULL FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, user_id, base + 14, 'v', usr, true, base + 9 FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, user_id, base + 25, 'c', k, false, base + 15 FROM ev WHERE event_id % 10 = 0)"
_PART_KILLED = _kill_sql("SELECT app, user_id AS source_id, base + 9 AS node_id, 5 AS size, false AS called FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, user_id, base + 15, 10, false FROM ev WHERE event_id % 10 = 0", "4 + CASE WHEN event_id % 10 = 0 THEN 22 ELSE 0 END")


@query(
    "e14_compare_fragmented",
    f"WITH RECURSIVE {A.SQL_EVENTS}, {_PART_KILLED}, kd AS (SELECT trial, node_id FROM w WHERE node_id IS NOT NULL), {_PART_TOKENS},"
    " tr AS (SELECT unnest([0, 1, 2]) AS trial), lv AS (SELECT pk.*, trial AS variant FROM pk, tr WHERE NOT EXISTS (SELECT 1 FROM kd WHERE kd.trial = tr.trial AND kd.node_id = pk.inside)),"
    f" tk AS (SELECT *, -1 AS of FROM lv UNION ALL SELECT *, variant AS of FROM lv), {_parts_sql('SELECT app, -1 AS variant, usr, k FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, trial, usr, k FROM ev, tr WHERE event_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM kd WHERE kd.trial = tr.trial AND kd.node_id = base + 15)')}"
    f" SELECT app, CAST(variant AS INTEGER) AS trial, {_DELTA}",
)
def e14(spark, d):
    """Three trials cut functions out at random; what is left is typed anew, and compared where it survives."""
    ast = A.trees(spark, d, A.USES, A.PARTS)
    return T.compare_fragmented(ast, A.decls(ast), N.random_kill_set(ast, 3, 0.5), 3)


@query(
    "e15_compare_isolated",
    f"WITH RECURSIVE {A.SQL_EVENTS}, {_PART_TOKENS}, lv AS (SELECT *, 0 AS variant FROM pk WHERE NOT starts_with(CAST(source_id AS VARCHAR), '1')), tk AS (SELECT *, -1 AS of FROM lv UNION ALL SELECT *, 0 AS of FROM lv),"
    f" {_parts_sql('SELECT app, -1 AS variant, usr, k FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT app, 0, usr, k FROM ev WHERE event_id % 10 = 0 AND NOT starts_with(CAST(user_id AS VARCHAR), chr(49))')} SELECT app, {_DELTA}",
)
def e15(spark, d):
    """Library code is the sources whose path begins with lib/1; they are typed with the program, and the program without them."""
    ast = A.trees(spark, d, A.USES, A.PARTS)
    sources = ast.select("app", "source_id").distinct().withColumn("path", F.concat(F.lit("lib/"), F.col("source_id").cast("string")))
    libs = sources.select("app", F.lit("one").alias("key"), F.lit("lib/1").alias("path_prefix")).distinct()
    return T.compare_isolated(ast, A.decls(ast), sources, libs)


@query(
    "g5_infer_parts",
    f"WITH RECURSIVE {A.SQL_EVENTS}, {_PART_TOKENS}, tk AS (SELECT * REPLACE (CASE WHEN name = 'c' AND item // 32 % 20 = 0 THEN 'alone ' || item ELSE base END AS base), -1 AS of, -1 AS variant FROM pk), {_parts_sql('SELECT app, -1 AS variant, usr, k FROM ev WHERE event_id % 10 = 0 AND event_id % 20 != 0')}"
    " SELECT app, name, CAST(size AS BIGINT) AS size, count(*) AS groups FROM (SELECT app, name, rep, count(*) AS size FROM ty GROUP BY ALL) GROUP BY ALL",
)
def g5_parts(spark, d):
    """Namespaces and methods: every other tying function is not looked at, so some names are namespaces and others share their methods' type; what stands in it is of a type of its own."""
    ast = A.trees(spark, d, A.USES, A.PARTS)
    ignored = ast.where((F.col("node_id") % A.STEP == 15) & (F.floor(F.col("node_id") / A.STEP) % 20 == 0)).select("app", "source_id", "node_id")
    return K.group_sizes(C.property_tokens(ast, A.decls(ast), ignored)).groupBy("app", "name", "size").agg(F.count(F.lit(1)).alias("groups"))
