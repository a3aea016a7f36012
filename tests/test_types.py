"""Same-type inference on small trees: groups of property tokens by line."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.trees import assign, call, fun, get, infix, name, node, number, obj, paren, program, ret, stmt, this, var
from tessera.operators import constraints as C
from tessera.operators import names as N
from tessera.runtime import cut


PROGRAMS = {}


@pytest.fixture(scope="module")
def found(spark):
    """All programs typed in one run, each an app of its own."""
    trees = [program(spark, *statements, app=app) for app, statements in PROGRAMS.items()]
    ast, decls = reduce(lambda x, y: (x[0].unionByName(y[0]), x[1].unionByName(y[1])), trees)
    rows = C.property_tokens(cut(ast), cut(decls)).groupBy("app", "name", "rep").agg(F.array_sort(F.collect_set("line")).alias("lines")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["app"], {}).setdefault(r["name"], []).append(r["lines"])
    return {app: {k: sorted(v) for k, v in names.items()} for app, names in out.items()}


PROGRAMS["namespace"] = (
    stmt(assign(name("lib"), obj())),
    stmt(assign(get(name("lib"), "A", 2), fun(["x"], stmt(assign(get(this(), "x", 3), name("x")))))),
    stmt(assign(get(name("lib"), "B", 4), fun(["x"], stmt(assign(get(this(), "x", 5), name("x")))))),
    stmt(call(get(name("lib"), "A", 6), number(), new=True)),
)
PROGRAMS["methods"] = (var("o", obj(("x", number()), ("f", fun([], stmt(get(this(), "x", 7)))))), stmt(get(name("o"), "x", 8)))
PROGRAMS["prototype"] = (
    node("FunctionNode", ("param", name("x")), ("body", node("Block", ("statement", stmt(assign(get(this(), "x", 1), name("x")))))), name="V"),
    stmt(assign(get(get(name("V"), "prototype", 2), "size", 2), fun([], ret(get(this(), "x", 3))))),
)
PROGRAMS["called"] = (
    stmt(assign(name("r"), call(paren(fun(["p"], stmt(get(name("p"), "q", 1)), ret(name("p")))), name("arg")))),
    stmt(get(name("arg"), "q", 2)),
    stmt(get(name("r"), "q", 3)),
    stmt(get(name("other"), "q", 4)),
)
PROGRAMS["scopes"] = (stmt(get(name("b"), "foo", 1)), stmt(call(paren(fun([], var("b", obj()), stmt(get(name("b"), "foo", 2)))))))
PROGRAMS["used"] = (stmt(assign(name("z"), infix("||", name("a"), name("b")))), stmt(get(name("a"), "p", 1)), stmt(get(name("b"), "p", 2)))
PROGRAMS["unused"] = (stmt(infix("||", name("a"), name("b"))), stmt(get(name("a"), "p", 1)), stmt(get(name("b"), "p", 2)))


def rules(spark, *statements):
    return {(r["rule"], r["kind"]) for r in C.constraints(*program(spark, *statements)).collect()}


def test_constructors_in_a_namespace_stay_apart(found):
    """lib.A and lib.B set x on their own instances; being made by new marks lib, so its methods do not merge its types."""
    assert found["namespace"]["x"] == [[3], [5]]
    assert found["namespace"]["A"] == [[2, 6]]


def test_methods_of_a_plain_object_share_its_type(found):
    assert found["methods"]["x"] == [[0, 7, 8]]


def test_prototype_joins_instances(found):
    assert found["prototype"]["x"] == [[1, 3]]


def test_called_function_binds_arguments_and_result(found):
    assert found["called"]["q"] == [[1, 2, 3], [4]]


def test_locals_and_globals_of_one_name_are_apart(found):
    assert found["scopes"]["foo"] == [[1], [2]]


def test_void_and_primitive(spark, found):
    assert found["used"]["p"] == [[1, 2]] and found["unused"]["p"] == [[1], [2]]
    ast, _ = program(spark, stmt(assign(name("x"), infix(",", name("y"), number()))), stmt(assign(name("x"), infix("&&", number(), this()))), stmt(assign(name("x"), name("y"), op="+=")))
    prim = {r["node_id"] for r in C.primitive(ast).where("prim").collect()}
    kinds = {r["node_id"]: r for r in ast.collect()}
    assert sorted(kinds[i]["kind"] for i in prim) == ["Assignment", "Assignment", "InfixExpression", "NumberLiteral", "NumberLiteral"]


def test_every_rule_has_its_tree(spark):
    cond = node("ConditionalExpression", ("test", name("t")), ("then", name("a")), ("else", name("b")))
    element = node("ElementGet", ("target", name("a")), ("element", node("StringLiteral", name="k")))
    statement_function = node("FunctionNode", ("param", name("p")), ("body", node("Block", ("statement", ret(name("p"))))), name="f")
    found = rules(
        spark,
        stmt(assign(name("x"), node("ArrayLiteral", ("element", name("a"))))),
        stmt(assign(name("x"), cond)),
        stmt(element),
        stmt(call(fun(["p"]), name("a"))),
        stmt(call(get(get(name("a"), "b"), "c"), new=True)),
        stmt(assign(get(name("a"), "m"), fun([], called="named"))),
        stmt(get(get(name("a"), "B"), "prototype")),
        stmt(infix("&&", name("a"), name("b"))),
        stmt(assign(name("x"), infix("||", name("a"), name("b")))),
        stmt(infix(",", name("a"), name("b"))),
        stmt(this()),
        stmt(assign(name("x"), obj(("k", fun([]))))),
        stmt(assign(name("x"), obj(("k", fun([])), op="get"))),
        stmt(assign(name("x"), obj(("k", fun(["v"])), op="set"))),
        stmt(paren(name("a"))),
        statement_function,
        var("y", name("x")),
    )
    assert {r for r, _ in found} == {f"C{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 25)}
    assert ("C6", "method") in found and ("C15", "method") in found


def test_labels(spark):
    from tessera.operators import edits as E

    loop = lambda inner: node("LabeledStatement", ("label", node("Label", name="l")), ("statement", inner))
    brk = node("BreakStatement", ("label", name("l")))
    ast, _ = program(spark, loop(node("Block", ("statement", brk), ("statement", loop(brk)))), loop(brk))
    targets = N.classify_names(ast).where("ref_kind = 'label' AND kind = 'Name'").orderBy("node_id").limit(1)
    got = E.label_questions(ast, targets).collect()
    assert len(got) == 1 and len(got[0]["tokens"]) == 2


def test_ignored_bodies_are_not_looked_at(spark):
    ast, decls = program(spark, stmt(call(paren(fun([], stmt(get(name("a"), "p", 1)))))))
    killed = ast.where("kind = 'FunctionNode'").select("app", "source_id", "node_id")
    assert not C.constraints(ast, decls, killed).where("rule = 'C7'").head(1)
    assert C.constraints(ast, decls).where("rule = 'C7'").count() == 1


def test_closure_makes_what_it_meets_once(spark, monkeypatch):
    """Chains o.k, o.k.k, ...: each round looks at the properties of what grew, which are written and not made anew for each
    use; tokens get their classes without those of all nodes being made."""
    from tessera.operators import closure as G

    seen, clashes = [], G._clashes
    monkeypatch.setattr(G, "_clashes", lambda prop: seen.append(prop._jdf.queryExecution().optimizedPlan().toString()) or clashes(prop))
    prop = spark.createDataFrame([("a", f"n:1:{i}{x}", "k", f"n:1:{i + 1}{x}") for i in range(4) for x in (0, 5)], "app string, owner string, prty string, value string")
    eq = spark.createDataFrame([("a", "n:1:0" + x, "n:1:00") for x in "05"], "app string, a string, b string")
    none = spark.createDataFrame([], "app string, node string, host string, receiver string")
    found = G.inferred(eq, prop.unionByName(prop), none, none)
    assert len(seen) > 3 and not [p for p in seen if "Join" in p]
    tokens = spark.createDataFrame([("a", 1, "property", n) for n in (0, 5, 40, 45, 99)], "app string, source_id long, ref_kind string, base_node long")
    rows = {r["base_node"]: r["rep"] for r in C.tokens_with_type(tokens, found).collect()}
    assert rows == {r["base_node"]: r["rep"] for r in C.tokens_with_type(tokens, found.typing()).collect()}
    assert rows[40] == rows[45] and rows[99] == "n:1:99"


def test_variables_in_no_scope_meet_no_declaration(spark, monkeypatch):
    asked, resolve = [], N.resolve_scope
    monkeypatch.setattr(N, "resolve_scope", lambda tokens, decls: asked.append(tokens) or resolve(tokens, decls))
    ast, decls = program(spark, stmt(name("a")), stmt(call(paren(fun(["p"], stmt(name("p")), stmt(name("q")))))))
    rows = {(r["a"] if r["a"] == "g" else r["a"][0], r["prty"]) for r in C.constraints(ast, decls).where("rule = 'C14'").collect()}
    assert rows == {("g", "a"), ("s", "p"), ("g", "q")}
    assert sorted(r["name"] for r in asked[0].collect()) == ["p", "q"]
