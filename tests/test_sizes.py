"""Trees are many times the size of the tables they are drawn from: nothing as large as they are may be broadcast."""

import re

import pytest

from tessera.jobs import ast_bindings as A
from tessera.jobs import ast_jobs as J
from tessera.operators import constraints as C
from tessera.operators import names as N
from tests.trees import name, node, number, program, stmt


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_planner_sees_trees_grow(spark, sf):
    trees = A.ast(spark, sf)
    assert int(trees._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 100 * trees.count()


def test_points_meet_intervals_by_shuffle(spark, sf):
    assert "BroadcastHashJoin" not in planned(J.QUERIES["n9_token_at"](spark, sf))


@pytest.mark.parametrize("of", [lambda t: C.primitive(t), lambda t: C.void(t, C.primitive(t))])
def test_nodes_meet_nodes_by_shuffle(spark, sf, of):
    """Also where the planner knows of small files only."""
    assert "BroadcastHashJoin" not in planned(of(A.trees(spark, sf)))


def test_case_asks_for_the_value_its_switch_looks_at(spark):
    case = lambda value: node("SwitchCase", ("expression", name(value)), ("statement", stmt(name("s"))))
    ast, _ = program(spark, node("SwitchStatement", ("expression", number()), ("case", case("a"))), node("SwitchStatement", ("expression", name("v")), ("case", case("b"))))
    named = ast.where("kind = 'Name'").select("node_id", "name")
    found = C.void(ast, C.primitive(ast)).join(named, "node_id").collect()
    assert {r["name"]: r["void"] for r in found if r["name"] != "s"} == {"a": True, "v": False, "b": False}
    assert all(r["void"] for r in found if r["name"] == "s")


def shuffled(df):
    """The columns that each exchange of the plan moves."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", df._jdf.queryExecution().explainString(mode))


@pytest.mark.parametrize("every, tenth", [(A.STATEMENT, A.CALL), (A.OPERATORS, A.UNUSED), (A.CLASSES, A.ACCESSORS)])
def test_no_ancestors_are_shuffled(spark, sf, every, tenth):
    trees = A.trees(spark, sf, every, tenth)
    decls = A.decls(trees)
    scopes = N.resolve_scope(N.classify_names(trees), decls).select(*N.NODE, "scope_id")
    for found in (scopes, C.constraints(trees, decls)):
        assert shuffled(found)
        assert not [x for x in shuffled(found) if "ancestors" in x]


def test_values_of_asked_nodes_only(spark, sf):
    """Asked for or not, a node's value is the same; nodes that are not asked for are not pushed to."""
    trees = A.trees(spark, sf, A.OPERATORS, A.UNUSED)
    asked = lambda kind, role, above: kind.isin("Assignment", "InfixExpression")
    whole = C.primitive(trees).join(trees.where("kind IN ('Assignment', 'InfixExpression')").select(*N.NODE), N.NODE)
    found = C.primitive(trees, asked)
    assert found.count() > 0
    assert sorted(found.collect()) == sorted(whole.select(found.columns).collect())


def test_suspicious_pairs_make_components_once(spark, sf):
    """Their plan reads the components, which it meets several times, and does not make them anew each time."""
    from tessera.jobs import compare_jobs as P

    for name in ("j10_suspicious_pairs", "j10_chained_pairs"):
        assert "MapInArrow" not in planned(P.QUERIES[name](spark, sf))


def test_tokens_come_with_lists_of_objects(spark, sf):
    """A row a token gives the components that a row for each of its objects gives, by names and by rounds."""
    from tessera.jobs import compare_jobs as P
    from tessera.operators import compare, graph

    spelled = lambda rows: sorted(map(repr, rows.select("app", "name", "item", "rep").collect()))
    want = spelled(compare.dynamic_components(P._chained(spark, sf)))
    assert spelled(compare.dynamic_components(P._chained_lists(P.B.tokens(spark, sf)))) == want
    few, graph.FEW = graph.FEW, 3
    try:
        assert spelled(compare.dynamic_components(P._chained_lists(P.B.tokens(spark, sf)))) == want
    finally:
        graph.FEW = few


def test_suspicious_pairs_move_static_tokens_once(spark, sf):
    """The heads of groups meet the components by themselves: their groups come to the tokens."""
    from tessera.jobs import compare_jobs as P

    moved = [x for x in shuffled(P.QUERIES["j10_chained_pairs"](spark, sf)) if "item" in x and "rep" in x]
    assert len(moved) <= 2


def test_type_properties_do_not_look_at_values(spark, sf):
    from tessera.jobs import graph_jobs as P
    from tessera.operators import closure

    eq, prop = P.constraints(spark, sf)
    assert not [x for x in shuffled(closure.type_properties(closure.congruence_closure(eq, prop), prop)) if "owner" in x and "value" in x and "rep" in x]
    assert not [x for x in shuffled(P.QUERIES["g6_type_properties"](spark, sf)) if "value" in x]


def test_enclosing_function_is_found_without_a_lambda(spark, sf):
    """The nearest function around a node, as a filter finds it; lambdas are interpreted, row by row."""
    trees = A.trees(spark, sf, A.CLASSES, A.ACCESSORS)
    found = trees.select("ancestors", N.enclosing().alias("fun"))
    assert "lambda" not in planned(found)
    assert all(r["fun"] == next((a["id"] for a in reversed(r["ancestors"]) if a["kind"] == "FunctionNode"), None) for r in found.collect())


def test_functions_are_walked_without_a_call_for_each_source(spark, sf):
    for name in ("e13_random_kill_set", "n14_killed_functions"):
        plan = planned(J.QUERIES[name](spark, sf))
        assert "MapInArrow" in plan
        assert "InPandas" not in plan
