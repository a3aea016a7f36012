"""Constraints are told of each node by itself and of pairs of slots; no parent gathers its children."""

import random

from tests.test_sizes import planned
from tests.trees import assign, call, fun, get, name, number, paren, program, stmt
from tessera.operators import closure as G
from tessera.operators import constraints as C
from tessera.operators import graph


def test_no_parent_gathers_its_children(spark):
    plan = planned(C.constraints(*program(spark, stmt(assign(name("a"), get(name("b"), "c"))))))
    assert "collect_list" not in plan and "map_from_entries" not in plan


def test_lists_of_ancestors_are_kept_for_few(spark):
    ast, _ = program(spark, *[stmt(assign(get(name("a"), "p"), name("b"))) for _ in range(3)], stmt(call(paren(fun(["x"], stmt(name("x")))))))
    far = C.Told(ast).flat.where("ancestors IS NOT NULL").select("kind", "name").collect()
    assert sorted((r["kind"], r["name"]) for r in far) == [("FunctionNode", ""), ("Name", "x")]


def test_assignments_have_the_value_that_is_passed_to_them(spark):
    """A number is passed through two assignments and parentheses; of a compound one only the property is told."""
    tree = lambda x: stmt(assign(name("x"), paren(assign(name("y"), x))))
    rules = lambda *s: sorted(r["rule"] for r in C.constraints(*program(spark, *s)).where("rule = 'C6'").collect())
    assert rules(tree(number())) == [] and rules(tree(name("z"))) == ["C6"] * 4
    assert rules(stmt(assign(name("x"), name("y"), op="+="))) == []
    ast, decls = program(spark, stmt(assign(name("x"), get(name("y"), "p"), op="+=")))
    assert [r["name"] for r in C.property_refs(ast).collect()] == ["p"]


def test_edges_inside_parts_are_closed_there(spark, monkeypatch):
    """With parts and without them a closure is the same, also where a part goes by rounds; no node's edges are counted by program."""
    draw = random.Random(3)
    node = lambda s: "g" if draw.random() < 0.05 else f"n:{s}:{draw.randrange(30)}"
    edges = [("a", s, node(s), node(s)) for s in range(4) for _ in range(25)]
    prop = spark.createDataFrame([("a", node(s), f"k{draw.randrange(3)}", node(s)) for s in range(4) for _ in range(20)], "app string, owner string, prty string, value string")
    eq = spark.createDataFrame([(a, None if "g" in (x, y) else s, x, y) for a, s, x, y in edges], "app string, part long, a string, b string")
    of = lambda rows: {r["node"]: r["rep"] for r in G.congruence_closure(rows, prop).collect()}
    want = of(eq.drop("part"))
    assert of(eq) == want
    monkeypatch.setattr(graph, "FEW", 2)
    assert of(eq) == want
