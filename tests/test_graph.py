"""Components and closures of random graphs, in rounds and in one task, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import closure as C
from tessera.operators import graph as G
from tessera.operators import html as H
from tessera.operators import intervals as I
from tessera.operators import names as N
from tests.trees import call, fun, get, name, program, stmt


@pytest.fixture(params=[G.FEW, -1], ids=["one task", "rounds"])
def few(request, monkeypatch):
    monkeypatch.setattr(G, "FEW", request.param)


def plain_components(pairs):
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_components(spark, few):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 215)] + [(7, 7), (300, 300)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "src int, dst int")
    assert {r["node"]: r["rep"] for r in G.connected_components(edges).collect()} == plain_components(pairs)
    keyed = spark.createDataFrame([(k, (str(a), a), (str(b), b)) for a, b in pairs for k in (("x", "y") if a % 2 else ("x",))], "k string, src struct<s:string,n:int>, dst struct<s:string,n:int>")
    found = {(r["k"], tuple(r["node"])): tuple(r["rep"]) for r in G.connected_components(keyed, keys=["k"]).collect()}
    want = {(k, n): r for k in "xy" for n, r in plain_components([((str(a), a), (str(b), b)) for a, b in pairs if k == "x" or a % 2]).items()}
    assert found == want


def test_components_of_many_keys(spark, monkeypatch):
    """Keys of few pairs are dealt out by key and need no rounds; a key of many goes by rounds."""
    from tessera.operators import compare

    rng = random.Random(5)
    pairs = sorted({(k, rng.randrange(12), rng.randrange(12)) for k in range(30) for _ in range(9)}) + [(None, 1, 2), (None, 2, 3)]
    wide = [(77, x, x + 1) for x in range(60)]
    want = lambda rows: {(k, n): r for k in {x[0] for x in rows} for n, r in plain_components([x[1:] for x in rows if x[0] == k]).items()}
    monkeypatch.setattr(G, "FEW", 5)
    found = G.connected_components(spark.createDataFrame([*pairs, *wide], "k int, src string, dst string").where("k IS NOT NULL"), keys=["k"])
    told = [(k, str(a), str(b)) for k, a, b in [*pairs, *wide] if k is not None]
    assert {(r["k"], r["node"]): r["rep"] for r in found.collect()} == want(told)
    tied = G.tied(spark.createDataFrame(pairs, "k int, src int, dst int"), ["k"], "src", "dst", both=True)
    assert {(r["k"], r["node"]): r["rep"] for r in tied.collect()} == want(pairs)

    # tokens (node, 0) of objects: the same as components of the pairs of tokens and objects
    objects = [("a", f"n{k % 3}", n, 0, 100 * k + o) for k, n, o in pairs if k is not None]
    up = {}
    for _ in range(20):
        for _, name, n, _, o in objects:
            up[name, n] = up[name, -o - 1] = min(up.get((name, n), n), up.get((name, -o - 1), n))
    rows = spark.createDataFrame(objects, "app string, name string, source_id int, pos int, obj int")
    monkeypatch.setattr(G, "_by_rounds", None)  # not needed
    monkeypatch.setattr(G, "FEW", 100)
    found = compare.dynamic_components(rows)
    assert {(r["name"], r["item"][0]): r["rep"][0] for r in found.collect()} == {x: r for x, r in up.items() if x[1] >= 0}


def test_reachable_makes_edges_once(spark, monkeypatch):
    """However many rounds there are, and whether or not parts of the result are put together."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pairs = [(k, k + 1) for k in range(8)] + [(20, 21)]
    edges = spark.createDataFrame(pairs, "src int, dst int").mapInArrow(counted, "src int, dst int")
    monkeypatch.setattr(G, "PARTS", 2)
    found = G.reachable(spark.createDataFrame([(2,), (5,)], "node int"), edges)
    assert sorted(r["node"] for r in found.collect()) == list(range(2, 9))
    assert made.value == len(pairs)


def plain_strong(edges):
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, path = {start}, [start]
        for node in path:
            fresh = {b for a, b in edges if a == node} - seen
            seen |= fresh
            path += fresh
        reach[start] = seen
    return {x: min(y for y in reach[x] if x in reach[y]) for x in reach}


def test_strong_components(spark, few):
    rng = random.Random(0)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(50 + k, 50 + (k + 1) % 9) for k in range(9)] + [(58, 70), (70, 71), (5, 5)]
    found = G.strong_components(spark.createDataFrame(edges, "src int, dst int"))
    assert {r["node"]: r["rep"] for r in found.collect()} == plain_strong(edges)


def test_graphs_without_cycles_or_edges(spark, few):
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)], "src int, dst int")
    assert {tuple(r) for r in G.strong_components(chain).collect()} == {(k, k) for k in range(13)}
    assert G.strong_components(chain.where("false")).count() == 0 and G.connected_components(chain.where("false")).count() == 0


def plain_closure(eq, prop):
    nodes = {x for e in eq for x in e} | {x for o, _, v in prop for x in (o, v)}
    up = {x: x for x in nodes}
    while True:
        before = dict(up)
        pairs = [*eq, *[(v, w) for o, p, v in prop for q, r, w in prop if p == r and up[o] == up[q]]]
        for a, b in pairs:
            low, high = sorted((up[a], up[b]))
            up = {x: low if y == high else y for x, y in up.items()}
        if up == before:
            return up


def test_closure(spark, few):
    rng = random.Random(1)
    node = lambda: f"n{rng.randrange(30)}"
    eq = [(node(), node()) for _ in range(5)]
    prop = [(node(), rng.choice("pqr"), node()) for _ in range(25)] + [(f"c{k}", "next", f"c{k + 1}") for k in range(6)] + [(f"d{k}", "next", f"d{k + 1}") for k in range(6)]
    e = spark.createDataFrame([("a", *x) for x in [*eq, ("c0", "d0")]], "app string, a string, b string")
    p = spark.createDataFrame([("a", *x) for x in prop], "app string, owner string, prty string, value string")
    want = plain_closure([*eq, ("c0", "d0")], prop)
    assert {r["node"]: r["rep"] for r in C.congruence_closure(e, p).collect()} == want
    if G.FEW > 0:
        first = C.congruence_closure(e.where("a != 'c0'"), p)
        assert {r["node"]: r["rep"] for r in C.congruence_closure(e, p, first).collect()} == want


def test_points_in_intervals(spark):
    rng = random.Random(2)
    spans = [(k % 2, s, s + rng.choice((0, 1, 5, 60, 1000))) for k in range(120) for s in [rng.randrange(2000)]] + [(0, 0, 1 << 31)]
    points = [(k % 2, rng.randrange(2100)) for k in range(80)] + [(0, 1 << 31), (1, 0)]
    found = I.holding(spark.createDataFrame(points, "k int, at long"), "at", spark.createDataFrame(spans, "k int, s long, e long"), "s", "e", ["k"])
    want = [(k, at, s, e) for k, at in points for j, s, e in spans if j == k and s <= at <= e]
    assert sorted((r["k"], r["at"], r["s"], r["e"]) for r in found.collect()) == sorted(want)


def test_ancestors_by_one_pass(spark):
    ast, _ = program(spark, stmt(call(fun(["p"], stmt(get(name("a"), "p", 1)), stmt(name("q"))))), stmt(name("z")))
    orphan = spark.createDataFrame([("a", 1, 90, 77, "left", 0, "Name", None, "x", 0, 1, 0), ("b", 1, 0, None, "statement", 0, "Name", None, "x", 0, 1, 0)], "app string, source_id long, node_id long, parent_id long, role string, ord int, kind string, op string, name string, pos long, len int, line int")
    rows = ast.drop("depth", "ancestors").unionByName(orphan)
    found = {(r["app"], r["node_id"]): (r["depth"], r["ancestors"]) for r in N.with_ancestors(rows).collect()}
    want = {(r["app"], r["node_id"]): (r["depth"], r["ancestors"]) for r in ast.collect()} | {("b", 0): (0, [])}
    assert found == want
    assert N.with_ancestors(rows.where("false")).count() == 0


def test_attributes_of_a_tag(spark):
    pages = [(1, "<a b=1 c='2' b=3 d>"), (2, "<a x=0 y='1\n2' z=5 z=6>"), (3, "<p " + " ".join(f"k{k % 700}={k}" for k in range(1500)) + ">"), (4, None)]
    rows = H.tag_attributes(spark.createDataFrame(pages, "page_id int, html string")).collect()
    by = lambda k: [(r["name"], r["value"]) for r in sorted(rows, key=lambda r: r["offset"]) if r["page_id"] == k]
    assert by(1) == [("b", "1"), ("c", "2")] and by(2) == [("z", "5")]
    assert by(3) == [(f"k{k}", str(k)) for k in range(700)] and by(4) == []
    for r in rows:
        html = dict(pages)[r["page_id"]]
        assert html[r["offset"] : r["offset"] + len(r["value"])] == r["value"]


def test_nodes_in_killed_bodies(spark):
    """Parameters of a killed function stay, those of functions inside it do not."""
    ast, _ = program(spark, stmt(fun(["p"], stmt(fun(["q"], stmt(name("x")))))))
    nodes = {(r["name"], r["kind"]): r["node_id"] for r in ast.collect()}
    outer = ast.where("kind = 'FunctionNode'").orderBy("node_id").limit(1).select("app", "source_id", "node_id")
    gone = {r["node_id"] for r in N.in_bodies(ast, outer).collect()}
    assert nodes["p", "Name"] not in gone and nodes["q", "Name"] in gone and nodes["x", "Name"] in gone
    assert gone == {r["node_id"] for r in ast.where(F.col("depth") > 1).collect()} - {nodes["p", "Name"]}
