"""Parts of programs against the whole: what all variants share is closed and typed once."""

import random

from pyspark.sql import functions as F

from tests.trees import assign, fun, get, name, program, stmt, this
from tessera.operators import compare
from tessera.operators import trials as T
from tessera.runtime import cut


def spelled(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else x for x in r) for r in rows.collect())


def test_counted_tokens_compare_like_single_ones(spark):
    draw = random.Random(7)
    tokens = [(f"a{i % 2}", f"n{draw.randrange(4)}", f"w{draw.randrange(5)}", f"p{draw.randrange(5)}", i // 20, i % 20) for i in range(200)]
    rows = spark.createDataFrame(tokens, "app string, name string, whole string, part string, source_id long, pos long")
    of = lambda rep: rows.select("app", "name", F.col(rep).alias("rep"), "source_id", "pos")
    groups = rows.groupBy("app", "name", "whole", "part", F.col("pos") % 3).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_id", "pos")).alias("head"))
    found = spelled(compare.compare_counted(groups))
    assert found == spelled(compare.compare_isolated(of("whole"), of("part")))
    assert all(r[-1] > 0 for r in found)


def test_variants_share_one_closure_of_what_all_have(spark, monkeypatch):
    """A variant's own closure gets the distinct properties between classes, however many statements there are, and the rows
    of functions that some variant lacks."""
    given, inferred = [], T.inferred
    monkeypatch.setattr(T, "inferred", lambda eq, prop, ns, methods: given.append([x.collect() for x in (eq, prop)]) or inferred(eq, prop, ns, methods))
    body = stmt(assign(name("u"), name("w")))
    ast, decls = program(spark, *[stmt(get(name("u"), "v", i)) for i in range(9)], *[stmt(get(name("w"), "v", i)) for i in range(9)], stmt(fun([], body)), stmt(this()))
    ast, decls = cut(ast), cut(decls)
    killed = ast.where("kind = 'FunctionNode'").select("app", "source_id", "node_id", F.lit(0).alias("trial"))
    found = T.compare_fragmented(ast, decls, killed, 2).collect()
    # the whole puts u and w together by the function's body, which trial 0 has not; ten tokens are apart there, and so the whole saves more
    assert {r["trial"]: (round(r["effect"]), round(r["delta"], 1), r["suspicious"]) for r in found} == {0: (100, -5.9, 0), 1: (100, 0.0, 0)}
    eq, prop = given[0]
    of = lambda rows, trial: [r for r in rows if r["app"].endswith(f"#{trial}")]
    assert len(of(prop, 0)) <= 8 and not of(eq, 0)
    assert len(of(eq, 1)) == len(of(eq, -1)) > 0
