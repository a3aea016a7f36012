"""Hand-made inputs: places in pages and texts, relations with changes, graphs, edits, corpus files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import edits as E
from tessera.operators import graph as G
from tessera.operators import html as H
from tessera.operators import names as N
from tessera.operators import relations as R
from tessera.sources import files as S

PAGE = '<html>\n  <body onload="start()">\r\n\t<a href=" JavaScript:go(a.b)" onclick=\' x() \'>é😀</a>\r<script>var i = "<!-- no -->";</script>\n<!-- <script>off()</script> -->\n<script src=lib/a.js></script><script type="text/template" onload="t()">no</script>\n<p onClick="no()" onclick=go class="a\nb" onfocus="f()" onblur="b()" onblur="c()"></p></html>'


def test_fragments_stand_where_they_say(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    found = H.extract_fragments(pages)
    got = [(r["origin"], r["kind"], r["attr"], r["code"] if r["kind"] == "inline" else r["url"], r["frag_index"]) for r in found.orderBy("line", "col").collect()]
    inline = [g for g in got if g[1] == "inline"]
    assert [g[3] for g in sorted(inline, key=lambda g: g[4])] == ["start()", "go(a.b)", " x() ", 'var i = "<!-- no -->";', "t()", "f()", "b()"]
    assert [g[3] for g in got if g[1] == "extern"] == ["lib/a.js"]
    assert H.check_fragments(found, pages).count() == 0


def test_line_starts_and_offsets(spark):
    texts = [(1, "a\nb\r\nc\rd"), (2, "x\n"), (3, ""), (4, "\r\n\r\n"), (5, "no break")]
    docs = spark.createDataFrame(texts, "k long, t string")
    starts = {r["k"]: r["s"] for r in docs.select("k", X.line_starts(F.col("t")).alias("s")).collect()}
    assert starts == {1: [0, 2, 5, 7, 8], 2: [0, 2], 3: [0], 4: [0, 2, 4], 5: [0, 8]}
    lines = H.line_starts(docs, "k", "t")
    points = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (1, 5), (1, 8), (1, 9), (3, 0)], "k long, offset int")
    assert {(r["k"], r["offset"]): (r["line"], r["col"]) for r in H.offset_to_line(points, lines, "k").collect()} == {(1, 0): (0, 0), (1, 2): (1, 0), (1, 4): (1, 2), (1, 5): (2, 0), (1, 8): (3, 1), (1, 9): (None, None), (3, 0): (None, None)}


def test_components_and_reachability_against_plain_search(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    nodes = {x for e in edges for x in e}

    def reach(start, step):
        seen, stack = set(), [start]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += step(x)
        return seen

    forward = {n: [b for a, b in edges if a == n] for n in nodes}
    both = {n: forward[n] + [a for a, b in edges if b == n] for n in nodes}
    assert {(x["node"], x["rep"]) for x in G.connected_components(frame).collect()} == {(n, min(reach(n, both.get))) for n in nodes}
    out = {n: reach(n, forward.get) for n in nodes}
    assert {(x["node"], x["rep"]) for x in G.strong_components(frame).collect()} == {(n, min(m for m in out[n] if n in out[m])) for n in nodes}


def test_relation_laws(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (1, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 2), (3, 3)], "k int, v int")
    one = lambda df: df.first()[0]
    assert one(R.adds(a, b)) and not one(R.adds(a, a)) and one(R.removes(a, b)) and not one(R.removes(a, b.where("k = 3")))
    assert one(R.equals(R.union(R.subtract(a, b), b), R.union(a, b))) and not one(R.equals(a, b))
    assert one(R.equals(R.inverse(R.inverse(a)), a)) and one(R.submap_of(b, R.union(a, b))) and not one(R.submap_of(b, a))


def test_edits_and_back(spark):
    docs = spark.createDataFrame([(1, "ab😀cd ef"), (2, "same"), (3, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 3, 2, "LONGER"), (1, 0, 1, ""), (1, 6, 2, "x")], "doc_id long, offset int, length int, replacement string")
    assert {r["doc_id"]: r["text"] for r in E.apply_edits(docs, edits).collect()} == {1: "b😀LONGER x", 2: "same", 3: None}
    bodies = spark.createDataFrame([(1, 0, 6), (1, 1, 3)], "doc_id long, start int, end int")
    assert E.blank_functions(docs.limit(1), bodies).first()["text"] == "{ /* removed! */ " + " " * 6 + "}ef"


def test_random_kills(spark):
    from tests.trees import fun, name, program, stmt

    body = [stmt(name(f"x{i}")) for i in range(4)]
    ast, _ = program(spark, *[stmt(fun([], *body, stmt(fun([], *body)))) for _ in range(12)])
    killed = N.random_kill_set(ast, 2, 0.5)
    got = [(r["trial"], r["node_id"]) for r in killed.collect()]
    above = {r["node_id"]: {a["id"] for a in r["ancestors"]} for r in ast.where("kind = 'FunctionNode'").collect()}
    for trial in (0, 1):
        mine = {n for t, n in got if t == trial}
        assert 0 < len(mine) < 24 and all(n in mine for n in above for m in above[n] if m in mine)


def test_corpus_files(spark, tmp_path):
    for path in ("games/pong/index.html", "games/pong/a.JS", "games/.git/x.js", "games/pong/readme.txt", "libs/q/q.js"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"// {path}")
    rows = S.read_sources(spark, str(tmp_path))
    assert {(r["path"], r["ext"]) for r in rows.collect()} == {("games/pong/index.html", "html"), ("games/pong/a.JS", "js"), ("libs/q/q.js", "js")}
    assert [r["content"] for r in S.named_sources(spark, [str(tmp_path / "libs/q/q.js")]).collect()] == ["// libs/q/q.js"]
    with pytest.raises(ValueError, match="readme.txt"):
        S.named_sources(spark, [str(tmp_path / "games/pong/readme.txt")])
    assert [tuple(r) for r in S.select_apps(rows).collect()] == [("games", "pong")]
    assert [r["path"] for r in S.app_inputs(rows).collect() if r["app"] == "pong"] == ["games/pong/index.html"]
    lines = spark.createDataFrame([("a", "k, lib/x, y"), ("a", ""), ("a", "alone")], "app string, value string")
    good, bad = S.read_libs(lines)
    assert [tuple(r) for r in good.collect()] == [("a", "k", "lib/x, y")] and bad.count() == 1
    alias = spark.createDataFrame([("a", "12, lib/a.js@0"), ("a", "x, y"), ("a", "1, 2, 3")], "app string, value string")
    good, bad = S.read_dyn_alias(alias)
    assert [tuple(r) for r in good.collect()] == [("a", 12, "lib/a.js@0")] and bad.count() == 2
    marks = spark.createDataFrame([("a", "jq", "/r/a/lib/j.js", "/r/a"), ("a", "out", "/other", "/r/a")], "app string, key string, full string, root string")
    S.mark_library(marks, str(tmp_path / "marks"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "marks")).collect()] == ["jq, lib/j.js"]


def test_mismatch_metrics_of_whole_texts(spark, tmp_path):
    """Prefix, suffix and distance go past the first 40 characters."""
    from tessera.jobs import html_jobs

    body = "".join(random.Random(3).choices("abcö😀 ", k=300))
    texts = [body, body[:150] + "X" + body[150:], body[:99] + body[101:], "", "X", body + body, body + "X" + body]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def common(s, t):
        return next((i for i, (c, e) in enumerate(zip(s, t)) if c != e), min(len(s), len(t)))

    got = {tuple(r) for r in html_jobs.QUERIES["h13_whole_text_metrics"](spark, str(tmp_path)).collect()}
    assert got == {(i, common(s, t), common(s[::-1], t[::-1]), distance(s, t)) for i, (s, t) in enumerate(zip(texts, texts[1:]))}
    assert (0, 150, 150, 1) in got


def test_very_long_and_unclosed_pages(spark):
    """What is not closed reaches to the end of the page; a megabyte of signs, or of one string literal, takes seconds."""
    import time

    from pyspark.sql import functions as F

    from tessera.operators import html as H

    odd = ["<a href='javascript:x()'>", "<!-- <a href='javascript:x()'>", "<script>a <a href='javascript:x()'>", "<b><a href='javascript:x()'", "<script type=x"]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string")
    assert [(r["page_id"], r["code"]) for r in H.extract_fragments(pages).collect()] == [(0, "x()")]
    began = time.time()
    for sign in ("<", "<!--", "<script", "<script>", "<a ", "<a x=1>"):
        long_ = spark.createDataFrame([(1, sign * (500_000 // len(sign)))], "page_id long, html string")
        assert H.extract_fragments(long_).count() == 0
    for code in ("a.b('" + "x" * 1_000_000 + "')", "a.b('" + "\\\\'" * 300_000 + "')", "a.b() /* " + "/* " * 300_000, "a.b() // " + "// " * 300_000):
        script = spark.createDataFrame([(1, 0, code)], "page_id long, offset int, code string")
        assert {r["name"] for r in H.scan_property_names(script, ["page_id"]).collect()} == {"b"}
    many = spark.createDataFrame([(1, 0, "a.b();" * 30_000)], "page_id long, offset int, code string")
    assert H.scan_property_names(many, ["page_id"]).agg(F.count("offset")).first()[0] == 30_000
    assert time.time() - began < 120


def test_paths_are_normalised(spark):
    from pyspark.sql import functions as F

    from tessera.operators import html as H

    rows = [("site/a/index.html", "../lib/./x.js", "site/lib/x.js"), ("site/index.html", "./a/../b.js", "site/b.js"), ("index.html", "../x.js", "../x.js"), ("site/index.html", "/abs/../x.js", "/abs/../x.js"), ("a/b", "http://h/../x", "http://h/../x"), ("a/i", "b.js", "a/b.js")]
    got = spark.createDataFrame(rows, "base string, url string, want string").select("want", H.directory_join(F.col("base"), F.col("url")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got
