"""Lines and columns of fragments against a plain count of breaks."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import html as H

BREAK = re.compile("\r\n|\r|\n")


def plain(text, at):
    """Line of a place, and where the line starts."""
    ends = [m.end() for m in BREAK.finditer(text) if m.end() <= at]
    return len(ends), ends[-1] if ends else 0


def test_lines_of_matches(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(("\r\n", "\n", "\r", "ab", "é", "<q>", "<q\n>", " ")) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", "<q>", "\n<q>\r\n<q>", "x" * 9000 + "\n<q>" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.inline(X.placed_matches(F.col("t"), "<q\n?>"))).collect()
    want = [(k, m.start(), m.end(), m[0], *plain(t, m.start())) for k, t in enumerate(texts) for m in re.finditer("<q\n?>", t)]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_places_of_fragments(spark):
    pages = [(1, "<p>\r\n<a\r\n href=\"javascript:go(1)\"\n onclick='x()'>é\r<script>a\nb</script>"), (2, "<script\n>\n1</script><b onload=q>"), (3, "\r\r<script src=u.js></script>"), (4, None)]
    found = H.extract_fragments(spark.createDataFrame(pages, "page_id int, html string")).collect()
    texts = dict(pages)
    inline = [r for r in found if r["kind"] == "inline"]
    assert sorted((r["page_id"], r["code"]) for r in inline) == [(1, "a\nb"), (1, "go(1)"), (1, "x()"), (2, "\n1"), (2, "q")]
    for r in inline:
        text, at = texts[r["page_id"]], r["offset"]
        line, start = plain(text, at)
        assert text[at : at + len(r["code"])] == r["code"] and (r["line"], r["col"]) == (line, at - start)
    assert [(r["url"], r["line"]) for r in found if r["kind"] == "extern"] == [("u.js", 2)]
