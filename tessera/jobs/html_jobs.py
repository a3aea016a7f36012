"""Queries over pages, as they are and with attributes and scripts spliced in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs.token_jobs import Q
from tessera.operators import html as H
from tessera.runtime import table

QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}

NAV = ("<nav>", '<nav onclick="nav.open(1)" class=x>')
LINK = ('<a href="/', '<a href="javascript:go(1)" data-u="/')
SCRIPT = ("<script>", '<script type="text/javascript" src="lib/a.js"></script><script type="text/template">x</script><script language="JScript">')


def query(name: str, sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r'(?<!")\boffset\b(?!")', '"offset"', sql)  # a reserved word there
        return f

    return add


def plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", "html")


def spliced(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    for old, new in (NAV, LINK, SCRIPT):
        html = F.replace(html, F.lit(old), F.lit(new))
    return plain(spark, d).withColumn("html", html)


_H2 = f"replace(replace(replace(html, '{NAV[0]}', '{NAV[1]}'), '{LINK[0]}', '{LINK[1]}'), '{SCRIPT[0]}', '{SCRIPT[1]}')"
P2 = f"p AS (SELECT page_id, url, {_H2} AS html FROM pages)"


def _places(mark: str, name: str, source: str = "p") -> str:
    """Places of a fixed string, by the lengths of the parts between."""
    return f"{name} AS (SELECT page_id, html, CAST(sum(length(part)) OVER (PARTITION BY page_id ORDER BY i) + (i - 1) * length('{mark}') AS INTEGER) AS pos_ FROM (SELECT page_id, html, unnest(s) AS part, unnest(generate_series(1, len(s))) AS i, len(s) AS n FROM (SELECT page_id, html, string_split(html, '{mark}') AS s FROM {source})) QUALIFY i < n)"


def _line(pos_: str) -> str:
    return f"CAST(len(regexp_extract_all(substr(html, 1, {pos_}), '\\r\\n|\\r|\\n')) AS INTEGER)"


def _col(pos_: str) -> str:
    return f"CAST(length(list_last(regexp_split_to_array(substr(html, 1, {pos_}), '\\r\\n|\\r|\\n'))) AS INTEGER)"


_CODE = "regexp_extract(substr(html, pos_ + 1), '(?s)^(.*?)</script', 1)"


@query("h1_script_fragments", f"WITH p AS (SELECT page_id, html FROM pages), {_places('<script>', 's')}, t AS (SELECT page_id, html, pos_ + 8 AS pos_ FROM s) SELECT page_id, {_CODE} AS code, pos_ AS offset, {_line('pos_')} AS line, {_col('pos_')} AS col FROM t")
def h1(spark, d):
    return H.script_fragments(plain(spark, d))


@query("h2_is_javascript", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Text/JavaScript' WHEN 2 THEN '' ELSE 'text/template' END AS type, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ' JScript ' ELSE 'vb' END AS language, page_id % 4 IN (0, 1) AND page_id % 3 IN (0, 1) AS js FROM pages")
def h2(spark, d):
    i = F.col("page_id")
    rows = plain(spark, d).select("page_id", F.when(i % 4 == 1, "Text/JavaScript").when(i % 4 == 2, "").when(i % 4 == 3, "text/template").alias("type"), F.when(i % 3 == 1, " JScript ").when(i % 3 == 2, "vb").alias("language"))
    return rows.withColumn("js", H.is_javascript(F.col("type"), F.col("language")))


_EXTERN = '<script type="text/javascript" src="lib/a.js">'
_JSCRIPT = '<script language="JScript">'


@query("h3_extern_scripts", f"WITH {P2}, {_places(_EXTERN, 's')} SELECT page_id, 'lib/a.js' AS url, {_line('pos_')} AS line FROM s")
def h3(spark, d):
    return H.extern_scripts(spliced(spark, d))


@query("h4_js_hrefs", f"WITH {P2}, {_places('<a href=' + chr(34) + 'javascript:', 's')} SELECT page_id, 'go(1)' AS code, pos_ + 20 AS offset FROM s")
def h4(spark, d):
    return H.js_hrefs(spliced(spark, d))


@query("h5_event_handlers", f"WITH {P2}, {_places('<nav onclick=' + chr(34), 's')} SELECT page_id, 'onclick' AS attr, 'nav.open(1)' AS code, pos_ + 14 AS offset FROM s")
def h5(spark, d):
    return H.event_handlers(spliced(spark, d))


@query(
    "h6_tag_attributes",
    f"WITH {P2}, {_places('<nav ', 'n')}, {_places('<a href=' + chr(34), 'a')}"
    " SELECT page_id, pos_ AS tag_offset, 'nav' AS tag, 'onclick' AS name, 'nav.open(1)' AS value, pos_ + 14 AS offset FROM n UNION ALL SELECT page_id, pos_, 'nav', 'class', 'x', pos_ + 33 FROM n"
    " UNION ALL SELECT page_id, pos_, 'a', 'href', regexp_extract(substr(html, pos_ + 10), '^[^\"]*', 0), pos_ + 9 FROM a UNION ALL SELECT page_id, pos_, 'a', 'data-u', regexp_extract(substr(html, pos_ + 36), '^[^\"]*', 0), pos_ + 35 FROM a WHERE substr(html, pos_ + 1) LIKE '<a href=\"javascript%'",
)
def h6(spark, d):
    return H.tag_attributes(spliced(spark, d)).where("tag IN ('nav', 'a')")


_ALL = f"""WITH {P2}, {_places(_EXTERN, 'x')}, {_places(_JSCRIPT, 'j')}, {_places('<a href=' + chr(34) + 'javascript:', 'l')}, {_places('<nav onclick=' + chr(34), 'v')},
f AS (SELECT page_id, html, 'extern' AS kind, 'script' AS origin, NULL AS attr, NULL AS code, 'lib/a.js' AS url, NULL AS offset, pos_ FROM x
 UNION ALL SELECT page_id, html, 'inline', 'script', NULL, regexp_extract(substr(html, pos_ + 28), '(?s)^(.*?)</script', 1), NULL, pos_ + 27, pos_ + 27 FROM j
 UNION ALL SELECT page_id, html, 'inline', 'href', 'href', 'go(1)', NULL, pos_ + 20, pos_ + 20 FROM l
 UNION ALL SELECT page_id, html, 'inline', 'event', 'onclick', 'nav.open(1)', NULL, pos_ + 14, pos_ + 14 FROM v),
fr AS (SELECT page_id, kind, origin, attr, code, url, offset, {_line('pos_')} AS line, CASE WHEN offset IS NOT NULL THEN {_col('pos_')} END AS col, CASE WHEN kind = 'inline' THEN CAST(row_number() OVER (PARTITION BY page_id, kind ORDER BY pos_) - 1 AS INTEGER) END AS frag_index FROM f)"""


@query("h8_extract_fragments", f"{_ALL} SELECT * FROM fr")
def h8(spark, d):
    return H.extract_fragments(spliced(spark, d))


@query("h7_number_fragments", f"{_ALL} SELECT page_id, offset, frag_index FROM fr WHERE kind = 'inline'")
def h7(spark, d):
    return H.extract_fragments(spliced(spark, d)).where("kind = 'inline'").select("page_id", "offset", "frag_index")


_LINES = """WITH t AS (SELECT page_id, html, regexp_split_to_array(html, '\\r\\n|\\r|\\n') AS parts, list_concat(regexp_extract_all(html, '\\r\\n|\\r|\\n'), ['']) AS seps FROM pages),
u AS (SELECT page_id, length(html) AS n, unnest(generate_series(1, len(parts))) AS i, unnest(list_transform(list_zip(parts, seps), lambda z: length(z[1]) + length(z[2]))) AS w FROM t),
lines AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS line, CAST(sum(w) OVER (PARTITION BY page_id ORDER BY i) - w AS INTEGER) AS start, CAST(sum(w) OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS "end" FROM u QUALIFY w > 0)"""


@query("h9_line_starts", f'{_LINES} SELECT page_id, line, start, "end" FROM lines')
def h9(spark, d):
    return H.line_starts(plain(spark, d), "page_id", "html")


_POINTS = 'pt AS (SELECT DISTINCT page_id, CAST(unnest([start, (start + "end") // 2, "end", "end" + 1]) AS INTEGER) AS offset FROM lines)'


@query("h10_offset_to_line", f"""{_LINES}, {_POINTS}, n AS (SELECT page_id, max("end") AS m FROM lines GROUP BY page_id) SELECT pt.page_id, offset, CASE WHEN offset <= m THEN line END AS line, CASE WHEN offset <= m THEN CAST(offset - start AS INTEGER) END AS col FROM pt ASOF LEFT JOIN lines ON pt.page_id = lines.page_id AND pt.offset >= lines.start LEFT JOIN n ON n.page_id = pt.page_id""")
def h10(spark, d):
    """Places of every line: its start, middle and end, and one beyond."""
    lines = H.line_starts(plain(spark, d), "page_id", "html")
    places = F.array("start", F.floor((F.col("start") + F.col("end")) / 2).cast("int"), "end", F.col("end") + 1)
    return H.offset_to_line(lines.select("page_id", F.explode(places).alias("offset")).distinct(), lines, "page_id")


@query("h11_line_to_offset", f"""{_LINES}, q AS (SELECT page_id, CAST(unnest(generate_series(0, max(line) + 1)) AS INTEGER) AS line, 2 AS col FROM lines GROUP BY page_id) SELECT q.page_id, q.line, q.col, CAST(start + col AS INTEGER) AS offset FROM q LEFT JOIN lines USING (page_id, line)""")
def h11(spark, d):
    """Every line, and one beyond the last."""
    lines = H.line_starts(plain(spark, d), "page_id", "html")
    asked = lines.groupBy("page_id").agg(F.max("line").alias("m")).select("page_id", F.explode(F.sequence(F.lit(0), F.col("m") + 1)).alias("line"), F.lit(2).alias("col"))
    return H.line_to_offset(asked, lines, "page_id")


@query("h12_check_fragments", f"{_ALL} SELECT fr.page_id, frag_index, CAST(fr.offset + 1 AS INTEGER) AS offset FROM fr JOIN p ON p.page_id = fr.page_id WHERE kind = 'inline' AND frag_index % 2 = 1 AND substr(p.html, CAST(fr.offset + 2 AS BIGINT), length(code)) != code")
def h12(spark, d):
    """Every other fragment is said to stand one place on: these are found, and no other."""
    pages = spliced(spark, d)
    return H.check_fragments(H.extract_fragments(pages).withColumn("offset", F.col("offset") + F.col("frag_index") % 2), pages)


_FOREIGN = "éÉßÇñÑèíÊöÈêüÖÜóçäÄ"
#: DuckDB's levenshtein() counts bytes: the letters beyond ASCII that the benchmark has become one byte each.
_BYTES = " || ".join(f"chr({i})" for i in range(1, 9)) + " || " + " || ".join(f"chr({i})" for i in range(14, 14 + len(_FOREIGN) - 8))


def _metrics_sql(step: int) -> str:
    single = lambda c: f"translate({c}, '{_FOREIGN}', {_BYTES})"
    return (
        f"WITH x AS (SELECT a.item_id AS a, a.text AS s, b.text AS t FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + {step}), y AS (SELECT a, s, t, unnest(generate_series(1, least(length(s), length(t)))) AS i FROM x),"
        " m AS (SELECT a, coalesce(max(i) FILTER (left(s, i) = left(t, i)), 0) AS prefix, coalesce(max(i) FILTER (right(s, i) = right(t, i)), 0) AS suffix FROM y GROUP BY a)"
        f" SELECT a, CAST(coalesce(prefix, 0) AS INTEGER) AS prefix, CAST(coalesce(suffix, 0) AS INTEGER) AS suffix, CAST(levenshtein({single('s')}, {single('t')}) AS INTEGER) AS distance FROM x LEFT JOIN m USING (a)"
    )


def _metrics(spark: SparkSession, d: str, step: int) -> DataFrame:
    b = table(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("s")).join(b.select((F.col("item_id") - step).alias("a"), F.col("text").alias("t")), "a")
    return H.mismatch_metrics(pairs, "s", "t").select("a", "prefix", "suffix", "distance")


@query("h13_mismatch_metrics", _metrics_sql(2))
def h13(spark, d):
    """Each text against the next but one."""
    return _metrics(spark, d, 2)


@query("h13_whole_text_metrics", _metrics_sql(1))
def h13_whole(spark, d):
    """Each text against the next."""
    return _metrics(spark, d, 1)


@query("n10_fragment_at", f"{_ALL}, q AS (SELECT DISTINCT page_id, offset + 2 AS offset FROM fr WHERE kind = 'inline' UNION SELECT page_id, 0 FROM pages) SELECT q.page_id, q.offset, max(frag_index) AS frag_index FROM q LEFT JOIN fr ON fr.page_id = q.page_id AND fr.kind = 'inline' AND q.offset BETWEEN fr.offset AND fr.offset + length(code) GROUP BY q.page_id, q.offset")
def n10(spark, d):
    fragments = H.extract_fragments(spliced(spark, d))
    points = fragments.where("kind = 'inline'").select("page_id", (F.col("offset") + 2).alias("offset")).unionByName(plain(spark, d).select("page_id", F.lit(0).alias("offset"))).distinct()
    return H.fragment_at(fragments, points)


@query(
    "n12_scan_property_names",
    f"WITH p AS (SELECT page_id, html FROM pages), {_places('<script>', 's')}, t AS (SELECT page_id, pos_ + 8 AS pos_, regexp_extract(substr(html, pos_ + 9), '(?s)^(.*?)</script', 1) AS code FROM s)"
    " SELECT page_id, 't' AS name, 'declaration' AS use, pos_ + 4 AS offset FROM t UNION ALL SELECT page_id, 'track', 'call', pos_ + strpos(code, 'track(') - 1 FROM t",
)
def n12(spark, d):
    fragments = H.extract_fragments(plain(spark, d)).where("kind = 'inline'")
    return H.scan_property_names(fragments, ["page_id"])


_SITE = "regexp_extract(url, '^https?://([^/]*)', 1)"


@query("j1_resolve_externs", f"{_ALL} SELECT fr.page_id, 'site/' || {_SITE.replace('url', 'pages.url')} || '/lib/a.js' AS target FROM fr JOIN pages ON pages.page_id = fr.page_id WHERE kind = 'extern' AND fr.page_id % 3 != 0")
def j1(spark, d):
    """Pages lie in site/<host>/; every third host's script is missing."""
    pages = spliced(spark, d).withColumn("path", F.concat(F.lit("site/"), F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("/index.html")))
    found = H.extract_fragments(pages)
    sources = pages.select(F.regexp_replace("path", "index.html$", "lib/a.js").alias("path"), (F.col("page_id") % 3).alias("source_id")).distinct()
    met, _ = H.resolve_externs(found.where("page_id % 3 != 0"), pages, sources.select("path").distinct().withColumn("source_id", F.lit(0)))
    return met.select("page_id", "target")


@query("j1_missing_externs", f"{_ALL} SELECT fr.page_id, 'site/' || {_SITE.replace('url', 'pages.url')} || '/lib/a.js' AS target FROM fr JOIN pages ON pages.page_id = fr.page_id WHERE kind = 'extern' AND 'site/' || {_SITE.replace('url', 'pages.url')} NOT IN (SELECT 'site/' || {_SITE} FROM pages WHERE page_id % 3 = 0)")
def j1_missing(spark, d):
    """Scripts of hosts that no third page lies on are not loaded."""
    pages = spliced(spark, d).withColumn("path", F.concat(F.lit("site/"), F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("/index.html")))
    sources = pages.where("page_id % 3 = 0").select(F.regexp_replace("path", "index.html$", "lib/a.js").alias("path")).distinct().withColumn("source_id", F.lit(0))
    return H.resolve_externs(H.extract_fragments(pages), pages, sources)[1].select("page_id", "target")


@query("s10_bundle_scripts", f"{_ALL} SELECT page_id, string_agg('// FILE: ' || CASE kind WHEN 'inline' THEN 'chunk' || line || '.js' ELSE url END || chr(10) || CASE kind WHEN 'inline' THEN code ELSE 'lib()' END || chr(10) || chr(10), '' ORDER BY line, coalesce(offset, -1)) AS bundle FROM fr GROUP BY page_id")
def s10(spark, d):
    pages = spliced(spark, d)
    urls = H.extract_fragments(pages).where("kind = 'extern'").select("url").distinct().withColumn("content", F.lit("lib()"))
    return H.bundle_scripts(H.extract_fragments(pages), urls)
