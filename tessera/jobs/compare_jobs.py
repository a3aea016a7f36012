"""Queries that compare groups, edit texts and read corpus lists, over line items as tokens and pages as programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs import bindings as B
from tessera.jobs import html_jobs as HJ
from tessera.jobs.token_jobs import Q
from tessera.operators import compare as C
from tessera.operators import edits as E
from tessera.operators import html as H
from tessera.operators import tokens as K
from tessera.runtime import folder, table, written
from tessera.sources import files as S

QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _spelled(c: str) -> Column:
    return F.concat_ws(":", F.col(f"{c}.source_id").cast("string"), F.col(f"{c}.pos").cast("string"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("app", "name", _spelled("rep").alias("rep"), _spelled("item").alias("item"), *[c for c in ("dead",) if c in rows.columns])


def heads(spark: SparkSession, d: str, modulus: int) -> DataFrame:
    return C.token_heads(written(B.tokens(spark, d, modulus)))


def _heads_sql(name: str, tok: str) -> str:
    return f"{name} AS (SELECT app, name, rep AS cls, (source_id, pos) AS item, min((source_id, pos)) OVER (PARTITION BY app, name, rep) AS rep FROM {tok})"


_SMALL = f"{B.T3}, {B.token_sql(5, 'tok2')}, {_heads_sql('sm', 'tok2')}, {_heads_sql('la', 'tok')}"
_NOT_IN = "np AS (SELECT s.app, s.name, s.rep, s.item FROM sm s LEFT JOIN la a ON a.app = s.app AND a.name = s.name AND a.item = s.rep LEFT JOIN la b ON b.app = s.app AND b.name = s.name AND b.item = s.item WHERE a.rep IS DISTINCT FROM b.rep)"
_TEXT = "app, name, rep[1] || ':' || rep[2] AS rep, item[1] || ':' || item[2] AS item"


@query("j8_non_subset_pairs", f"{_SMALL}, {_NOT_IN} SELECT {_TEXT} FROM np")
def j8(spark, d):
    return _pairs(C.non_subset_pairs(heads(spark, d, 5), heads(spark, d, 16)))


@query("j9_is_subset", f"{_SMALL}, {_NOT_IN} SELECT app, app NOT IN (SELECT app FROM np) AS subset FROM (SELECT DISTINCT app FROM sm)")
def j9(spark, d):
    return C.is_subset(heads(spark, d, 5), heads(spark, d, 16))


@query("j11_compare_by_name", f"{_SMALL}, sm2 AS (SELECT * FROM sm), {_NOT_IN.replace('FROM sm s', 'FROM sm2 s')} SELECT {_TEXT} FROM np WHERE (app, name) IN (SELECT (app, name) FROM la)")
def j11(spark, d):
    return _pairs(C.compare_by_name(heads(spark, d, 16), heads(spark, d, 5)))


#: Code that never ran: a seventh of the tokens of returned line items. All objects take part.
_RUN = "NOT (app LIKE 'R%' AND pos % 7 = 0)"
_DYN = f"dt AS (SELECT app, name, obj, (source_id, pos) AS item FROM tok WHERE {_RUN})"


def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    return B.tokens(spark, d).where(_RUN)


@query("a18_dynamic_components", f"{B.T3}, {_DYN} SELECT app, name, min(item) OVER (PARTITION BY app, name, obj)[1] || ':' || min(item) OVER (PARTITION BY app, name, obj)[2] AS rep, item[1] || ':' || item[2] AS item FROM dt")
def a18(spark, d):
    """A token here has one object, so components are the objects' tokens."""
    return _pairs(C.dynamic_components(_dynamic(spark, d)))


@query("j10_suspicious_pairs", f"{B.T3}, {_DYN}, {_heads_sql('sm', 'tok')}, la AS (SELECT app, name, item, min(item) OVER (PARTITION BY app, name, obj) AS rep FROM dt), {_NOT_IN}, lv AS (SELECT DISTINCT app, name, item FROM dt) SELECT {_TEXT}, x.dead FROM (SELECT np.*, (app, name, rep) NOT IN (SELECT (app, name, item) FROM lv) OR (app, name, item) NOT IN (SELECT (app, name, item) FROM lv) AS dead FROM np WHERE (app, name) IN (SELECT (app, name) FROM lv)) x")
def j10(spark, d):
    tok = written(B.tokens(spark, d))
    return _pairs(C.suspicious_static_pairs(C.token_heads(tok), C.dynamic_components(tok.where(_RUN)), show_dead=True))


@query("a14_token_coverage", f"{B.T3} SELECT app, 100.0 * count(*) FILTER ({_RUN}) / count(*) AS coverage FROM tok GROUP BY app")
def a14(spark, d):
    return C.token_coverage(B.tokens(spark, d), _dynamic(spark, d), ["app", "name", "source_id", "pos"])


#: Run time saw all sources but every tenth; a token has the objects of all tokens of its source.
_CHAINED = (
    B.T3.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", dt AS (SELECT DISTINCT t.app, t.name, o.obj, (t.source_id, t.pos) AS item FROM tok t JOIN (SELECT DISTINCT source_id, obj FROM tok) o ON o.source_id = t.source_id WHERE t.source_id % 10 != 0),"
    " st AS (SELECT app, name, item AS dst, min(item) OVER (PARTITION BY app, name, obj) AS src FROM dt), ed AS (SELECT app, name, src, dst FROM st UNION SELECT app, name, dst, src FROM st),"
    " rc AS (SELECT app, name, dst AS item, dst AS root FROM ed UNION SELECT rc.app, rc.name, ed.dst, rc.root FROM rc JOIN ed ON ed.app = rc.app AND ed.name = rc.name AND ed.src = rc.item),"
    " la AS (SELECT app, name, item, min(root) AS rep FROM rc GROUP BY app, name, item)"
)


def _chained(spark: SparkSession, d: str, by: str | None = "source_id") -> DataFrame:
    """Line items go to their source once; there they are made distinct and meet its objects. Without ``by`` they are made
    distinct before: one shuffle more, and less held by a task."""
    tok = B.tokens(spark, d, by=by)
    return tok.drop("obj").where("source_id % 10 != 0").distinct().join(tok.select("source_id", "obj").distinct(), "source_id")


def _chained_lists(tok: DataFrame) -> DataFrame:
    """The same with the objects of a token in one list, of distinct tokens that are dealt by source."""
    lists = tok.groupBy("source_id").agg(F.collect_set("obj").alias("objs"))
    return tok.drop("obj").where("source_id % 10 != 0").distinct().join(lists, "source_id")


@query("a18_chained_components", f"{_CHAINED} SELECT {_TEXT} FROM la")
def a18_chained(spark, d):
    """Tokens have several objects, so components chain."""
    return _pairs(C.dynamic_components(_chained_lists(B.tokens(spark, d, by="source_id"))))


@query("j10_chained_pairs", f"{_CHAINED}, {_heads_sql('sm', 'tok')}, {_NOT_IN}, lv AS (SELECT DISTINCT app, name, item FROM dt) SELECT {_TEXT}, x.dead FROM (SELECT np.*, (app, name, rep) NOT IN (SELECT (app, name, item) FROM lv) OR (app, name, item) NOT IN (SELECT (app, name, item) FROM lv) AS dead FROM np WHERE (app, name) IN (SELECT (app, name) FROM lv)) x")
def j10_chained(spark, d):
    tok = written(B.tokens(spark, d))
    return _pairs(C.suspicious_static_pairs(C.token_heads(tok), C.dynamic_components(_chained_lists(tok.repartition("source_id"))), show_dead=True))


@query("a14_chained_coverage", f"{_CHAINED} SELECT app, 100.0 * count(*) FILTER ((app, name, (source_id, pos)) IN (SELECT (app, name, item) FROM dt)) / count(*) AS coverage FROM tok GROUP BY app")
def a14_chained(spark, d):
    return C.token_coverage(B.tokens(spark, d), _chained(spark, d, None), ["app", "name", "source_id", "pos"])


_ALIAS = f"{B.T3}, al AS (SELECT DISTINCT app, source_id || '@' || (pos % 7) AS expr_id, obj FROM tok)"


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return B.tokens(spark, d).select("app", F.concat_ws("@", F.col("source_id").cast("string"), (F.col("pos") % 7).cast("string")).alias("expr_id"), "obj").distinct()


@query("a17_objects_at", f"{_ALIAS} SELECT app, expr_id, string_agg(obj, ',' ORDER BY obj) AS objects FROM al GROUP BY app, expr_id")
def a17(spark, d):
    return C.objects_at(_aliases(spark, d)).select("app", "expr_id", F.array_join("objects", ",").alias("objects"))


@query("a17_flows_to", f"{_ALIAS} SELECT app, obj, string_agg(expr_id, ',' ORDER BY expr_id) AS expressions FROM al GROUP BY app, obj")
def a17b(spark, d):
    return C.flows_to(_aliases(spark, d)).select("app", "obj", F.array_join("expressions", ",").alias("expressions"))


@query("j3_tokens_with_objects", f"{_ALIAS}, ex AS (SELECT DISTINCT app, source_id, pos % 5 AS base_node, source_id || '@' || (pos % 7) AS expr_id FROM tok WHERE pos % 3 != 0), tk AS (SELECT app, name, source_id, pos, pos % 5 AS base_node FROM tok) SELECT DISTINCT tk.*, al.obj FROM tk JOIN ex USING (app, source_id, base_node) JOIN al USING (app, expr_id)")
def j3(spark, d):
    tok = B.tokens(spark, d)
    ex = tok.where("pos % 3 != 0").select("app", "source_id", (F.col("pos") % 5).alias("node_id"), F.concat_ws("@", F.col("source_id").cast("string"), (F.col("pos") % 7).cast("string")).alias("expr_id")).distinct()
    return C.tokens_with_objects(tok.select("app", "name", "source_id", "pos", (F.col("pos") % 5).alias("base_node")), ex, _aliases(spark, d))


_LIBS = "libs AS (SELECT DISTINCT 'k' || (p_size % 4) AS key, p_brand AS app, substr(p_name, 1, 2 + p_size % 4) AS path_prefix FROM part WHERE p_partkey % 10 = 0), src AS (SELECT DISTINCT p_brand AS app, p_name AS path FROM part)"


def _part_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    libs = p.where("p_partkey % 10 = 0").select(F.concat(F.lit("k"), (F.col("p_size") % 4).cast("string")).alias("key"), F.col("p_brand").alias("app"), F.substring(F.col("p_name"), F.lit(1), 2 + F.col("p_size") % 4).alias("path_prefix"))
    return p.select(F.col("p_brand").alias("app"), F.col("p_name").alias("path")).distinct(), libs.distinct()


@query("j4_in_library", f"WITH {_LIBS} SELECT app, path FROM src WHERE EXISTS (SELECT 1 FROM libs WHERE libs.app = src.app AND starts_with(path, path_prefix))")
def j4(spark, d):
    return C.in_library(*_part_sources(spark, d))


@query("j5_without_library", f"WITH {_LIBS} SELECT app, path FROM src WHERE NOT EXISTS (SELECT 1 FROM libs WHERE libs.app = src.app AND starts_with(path, path_prefix))")
def j5(spark, d):
    return C.without_library(*_part_sources(spark, d))


@query("j6_only_library", f"WITH {_LIBS} SELECT app, path FROM src WHERE EXISTS (SELECT 1 FROM libs WHERE key = 'k1' AND libs.app = src.app AND starts_with(path, path_prefix))")
def j6(spark, d):
    return C.only_library(*_part_sources(spark, d), "k1")


@query("e9_build_edits", f"WITH p AS (SELECT page_id, html FROM pages), {HJ._places('<script>', 's')} SELECT page_id AS doc_id, CAST(pos_ + strpos(substr(html, pos_ + 1), 'track(') - 1 AS INTEGER) AS \"offset\", CAST(5 AS INTEGER) AS length, 'follow' AS replacement FROM s")
def e9(spark, d):
    return _edits(spark, d)[1]


def _edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edits that rename ``track`` in the scripts of pages."""
    pages = HJ.plain(spark, d)
    fragments = H.extract_fragments(pages).where("kind = 'inline'").withColumn("app", F.lit("site"))
    sources = fragments.select("app", F.col("page_id").alias("source_id"), F.col("page_id").alias("doc_id"), "offset")
    relative = fragments.withColumn("offset", F.lit(0))
    used = H.scan_property_names(relative, ["app", "page_id"]).where("name = 'track'").select("app", F.col("page_id").alias("source_id"), "name", F.col("offset").alias("pos"))
    return pages, E.build_edits(used, sources, F.lit("follow"))


@query("e10_apply_edits", "SELECT page_id, replace(html, 'track(', 'follow(') AS html FROM pages")
def e10(spark, d):
    pages, edits = _edits(spark, d)
    return E.apply_edits(pages.select("page_id", "html"), edits, "page_id", "html")


def _bodies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Killed bodies: the argument list of ``track`` and, inside it, its number."""
    fragments = H.extract_fragments(HJ.plain(spark, d)).where("kind = 'inline'")
    at = F.instr("code", "track(").cast("int") + 4
    end = F.length("code")
    return fragments, fragments.select("page_id", "frag_index", F.inline(F.array(F.struct(at.alias("start"), end.alias("end")), F.struct((at + 1).alias("start"), (at + 2).alias("end")))))


_BLANK = f"WITH p AS (SELECT page_id, html FROM pages), {HJ._places('<script>', 's')}, c AS (SELECT page_id, html, pos_ + 8 AS pos_, regexp_extract(substr(html, pos_ + 9), '(?s)^(.*?)</script', 1) AS code FROM s), n AS (SELECT page_id, {HJ._line('pos_')} AS line, left(code, strpos(code, 'track(') + 4) || '{{ /* removed! */ ' || regexp_replace(substr(code, strpos(code, 'track(') + 5), '\\S', ' ', 'g') || '}}' AS code FROM c)"


@query("e11_blank_functions", f"{_BLANK} SELECT page_id, code FROM n")
def e11(spark, d):
    fragments, bodies = _bodies(spark, d)
    return E.blank_functions(fragments.select("page_id", "code"), bodies, "page_id", "code")


@query("e12_fragmented_sources", f"{_BLANK} SELECT page_id, '// fragment from line ' || (line + 1) || chr(10) || code || chr(10) AS script FROM n")
def e12(spark, d):
    return E.fragmented_sources(*_bodies(spark, d))


# corpus lists: lines as they stand in files, made of the tables


@query("s1_read_sources", "SELECT 'web' AS category, 'app=' || (page_id // 50) AS app, 'htm' AS ext, page_id, length(html) AS chars, sha256(html) AS digest FROM pages WHERE page_id % 4 > 1")
def s1(spark, d):
    """Pages as lines of files, one file an app; a quarter under another extension, a quarter below a folder with a dot, both passed over."""
    root, key = folder(spark), F.col("page_id")
    lines = table(spark, d, "pages").select("page_id", F.floor(key / 50).alias("app"), F.concat_ws(" ", key.cast("string"), F.translate(F.base64(F.col("html").cast("binary")), "\r\n", "")).alias("line"))
    for part, place, ext in ((key % 4 > 1, "web", "htm"), (key % 4 == 1, "web/.git", "htm"), (key % 4 == 0, "web", "csv")):
        lines.where(part).repartition("app").select("app", "line").write.mode("append").partitionBy("app").option("extension", ext).csv(f"{root}/{place}")
    fields = F.split("line", " ")
    found = S.read_sources(spark, root).select("category", "app", "ext", F.explode(F.split("content", "\n")).alias("line")).where("line != ''")
    html = F.decode(F.unbase64(fields[1]), "UTF-8")
    return found.select("category", "app", "ext", fields[0].cast("long").alias("page_id"), F.length(html).cast("long").alias("chars"), F.sha2(F.unbase64(fields[1]), 256).alias("digest"))


@query("s11_mark_library", "SELECT 'site' || (page_id % 7) AS app, 'k' || page_id AS key, 'lib/p' || page_id || '.js' AS path_prefix FROM pages WHERE page_id % 5 != 0")
def s11(spark, d):
    """Marks are appended twice and read back; what lies outside the app's folder is left out."""
    path, key = folder(spark), F.col("page_id").cast("string")
    app = F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string"))
    root = F.concat(F.lit("/corpus/web/"), app)
    full = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/other/"), key)).otherwise(F.concat(root, F.lit("/lib/p"), key, F.lit(".js")))
    marks = table(spark, d, "pages").select("page_id", app.alias("app"), F.concat(F.lit("k"), key).alias("key"), full.alias("full"), root.alias("root"))
    for part in (F.col("page_id") % 2 == 0, F.col("page_id") % 2 == 1):
        S.mark_library(marks.where(part), path)
    return S.read_libs(spark.read.text(path))[0]


@query("s2_select_apps", "WITH s AS (SELECT lang AS category, source AS app FROM documents) SELECT DISTINCT CASE category WHEN 'de' THEN '.de' ELSE category END AS category, CASE app WHEN 'src3' THEN '.src3' ELSE app END AS app FROM s WHERE category NOT IN ('de', 'fr') AND app != 'src3'")
def s2(spark, d):
    docs = table(spark, d, "documents")
    named = docs.select(F.when(F.col("lang") == "de", ".de").when(F.col("lang") == "fr", "fake").otherwise(F.col("lang")).alias("category"), F.when(F.col("source") == "src3", ".src3").otherwise(F.col("source")).alias("app"))
    return S.select_apps(named)


def _lib_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("k"), F.col("p_size").cast("string"), F.lit(",  "), "p_name", F.lit(", x"))).otherwise(F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("lonely"), F.col("p_size").cast("string"))))
    return table(spark, d, "part").select(F.col("p_brand").alias("app"), line.alias("value"))


@query("s3_read_libs", "SELECT p_brand AS app, 'k' || p_size AS key, p_name || ', x' AS path_prefix FROM part WHERE p_partkey % 7 != 0")
def s3(spark, d):
    return S.read_libs(_lib_lines(spark, d))[0]


@query("s3_rejected_libs", "SELECT p_brand AS app, 'lonely' || p_size AS value FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 2 = 1")
def s3_rejected(spark, d):
    """Lines without a path; blank ones are passed over."""
    return S.read_libs(_lib_lines(spark, d))[1]


def _alias_lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_linenumber")
    line = F.concat(F.when(i == 3, F.lit("x")).otherwise(F.lit("")), F.col("l_suppkey").cast("string"), F.lit(", "), F.col("l_orderkey").cast("string"), F.lit("@"), i.cast("string"), F.when(i == 4, F.lit(", more")).otherwise(F.lit("")))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("app"), line.alias("value"))


@query("s4_read_dyn_alias", "SELECT l_returnflag AS app, CAST(l_suppkey AS INTEGER) AS obj, l_orderkey || '@' || l_linenumber AS expr_id FROM lineitem WHERE l_linenumber NOT IN (3, 4)")
def s4(spark, d):
    return S.read_dyn_alias(_alias_lines(spark, d))[0]


@query("s4_rejected_aliases", "SELECT l_returnflag AS app, CASE l_linenumber WHEN 3 THEN 'x' ELSE '' END || l_suppkey || ', ' || l_orderkey || '@' || l_linenumber || CASE l_linenumber WHEN 4 THEN ', more' ELSE '' END AS value FROM lineitem WHERE l_linenumber IN (3, 4)")
def s4_rejected(spark, d):
    """Lines whose object is no number, and lines of three fields."""
    return S.read_dyn_alias(_alias_lines(spark, d))[1]


@query("s5_kill_keys", "SELECT DISTINCT l_returnflag AS app, CAST(l_linenumber AS INTEGER) AS trial, 'd/s' || l_suppkey || '.js' AS source, CAST(l_partkey % 5 AS INTEGER) AS ordinal FROM lineitem")
def s5(spark, d):
    f = F.concat(F.lit("/x/"), "l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-key.txt"))
    v = F.concat(F.lit("d/s"), F.col("l_suppkey").cast("string"), F.lit(".js/"), (F.col("l_partkey") % 5).cast("string"))
    return S.kill_keys(table(spark, d, "lineitem").select(f.alias("file"), v.alias("value")))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return K.name_stats(K.group_sizes(B.tokens(spark, d)))


@query("s7_name_stat_lines", f"{B.T3} SELECT app || ' ' || name || ' ' || search_replace || ' ' || rename AS value FROM ns")
def s7(spark, d):
    return S.name_stat_lines(_stats(spark, d))


@query("s6_stat_table", f"{B.T3} SELECT app AS bench, CAST(search_replace AS DOUBLE) AS search_replace, CAST(rename AS DOUBLE) AS rename FROM ns")
def s6(spark, d):
    """Reads back the lines that S7 writes, without the name."""
    lines = S.name_stat_lines(_stats(spark, d)).select(F.concat(F.lit("  "), F.regexp_replace("value", " ", "   ")).alias("value"))
    return S.stat_table(lines, ["bench", None, "search_replace", "rename"], ("search_replace", "rename"))


@query("s8_group_size_lines", f"{B.T3} SELECT rpad(app, 20, ' ') || ' ' || size AS value FROM grp WHERE (app, name) IN (SELECT (app, name) FROM grp GROUP BY app, name HAVING sum(size) > 1)")
def s8(spark, d):
    return S.group_size_lines(K.group_sizes(B.tokens(spark, d)))


@query("s9_pair_lines", f"{_SMALL}, {_NOT_IN} SELECT app, '\"' || name || '\" at ' || rep[1] || ':' || (rep[2] + 1) || ' and ' || item[1] || ':' || (item[2] + 1) || CASE WHEN item[1] % 2 = 0 THEN ' [dead]' ELSE '' END AS value FROM np")
def s9(spark, d):
    pairs = C.non_subset_pairs(heads(spark, d, 5), heads(spark, d, 16))
    at = lambda c: F.struct(F.col(f"{c}.source_id").alias("source_id"), F.col(f"{c}.pos").alias("line"))
    return S.pair_lines(pairs.select("app", "name", at("rep").alias("a"), at("item").alias("b"), (F.col("item.source_id") % 2 == 0).alias("dead")))


_PATHS = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '')"


@query("s12_relative_path", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_replace({_PATHS}, '^[^/]*/', '') END AS path FROM pages")
def s12(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", "")
    base = F.when(F.col("page_id") % 3 == 0, F.lit("elsewhere")).otherwise(F.regexp_extract(path, "^[^/]*", 0))
    return table(spark, d, "pages").select("page_id", S.relative_path(base, path).alias("path"))


_SITE = f"site AS (SELECT 'web' AS category, regexp_extract({_PATHS}, '^[^/]*', 0) AS app, 'web/' || {_PATHS} || CASE WHEN page_id % 6 = 0 THEN '/index.html' ELSE '/a.js' END AS path, CASE WHEN page_id % 6 = 0 THEN 'html' ELSE 'js' END AS ext FROM pages)"


def _site(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", "")
    rows = table(spark, d, "pages").select(F.concat(F.lit("web/"), path, F.when(F.col("page_id") % 6 == 0, "/index.html").otherwise("/a.js")).alias("path"))
    return S.placed(rows)


@query("s13_app_inputs", f"WITH {_SITE} SELECT category, app, path FROM site WHERE CASE WHEN app IN (SELECT app FROM site WHERE ext = 'html') THEN ext = 'html' ELSE ext = 'js' END")
def s13(spark, d):
    return S.app_inputs(_site(spark, d))


@query("s14_app_root", f"WITH {_SITE} SELECT path, CASE WHEN app IN (SELECT app FROM site WHERE ext = 'html') THEN 'web/' || app END AS root FROM site")
def s14(spark, d):
    """Every app with an index has a marker in its folder."""
    rows = _site(spark, d)
    markers = rows.where("ext = 'html'").select(F.concat_ws("/", "category", "app", F.lit("dyn-alias.txt")).alias("path")).distinct()
    return rows.select("path").join(S.app_root(rows.select("path").distinct(), markers), "path")
