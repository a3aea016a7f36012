"""Script fragments of HTML pages with exact places, and places in texts.

Pages have (page_id, html). A page is scanned by one pattern whose matches are comments, script elements and tags;
attributes are found inside the tags. Places are 0-based code points; a line break is ``\\n``, ``\\r`` or ``\\r\\n``.
No shuffle: everything about a page is computed in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.arrays import bound
from tessera.operators.intervals import holding

#: A comment or script that is not closed reaches to the end of the page, an open tag without its end is none: nothing is
#: searched twice for an end that is not there.
PIECES = r"(?i)<!--[\s\S]*?(?:-->|\z)|<script\b[^>]*+>[\s\S]*?(?:</script\s*+>|\z)|<[a-z][^>]*+(?:>|\z)"
ATTRIBUTE = r"[^\s\"'<>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)"

# The event attributes that hold script code.
EVENT_ATTRIBUTES = (
    "onabort", "onafterprint", "onbeforeprint", "onbeforeunload", "onblur", "oncancel", "oncanplay", "oncanplaythrough", "onchange", "onclick",
    "onclose", "oncontextmenu", "oncuechange", "ondblclick", "ondrag", "ondragend", "ondragenter", "ondragleave", "ondragover", "ondragstart",
    "ondrop", "ondurationchange", "onemptied", "onended", "onerror", "onfocus", "onhashchange", "oninput", "oninvalid", "onkeydown",
    "onkeypress", "onkeyup", "online", "onload", "onloadeddata", "onloadedmetadata", "onloadstart", "onmessage", "onmousedown", "onmousemove",
    "onmouseout", "onmouseover", "onmouseup", "onmousewheel", "onoffline", "ononline", "onpagehide", "onpageshow", "onpause", "onplay",
    "onplaying", "onpopstate", "onprogress", "onratechange", "onreadystatechange", "onreset", "onresize", "onscroll", "onseeked", "onseeking",
    "onselect", "onshow", "onstalled", "onstorage", "onsubmit", "onsuspend", "ontimeupdate", "onunload", "onvolumechange", "onwaiting",
)


def is_javascript(type_: Column, language: Column) -> Column:
    """Both hold: type null or with ``javascript`` in it; language null or ``javascript`` or ``jscript``."""
    lang = F.lower(F.trim(language))
    return (type_.isNull() | F.lower(type_).contains("javascript")) & (language.isNull() | lang.isin("javascript", "jscript"))


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, start, line, line_start, open, code, tag): open tags outside comments, with the text of a script element."""
    found = pages.select("page_id", F.inline(X.placed_matches(F.coalesce("html", F.lit("")), PIECES))).where("NOT startswith(value, '<!--') AND (endswith(value, '>') OR lower(value) RLIKE '^<script\\\\b[^>]*>')")
    script = F.lower("value").rlike(r"^<script\b[^>]*>[\s\S]*</script\s*>$")
    open_ = F.when(F.lower("value").startswith("<script"), F.regexp_extract("value", "^<[^>]*>", 0)).otherwise(F.col("value"))
    rest = F.substring(F.col("value"), F.length(open_) + 1, F.length("value"))
    return found.select("page_id", "start", "line", "line_start", open_.alias("open"), F.when(script, F.regexp_replace(rest, r"(?i)</script\s*>$", "")).alias("code"), F.lower(F.regexp_extract("value", "^<([A-Za-z0-9]+)", 1)).alias("tag"))


def _line_and_column(at: Column) -> tuple[Column, Column]:
    """Of a place in an open tag or at its end: what stands in the tag before it is all that is looked at."""
    before = F.substring(F.col("open"), F.lit(1), at - F.col("start"))
    breaks = F.regexp_count(before, F.lit(X.BREAK))
    column = F.when(breaks > 0, F.length(F.element_at(F.split(before, X.BREAK, -1), -1))).otherwise(at - F.col("line_start"))
    return (F.col("line") + breaks).cast("int"), column.cast("int")


def _attributes(open_: Column, start: Column) -> Column:
    """array<struct<name, value, offset>>, leftmost of a name only; what stands left of a quoted value with a line break is lost, and that value."""
    name_end = F.length(F.regexp_extract(open_, r"^<[A-Za-z0-9]+", 0))
    inner = F.concat(F.repeat(F.lit(" "), name_end), F.substring(open_, name_end + 1, F.length(open_) - name_end - 1))

    def one(m: Column) -> Column:
        raw = F.regexp_extract(m["value"], r"^[^=]*=\s*([\s\S]*)$", 1)
        quoted = raw.rlike("^[\"']")
        value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        at = start + m["end"] - F.length(raw) + F.when(quoted, 1).otherwise(0)
        return F.struct(F.regexp_extract(m["value"], r"^[^\s=]+", 0).alias("name"), value.alias("value"), at.cast("int").alias("offset"), (quoted & value.rlike("[\r\n]")).alias("broken"))

    all_ = F.transform(X.matches(inner, ATTRIBUTE), one)

    def kept(found: Column) -> Column:
        """Behind the last broken one, the first of each name: by name, then by place again."""
        last = F.coalesce(F.array_max(F.transform(found, lambda a, i: F.when(a["broken"], i))), F.lit(-1))
        named = F.array_sort(F.transform(F.slice(found, last + 2, F.size(found)), lambda a: F.struct(a["name"].alias("name"), a["offset"].alias("offset"), a["value"].alias("value"))))
        first = lambda v: F.filter(v, lambda a, i: (i == 0) | (F.get(v, i - 1)["name"] != a["name"]))
        placed = F.array_sort(F.transform(bound(named, first), lambda a: F.struct(a["offset"].alias("offset"), a["name"].alias("name"), a["value"].alias("value"))))
        return F.transform(placed, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"), a["offset"].alias("offset")))

    return F.when(F.contains(open_, F.lit("=")), bound(all_, kept)).otherwise(F.array().cast("array<struct<name:string,value:string,offset:int>>"))


def tag_attributes(pages: DataFrame) -> DataFrame:
    """(page_id, tag_offset, tag, name, value, offset): attributes with values of all open tags."""
    rows = tags(pages).withColumn("attrs", _attributes(F.col("open"), F.col("start")))
    return rows.select("page_id", F.col("start").alias("tag_offset"), "tag", F.inline("attrs"))


def _value(name: str) -> Column:
    return F.get(F.filter("attrs", lambda a: F.lower(a["name"]) == name), F.lit(0))["value"]


def _branches(rows: DataFrame) -> DataFrame:
    """One row for each fragment; pages are scanned once for all kinds."""
    none, text = F.lit(None), lambda c: c.cast("string")
    fragment = lambda kind, origin, attr, code, url, offset, at: F.struct(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), text(attr).alias("attr"), text(code).alias("code"), text(url).alias("url"), offset.cast("int").alias("offset"), at.cast("int").alias("at"))
    end = F.col("start") + F.length("open")
    js = (F.col("tag") == "script") & F.col("code").isNotNull() & is_javascript(_value("type"), _value("language"))
    empty = F.array().cast("array<struct<kind:string,origin:string,attr:string,code:string,url:string,offset:int,at:int>>")
    script = F.when(js & _value("src").isNotNull(), F.array(fragment("extern", "script", none, none, _value("src"), none, end))).when(js, F.array(fragment("inline", "script", none, F.col("code"), none, end, end))).otherwise(empty)
    prefix = F.length(F.regexp_extract(F.col("h.value"), r"(?i)^\s*javascript:", 0))
    href = F.get(F.filter("attrs", lambda a: F.lower(a["name"]) == "href"), F.lit(0))
    links = F.when((F.col("tag") == "a") & F.col("h").isNotNull() & (prefix > 0), F.array(fragment("inline", "href", F.lit("href"), F.substring(F.col("h.value"), prefix + 1, F.length("h.value")), none, F.col("h.offset") + prefix, F.col("h.offset")))).otherwise(empty)
    events = F.transform(F.filter("attrs", lambda a: a["name"].isin(*EVENT_ATTRIBUTES)), lambda a: fragment("inline", "event", a["name"], a["value"], none, a["offset"], a["offset"]))
    rows = rows.withColumn("attrs", _attributes(F.col("open"), F.col("start"))).withColumn("h", href)
    return rows.select("page_id", "start", "line", "line_start", "open", F.inline(F.concat(script, links, events)))


def extract_fragments(pages: DataFrame) -> DataFrame:
    """(page_id, kind, origin, attr, code, url, offset, line, col, frag_index) of all fragments; extern ones have no place but a line."""
    return number_fragments(_placed(_branches(tags(pages))))


def _placed(rows: DataFrame) -> DataFrame:
    line, column = _line_and_column(F.coalesce("offset", "at"))
    return rows.select("page_id", "kind", "origin", "attr", "code", "url", "offset", line.alias("line"), F.when(F.col("offset").isNotNull(), column).alias("col"), "at")


def number_fragments(rows: DataFrame) -> DataFrame:
    """0-based index over a page's inline fragments by place; extern ones have none."""
    order = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("at")) - 1
    return rows.withColumn("frag_index", F.when(F.col("kind") == "inline", order)).drop("at")


def script_fragments(pages: DataFrame) -> DataFrame:
    """(page_id, code, offset, line, col) of every script element with its text, whatever its type."""
    rows = tags(pages).where("tag = 'script' AND code IS NOT NULL").withColumn("offset", (F.col("start") + F.length("open")).cast("int"))
    line, column = _line_and_column(F.col("offset"))
    return rows.select("page_id", "code", "offset", line.alias("line"), column.alias("col"))


def extern_scripts(pages: DataFrame) -> DataFrame:
    return extract_fragments(pages).where("kind = 'extern'").select("page_id", "url", "line")


def js_hrefs(pages: DataFrame) -> DataFrame:
    return extract_fragments(pages).where("origin = 'href'").select("page_id", "code", "offset")


def event_handlers(pages: DataFrame) -> DataFrame:
    return extract_fragments(pages).where("origin = 'event'").select("page_id", "attr", "code", "offset")


def line_starts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end) of the lines of each text; an empty text has none."""
    starts = docs.select(key, X.line_starts(F.coalesce(text, F.lit(""))).alias("s"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(i.alias("line"), F.get("s", i).alias("start"), F.get("s", i + 1).alias("end")))
    return starts.where(F.size("s") > 1).select(key, F.inline(pairs))


def offset_to_line(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """points (key, offset) with line and col; null out of range. An as-of join: points and line starts in one order."""
    marks = lines.select(key, F.col("start").alias("offset"), F.lit(0).alias("_kind"), F.struct("line", "start", "end").alias("_l"))
    asked = points.select(key, "offset", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_l"].dataType).alias("_l"))
    seen = Window.partitionBy(key).orderBy("offset", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(asked).withColumn("_l", F.last("_l", ignorenulls=True).over(seen)).where("_kind = 1")
    inside = (F.col("offset") >= 0) & (F.col("offset") <= F.col("_l.end"))
    return rows.select(key, "offset", F.when(inside, F.col("_l.line")).alias("line"), F.when(inside, F.col("offset") - F.col("_l.start")).alias("col"))


def line_to_offset(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """points (key, line, col) with their offset, null when there is no such line."""
    return points.join(lines.select(key, "line", "start"), [key, "line"], "left").select(key, "line", "col", (F.col("start") + F.col("col")).alias("offset"))


def check_fragments(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """Inline fragments whose text is not what stands at their place: none, if all is sound."""
    rows = fragments.where("kind = 'inline'").join(pages.select("page_id", "html"), "page_id")
    return rows.where(F.substring(F.col("html"), F.col("offset") + 1, F.length("code")) != F.col("code")).select("page_id", "frag_index", "offset")


def mismatch_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Lengths of the common prefix and suffix of two texts, and their edit distance, in code points.

    A length is found bit by bit from the highest: a step is taken where the next so many code points agree.
    """
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def agreed(begin) -> Column:
        same = lambda n, step: F.substring(F.col(a), begin(a, n, step), step) == F.substring(F.col(b), begin(b, n, step), step)
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when((step <= least - n) & same(n, step), n + step).otherwise(n))

    head = agreed(lambda text, n, step: n + 1)
    tail = agreed(lambda text, n, step: F.length(text) - n - step + 1)
    return pairs.withColumns({"prefix": head, "suffix": tail, "distance": F.levenshtein(a, b)})


def fragment_at(fragments: DataFrame, points: DataFrame) -> DataFrame:
    """points (page_id, offset) with the inline fragment that holds them, both ends included, the last one if several do."""
    inline = fragments.where("kind = 'inline'").select("page_id", F.col("offset").alias("_from"), (F.col("offset") + F.length("code")).alias("_to"), "frag_index")
    met = holding(points.select("page_id", "offset"), "offset", inline, "_from", "_to", ["page_id"]).groupBy("page_id", "offset").agg(F.max("frag_index").alias("frag_index"))
    return points.join(met, ["page_id", "offset"], "left")


#: Comments and strings of a script, for a scan of names only.
QUIET = r"//[^\r\n]*+|/\*[\s\S]*?(?:\*/|\z)|\"[^\"\\\r\n]*+(?:\\.[^\"\\\r\n]*+)*+\"|'[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+'"
NAMES = r"\.\s*[A-Za-z_$][\w$]*|\bvar\s+[A-Za-z_$][\w$]*|(?<![.\w$])[A-Za-z_$][\w$]*(?=\s*\()"


def scan_property_names(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, use, offset): names after a dot, after ``var``, and called ones, straight from the text of scripts."""
    rows = fragments.select(*keys, "offset", F.inline(X.matches(X.blanked(F.col("code"), QUIET), NAMES)))
    name = F.regexp_extract("value", r"[A-Za-z_$][\w$]*$", 0)
    use = F.when(F.col("value").startswith("."), "property").when(F.col("value").rlike(r"^var\s"), "declaration").otherwise("call")
    return rows.select(*keys, name.alias("name"), use.alias("use"), (F.col("offset") + F.col("end") - F.length(name)).alias("offset"))


def normalised(path: Column) -> Column:
    """A path without ``.`` and with every ``..`` taken back; what leads above the top stays there."""
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(?:^|/)\.{0,2}/|/\.{1,2}$"), F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))).otherwise(path)


def directory_join(base: Column, url: Column) -> Column:
    """A url taken relative to the directory of a page path, normalised; absolute ones stay."""
    directory = F.regexp_extract(base, r"^(.*/)?[^/]*$", 1)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^/"), url).otherwise(normalised(F.concat(directory, url)))


def resolve_externs(fragments: DataFrame, pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extern scripts with the source they name (app, path joined), and those whose target is missing."""
    named = fragments.where("kind = 'extern'").join(pages.select("page_id", "path"), "page_id").withColumn("target", directory_join(F.col("path"), F.col("url")))
    target = sources.select(F.col("path").alias("target"), "source_id")
    return named.join(target, "target"), named.join(target, "target", "left_anti")


def bundle_scripts(fragments: DataFrame, contents: DataFrame, app: str = "page_id") -> DataFrame:
    """One text for each app: every fragment under a ``// FILE:`` line, extern ones by the content of their url."""
    joined = fragments.join(contents.select("url", "content"), "url", "left")
    name = F.when(F.col("kind") == "inline", F.concat(F.lit("chunk"), F.col("line").cast("string"), F.lit(".js"))).otherwise(F.col("url"))
    body = F.coalesce(F.when(F.col("kind") == "inline", F.col("code")).otherwise(F.col("content")), F.lit(""))
    part = F.struct("line", F.coalesce("offset", F.lit(-1)).alias("o"), F.concat(F.lit("// FILE: "), name, F.lit("\n"), body, F.lit("\n\n")).alias("text"))
    return joined.groupBy(app).agg(F.array_sort(F.collect_list(part)).alias("p")).select(app, F.array_join("p.text", "").alias("bundle"))
