"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Every response gives a ``metadata`` record (title, language, link targets as warc-fields) and a ``conversion`` record
(its plain text). Both name the response in WARC-Refers-To with its target URI and date; the metadata record also
names the conversion in WARC-Concurrent-To. Headers of the source and the digest of its payload are carried over.
Record ids derive from (page id, url), so a rerun gives the same ids. All of it is column expressions: one scan, no
shuffle.

Defined results: a null payload is empty (an empty conversion of length 0, digest of nothing), a null url is an empty
target; repeated pages give repeated records; an empty table gives no records; a stray ``<`` is text; very long pages are
read whole, in time that grows with their length; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Patterns in the part of the syntax that Java and RE2 share. What is not closed reaches to the end of the page (as a
#: browser reads it), so nothing is searched twice for an end that is not there; a tag needs a letter after its sign.
DROPPED = r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*(?:>.*?(?:</script\s*>|\z)|\z)|style\b[^>]*(?:>.*?(?:</style\s*>|\z)|\z))"
BREAKS = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|html)\b[^>]*(?:>|\z)"
TAGS = r"</?[A-Za-z!?][^>]*(?:>|\z)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Runs of blanks but single spaces, which stay; line ends with the blanks around them.
BLANKS, LINES, EDGES = " [ \\t\\r\\f]+|[\\t\\r\\f][ \\t\\r\\f]*", " ?\\n[ \\n]*", " \n"
TITLE, LANG, LINKS = r"(?i)<title[^<>]*>([^<]*)", r"(?i)<html[^<>]*?\blang=[\"']?([A-Za-z-]+)", r"(?i)<a\s[^<>]*?href=[\"']([^\"']*)[\"']"


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, blocks on lines of their own, entities resolved."""
    out = F.regexp_replace(html, DROPPED, "")
    out = F.regexp_replace(out, BREAKS, "\n")
    out = F.regexp_replace(out, TAGS, "")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(out, BLANKS, " ")
    out = F.regexp_replace(out, LINES, "\n")
    return F.btrim(out, F.lit(EDGES))


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]])


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages: page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    return pages.select("page_id", urn(F.lit("response"), page, url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response, as columns."""
    html, page = F.col("payload"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    one_line = lambda c: F.regexp_replace(c, "[\\r\\n]+", " ")
    links = F.regexp_extract_all(html, F.lit(LINKS), 1)
    fields = F.concat(
        F.lit("title: "), one_line(F.regexp_extract(html, TITLE, 1)), F.lit(CRLF + "lang: "), F.regexp_extract(html, LANG, 1), F.lit(CRLF + "outlinks: "), F.size(links).cast("string"),
        F.when(F.size(links) > 0, F.concat(F.lit(CRLF + "outlink: "), F.array_join(F.transform(links, one_line), CRLF + "outlink: "))).otherwise(F.lit("")), F.lit(CRLF),
    )
    conversion, metadata = urn(F.lit("conversion"), page, F.col("target_uri")), urn(F.lit("metadata"), page, F.col("target_uri"))
    none = F.lit(None).cast("string")
    records = F.array(
        F.struct(F.lit("metadata").alias("record_type"), metadata.alias("id"), conversion.alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("record_type"), conversion.alias("id"), none.alias("concurrent_to"), F.lit("text/plain").alias("content_type"), plain_text(html).alias("content")),
    )
    rows = found.select("*", F.inline(records))
    return rows.select(
        "page_id", "record_type", F.col("id").alias("record_id"), F.col("record_id").alias("refers_to"), "concurrent_to", "target_uri", "warc_date",
        F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), "content_type", F.octet_length("content").cast("long").alias("content_length"), digest(F.col("content")).alias("block_digest"), "content",
    )


def record(rows: DataFrame) -> DataFrame:
    """One column ``value``: the record as it stands in a file, without its closing blank lines."""
    line = lambda name, c: F.concat(F.lit(name + ": "), c, F.lit(CRLF))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", angle(F.col("record_id"))), line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", angle(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("warc_date")),
        F.coalesce(line("WARC-Concurrent-To", angle(F.col("concurrent_to"))), F.lit("")), line("WARC-Block-Digest", F.col("block_digest")), line("X-Source-Payload-Digest", F.col("source_digest")),
        F.array_join(F.transform(F.split("source_headers", CRLF), lambda h: F.concat(F.lit("X-Source-Header: "), h)), CRLF), F.lit(CRLF),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return rows.select(F.concat(head, "content").alias("value"))


def write_warc(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of records; a record ends in two line ends, which is the writer's line separator."""
    record(rows).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    e = lambda s: "E" + q(s.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n"))
    text = f"regexp_replace(html, {q(DROPPED)}, '', 'g')"
    text = f"regexp_replace({text}, {q(BREAKS)}, {e(chr(10))}, 'g')"
    text = f"regexp_replace({text}, {q(TAGS)}, '', 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(sign)})"
    for pattern, by in ((BLANKS, "' '"), (LINES, e("\n"))):
        text = f"regexp_replace({text}, {q(pattern)}, {by}, 'g')"
    text = f"trim({text}, {e(EDGES)})"
    urn_sql = lambda kind: f"'urn:uuid:' || regexp_replace(md5(concat_ws('|', '{kind}', page, target_uri)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
    one = lambda s: f"regexp_replace({s}, '[\\r\\n]+', ' ', 'g')"
    links = f"regexp_extract_all(html, {q(LINKS)}, 1)"
    fields = (
        f"'title: ' || {one(f'regexp_extract(html, {q(TITLE)}, 1)')} || {e(CRLF + 'lang: ')} || regexp_extract(html, {q(LANG)}, 1) || {e(CRLF + 'outlinks: ')} || len({links})"
        f" || CASE WHEN len({links}) > 0 THEN {e(CRLF + 'outlink: ')} || array_to_string(list_transform({links}, lambda x: {one('x')}), {e(CRLF + 'outlink: ')}) ELSE '' END || {e(CRLF)}"
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), 'null') AS page, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, 'metadata' AS record_type, {urn_sql('metadata')} AS record_id, {urn_sql('response')} AS refers_to, {urn_sql('conversion')} AS concurrent_to, target_uri, html, 'application/warc-fields' AS content_type, {fields} AS content FROM p
  UNION ALL
  SELECT page_id, 'conversion', {urn_sql('conversion')}, {urn_sql('response')}, NULL, target_uri, html, 'text/plain', {text} FROM p)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' AS warc_date,
       {e('HTTP/1.1 200 OK' + CRLF + 'Content-Type: text/html; charset=utf-8' + CRLF + 'Content-Length: ')} || strlen(html) AS source_headers,
       'sha256:' || sha256(html) AS source_digest, content_type, CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest, content
FROM r
"""


QUERIES = {"op7_warc_derivatives": op7}
ORACLES = {"op7_warc_derivatives": _sql()}
