"""Text edits: renames as offset edits, blanked functions, routed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import names as N


def build_edits(tokens: DataFrame, sources: DataFrame, new_name: Column) -> DataFrame:
    """(doc_id, offset, length, replacement) of tokens (app, source_id, name, pos) in the documents their sources lie in."""
    met = tokens.join(sources.select("app", "source_id", "doc_id", F.col("offset").alias("_o")), ["app", "source_id"])
    return met.select("doc_id", (F.col("_o") + F.col("pos")).cast("int").alias("offset"), F.length("name").alias("length"), new_name.alias("replacement"))


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their edits made; those without pass through. Edits of a document do not overlap.

    The text is cut once at all edits and put together again, so many edits of a long text cost one pass.
    """
    listed = edits.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("offset", "length", "replacement"))).alias("_e"))
    rows = docs.join(listed, key, "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("_e", lambda e: e["offset"] + e["length"]))
    starts = F.concat(F.transform("_e", lambda e: e["offset"]), F.array(F.length(text)))
    new = F.concat(F.transform("_e", lambda e: e["replacement"]), F.array(F.lit("")))
    pieces = F.zip_with(F.zip_with(ends, starts, lambda b, e: F.substring(F.col(text), b + 1, e - b)), new, lambda p, r: F.concat(p, r))
    return rows.withColumn(text, F.when(F.col("_e").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))).drop("_e")


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Intervals (key, start, end) without those inside another."""
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_m", F.max("end").over(before)).where("_m IS NULL OR start >= _m").drop("_m")


def blank_functions(docs: DataFrame, bodies: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Outermost bodies (key, start, end) become a note and blanks for all that was not white space."""
    cut = outermost(bodies.select(key, "start", "end"), key).join(docs.select(key, text), key)
    body = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    new = F.concat(F.lit("{ /* removed! */ "), F.regexp_replace(body, r"\S", " "), F.lit("}"))
    edits = cut.select(F.col(key).alias("doc_id"), F.col("start").cast("int").alias("offset"), (F.col("end") - F.col("start")).cast("int").alias("length"), new.alias("replacement"))
    return apply_edits(docs, edits, key, text)


def fragmented_sources(fragments: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, script): inline fragments of each page, killed bodies blanked, each under a note of its line; extern ones are left out.

    ``bodies`` are (page_id, frag_index, start, end) inside the fragment.
    """
    named = lambda d: d.withColumn("doc_id", F.concat_ws("/", F.col("page_id").cast("string"), F.col("frag_index").cast("string")))
    inline = named(fragments.where("kind = 'inline'")).withColumnRenamed("code", "text")
    out = blank_functions(inline, named(bodies))
    part = F.struct("frag_index", F.concat(F.lit("// fragment from line "), (F.col("line") + 1).cast("string"), F.lit("\n"), "text", F.lit("\n")).alias("t"))
    return out.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(part))["t"], "").alias("script"))


def route(tokens: DataFrame) -> DataFrame:
    """Adds route: property, global (also properties of the global object), local or label; null is rejected.

    Tokens carry ref_kind, scope_id and, for properties, base_is_global.
    """
    prop = F.when(F.coalesce("base_is_global", F.lit(False)), "global").otherwise("property")
    return tokens.withColumn("route", F.when(F.col("ref_kind") == "property", prop).when(N.is_local(), "local").when(N.is_global(), "global").when(F.col("ref_kind") == "label", "label"))


def local_questions(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(app, source_id, scope_id, name, tokens): one group for each asked local."""
    keys = ["app", "source_id", "scope_id", "name"]
    rows = tokens.where(N.is_local()).join(targets.select(*keys).distinct(), keys, "left_semi")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("tokens"))


def global_questions(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(app, name, question, tokens): group 1 the global variables of the name, group 2 properties of the global object; empty groups are left out."""
    rows = tokens.withColumn("question", F.when(N.is_global(), 1).when((F.col("ref_kind") == "property") & F.coalesce("base_is_global", F.lit(False)), 2)).where("question IS NOT NULL")
    rows = rows.join(targets.select("app", "name").distinct(), ["app", "name"], "left_semi")
    return rows.groupBy("app", "name", "question").agg(F.array_sort(F.collect_list(F.struct("source_id", "pos"))).alias("tokens"))


def label_questions(ast: DataFrame, targets: DataFrame) -> DataFrame:
    """(app, source_id, statement, name, tokens): each asked label with the breaks and continues that mean it.

    A label token means the nearest labelled statement of that name around it, not looking out of its function.
    """
    labels = ast.where("kind = 'Label'").select("app", "source_id", F.col("parent_id").alias("statement"), "name", F.col("node_id").alias("_label"))
    above = F.transform("ancestors", lambda a, i: F.struct(a["id"].alias("id"), a["kind"].alias("kind"), i.alias("at")))
    inner = F.aggregate(F.reverse(above), F.struct(F.lit(True).alias("on"), F.array().cast("array<struct<id:bigint,kind:string,at:int>>").alias("out")), lambda acc, a: F.struct((acc["on"] & (a["kind"] != "FunctionNode")).alias("on"), F.when(acc["on"] & (a["kind"] == "LabeledStatement"), F.concat(acc["out"], F.array(a))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    used = N.classify_names(ast).where("ref_kind = 'label'").select(*N.NODE, "name", "pos", F.inline(inner)).withColumnRenamed("id", "statement")
    met = used.join(labels, ["app", "source_id", "statement", "name"]).groupBy(*N.NODE, "name", "pos").agg(F.max_by("statement", "at").alias("statement"))
    asked = met.join(targets.select(*N.NODE), N.NODE, "left_semi").select("app", "source_id", "statement").distinct()
    return met.join(asked, ["app", "source_id", "statement"], "left_semi").groupBy("app", "source_id", "statement", "name").agg(F.array_sort(F.collect_list("pos")).alias("tokens"))
