"""Corpus files: sources of programs, lists beside them, and the text tables that reports are kept in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("js", "html", "htm")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)"


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, category, app, ext, content) of every .js, .html and .htm file below ``root``/<category>/<app>/; folders that start with a dot are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[jJ][sS],[hH][tT][mM],[hH][tT][mM][lL]}").load(root)
    base = re.sub(SCHEME, "", root.rstrip("/"))
    rows = files.select(F.regexp_replace(F.col("path"), SCHEME, "").alias("full"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.withColumn("path", relative_path(F.lit(base), F.col("full")))
    return placed(rows).where(F.col("ext").isin(*EXTENSIONS) & ~F.concat(F.lit("/"), "path").rlike(r"/\.[^/]")).select("path", "category", "app", "ext", "content")


def named_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ext, content) of the named files; one with another extension is an error."""
    other = [p for p in paths if p.rsplit("/", 1)[-1].rpartition(".")[2].lower() not in EXTENSIONS]
    if other:
        raise ValueError(f"no script or page: {', '.join(other)}")
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.decode("content", "UTF-8").alias("content"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds category, app and ext from a path <category>/<app>/...."""
    parts = F.split("path", "/")
    return rows.withColumns({"category": F.get(parts, F.lit(0)), "app": F.get(parts, F.lit(1)), "ext": F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))})


def relative_path(base: Column, child: Column) -> Column:
    """Path of a child below base, null when it is not inside."""
    return F.when(child.startswith(F.concat(base, F.lit("/"))), F.substring(child, F.length(base) + 2, F.length(child)))


def select_apps(sources: DataFrame, include_fake: bool = False, include_libs: bool = False) -> DataFrame:
    """Distinct (category, app) of the corpus in order, without dot names, and without ``fake`` and ``libs`` unless asked for."""
    out = sources.where(~F.col("category").startswith(".") & ~F.col("app").startswith("."))
    if not include_fake:
        out = out.where("category != 'fake'")
    if not include_libs:
        out = out.where("category != 'libs'")
    return out.select("category", "app").distinct().orderBy("category", "app")


def read_libs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(app, key, path_prefix) from (app, value) lines ``key, path``, and the lines without a path."""
    parts = F.split("value", ", *", 2)
    rows = lines.where(F.trim("value") != "").withColumn("_p", parts)
    good = rows.where(F.size("_p") == 2).select("app", F.col("_p")[0].alias("key"), F.col("_p")[1].alias("path_prefix"))
    return good, rows.where(F.size("_p") != 2).select("app", "value")


def read_dyn_alias(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(app, obj, expr_id) from lines ``obj, expr``, and the lines that are not two fields with a number first."""
    rows = lines.withColumn("_p", F.split("value", ", *"))
    ok = (F.size("_p") == 2) & F.coalesce(F.expr("try_cast(_p[0] AS int)").isNotNull(), F.lit(False))
    good = rows.where(ok).select("app", F.col("_p")[0].cast("int").alias("obj"), F.col("_p")[1].alias("expr_id"))
    return good, rows.where(~ok).select("app", "value")


def kill_keys(lines: DataFrame) -> DataFrame:
    """Distinct (app, trial, source, ordinal) from (file, value): files ``<app>-<trial>-key.txt``, lines ``source/ordinal``."""
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    of = lambda c, p, n: F.regexp_extract(c, p, n)
    return lines.select(
        of(name, r"^(.*)-([0-9]+)-key\.txt$", 1).alias("app"), of(name, r"^(.*)-([0-9]+)-key\.txt$", 2).cast("int").alias("trial"),
        of("value", "^(.*)/([0-9]+)$", 1).alias("source"), of("value", "^(.*)/([0-9]+)$", 2).cast("int").alias("ordinal"),
    ).where("ordinal IS NOT NULL").distinct()


def read_kill_keys(spark: SparkSession, path: str) -> DataFrame:
    return kill_keys(spark.read.text(path).select(F.input_file_name().alias("file"), "value"))


def stat_table(lines: DataFrame, names: list[str | None], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Columns of white-space separated lines (value), by place; a None name drops the column."""
    parts = F.split(F.trim("value"), r"\s+")
    cols = [(F.get(parts, F.lit(i)).cast("double") if n in numbers else F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names) if n]
    return lines.where(F.trim("value") != "").select(*cols)


def name_stat_lines(stats: DataFrame) -> DataFrame:
    """Lines ``app name search_replace rename`` in order of app and name."""
    line = F.format_string("%s %s %d %d", "app", "name", "search_replace", "rename")
    return stats.orderBy(F.concat_ws(" ", "app", "name")).select(line.alias("value"))


def group_size_lines(groups: DataFrame) -> DataFrame:
    """A line ``app size`` for each group of a name with several tokens, app padded to 20."""
    several = groups.where("name != 'prototype'").groupBy("app", "name").agg(F.sum("size").alias("_n")).where("_n > 1")
    return groups.join(several, ["app", "name"], "left_semi").select(F.format_string("%-20s %d", "app", "size").alias("value"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """(app, value): ``"name" at src:line and src:line``, lines counted from 1, dead pairs marked. Pairs have a and b structs (source_id, line)."""
    at = lambda c: F.concat(F.col(f"{c}.source_id").cast("string"), F.lit(":"), (F.col(f"{c}.line") + 1).cast("string"))
    text = F.concat(F.lit('"'), "name", F.lit('" at '), at("a"), F.lit(" and "), at("b"), F.when(F.col("dead"), " [dead]").otherwise(""))
    return pairs.select("app", text.alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Text files, one folder an app where the lines have one."""
    (rows.write.partitionBy("app") if "app" in rows.columns else rows.write).text(path)


def mark_library(marks: DataFrame, path: str) -> None:
    """Appends (app, key, full, root) as library lines ``key, path``, the path made relative to the app's root."""
    line = F.concat("key", F.lit(", "), relative_path(F.col("root"), F.col("full")))
    marks.select("app", line.alias("value")).where("value IS NOT NULL").write.mode("append").partitionBy("app").text(path)


def app_inputs(sources: DataFrame) -> DataFrame:
    """Where an app is entered: its index.html, else all its scripts."""
    index = F.col("path").endswith("/index.html")
    has = sources.groupBy("category", "app").agg(F.bool_or(index).alias("_index"))
    rows = sources.join(has, ["category", "app"])
    return rows.where(F.when(F.col("_index"), index).otherwise(F.col("ext") == "js")).select("category", "app", "path")


def app_root(paths: DataFrame, markers: DataFrame, marker: str = "dyn-alias.txt") -> DataFrame:
    """(path, root): the nearest folder above each path that holds the marker file, null if none does. Every folder above is looked up by an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select("path", F.explode(above).alias("root"))
    held = markers.where(F.col("path").endswith("/" + marker)).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()
    near = each.join(held, "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").join(near, "path", "left")
