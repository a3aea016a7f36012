"""Name tokens: frequencies, groups of same-typed occurrences, questions saved, and the tables drawn from them.

Tokens have (app, name, rep, source_id, pos); rep is the representative of the type of what the name belongs to.
Groups with their tokens are only collected for names that are asked for; statistics work on counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bucket labels of the group-size table and of the cumulative question table.
SIZE_LABELS = ("1", "2", "3..5", "6..8", "9+")
QUESTION_LABELS = ("1", "1..2", "1..3", "1..4", "1..5", "1..6", "1..7", "1..8", "1..9", "1..10", "1+")
OPEN_END = 1_000_000


def without_prototype(tokens: DataFrame) -> DataFrame:
    """Property tokens that count: all names but ``prototype``."""
    return tokens.where("name != 'prototype'")


def name_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("app", "name").agg(F.count(F.lit(1)).alias("n"))


def property_names(tokens: DataFrame) -> DataFrame:
    return tokens.select("app", "name").distinct()


def group_sizes(tokens: DataFrame, kept: Column | None = None) -> DataFrame:
    """(app, name, rep, size); ``kept`` counts only some tokens, groups left empty go."""
    size = F.count(F.lit(1)) if kept is None else F.count_if(kept)
    return tokens.groupBy("app", "name", "rep").agg(size.alias("size")).where("size > 0")


def property_questions(tokens: DataFrame, kept: Column | None = None) -> DataFrame:
    """(app, name, rep, tokens, size) with the tokens in order, for the names that are asked for."""
    place = F.struct("source_id", "pos")
    if kept is not None:
        place = F.when(kept, place)
    found = tokens.groupBy("app", "name", "rep").agg(F.array_sort(F.collect_list(place)).alias("tokens"))
    return found.withColumn("size", F.size("tokens")).where("size > 0")


def reduction(before: Column, after: Column) -> Column:
    """after / before, 0 when there was nothing before."""
    return F.when(before == 0, F.lit(0.0)).otherwise(after / before)


def percent(before: Column, after: Column) -> Column:
    """Percent saved going from ``before`` to ``after``, 0 when there was nothing before."""
    return F.when(before == 0, F.lit(0.0)).otherwise(F.lit(100.0) * (before - after) / before)


def name_stats(groups: DataFrame) -> DataFrame:
    """Questions of search-and-replace (tokens - 1) and of renaming by groups (groups - 1), names of several tokens."""
    sums = groups.groupBy("app", "name").agg((F.sum("size") - 1).alias("search_replace"), (F.count(F.lit(1)) - 1).alias("rename"))
    return sums.where("search_replace > 0").withColumn("effect", percent(F.col("search_replace"), F.col("rename")))


def app_stats(stats: DataFrame) -> DataFrame:
    sums = stats.groupBy("app").agg(F.sum("search_replace").alias("search_replace"), F.sum("rename").alias("rename"))
    return sums.withColumn("effect", percent(F.col("search_replace"), F.col("rename")))


def parse_range(label: Column) -> tuple[Column, Column]:
    """``n``, ``a..b`` (both in) or ``n+`` as [low, high)."""
    parts = F.split(label, "\\.\\.")
    low = F.regexp_extract(label, "^[0-9]+", 0).cast("int")
    high = F.when(label.endswith("+"), F.lit(OPEN_END)).when(F.size(parts) == 2, F.get(parts, F.lit(1)).cast("int") + 1).otherwise(low + 1)
    return low, high


def format_range(low: Column, high: Column) -> Column:
    return F.when(high == OPEN_END, F.concat(low.cast("string"), F.lit("+"))).when(high == low + 1, low.cast("string")).otherwise(F.concat_ws("..", low.cast("string"), (high - 1).cast("string")))


def ranges(spark: SparkSession, labels: tuple[str, ...]) -> DataFrame:
    """(label, lo, hi): one row a bucket label."""
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    low, high = parse_range(F.col("label"))
    return rows.select("label", low.alias("lo"), high.alias("hi"))


def in_ranges(rows: DataFrame, value: str, buckets: DataFrame) -> DataFrame:
    """Range join; the bucket table is a handful of labels, and a row may fall into several."""
    return rows.join(F.broadcast(buckets), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))


def _wide(rows: DataFrame, keys: list[str], labels: tuple[str, ...], value: str) -> DataFrame:
    return rows.groupBy(*keys).pivot("label", list(labels)).agg(F.sum(value)).na.fill(0)


def group_size_histogram(groups: DataFrame, labels: tuple[str, ...] = SIZE_LABELS) -> DataFrame:
    """Per app, how many tokens are in groups of each size. Sizes are counted before buckets are looked up."""
    counted = groups.where("name != 'prototype'").groupBy("app", "size").agg(F.sum("size").alias("tokens"))
    return _wide(in_ranges(counted, "size", ranges(groups.sparkSession, labels)), ["app"], labels, "tokens")


def question_histogram(groups: DataFrame, labels: tuple[str, ...] = QUESTION_LABELS) -> DataFrame:
    """Per app and tool, names by number of tokens (``naive``) and the surplus by number of groups (``rename``)."""
    names = groups.where("name != 'prototype'").groupBy("app", "name").agg(F.sum("size").alias("naive"), F.count(F.lit(1)).alias("rename")).where("naive > 1")
    counted = names.select("app", F.inline(F.array(*[F.struct(F.lit(t).alias("tool"), F.col(c).cast("long").alias("value"), F.lit(s).alias("sign")) for t, c, s in (("naive", "naive", 1), ("rename", "rename", 1), ("rename", "naive", -1))])))
    counted = counted.groupBy("app", "tool", "value").agg(F.sum("sign").alias("names"))
    return _wide(in_ranges(counted, "value", ranges(groups.sparkSession, labels)), ["app", "tool"], labels, "names")


def group_distribution(groups: DataFrame) -> DataFrame:
    """Per app, the share of tokens in groups of 1, 2, 3 to 9 and 10 or more."""
    size = F.col("size")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, size)), F.lit(0)) / F.sum(size)
    return groups.groupBy("app").agg(part(size == 1).alias("one"), part(size == 2).alias("two"), part(size.between(3, 9)).alias("to_nine"), part(size >= 10).alias("ten_up")).orderBy("one", "app")


def solved_within(stats: DataFrame, n: int = 10) -> DataFrame:
    """Per app: share of names within n search-and-replace questions, the extra share by renaming, and neither."""
    sr, rn, all_ = F.count_if(F.col("search_replace") <= n), F.count_if(F.col("rename") <= n), F.count(F.lit(1))
    return stats.groupBy("app").agg((sr / all_).alias("search_replace"), ((rn - sr) / all_).alias("rename"), ((all_ - rn) / all_).alias("neither")).orderBy("search_replace", "app")


def cross_thresholds(stats: DataFrame, most: int = 9) -> DataFrame:
    """Every row with every threshold 0..most: a fixed number of copies, made without a shuffle."""
    return stats.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(most))))


def cumulative_questions(stats: DataFrame, app: str, most: int = 9) -> DataFrame:
    """Names of one app within each threshold. An app without names is an error."""
    mine = stats.where(F.col("app") == app)
    if not mine.head(1):
        raise ValueError(f"no names of app {app}")
    sr, rn = F.count_if(F.col("search_replace") <= F.col("threshold")), F.count_if(F.col("rename") <= F.col("threshold"))
    return cross_thresholds(mine, most).groupBy("threshold").agg(sr.alias("search_replace"), (rn - sr).alias("rename")).orderBy("threshold")


def property_count(stats: DataFrame, app: str | None = None) -> DataFrame:
    rows = stats if app is None else stats.where(F.col("app") == app)
    return rows.groupBy("app").agg(F.count(F.lit(1)).alias("num"))


def question_scatter(stats: DataFrame, limit: int = 100) -> DataFrame:
    """Points (search_replace, rename) within the window, with how many names lie on each."""
    rows = stats.where(F.col("search_replace").between(0, limit) & F.col("rename").between(0, limit))
    return rows.groupBy("search_replace", "rename").agg(F.count(F.lit(1)).alias("names"))


def most_frequent_name(tokens: DataFrame) -> DataFrame:
    """Top name of each app, ties by name."""
    counted = name_frequency(tokens)
    return counted.groupBy("app").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"), F.max("n").alias("n"))


def effect_delta(whole: DataFrame, other: DataFrame) -> DataFrame:
    """Per app, effect in the other analysis less effect in the whole one."""
    return whole.select("app", "effect").join(other.select("app", F.col("effect").alias("other")), "app").select("app", "effect", (F.col("other") - F.col("effect")).alias("delta"))


def library_samples(in_app: DataFrame, uses: DataFrame, alone: DataFrame) -> DataFrame:
    """(lib, app, in_app, alone): effect of library code inside each app that uses it, and by itself."""
    joined = in_app.select("app", "lib", F.col("effect").alias("in_app")).join(uses, ["app", "lib"], "left_semi")
    return joined.join(alone.select("lib", F.col("effect").alias("alone")), "lib")


def library_averages(samples: DataFrame) -> DataFrame:
    return samples.groupBy("lib").agg(F.avg("in_app").alias("mean_effect"), F.avg(F.col("alone") - F.col("in_app")).alias("mean_delta")).orderBy("lib")


def questions_of_targets(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """All groups of the asked names: tokens are cut down to those names first."""
    return property_questions(tokens.join(targets.select("app", "name").distinct(), ["app", "name"], "left_semi"))


def order_questions(groups: DataFrame, current: Column | None = None) -> DataFrame:
    """Numbered groups of each (app, name): tokens and groups by (file rank, source, position), the current file first."""
    from pyspark.sql import Window

    rank = lambda t: F.when(current == t["source_id"], 0).otherwise(1) if current is not None else F.lit(1)
    ranked = F.array_sort(F.transform("tokens", lambda t: F.struct(rank(t).alias("r"), t["source_id"].alias("source_id"), t["pos"].alias("pos"))))
    rows = groups.withColumn("tokens", ranked).withColumn("first", F.col("tokens")[0])
    rows = rows.withColumn("question", F.row_number().over(Window.partitionBy("app", "name").orderBy("first")))
    return rows.withColumn("tokens", F.transform("tokens", lambda t: t.dropFields("r"))).drop("first")


def select_tokens(groups: DataFrame, targets: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens to rename: the group that holds the target, and groups answered yes. Few targets and answers, no arrays moved twice."""
    tokens = groups.select("app", "name", "rep", F.inline("tokens"))
    asked = tokens.join(targets.select("app", "name", "source_id", "pos"), ["app", "name", "source_id", "pos"], "left_semi").select("app", "name", "rep")
    wanted = asked.unionByName(answers.where("yes").select("app", "name", "rep")).distinct()
    return tokens.join(wanted, ["app", "name", "rep"], "left_semi")


def affected_documents(tokens: DataFrame, scope: str = "workspace", source_id: int | None = None, app: str | None = None) -> DataFrame:
    """Distinct documents a rename changes, within a file, a project (app) or everywhere."""
    if scope == "file":
        tokens = tokens.where(F.col("source_id") == source_id)
    elif scope == "project":
        tokens = tokens.where(F.col("app") == app)
    elif scope != "workspace":
        raise ValueError(f"scope {scope}")
    return tokens.select("app", "source_id").distinct()
