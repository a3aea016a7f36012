"""Document fingerprints from closed syncmers over the bytes of UTF-8 texts, as column expressions.

Every byte has a rank (``RANKS``, rare ones low; bytes of other scripts by a rule). A k-mer, K consecutive bytes, is a
closed syncmer when the least rank among its bytes, its inner substrings of length one, stands first or last. Whether
it is chosen depends on the k-mer alone, so a passage gives the same anchors wherever it stands: anchors are free of
context and can be matched by place. K - 1 marks (a byte that UTF-8 never has, of the highest rank) stand before and
after a text, so every text that is not empty has an anchor (at its first byte of least rank), by one rule for all
lengths and scripts. Regular expressions with look-arounds of fixed width find them inside the JVM, without recursion
and linear in the text: those led or closed by one of the ``LOW`` lowest ranks start at such a byte only, so most bytes
cost one table lookup; k-mers without such a byte lie in runs of higher ranks, which are cut out and searched alone.

The fingerprint lists the distinct anchors, 32 bits of each k-mer's hash: those with a low first byte, those with a low
last byte, the others, each in order of place. Likeness is the share of anchors that two fingerprints have in common. ``places`` tells where anchors stand and ``matches`` joins two tables on
them by document pair and offset.

Defined results: a null text is empty; an empty text has an empty fingerprint; two empty fingerprints are alike (1), an
empty and a non-empty one are not (0). A null doc_id counts as the smallest; the document after several rows of one id
is that of the next smaller id, and of several texts under that id the least is taken; a lone id follows itself;
repeated rows get equal results; a very long text is held whole by one task; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import partitions, small, table, written

K = 24
#: ASCII by rank, lowest first; what is not listed (controls, signs) has the lowest. Blank, vowels and frequent
#: consonants come last.
RANKS = ("qxjzkQXJZK0123456789", "vwyVWYABCDEFGHILMNOPRSTU,.\n", "bpf", "gmcu", "hldo", "rnsitea ")
LOW = 3
MARK = 0xFF
NULL_ID = -(1 << 63)
KEYS_A_RANGE = 1_000_000


def rank(byte: int) -> int:
    """Bytes that begin a code point of other scripts have the highest rank, those that follow are spread over all but the lowest."""
    if byte >= 0xC0:
        return len(RANKS) - 1
    if byte >= 0x80:
        return 1 + (byte * 37 >> 2) % (len(RANKS) - 1)
    return next((r for r, signs in enumerate(RANKS) if chr(byte) in signs), 0)


def _bytes(test: Callable[[int], bool]) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if test(rank(b))) + "]"


def _edges(ranks: range, k: int) -> tuple[str, str]:
    """A byte whose k-mer to the right, or to the left, has none of a lower rank (of ``ranks``, whose first is the least there is)."""
    one, rest = lambda r: _bytes(lambda x: x == r), lambda r: _bytes(lambda x: x >= r)
    first = "|".join(one(r) + (f"(?={rest(r)}{{{k - 1}}})" if r > ranks[0] else "") for r in ranks)
    last = "|".join(one(r) + (f"(?<={rest(r)}{{{k}}})" if r > ranks[0] else "") for r in ranks)
    return first, last


def pattern(k: int = K, ranks: range = range(len(RANKS))) -> str:
    """Matches, without taking it, the start of every anchor; its only group is the k-mer."""
    first, last = _edges(ranks, k)
    return f"(?s)(?=((?:{first}).{{{k - 1}}}|.{{{k - 1}}}(?:{last})))"


def patterns(k: int = K) -> tuple[str, str, str]:
    """Anchors with a low first byte, those with a low last byte (group 1 is the k-mer), and runs that hold all others."""
    first, _ = _edges(range(LOW), k)
    low, high = _bytes(lambda x: x < LOW), _bytes(lambda x: x >= LOW)
    last = "|".join(f"(?<={_bytes(lambda x, r=r: x == r)})" + (f"(?<={_bytes(lambda x, r=r: x >= r)}{{{k}}})" if r else "") for r in range(LOW))
    return f"(?s){low}(?<=(?=((?:{first}).{{{k - 1}}})).)", f"(?s){low}(?:{last})(?<=(.{{{k}}}))", f"(?<!{high}){high}{{{k},}}+"


def marked(text: Column, k: int = K) -> Column:
    """The UTF-8 bytes, one sign each, between marks."""
    marks = F.lit(chr(MARK) * (k - 1))
    return F.when(text == "", "").otherwise(F.concat(marks, F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), marks))


def anchors(text: Column, k: int = K) -> Column:
    """array<int>: the distinct anchors."""
    signs, (first, last, runs) = marked(text, k), patterns(k)
    others = F.flatten(F.transform(F.regexp_extract_all(signs, F.lit(runs), F.lit(0)), lambda run: F.regexp_extract_all(run, F.lit(pattern(k, range(LOW, len(RANKS)))), F.lit(1))))
    return F.array_union(F.array_union(_hashed(signs, first), _hashed(signs, last)), F.transform(others, lambda x: F.hash(x)))


def _hashed(text: Column | str, found: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(found), F.lit(1)), lambda x: F.hash(x))


def spelled(found: Column) -> Column:
    """Anchors as eight hexadecimal digits, with a space between."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def places(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, place, anchor): where each anchor begins, in bytes of the text (marks before it are negative places)."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), marked(F.coalesce(F.col("text").cast("string"), F.lit("")), k).alias("text")).where("text != ''")
    cut = rows.select("doc_id", "row", _hashed("text", pattern(k)).alias("anchors"), F.split("text", pattern(k), -1).alias("pieces"))
    # no empty piece stands before an anchor at the very start
    before = F.when(F.size("pieces") > F.size("anchors"), F.col("pieces")).otherwise(F.concat(F.array(F.lit("")), F.col("pieces")))
    each = F.zip_with("anchors", F.slice(before, 1, F.size("anchors")), lambda x, piece: F.struct(x.alias("anchor"), F.length(piece).alias("step")))
    steps = cut.select("doc_id", "row", F.posexplode(each).alias("at", "each"))
    upto = Window.partitionBy("row").orderBy("at")
    return steps.select("doc_id", (F.sum("each.step").over(upto) - (k - 1)).alias("place"), F.col("each.anchor").alias("anchor"))


def matches(left: DataFrame, right: DataFrame, k: int = K) -> DataFrame:
    """(left_id, right_id, offset, n): anchors that two documents share at one offset, most telling where n is large."""
    a = places(left, k).select(F.col("doc_id").alias("left_id"), "anchor", F.col("place").alias("left_place"))
    b = places(right, k).select(F.col("doc_id").alias("right_id"), "anchor", F.col("place").alias("right_place"))
    return a.join(b, "anchor").groupBy("left_id", "right_id", (F.col("right_place") - F.col("left_place")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def following(ids: DataFrame, keys_a_range: int = KEYS_A_RANGE) -> DataFrame:
    """(key, next_key): for every distinct key the next smaller one, for the smallest the largest.

    Keys are dealt into ranges, more of them as keys grow in number; the order is made inside each range, and only one
    row of each range meets in one task.
    """
    keys = written(ids.distinct())
    n = max(partitions(ids.sparkSession), keys.count() // keys_a_range + 1)
    ranged = written(keys.repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("range")))
    ends = ranged.groupBy("range").agg(F.max("key").alias("most"))
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lag("most").over(order), F.last("most").over(whole)).alias("before"))
    lower = F.lag("key").over(Window.partitionBy("range").orderBy("key"))
    return ranged.join(small(ends), "range").select("key", F.coalesce(lower, "before").alias("next_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the contract's columns.

    Both joins read one exchange of (key, text); the following text travels once more, which is less than its half and
    its anchors would be.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = following(rows.select("key")).select(F.col("next_key").alias("key"), F.col("key").alias("asker"))
    given = rows.join(asked, "key").groupBy("asker").agg(F.min("text").alias("after"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("after"), F.lit(1), half))
    met = rows.join(given, rows["key"] == given["asker"]).select("key", "text", "after", edited.alias("edited"))
    met = met.select("key", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[anchors(F.col(c)).alias(a) for c, a in (("text", "anchors"), ("after", "next"), ("edited", "changed"))])
    return met.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        spelled(F.col("anchors")).alias("fingerprint"),
        spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("changed")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next")).alias("near_next"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_syncmer_fingerprints": op4}
ORACLES: dict[str, str] = {}
