"""Spelling variants by anagram hashing: words one edit apart, each led to the most frequent spelling near it.

A word's key is the sum of the fifth powers of its letters, modulo a prime, so anagrams share it and an edit moves it by
the letter's value. Two words differ by an exchanged letter when their keys less one letter each are equal, by an added or
removed one when one's key less a letter is the other's; every word therefore offers its key, and its key less each of its
letters, and an equi-join finds all three. As an edit stands in one half of a word, the other half goes into the join
beside the key: anagrams of a word do not all meet. Letter order is verified on the words themselves.

Defined results: null texts have no words, an empty table has none; repeated rows count each time; a null doc_id is
spelled as nothing; of equally frequent spellings the least in code-point order leads; other columns are not read. A text
is cut into its words in one row, however long it is; from then on words are counted, not texts.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import cut, table

LETTERS = "[A-Za-zÀ-ÿ]"
#: The largest prime below 2**40: a value times a code point stays within a long.
PRIME = (1 << 40) - 87
DAMAGE, LEAST_CHARS, LEAST_N, RATIO = 199, 6, 5, 5


def runs(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, run): maximal runs of letters, of so many at least, with A-Z in lower case."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_chars},}}+"), F.lit(0))).alias("run"))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", ascii_uppercase, ascii_lowercase)).otherwise(F.col("run")))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words of so many code points that occur so often."""
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _value(letter: Column) -> Column:
    """Fifth power of the code point, modulo the prime."""
    c = F.ascii(letter).cast("long")
    out = c
    for _ in range(4):
        out = out * c % PRIME
    return out


def _offers(vocab: DataFrame) -> DataFrame:
    """A word's key, and its key less each letter, once with the front half of what is left and once with the rear half.

    ``size`` is the length of what is left; halves are hashed, as the words are compared in the end.
    """
    keyed = vocab.withColumn("_letters", F.split("word", "")).withColumn("_key", F.aggregate("_letters", F.lit(0).cast("long"), lambda acc, x: (acc + _value(x)) % PRIME))
    whole = F.struct(F.lit(None).cast("string").alias("letter"), F.col("_key").alias("key"), F.char_length("word").alias("size"))
    less = F.transform(F.array_distinct("_letters"), lambda x: F.struct(x.alias("letter"), F.pmod(F.col("_key") - _value(x), F.lit(PRIME)).alias("key"), (F.char_length("word") - 1).alias("size")))
    rows = keyed.select("word", "n", F.inline(F.concat(F.array(whole), less)))
    front = F.floor(F.col("size") / 2).cast("int")
    halves = F.array(F.struct(F.lit(True).alias("fore"), F.xxhash64(F.substring("word", F.lit(1), front)).alias("half")), F.struct(F.lit(False).alias("fore"), F.xxhash64(F.substring(F.col("word"), -(F.col("size") - front), F.col("size") - front)).alias("half")))
    return rows.select("word", "n", "letter", "key", "size", F.inline(halves))


def _has_one_more(a: str, b: str, letter: str) -> Column:
    """Does word a have the letter once more than b? True for no letter."""
    times = lambda w: F.char_length(w) - F.char_length(F.replace(F.col(w), F.col(letter), F.lit("")))
    return F.col(letter).isNull() | (times(a) == times(b) + 1)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    Both halves can agree (a letter doubled, an exchange in the middle): then the front counts. The letters offered must
    be the ones by which the words differ, so a chance equality of sums gives no pair twice.
    """
    offers = _offers(vocab)
    keys = ["key", "size", "fore", "half"]
    left = offers.select(*keys, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letter").alias("a_less"))
    right = offers.select(*keys, F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letter").alias("b_less"))
    front = lambda w: F.substring(F.col(w), F.lit(1), F.floor(F.col("size") / 2).cast("int"))
    met = left.join(right, keys).where("a < b AND NOT (a_less <=> b_less)").where(F.levenshtein("a", "b", 1) == 1)
    met = met.where(_has_one_more("a", "b", "a_less") & _has_one_more("b", "a", "b_less"))
    return met.where(F.col("fore") | (front("a") != front("b"))).select("a", "a_n", "b", "b_n")


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the most frequent near word, if it is ``ratio`` times as frequent, and where forms lead.

    Frequencies grow by ``ratio`` from form to form, so the doubling of paths ends after the logarithm of a logarithm.
    """
    vocab = cut(vocab)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = near_pairs(vocab).select(F.inline(both)).select("word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    rows = near.unionByName(vocab.select("word", "n", F.lit(None).cast(near.schema["best"].dataType).alias("best")))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    leads = -F.col("best.less") >= F.col("n") * ratio
    rows = cut(rows.select("word", F.when(leads, F.col("best.near")).alias("form"), "n", "n_near", F.when(leads, -F.col("best.less")).alias("form_n")))
    paths = cut(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(paths.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        paths = step.select("word", "root")
        if not step.where("moved").head(1):
            break
    return rows.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def damaged(words: DataFrame) -> DataFrame:
    """(word): runs with a code point deleted where DAMAGE divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return words.select(F.when(h % DAMAGE == 0, less).otherwise(F.col("run")).alias("word"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs too short to become a word are not taken at all."""
    return variants(vocabulary(damaged(runs(table(spark, sf_dir, "documents"), LEAST_CHARS))))


#: CRC-32 by its table, over the bytes of UTF-8: a table of it for SQL, and the checksum of a string by it.
CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def crc_sql(s: str) -> str:
    """Checksum of column ``s``, where ``tab`` is joined."""
    codes = f"list_transform(range(1, CAST(length(hex(encode({s}))) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({s})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
run AS (SELECT doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run, count(*) AS n FROM raw WHERE length(run) >= 6 GROUP BY ALL),
{CRC_TABLE}, crc AS (SELECT run, n, {crc_sql('s')} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM run), tab),
word AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM crc),
voc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_N}),
del AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.less = b.less AND a.len = b.len AND a.i = b.i AND a.word != b.word
  UNION SELECT d.word, v.word, v.n FROM del d JOIN voc v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM del d JOIN voc v ON v.word = d.less),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
out AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * v.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * v.n THEN near_n END AS form_n FROM voc v LEFT JOIN best b ON b.word = v.word),
path AS (SELECT word, word AS at, form FROM out UNION ALL SELECT p.word, o.word, o.form FROM path p JOIN out o ON o.word = p.form)
SELECT o.word, o.form, p.at AS root, o.n, o.n_near, o.form_n FROM out o JOIN path p ON p.word = o.word AND p.form IS NULL
"""

QUERIES = {"op11_spelling_variants": op11}
ORACLES = {"op11_spelling_variants": SQL}
