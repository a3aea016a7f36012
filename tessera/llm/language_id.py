"""Language identification by rank-order profiles.

A language's profile is its ``SIZE`` most frequent letter n-grams (1 to 3 letters, word edges count as a sign) in
order; a text's distance to it is the sum, over the text's own most frequent n-grams, of how far each is out of place
(``SIZE`` when the profile lacks it). Profiles are fitted on at most ``fit_docs`` distinct labelled documents a
language, taken in order of a hash of id and text; every text is read whole when it is judged. Profiles are broadcast in
blocks of ``labels`` languages (``SIZE`` entries each, about 70 MB a full block), one at a time; a text is judged against
every block.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing is
labelled; ties go to the first label in order; rows with a null label are not learned from; a null doc_id is never
held out and is learned from like others; repeated rows are learned from once and judged alike; very long texts are
held whole, one at a time; other columns pass untouched. The score is 1 - distance / largest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from tessera.llm import textarrays as ta
from tessera.runtime import batches_by_bytes, small, table, written

SIZE, FIT_DOCS, LABELS = 300, 4000, 10_000
CHUNK = 1 << 18
GUESS = "struct<lang:string,score:double>"
GUESS_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


@cache
def _letters() -> np.ndarray:
    return np.frombuffer("".join("1" if chr(c).isalpha() else "0" for c in range(0x110000)).encode(), np.uint8) == 49


def ngrams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Codes of all n-grams of each text (21 bits a letter, 0 for a word edge)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    for a, b in zip(first[:-1], first[1:], strict=True):
        p = points[a:b]
        letter = _letters()[p]
        c = np.zeros(len(p) + 2, np.uint64)
        c[1:-1] = np.where(letter, p, 0)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one edge between words
        if not letter.any():
            yield np.zeros(0, np.uint64)
            continue
        two = (c[:-1] << ta.U64(21)) | c[1:] | ta.U64(1 << 62)
        three = (c[:-2] << ta.U64(42)) | (c[1:-1] << ta.U64(21)) | c[2:]
        yield np.concatenate([c[c != 0], two, three[(c[1:-1] != 0)] | ta.U64(1 << 63)])


def ranked(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, codes in zip(batch.column("lang").to_pylist(), ngrams(batch.column("text").to_pylist()), strict=True):
            by.setdefault(lang, []).append(codes)
        for lang, parts in by.items():
            found, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


class Profiles:
    """Labels and, for every n-gram of any profile, the labels that have it with its rank in each."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]) -> None:
        """``rows``: a label with its n-grams, most frequent first."""
        rows = sorted(rows, key=lambda r: r[0])
        self.labels = [r[0] for r in rows]
        sizes = [len(r[1]) for r in rows]
        codes = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r[1], np.int64) for r in rows]]).view(np.uint64)
        label = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        rank = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in sizes]])
        order = np.argsort(codes, kind="stable")  # labels stay in order
        self.codes, begin = np.unique(codes[order], return_index=True)
        self.first = np.append(begin, len(codes))
        self.label, self.rank = label[order], rank[order]

    def guess(self, codes: np.ndarray) -> tuple[str, float]:
        top = ranked(codes)
        if not len(top) or not self.labels:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == top)
        first, count = self.first[at[known]], self.first[at[known] + 1] - self.first[at[known]]
        entry = np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)
        near = SIZE - np.abs(self.rank[entry] - np.repeat(known, count))  # what each n-gram in the profile spares
        total = SIZE * len(top) - np.bincount(self.label[entry], near, len(self.labels))
        best = int(total.argmin())
        return self.labels[best], 1.0 - float(total[best]) / (SIZE * len(top))


class Fitted(Sequence):
    """Profiles in blocks of languages; a block comes to the driver, as arrays, when it is asked for."""

    def __init__(self, rows: DataFrame, blocks: int) -> None:
        self.rows, self.blocks = rows, blocks

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, b: int) -> Profiles:
        if not 0 <= b < self.blocks:
            raise IndexError(b)
        table_ = self.rows.where(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == b).toArrow()  # SIZE codes a label
        return Profiles(list(zip(table_.column("lang").to_pylist(), (x.values.to_numpy() for x in table_.column("codes")), strict=True)))


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, labels: int = LABELS) -> Fitted:
    """Profiles from (doc_id, text, lang) rows, in blocks of ``labels``: at most ``fit_docs`` documents a language."""
    batches_by_bytes(labelled.sparkSession)
    named = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # about twice the wanted number by hash first, so that no task puts a whole language in order
    share = small(written(sizes.select("lang", F.least(F.lit(1.0), F.lit(2.0 * fit_docs) / F.col("n")).alias("share"))))
    some = named.join(share, "lang").where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) <= F.col("share")).select("lang", "text", F.pmod("hash", F.lit(1 << 30)).alias("part"), "hash")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("part", "hash"))
    last = some.select("lang", "part", "hash").distinct().withColumn("place", order).where(F.col("place") <= fit_docs).groupBy("lang").agg(F.max(F.struct("part", "hash")).alias("last"))
    sample = some.join(small(written(last)), "lang").where(F.struct("part", "hash") <= F.col("last")).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code").bitwiseXOR(F.lit(-(1 << 63)))))  # codes are unsigned
    top = counts.withColumn("_rank", first).where(F.col("_rank") <= SIZE)
    rows = written(top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "code"))), lambda x: x["code"]).alias("codes")))
    return Fitted(rows, max(1, -(-rows.count() // labels)))


def _guess(profiles: Broadcast):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[tuple] = []
            _, offsets = ta.utf8(column)
            for a, b in ta.chunks(offsets, CHUNK):
                out += [profiles.value.guess(c) for c in ngrams(column.slice(a, b - a).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], fields=list(GUESS_ARROW))

    return run


def identify(docs: DataFrame, profiles: Sequence[Profiles], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns, or those of ``carry``) and ``guess`` (lang, score). Only texts go to Python. With
    several blocks of profiles the rows and their best guess are written after each but the last, and its broadcast goes."""
    spark = docs.sparkSession
    batches_by_bytes(spark)
    if len(profiles) == 1:
        guess = F.arrow_udf(_guess(spark.sparkContext.broadcast(profiles[0])), GUESS, ArrowUDFType.SCALAR_ITER)(docs[f"`{text_col}`"])
        return docs.select(F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias("row"), guess.alias("guess"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias("row"), docs[f"`{text_col}`"].alias("text"), F.lit(None).cast(GUESS).alias("guess"))
    for b in range(len(profiles)):
        shared = spark.sparkContext.broadcast(profiles[b])
        rows = rows.withColumn("_new", F.arrow_udf(_guess(shared), GUESS, ArrowUDFType.SCALAR_ITER)(F.col("text")))
        old, new = F.col("guess"), F.col("_new")
        better = old.isNull() | ((new["lang"] != "und") & ((old["lang"] == "und") | (new["score"] > old["score"]) | ((new["score"] == old["score"]) & (new["lang"] < old["lang"]))))
        rows = rows.withColumn("guess", F.when(better, F.col("_new")).otherwise(F.col("guess"))).drop("_new")
        if b < len(profiles) - 1:
            rows = written(rows)
            shared.destroy()
    return rows.select("row", "guess")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), profiles, carry=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


QUERIES = {"op5_language_id": op5}
ORACLES: dict[str, str] = {}
