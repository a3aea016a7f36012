"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source with share p of the tokens gets weight p**a / sum(p**a). The exponent a in [0, 1] is bisected: the largest
(nearest to the natural mix) whose entropy reaches ``entropy`` times that of the uniform mix, then raised where the
``repeats`` limit asks for it (no source is read more often than that; 1 or more, so that a = 1 always meets it).

The budget (default: all tokens once) times its weight is what a source may spend: whole epochs, then a part of one
more. Documents lie in blocks by hash; each epoch permutes a source's blocks by hash and the documents of a block by
hash. The last epoch takes whole blocks in that order while they fit, then documents of the next block while they fit.
Sorted by (slot, block, rank) the rows are the mixed order: blocks of all sources and epochs, permuted together.

A source has at most ``BLOCKS`` blocks, so what is summed in order is that many rows a source, however large it is;
documents themselves are only ordered inside the one block that is cut, by their numbers and token counts: texts and
other columns take no part in any order, they are joined to the numbers chosen. A document's block and rank come from
its id and a hash of its text, so documents without an id, or under one id, are dealt over all blocks. Sources are bisected on the driver while there are at most
``LOCAL_SOURCES``; beyond, every step of the same bisection is one aggregate.

Defined results: a null source is a source of its own; null or empty texts have no tokens (tokens are runs of anything
but white space) and come with the whole epochs of their source; a source without tokens gets no weight and is left
out; repeated rows are documents of their own (in one block, in any order); a very long text is one document of many tokens
(the cut block takes it only if it fits whole); an empty table gives an empty mix; other columns pass untouched, but
for those with the names of the columns added here, which take their place.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, floor, log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import cut, small, table, written

ENTROPY, REPEATS, BLOCK_TOKENS, BLOCKS, SEED = 0.97, 4.0, 20_000, 1 << 16, 42
LOCAL_SOURCES, STEPS = 50_000, 50
ADDED = ("mix_n_tokens", "mix_epoch", "mix_block", "mix_slot", "mix_rank")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with source_key and n_tokens."""
    return docs.withColumn("source_key", F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))).withColumn("n_tokens", F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit("\\S+")), F.lit(0)).cast("long"))


def mix_at(shares: list[float], a: float) -> tuple[float, float, float]:
    """Sum of p**a, entropy of the mix, and the largest weight over share."""
    powered = [p**a for p in shares]
    z = sum(powered)
    return z, log(z) - a * sum(q * log(p) for p, q in zip(shares, powered, strict=True)) / z, max(q / p for p, q in zip(shares, powered, strict=True)) / z


def _mix_at(sources: DataFrame, total: int) -> Callable[[float], tuple[float, float, float]]:
    p = F.col("tokens") / float(total)

    def at(a: float) -> tuple[float, float, float]:
        q = F.exp(F.lit(a) * F.log(p))
        z, s, most = sources.agg(F.sum(q), F.sum(q * F.log(p)), F.max(q / p)).first()
        return z, log(z) - a * s / z, most / z

    return at


def bisect(at: Callable[[float], tuple[float, float, float]], sources: int, entropy: float, repeats: float, epochs: float = 1.0) -> float:
    """The exponent; ``epochs`` is the budget in readings of the whole corpus."""
    a = 1.0
    if at(1.0)[1] < entropy * log(sources) - 1e-12:
        low, high = 0.0, 1.0  # the entropy falls as the exponent grows
        for _ in range(STEPS):
            a = (low + high) / 2
            low, high = (a, high) if at(a)[1] >= entropy * log(sources) else (low, a)
        a = low
    if at(a)[2] * epochs > repeats:
        low, high = a, 1.0  # so do the repeats of the smallest source
        for _ in range(STEPS):
            a = (low + high) / 2
            low, high = (low, a) if at(a)[2] * epochs <= repeats else (a, high)
        a = high
    return a


def weights(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """(source_key, tokens, weight, allowance) of the sources that have tokens; ``docs`` comes from ``counted``."""
    spark = docs.sparkSession
    sources = docs.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    schema = "source_key string, tokens long, weight double, allowance long"
    if not n:
        return spark.createDataFrame([], schema)
    budget = total if budget is None else budget
    if n <= LOCAL_SOURCES:
        rows = sorted((r["source_key"], r["tokens"]) for r in sources.collect())
        shares = [t / total for _, t in rows]
        a = bisect(lambda x: mix_at(shares, x), n, entropy, repeats, budget / total)
        z = mix_at(shares, a)[0]
        return spark.createDataFrame([(k, t, p**a / z, floor(p**a / z * budget)) for (k, t), p in zip(rows, shares, strict=True)], schema)
    at = _mix_at(sources, total)
    a = bisect(at, n, entropy, repeats, budget / total)
    w = F.exp(F.lit(a) * F.log(F.col("tokens") / float(total))) / F.lit(at(a)[0])
    return sources.select("source_key", "tokens", w.alias("weight"), F.floor(w * budget).alias("allowance"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """A row for each reading of a document: its columns (the text with ``carry_text``) and mix_n_tokens, mix_epoch, mix_block, mix_slot, mix_rank."""
    columns = [c for c in docs.columns if (carry_text or c != text_col) and c not in ADDED]
    row = F.struct(*[docs[f"`{c}`"] for c in columns])
    text = docs[f"`{text_col}`"].cast("string")
    rows = counted(docs.select(row.alias("row"), "source", text.alias("text"), F.xxhash64(F.lit(seed), "doc_id", text).alias("hash")))
    rows = written(rows.select("row", "source_key", "n_tokens", "hash", F.monotonically_increasing_id().alias("number")))
    plan = weights(rows, entropy, repeats, budget)
    few = plan.select("source_key", F.floor(F.col("allowance") / F.col("tokens")).alias("epochs"), (F.col("allowance") % F.col("tokens")).alias("rest"), F.least(F.lit(BLOCKS), F.ceil(F.col("tokens") / block_tokens)).alias("blocks"))
    rows = rows.join(small(few), "source_key").withColumn("block", F.pmod("hash", F.col("blocks")))
    order = lambda epoch: F.xxhash64(F.lit(seed), "source_key", epoch, "block")
    rank = lambda epoch: F.xxhash64(F.lit(seed), epoch, "hash")
    # blocks of the last, partial epoch: whole ones, and the one that is cut
    sums = rows.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("epochs").alias("epochs"), F.max("rest").alias("rest"))
    run = Window.partitionBy("source_key").orderBy(order(F.col("epochs")), "block")
    sums = sums.withColumn("until", F.sum("tokens").over(run))
    sums = sums.withColumn("place", F.when(F.col("until") <= F.col("rest"), "whole").when(F.col("until") - F.col("tokens") < F.col("rest"), "part"))
    last = cut(sums.where("place IS NOT NULL").select("source_key", "block", "place", (F.col("rest") - F.col("until") + F.col("tokens")).alias("left")))
    ends = F.col("epochs") - F.when(F.col("place") == "whole", 0).otherwise(1)
    every = rows.join(small(last.where("place = 'whole'").drop("left")), ["source_key", "block"], "left").where(ends >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), ends.cast("long"))))
    inside = Window.partitionBy("source_key", "block").orderBy(rank(F.col("epochs")), "number").rowsBetween(Window.unboundedPreceding, 0)
    some = rows.join(small(last.where("place = 'part'").drop("place")), ["source_key", "block"])
    taken = some.select("source_key", "block", "number", "n_tokens", "epochs", "hash", "left").withColumn("spent", F.sum("n_tokens").over(inside)).where("spent <= left").select("number")
    part = some.join(taken, "number").withColumn("epoch", F.col("epochs"))
    kept = ["row", "n_tokens", "epoch", "block", "source_key", "hash"]
    out = every.select(*kept).unionByName(part.select(*kept))
    epoch = F.col("epoch").cast("long")
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns],
        F.col("n_tokens").alias("mix_n_tokens"),
        epoch.alias("mix_epoch"),
        F.col("block").alias("mix_block"),
        order(epoch).alias("mix_slot"),
        rank(epoch).alias("mix_rank"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES = {"op10_mix_sources": op10}
ORACLES: dict[str, str] = {}
