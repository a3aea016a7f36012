"""N-gram Jaccard join with Bayesian candidate pruning.

Sets of five-word shingles; two texts are linked when the Jaccard similarity of their sets is ``threshold`` or more.

1. sets      one row a document: a 128-bit cryptographic digest of its word sequence, band hashes of its MinHash values
2. classes   texts of one word sequence become one representative (partial aggregation first, so a hot text is one row
             a task); equal sets of other sequences are found as pairs
3. buckets   representatives that share a band are tied to the least of the bucket (a star, not all pairs); components
             of these ties hold every candidate pair
4. compare   components of one block share a task; of a larger one only representatives in the same bucket meet, a
             pair in the first bucket it shares, and buckets of several blocks are dealt by pairs of blocks. MinHash
             values are compared a slice at a time and a pair is dropped once the posterior probability that its
             similarity reaches the threshold is below ``tolerance``; what is left is verified on the words themselves
             (hashes only number them, and equal hashes are compared word for word). Counts and a spanning star leave
             the task
5. groups    components of the true links

Banding: 32 bands of 5 values; a pair at the very threshold is missed with probability 3e-6, one at 0.9 with 4e-13.
Posterior: uniform prior on the similarity, m of n values equal: P(S >= t) is the binomial probability of at most m
of n + 1 at rate t.

Defined results: null, empty and wordless texts have no links and are classes of their own; a text of fewer than five
words is one shingle; rows of equal id and text are copies; different texts under one id stay apart; null ids count as
the smallest (-2**63 as a class id); class_id is the least id in the group, so two groups can have one class_id when
their least texts share an id; rows are told apart by id and a hash of the text; a very long text is held whole by one
task; an empty table gives no rows; other columns are not read. ``n_links`` counts the other documents, copies included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.operators.graph import connected_components
from tessera.runtime import batches_by_bytes, table, written

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS_A_BAND, SLICE = 32, 5, 32
#: Most representatives and most shingles of a block; about those of components that share a task; pairs compared at once.
BLOCK, BLOCK_SHINGLES, BIN, BIN_SHINGLES, PAIRS = 2048, 1 << 20, 512, 1 << 18, 1 << 16
NULL_ID = -(1 << 63)
SETS = "doc_id long, key long, tag long, h1 long, h2 long, n_shingles int, bands array<long>"
LINKS = "kind int, a long, b long"


@cache
def _multipliers() -> np.ndarray:
    return ta.mix(np.arange(1, BANDS * ROWS_A_BAND + 1, dtype=np.uint64)) | ta.U64(1)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = ta.utf8(column)
    data = ta.lower_ascii(data)
    return data, *ta.word_spans(data, offsets, ta.ALNUM)


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within it, and the n + 1 offsets."""
    out = [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return (np.concatenate(out) if out else np.zeros(0, ta.U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _windows(first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every shingle, and the n + 1 offsets of the rows in them."""
    size = np.diff(first)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], count)
    return at, np.repeat(np.minimum(size, words), count), offsets


def hashed_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, for MinHash values only."""
    at, width, offsets = _windows(first, words)
    return _distinct(ta.span_hash(ta.prefix(ta.word_hash(data, starts, ends)), at, at + width), offsets)


def _numbers(hashes: np.ndarray, differ) -> tuple[np.ndarray, bool]:
    """A number for each value by its hash, and whether ``differ(places, places of equal hash)`` found no two unlike things under one."""
    _, place, number = np.unique(hashes, return_index=True, return_inverse=True)
    return number, not differ(np.arange(len(hashes)), place[number])


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as spread numbers, equal only for the same words in the same order (within ``column``)."""
    data, starts, ends, first = _words(column)
    sizes = ends - starts
    unlike = lambda a, b: not ((sizes[a] == sizes[b]).all() and ta.same_pieces(data, starts[a], starts[b], sizes[a]).all())
    number, exact = _numbers(ta.word_hash(data, starts, ends), unlike)
    if not exact:
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    at, width, offsets = _windows(first, words)
    rows = np.full((words, len(at)), -1, np.int32)
    for k in range(words):
        some = width > k
        rows[k, some] = number[at[some] + k]
    h = np.zeros(len(at), ta.U64)
    for k in range(words):
        h = ta.mix((h ^ rows[k].astype(np.int64).view(ta.U64)) * ta.U64(ta.BASE) + ta.U64(k))
    number, exact = _numbers(h, lambda a, b: any((rows[k][a] != rows[k][b]).any() for k in range(words)))
    if not exact:
        number = np.unique(rows, axis=1, return_inverse=True)[1].reshape(-1)
    return _distinct(ta.mix(number.astype(np.int64).view(ta.U64) + ta.U64(1)), offsets)  # 0 would be mixed to 0


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty rows, one column each."""
    full = first[:-1][np.diff(first) > 0]
    out = np.zeros((BANDS * ROWS_A_BAND, len(full)), np.uint32)
    if len(full):
        for j, m in enumerate(_multipliers()):
            out[j] = np.minimum.reduceat(sets * m, full) >> ta.U64(32)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((sig.shape[1], BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(sig.shape[1], b + 1, ta.U64)
        for r in range(ROWS_A_BAND):
            h = ta.mix(h * ta.U64(ta.BASE) + sig[b * ROWS_A_BAND + r])
        out[:, b] = h.view(np.int64)
    return out


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic digest of each row's words."""
    joined, at = ta.joined(data, starts, ends)
    edges = np.append(at, len(joined))[first].tolist()
    raw = b"".join(hashlib.blake2b(joined[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True))
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = ta.utf8(batch.column("text"))
        for a, b in ta.chunks(offsets):
            part = batch.slice(a, b - a)
            words = _words(part.column("text"))
            h1, h2 = _digests(*words)
            sets, first = hashed_shingles(*words)
            size = np.diff(first)
            bands = _bands(signatures(sets, first))
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("tag"), pa.array(h1), pa.array(h2), pa.array(size.astype(np.int32)), lists], ["doc_id", "key", "tag", "h1", "h2", "n_shingles", "bands"])


@cache
def least_equal(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values among n that leaves a pair in: P(S >= threshold) >= tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _pruned(sig: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray, same: bool, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of places) that stay candidates after all values are compared, slice by slice; some rows of the left at once."""
    step = max(1, PAIRS // max(1, len(right)))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        lo, hi = np.minimum(size[rows][:, None], size[right][None, :]), np.maximum(size[rows][:, None], size[right][None, :])
        fits = lo >= threshold * hi - 1e-9
        if same:
            fits &= (np.arange(a, a + len(rows))[:, None]) < np.arange(len(right))[None, :]
        i, j = np.nonzero(fits)
        i, j = rows[i], right[j]
        equal = np.zeros(len(i), np.int64)
        for b in range(0, len(sig), SLICE):
            if not len(i):
                break
            equal += (sig[b : b + SLICE, i] == sig[b : b + SLICE, j]).sum(axis=0)
            stay = equal >= least_equal(min(len(sig), b + SLICE), threshold, tolerance)
            i, j, equal = i[stay], j[stay], equal[stay]
        if len(i):
            yield i, j


def _common(sets: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the exact intersections of the pairs; by products of 0/1 matrices where pairs are many."""
    if len(i) < 2000:
        parts = {}
        part = lambda r: parts.setdefault(r, sets[first[r] : first[r + 1]])
        out = np.zeros(len(i), np.int64)
        for p, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            both = np.concatenate([part(x), part(y)])
            both.sort()
            out[p] = np.count_nonzero(both[1:] == both[:-1])
        return out
    rows, cols = np.unique(i), np.unique(j)
    used = np.unique(np.concatenate([rows, cols]))
    at = np.concatenate([np.arange(first[r], first[r + 1]) for r in used.tolist()])
    owner = np.repeat(used, first[used + 1] - first[used])
    _, word, count = np.unique(sets[at], return_inverse=True, return_counts=True)
    several = count[word] > 1
    owner, word = owner[several], (np.cumsum(count > 1) - 1)[word[several]]
    place_r, place_c = np.searchsorted(rows, i), np.searchsorted(cols, j)
    out = np.zeros(len(i), np.float32)
    is_row, is_col = np.isin(owner, rows), np.isin(owner, cols)
    total = int(word.max()) + 1 if len(word) else 0
    for a in range(0, total, 2048):
        here = (word >= a) & (word < a + 2048)
        x, y = np.zeros((len(rows), 2048), np.float32), np.zeros((len(cols), 2048), np.float32)
        x[np.searchsorted(rows, owner[here & is_row]), word[here & is_row] - a] = 1
        y[np.searchsorted(cols, owner[here & is_col]), word[here & is_col] - a] = 1
        out += (x @ y.T)[place_r, place_c]
    return out.astype(np.int64)


def linked(sets: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, sig: np.ndarray | None = None, meet=None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two lists of rows (or within one), of those that ``meet`` (pairs: flags) lets in."""
    sig = signatures(sets, first) if sig is None else sig
    found, waiting, n = [], [], 0

    def verified() -> None:
        x, y = (np.concatenate(v) for v in zip(*waiting, strict=True))
        common = _common(sets, first, x, y)
        ok = common >= threshold * (first[x + 1] - first[x] + first[y + 1] - first[y] - common) - 1e-9
        found.append((x[ok], y[ok]))

    for i, j in _pruned(sig, left, right, np.diff(first), same, threshold, tolerance):
        if meet is not None:
            here = meet(i, j)
            i, j = i[here], j[here]
        waiting.append((i, j))
        n += len(i)
        if n > 1 << 20:
            verified()
            waiting, n = [], 0
    if n:
        verified()
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place linked with each place, through any number of links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(threshold: float, tolerance: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, copies, comp, side, band = (rows.column(c).to_numpy() for c in ("node", "copies", "comp", "side", "band"))
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        sets, first = shingles(rows.column("text"))
        sig = signatures(sets, first)
        bands = np.stack(rows.column("bands").to_numpy()) if len(rows) and band[0] >= 0 else None
        meet = None if bands is None else lambda i, j: (bands[i] == bands[j]).argmax(axis=1) == band[0]
        order = np.lexsort((node, comp))
        edges = np.flatnonzero(np.diff(comp[order], prepend=comp[order][:1] - 1)) if len(order) else []
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True) if len(order) else ():
            at = order[a:b]
            own = [at[side[at] == s] for s in (0, 1)]
            same = not len(own[1])
            i, j = linked(sets, first, own[0], own[0] if same else own[1], same, threshold, tolerance, sig, meet)
            if not len(i):
                continue
            count = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            some = np.flatnonzero(count)
            out.append(np.stack([np.zeros(len(some), np.int64), node[some], count[some].astype(np.int64)], 1))
            place = np.zeros(len(rows), np.int64)
            place[at] = np.arange(len(at))
            label = at[_stars(len(at), place[i], place[j])]
            away = at != label
            out.append(np.stack([np.ones(int(away.sum()), np.int64), node[at[away]], node[label[away]]], 1))
        x = np.concatenate(out)
        return pa.table({"kind": pa.array(x[:, 0].astype(np.int32)), "a": pa.array(x[:, 1]), "b": pa.array(x[:, 2])})

    return run


def _key() -> list[Column]:
    """What tells rows apart: the id (null as the least) and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("tag")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), F.col("text").cast("string").alias("text"))


def _representatives(sets: DataFrame) -> DataFrame:
    """One row for each word sequence: node (a number of its own), key and tag of its least text, copies, bands."""
    first = F.min(F.struct("key", "tag")).alias("first")
    reps = sets.where("n_shingles > 0").groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("copies"), F.min_by("bands", "key").alias("bands"), F.min("n_shingles").alias("n_shingles"))
    return reps.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.*", "copies", "bands", "n_shingles")


def _blocks(comps: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """(node, key, tag, copies, comp, task, side, band, bands): components of one block share a task by hash; of others
    the members of each bucket meet, dealt by pairs of blocks where a bucket has several."""
    met = comps.join(reps.select("node", "key", "tag", "copies", "bands", "n_shingles"), "node")
    of = lambda n, shingles_: F.ceil(F.greatest(F.col(n) / block, F.col(shingles_) / BLOCK_SHINGLES))
    sums = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("sum")).select(*by, "n", "sum", of("n", "sum").alias("blocks"))
    sizes = sums(met, "rep")
    most = sizes.agg(F.greatest(F.sum("sum") / BIN_SHINGLES, F.sum("n") / BIN)).first()[0]
    bins = int(most or 0) + 1
    met = met.join(sizes.select("rep", "blocks"), "rep")
    plain = ["node", "key", "tag", "copies", F.col("rep").alias("comp")]
    small = met.where("blocks = 1").select(*plain, F.concat(F.lit("b"), F.pmod(F.xxhash64("rep"), F.lit(bins)).cast("string")).alias("task"), F.lit(0).alias("side"), F.lit(-1).alias("band"), F.array().cast("array<bigint>").alias("bands"))
    large = met.where("blocks > 1").drop("blocks").withColumn("each", F.explode(F.transform("bands", lambda v, k: F.struct(k.alias("band"), v.alias("value"))))).select("*", "each.*").drop("each")
    large = large.join(sums(large, "rep", "band", "value").where("n > 1").select("rep", "band", "value", "blocks"), ["rep", "band", "value"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    named = lambda o: F.concat_ws(":", "rep", "band", "value", F.least(o, own), F.greatest(o, own))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(named(o).alias("task"), (own > o).cast("int").alias("side")))
    return small.unionByName(large.select(*plain, "band", "bands", F.inline(each)))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id (the least id of its group), n_links, n_shingles."""
    return _classes(docs, threshold, tolerance, block).select("doc_id", F.col("lead.key").alias("class_id"), "n_links", "n_shingles")


def _classes(docs: DataFrame, threshold: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """doc_id, key, tag, lead (key and tag of the least text of the group), n_links, n_shingles."""
    batches_by_bytes(docs.sparkSession)
    rows = _keyed(docs)
    sets = written(rows.mapInArrow(_sets, SETS))
    reps = written(_representatives(sets))
    banded = reps.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = banded.join(centres, "band").where("node != centre").select(F.col("node").alias("src"), F.col("centre").alias("dst"))
    dealt = written(_blocks(connected_components(ties), reps, block))
    asked = dealt.select("key", "tag").distinct().hint("merge")  # one plan at every size: what is asked for grows with the rows
    texts = rows.select("key", "tag", "text").join(asked, ["key", "tag"], "left_semi").groupBy("key", "tag").agg(F.first("text").alias("text"))  # a text is compared once, however often its row stands there
    found = written(dealt.join(texts, ["key", "tag"]).groupBy("task").applyInArrow(_compare(threshold, tolerance), LINKS))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    groups = connected_components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    leads = groups.join(reps.select("node", F.struct("key", "tag").alias("own")), "node").groupBy("rep").agg(F.min("own").alias("lead"))
    of_node = groups.join(leads, "rep").select("node", "lead").join(counts, "node", "left")
    of_set = reps.select("node", "h1", "h2", "copies", F.struct("key", "tag").alias("own")).join(of_node, "node", "left")
    of_set = of_set.select("h1", "h2", F.coalesce("lead", "own").alias("lead"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = sets.drop("bands").join(of_set, ["h1", "h2"], "left")
    alone = F.col("n_shingles") == 0
    return joined.select(
        "doc_id",
        "key",
        "tag",
        F.when(alone, F.struct("key", "tag")).otherwise(F.col("lead")).alias("lead"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One document of each group (links taken transitively): that with the least id, then the least hash of its text.

    Texts without words are groups of their own, equal ones under one id together. Of several rows of one id and text
    the least by the JSON of its other columns stays.
    """
    classes = _classes(docs.select("doc_id", "text"), threshold, tolerance)
    kept = written(classes.where(F.col("lead") == F.struct("key", "tag")).groupBy("key", "tag").agg(F.count(F.lit(1)).alias("n")))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    met = docs.select(*_key(), row.alias("row")).join(kept, ["key", "tag"])
    if not kept.where("n > 1").head():
        return met.select("row.*")
    other = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    once = met.where("n > 1").groupBy("key", "tag").agg(F.min_by("row", other).alias("row"))
    return met.where("n = 1").select("row.*").unionByName(once.select("row.*"))


def reference(docs: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """Plain all-pairs result for small inputs of distinct ids."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = {}
    for d, t in docs:
        w = word.findall((t or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()
    by: dict[tuple, list] = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    links: dict[int, set] = {d: set() for d in sets}
    for d, s in sets.items():
        shared: dict[int, int] = {}
        for x in s:
            for e in by[x]:
                shared[e] = shared.get(e, 0) + 1
        links[d] = {e for e, n in shared.items() if e != d and n >= threshold * (len(s) + len(sets[e]) - n) - 1e-9}
    group: dict[int, int] = {}
    for d in sorted(sets):
        stack = [d] if d not in group else []
        while stack:
            x = stack.pop()
            if x not in group:
                group[x] = d
                stack += links[x]
    return [(d, group[d], len(links[d]), len(sets[d])) for d, _ in docs]


QUERIES = {"op9_jaccard_join": op9}
ORACLES: dict[str, str] = {}
