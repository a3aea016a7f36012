"""Benchmark decontamination: a broadcast hash set of normalised test n-grams meets the windows of training texts.

Words are runs of letters and digits (A-Z lower-cased, all of non-ASCII kept). A benchmark item gives every window of
``n`` consecutive words; an item of fewer words, but not none, is one window. The windows are split into blocks whose
summed bytes are checked against a bound before they are collected and broadcast; with more than one block the texts
are scanned once for each, so nothing broadcast grows with the benchmark. A hash hit is compared word for word.

Defined results: null or empty texts have no words and are never hit; null or empty items have no windows; equal items
count by their distinct ids; items with a null id are known as "null"; repeated documents are judged one by one;
columns that the operator does not read pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql import types as T

from tessera.llm import textarrays as ta
from tessera.runtime import batches_by_bytes, table, written

N = 10
BLOCK_BYTES = 64 << 20

WINDOWS = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("item", T.StringType())])
FOUND = "struct<n_words:bigint,hits:array<int>,items:array<string>,spans:array<array<int>>>"
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32())))])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = ta.utf8(column)
    data = ta.lower_ascii(data)
    starts, ends, first = ta.word_spans(data, offsets, ta.ALNUM)
    hashes = ta.word_hash(data, starts, ends)
    return data, offsets, starts, ends, first, hashes


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _, starts, ends, first, hashes = _words(batch.column("text"))
            out = {"hash": [], "n_words": [], "words": [], "item": []}
            for row, item in enumerate(batch.column("item").to_pylist()):
                a, b = int(first[row]), int(first[row + 1])
                size = min(n, b - a)
                if not size:
                    continue
                rolled = ta.rolling(hashes[a:b], size).view(np.int64)
                for i in range(a, b - size + 1):
                    out["hash"].append(int(rolled[i - a]))
                    out["n_words"].append(size)
                    out["words"].append(b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size], strict=True)))
                    out["item"].append(item)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("hash", pa.int64()), ("n_words", pa.int32()), ("words", pa.binary()), ("item", pa.string())]))

    return run


def windows(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item) rows of the benchmark."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_item_windows(n), WINDOWS).distinct()


class _Block:
    """Windows of one block: by number of words, a sorted hash array and the exact words with their items."""

    def __init__(self, rows: list) -> None:
        self.exact: dict[bytes, list[str]] = {}
        by: dict[int, set[int]] = {}
        for r in rows:
            by.setdefault(r["n_words"], set()).add(r["hash"])
            self.exact.setdefault(bytes(r["words"]), []).append(r["item"])
        self.hashes = {size: np.sort(np.array(sorted(found), np.int64).view(np.uint64)) for size, found in sorted(by.items())}

    def flags(self, size: int) -> np.ndarray:
        """A bitmap over the low 20 bits: turns most windows away before the exact search."""
        out = np.zeros(1 << 20, bool)
        out[(self.hashes[size] & ta.U64((1 << 20) - 1)).astype(np.int64)] = True
        return out


def _scan(block_var):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        block: _Block = block_var.value
        flags = {size: block.flags(size) for size in block.hashes}
        for column, earlier in columns:
            _, offsets = ta.utf8(column)
            rows = [x for a, b in ta.chunks(offsets) for x in _scan_chunk(block, flags, column.slice(a, b - a), earlier.slice(a, b - a).to_pylist())]
            yield pa.array(rows, FOUND_ARROW)

    return run


def _scan_chunk(block: _Block, flags: dict, column: pa.Array, found: list) -> list[dict]:
    data, offsets, starts, ends, first, hashes = _words(column)
    hits: dict[int, set[int]] = {}
    items: dict[int, set[str]] = {}
    for size, known in block.hashes.items():
        rolled = ta.rolling(hashes, size)
        at = np.flatnonzero(flags[size][(rolled & ta.U64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, rolled[at]), len(known) - 1)
        at = at[known[place] == rolled[at]]
        row = np.searchsorted(first, at, "right") - 1
        within = at + size <= first[row + 1]
        for i, r in zip(at[within].tolist(), row[within].tolist(), strict=True):
            words = b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size], strict=True))
            if words in block.exact:
                hits.setdefault(r, set()).update(range(i - int(first[r]), i - int(first[r]) + size))
                items.setdefault(r, set()).update(block.exact[words])
    out = []
    for r, before in enumerate(found):
        base = int(first[r])
        h, names = hits.get(r, set()), items.get(r, set())
        if before:
            h, names = h | set(before["hits"]), names | set(before["items"])
        h = sorted(h)
        out.append({"n_words": int(first[r + 1]) - base, "hits": h, "items": sorted(names), "spans": _runs(data, offsets[r], starts[base:], ends[base:], h)})
    return out


def _runs(data: np.ndarray, begin: int, starts: np.ndarray, ends: np.ndarray, hits: list[int]) -> list[list[int]]:
    """Runs of hit words as [start, end) in code points of the text."""
    out: list[list[int]] = []
    if not hits:
        return out
    points = np.cumsum((data[begin : ends[hits[-1]]] & 0xC0) != 0x80)
    at = lambda k: int(points[k - begin - 1]) if k > begin else 0
    last = None
    for w in hits:
        if last is not None and w == last + 1:
            out[-1][1] = at(int(ends[w]))
        else:
            out.append([at(int(starts[w])), at(int(ends[w]))])
        last = w
    return out


def _blocks(rows: DataFrame, bound: int) -> Iterator[tuple[list, bool]]:
    """Blocks of windows, and whether each is the last."""
    size = rows.agg(F.sum(F.length("words") + F.length("item") + 64)).first()[0] or 0
    n = max(1, -(-size // bound))
    rows = rows if n == 1 else written(rows)
    for b in range(n):
        kept = rows if n == 1 else rows.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == b)
        yield kept.collect(), b == n - 1  # at most about ``bound`` bytes, by the sum above


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", bound: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the document's own columns) and ``found``: n_words, hit word indexes, items, spans of hit runs in code points.

    Only texts go to Python. With several blocks of windows the rows and what was found are written after each but the
    last, and its broadcast goes, so that tasks and driver hold one block at a time however large the benchmark is.
    """
    spark = docs.sparkSession
    batches_by_bytes(spark)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.lit(None).cast(FOUND).alias("found"))
    for block, last in _blocks(windows(benchmark, n), bound):
        shared = spark.sparkContext.broadcast(_Block(block))
        found = F.arrow_udf(_scan(shared), FOUND, ArrowUDFType.SCALAR_ITER)(F.col(f"row.`{text_col}`"), F.col("found"))
        rows = rows.select("row", found.alias("found"))
        if not last:
            rows = written(rows)
            shared.destroy()
    return rows


def clean(scanned: DataFrame, columns: list[str], mode: str = "document", text_col: str = "text") -> DataFrame:
    """The documents without contaminated ones (``document``), or with their hit spans cut out (``span``)."""
    if mode == "document":
        return scanned.where(F.size("found.hits") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    if mode != "span":
        raise ValueError(f"mode {mode}")
    text = F.col(f"row.`{text_col}`")
    ends = F.concat(F.transform("found.spans", lambda s: s[0]), F.array(F.length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform("found.spans", lambda s: s[1]))
    kept = F.concat_ws("", F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, e - b)))
    kept = F.when(F.size("found.spans") == 0, text).otherwise(kept)
    return scanned.select(*[(kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns])


def _digest(scanned: DataFrame) -> DataFrame:
    n_hit = F.size("found.hits").cast("long")
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(scan(docs, table(spark, sf_dir, "benchmark")))


def reference(docs: list[tuple], items: list[tuple], n: int = N) -> list[tuple]:
    """Plain count of the same result, for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower().decode())
    wins: dict[tuple, set[str]] = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    names |= wins[x]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, sizes WHERE len(w) >= n)),
h AS (SELECT r, dw.n, i, item FROM dw JOIN bw USING (s, n)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

QUERIES = {"op1_decontaminate": op1}
ORACLES = {"op1_decontaminate": SQL}
