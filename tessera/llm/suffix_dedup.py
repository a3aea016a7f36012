"""Suffix-array dedup: later copies of long byte strings go, the first stays.

A byte goes when a string of ``n`` bytes that covers it also starts earlier: in a smaller document, or earlier in the
same one. With the longest previous factor LPF[i] of each place (the longest string at i that also starts earlier)
that is: bytes i to i + n - 1 go when LPF[i] >= n. LPF comes from suffix order: the earlier match of place i is the
previous or the next smaller place in that order. Only the comparison with ``n`` matters, so suffixes are cut at n
bytes, and suffixes are only put in order against those that share their minimising k-mer (see ``repeats``), as no
others can agree on n bytes: the suffix array is a set of small ones, spread over the cluster.

Defined results: null and empty texts have no bytes; a null doc_id counts as the smallest; rows with equal id and text
are one place and do not remove each other; texts of one id are told apart by their hash; other columns are not read.
Working memory is a bucket of strings, or a group of about 3 MB of documents; a single text is held whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import repeats as rp
from tessera.llm import textarrays as ta
from tessera.runtime import table

N, K = 100, 40
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
ARROW_COPIES = ARROW.append(pa.field("copies", pa.int64()))


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings of one length have in common at their start."""
    if a == b:
        return len(a)
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def previous_factors(suffixes: list[tuple]) -> list[int]:
    """The longest previous factor of every suffix, in suffix order: what it has in common with the previous or the next
    smaller place in that order, whichever is more. One pass with a stack of rising places."""
    found, stack, n = [0] * len(suffixes), [], len(suffixes)
    for i in range(n + 1):
        shared = common(suffixes[i - 1][0], suffixes[i][0]) if 0 < i < n else 0
        while stack and (i == n or suffixes[i][1] < suffixes[stack[-1][0]][1]):
            j, before = stack.pop()
            found[j] = max(before, shared)
            shared = min(before, shared)
        stack.append((i, shared))
    return found


def earlier_matches(suffixes: list[tuple], n: int) -> list[tuple]:
    """(run, offset) of the suffixes whose longest previous factor reaches ``n``; each is (bytes cut at n, place, run, offset)."""
    suffixes.sort(key=lambda x: x[:2])
    return [s[2:] for s, reach in zip(suffixes, previous_factors(suffixes), strict=True) if reach >= n]


def _order_windows(n: int):
    def run(runs: list[tuple], places: dict, widths: list[int]) -> list[tuple]:
        suffixes = [(text[i : i + n], (*places[r][:2], places[r][2] + i), r, i) for text, r in runs for i in range(widths[r])]
        return earlier_matches(suffixes, n)

    return run


def _apply(n: int, keep: bool):
    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ARROW_COPIES.empty_table()
        data, first = ta.utf8(docs.column("text"))
        gone = rp.covered(rows, docs, first, n)
        out = []
        for i, (doc, copies) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("copies").to_pylist(), strict=True)):
            a, b = int(first[i]), int(first[i + 1])
            flags = gone[a:b]
            left = data[a:b][~flags].tobytes()
            spans = int(flags[:1].sum()) + int(np.count_nonzero(flags[1:] & ~flags[:-1]))
            out.append((doc, b - a, int(flags.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep else None, copies))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW_COPIES.types, strict=True)], schema=ARROW_COPIES)

    return run


def suffix_dedup(docs: DataFrame, n: int = N, k: int = K, keep: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, digest and, with ``keep``, the bytes that stay."""
    return rp.repeats(docs, rp.Spec(n, k, False, False), _order_windows(n), _apply(n, keep), SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False).drop("kept")


def reference(docs: list[tuple], n: int = N) -> list[tuple]:
    """Plain result for small inputs of distinct ids: a set of the strings seen so far."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - n + 1):
            s = data[i : i + n]
            if s in seen:
                gone[i : i + n] = [True] * n
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = (doc, len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return [out[d] for d, _ in docs]


QUERIES = {"op3_suffix_dedup": op3}
ORACLES: dict[str, str] = {}
