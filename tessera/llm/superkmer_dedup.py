"""Substring dedup over words: super-k-mer partitioning.

Windows of ``n`` words; consecutive windows that share a minimiser travel as one packed string to the minimiser's
bucket (see ``repeats``), where sorting brings equal windows together and counts them exactly. A word goes when a
window that covers it also starts in a document with a smaller id.

Defined results: null and empty texts have no words; a null doc_id counts as the smallest; repeats inside one document
and rows of equal id do not remove each other; other columns are not read. A single text is held whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import repeats as rp
from tessera.runtime import table

N, K = 13, 5
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
ARROW_COPIES = ARROW.append(pa.field("copies", pa.int64()))


def counted(windows: list[tuple]) -> list[tuple]:
    """(window, places) with every distinct window once, by sorting (window, place) pairs."""
    windows.sort()
    out: list[tuple] = []
    for text, *place in windows:
        if not out or out[-1][0] != text:
            out.append((text, []))
        out[-1][1].append(place)
    return out


def _order_windows(n: int):
    def run(runs: list[tuple], places: dict, widths: list[int]) -> list[tuple]:
        windows = []
        for text, r in runs:
            words = text.split(b" ")
            windows += [(b" ".join(words[i : i + n]), places[r][0], r, i) for i in range(widths[r])]
        return [(r, i) for _, found in counted(windows) for doc, r, i in found if doc != found[0][0]]

    return run


def _apply(n: int, keep: bool):
    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ARROW_COPIES.empty_table()
        s = rp.symbols(docs.column("text"), True)
        gone = rp.covered(rows, docs, s.first, n)
        out = []
        for i, (doc, copies) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("copies").to_pylist(), strict=True)):
            a, b = int(s.first[i]), int(s.first[i + 1])
            flags = gone[a:b]
            if a == b:
                left = b""
            elif flags.any():
                left = b" ".join(s.data[s.starts[w] : s.ends[w]].tobytes() for w in (np.flatnonzero(~flags) + a).tolist())
            else:
                left = s.data[s.starts[a] : s.ends[b - 1]].tobytes()
            out.append((doc, b - a, int(flags.sum()), hashlib.sha256(left).hexdigest(), left.decode() if keep else None, copies))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW_COPIES.types, strict=True)], schema=ARROW_COPIES)

    return run


def superkmer_dedup(docs: DataFrame, n: int = N, k: int = K, keep: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, digest and, with ``keep``, the words that stay, joined by one space."""
    return rp.repeats(docs, rp.Spec(n, k, True, True), _order_windows(n), _apply(n, keep), SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False).drop("kept")


def reference(docs: list[tuple], n: int = N) -> list[tuple]:
    """Plain result for small inputs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    least: dict[tuple, int] = {}
    parts = [(d, word.findall(t or "")) for d, t in docs]
    for d, w in parts:
        for i in range(len(w) - n + 1):
            s = tuple(w[i : i + n])
            least[s] = min(d, least.get(s, d))
    out = []
    for d, w in parts:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS p FROM m WHERE least < doc_id),
e AS (SELECT r, p, x FROM (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM w)),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""

QUERIES = {"op6_superkmer_dedup": op6}
ORACLES = {"op6_superkmer_dedup": SQL}
