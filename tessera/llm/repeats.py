"""Windows that repeat across a corpus: shared machinery of substring dedup over bytes (suffix order) and over words.

Every window of ``n`` symbols chooses the least hash of its inner k-mers, the leftmost on ties; consecutive windows
with the same choice form a run (a super-k-mer). Equal windows choose equal k-mers, so they meet in one bucket.

1. anchors   per Arrow batch, runs are cut; equal runs of a batch, found by hash and compared byte for byte, are
             combined (hot passages shrink to one run a batch before the shuffle) and only (48 hash bits, place)
             travels, packed, to the bucket
2. filter    a bucket keeps the runs whose k-mer occurs twice or more: a superset of all repeats
3. strings   documents meet their kept runs; each run travels to its bucket as one packed string
4. decide    the bucket puts the windows of a k-mer in order and finds those with an earlier equal window
5. apply     documents meet their decided windows

Documents are shuffled once: steps 3 and 5 read the same exchange. Groups of documents and buckets are dealt by bytes:
they grow in number, not in size. A k-mer with more than ``HOT`` kept runs is dealt anew by the hash of each single
window. Hashes only bring runs together: what goes is decided on strings. Rows of equal id and text are one document,
read once and given back as often as they stand there.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.runtime import partitions

HOT = 20_000
GROUP_BYTES, BUCKET_BYTES = 3 << 20, 32 << 20
NULL_ID = -(1 << 63)
ANCHOR, GONE, STRING = 0, 1, 2
ROWS = "place long, kind int, data binary"
ARROW_ROWS = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


@dataclass(frozen=True)
class Spec:
    """Windows of ``n`` symbols with minimisers of ``k``; ``words``: symbols are words, else bytes; ``other_doc``: only a smaller document counts as earlier."""

    n: int
    k: int
    words: bool
    other_doc: bool


@dataclass
class Symbols:
    """Symbols of some rows: a value for hashing each, the first index of each row, and how to cut a stretch as bytes."""

    values: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def symbols(column: pa.Array, words: bool) -> Symbols:
    data, offsets = ta.utf8(column)
    if not words:
        return Symbols(data.astype(ta.U64) + ta.U64(1), offsets, data, None, None)
    starts, ends, first = ta.word_spans(data, offsets, ta.NOT_SPACE)
    joined, at = ta.joined(data, starts, ends)
    return Symbols(ta.word_hash(data, starts, ends), first, joined, at, at + ends - starts)


def stretch(s: Symbols, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length in bytes of ``count`` symbols from ``first``."""
    if s.starts is None:
        return first, count
    begin = s.starts[first]
    return begin, s.ends[first + count - 1] - begin


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2s3sI", name.encode().ljust(2), a.dtype.str.encode().ljust(3), len(a)))
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<B", len(head)) + b"".join(head) + b"".join(body))


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out, at = raw[0], {}, 1 + 9 * raw[0]
    for i in range(n):
        name, kind, length = struct.unpack_from("<2s3sI", raw, 1 + 9 * i)
        kind = np.dtype(kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        out[name.decode().strip()] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += length * kind.itemsize
    return out


def packed_runs(docs: dict[str, np.ndarray], doc: np.ndarray, start: np.ndarray, windows: np.ndarray, **more: np.ndarray) -> bytes:
    """Runs with the documents they are in; runs are in order of document."""
    used, index = np.unique(doc, return_inverse=True)
    counts = np.bincount(index, minlength=len(used)).astype(np.uint32)
    return pack(i=docs["key"][used], t=docs["tag"][used], p=docs["part"][used], c=counts, s=np.diff(start.astype(np.uint32), prepend=np.uint32(0)), w=windows.astype(np.uint16), **more)


def unpacked_runs(data: bytes) -> dict[str, np.ndarray]:
    x = unpack(data)
    x["s"] = np.cumsum(x["s"], dtype=np.uint32)
    x["d"] = np.repeat(np.arange(len(x["c"])), x["c"])
    return x


def _join(payloads: list[bytes]) -> dict[str, np.ndarray] | None:
    """Payloads of one kind as one: documents are numbered through."""
    parts = [unpacked_runs(p) for p in payloads]
    if not parts:
        return None
    base = np.cumsum([0] + [len(p["i"]) for p in parts])
    for p, b in zip(parts, base, strict=False):
        p["d"] = p["d"] + b
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, key (a null id sorts first), tag (tells texts of one id apart), part (a group of documents), copies; and all bytes."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("key"), F.xxhash64("text").alias("tag"))
    counts = rows.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("text")).alias("bytes"))
    most, size = counts.agg(F.max("copies"), F.sum("bytes")).first()
    size = size or 0
    if (most or 0) > 1:
        rows = rows.groupBy("key", "tag").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    return rows.select("doc_id", "text", "key", "tag", F.pmod(F.xxhash64("key", "tag"), F.lit(size // GROUP_BYTES + 1)).alias("part"), "copies"), size


def _doc_arrays(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "tag", "part")}


def cut_runs(s: Symbols, spec: Spec) -> tuple[np.ndarray, ...]:
    """Runs of the rows: k-mer hash, row, first symbol in the row, windows, hash of the whole stretch."""
    lens = np.diff(s.first)
    total = int(s.first[-1])
    if total < spec.n:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
    least, place = ta.leftmost_min(ta.rolling(s.values, spec.k), spec.n - spec.k + 1)
    row = np.repeat(np.arange(len(lens)), lens)
    whole = np.arange(len(least)) <= (s.first[1:] - spec.n)[row[: len(least)]]
    windows = np.flatnonzero(whole)
    chosen = place[windows]
    begin = np.flatnonzero(np.diff(chosen, prepend=-1) != 0)
    count = np.diff(begin, append=len(windows))
    first = windows[begin]
    ends = first + count + spec.n - 1
    return least[first], row[first], first - s.first[row[first]], count, ta.span_hash(ta.prefix(s.values), first, ends)


def _anchors(spec: Spec, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = _doc_arrays(batch)
            order = np.lexsort((docs["tag"], docs["key"]))
            batch = batch.take(pa.array(order))
            docs = {k: v[order] for k, v in docs.items()}
            _, offsets = ta.utf8(batch.column("text"))
            found, data, base = [], [], 0
            for a, b in ta.chunks(offsets):
                s = symbols(batch.column("text").slice(a, b - a), spec.words)
                h, row, start, count, whole = cut_runs(s, spec)
                begin, length = stretch(s, s.first[row] + start, count + spec.n - 1)
                found.append((h, row + a, start, count, h ^ ta.mix(whole), begin + base, length))
                data.append(s.data)
                base += len(s.data)
            h, row, start, count, same, begin, length = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(same, kind="stable")  # rows are in order of document: the first of a class is the earliest
            head = np.diff(same[order], prepend=~same[order][:1]) != 0
            first = order[head][np.cumsum(head) - 1] if len(order) else order
            equal = head | (length[order] == length[first])
            check = np.flatnonzero(equal & ~head)
            equal[check] = ta.same_pieces(np.concatenate(data), begin[order[check]], begin[first[check]], length[order[check]])
            later_doc = docs["key"][row[order]] > docs["key"][row[first]]
            if spec.other_doc:
                later, stays = later_doc, ~later_doc  # repeats inside the first document share its fate, which is open
            else:
                later = later_doc | (docs["tag"][row[order]] != docs["tag"][row[first]]) | (start[order] > start[first])
                stays = head
            later, stays = later & equal, stays | ~equal  # unlike runs under one hash go on, each for itself
            yield from _emit(docs, row, start, count, np.sort(order[stays]), h, np.sort(order[later & ~head]), buckets)

    return run


def _emit(docs, row, start, count, stay, h, gone, buckets) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    bucket = (h[stay] % ta.U64(buckets)).astype(np.int64)
    for b, at in _slices(bucket):
        x = stay[at]
        bits = h[x] >> ta.U64(16)
        out.append((b, ANCHOR, packed_runs(docs, row[x], start[x], count[x], h=(bits >> ta.U64(16)).astype(np.uint32), l=(bits & ta.U64(0xFFFF)).astype(np.uint16))))
    for p, at in _slices(docs["part"][row[gone]]):
        x = gone[at]
        out.append((p % buckets, GONE, packed_runs(docs, row[x], start[x], count[x])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW_ROWS.types, strict=True)], schema=ARROW_ROWS)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that hold it, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
    for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True):
        yield int(keys[order[a]]), order[a:b]


def _table(out: list[tuple]) -> pa.Table:
    columns = zip(*out, strict=True) if out else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, ARROW_ROWS.types, strict=True)], schema=ARROW_ROWS)


def _kinds(rows: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for kind, data in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True):
        out.setdefault(kind, []).append(data)
    return out


def _regroup(payloads: list[bytes]) -> list[tuple]:
    """Decided runs, dealt to the groups of their documents."""
    x = _join(payloads)
    if x is None:
        return []
    return [(p, GONE, _subset(x, np.sort(at))) for p, at in _slices(x["p"][x["d"]])]


def _subset(x: dict, at: np.ndarray, **more: np.ndarray) -> bytes:
    at_docs = {"key": x["i"], "tag": x["t"], "part": x["p"]}
    order = np.argsort(x["d"][at], kind="stable")
    return packed_runs(at_docs, x["d"][at][order], x["s"][at][order], x["w"][at][order], **{k: v[order] for k, v in more.items()})


def _filter(rows: pa.Table) -> pa.Table:
    """A bucket's runs whose k-mer occurs twice; numbered by k-mer, hot ones marked."""
    bucket = rows.column("place")[0].as_py()
    kinds = _kinds(rows)
    out = _regroup(kinds.get(GONE, []))
    if x := _join(kinds.get(ANCHOR, [])):
        h = (x["h"].astype(np.uint64) << ta.U64(16)) | x["l"]
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]))
        sizes = np.diff(edges, append=len(h))
        size, group = np.repeat(sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
        kept = order[size > 1]
        gid = group[size > 1].astype(np.uint32)
        hot = (size[size > 1] > HOT).astype(np.uint8)
        for p, at in _slices(x["p"][x["d"][kept]]):
            out.append((p, STRING, _subset(x, kept[at], g=gid[at], f=hot[at], b=np.full(len(at), bucket, np.int64))))
    return _table(out)


def _doc_rows(docs: pa.Table) -> dict[tuple[int, int], int]:
    a = _doc_arrays(docs)
    return {k: i for i, k in enumerate(zip(a["key"].tolist(), a["tag"].tolist(), strict=True))}


def _strings(spec: Spec, buckets: int) -> Callable:
    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = _kinds(rows)
        out = [(p % buckets, GONE, data) for p, data in zip([docs.column("part")[0].as_py() if docs.num_rows else 0] * len(kinds.get(GONE, [])), kinds.get(GONE, []), strict=True)]
        if not (x := _join(kinds.get(STRING, []))):
            return _table(out)
        where = _doc_rows(docs)
        doc_row = np.array([where[k] for k in zip(x["i"].tolist(), x["t"].tolist(), strict=True)], np.int64)
        of_run = doc_row[x["d"]]
        _, offsets = ta.utf8(docs.column("text"))
        text = docs.column("text").combine_chunks()
        found: dict[int, list] = {}
        for a, b in ta.chunks(offsets):
            at = np.flatnonzero((of_run >= a) & (of_run < b))
            if len(at):
                s = symbols(text.slice(a, b - a), spec.words)
                _cut_strings(spec, s, x, at, s.first[of_run[at] - a], buckets, found)
        docs_of = {"key": x["i"], "tag": x["t"], "part": x["p"]}
        for bucket, parts in found.items():
            d, st, w, g, length, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(d, kind="stable")
            before = np.cumsum(length) - length
            raw = ta.gather(raw, before[order], length[order])
            out.append((bucket, STRING, packed_runs(docs_of, d[order], st[order], w[order], g=g[order], n=length[order].astype(np.uint32), r=raw)))
        return _table(out)

    return run


def _cut_strings(spec: Spec, s: Symbols, x: dict, at: np.ndarray, base: np.ndarray, buckets: int, found: dict) -> None:
    """Packed strings of the runs ``at`` by bucket; hot runs as single windows by their own hash."""
    hot = x["f"][at] == 1
    plain = at[~hot]
    groups = [(plain, base[~hot], x["s"][plain].astype(np.int64), x["w"][plain].astype(np.int64), x["g"][plain], x["b"][plain])]
    if hot.any():
        runs, width = at[hot], x["w"][at[hot]].astype(np.int64)
        each = np.repeat(runs, width)
        start = x["s"][each].astype(np.int64) + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
        first = np.repeat(base[hot], width)
        h = ta.span_hash(ta.prefix(s.values), first + start, first + start + spec.n)
        gid = ((h >> ta.U64(33)).astype(np.uint32)) | np.uint32(1 << 31)
        groups.append((each, first, start, np.ones(len(each), np.int64), gid, (h % ta.U64(buckets)).astype(np.int64)))
    for runs, first, start, width, gid, bucket in groups:
        begin, length = stretch(s, first + start, width + spec.n - 1)
        for b, i in _slices(bucket):
            found.setdefault(b, []).append((x["d"][runs[i]], start[i], width[i], gid[i], length[i], ta.gather(s.data, begin[i], length[i])))


def _decide(spec: Spec, order_windows: Callable) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        kinds = _kinds(rows)
        out = _regroup(kinds.get(GONE, []))
        x = _join(kinds.get(STRING, []))
        if x is None:
            return _table(out)
        key, tag = x["i"][x["d"]], x["t"][x["d"]]
        order = np.lexsort((x["s"], tag, key, x["g"]))
        end = np.cumsum(x["n"], dtype=np.int64)
        raw = x["r"].tobytes()
        groups, keys, tags, starts = x["g"][order].tolist(), key[order].tolist(), tag[order].tolist(), x["s"][order].tolist()
        ends, lengths, widths = end[order].tolist(), x["n"][order].tolist(), x["w"][order].tolist()
        gone_run: list[int] = []
        gone_start: list[int] = []
        gone_width: list[int] = []
        i, n = 0, len(groups)
        while i < n:
            g, seen = groups[i], {}
            while i < n and groups[i] == g:
                text = raw[ends[i] - lengths[i] : ends[i]]
                f = seen.setdefault(text, i)
                if f != i and (keys[i] != keys[f] if spec.other_doc else (keys[i], tags[i], starts[i]) != (keys[f], tags[f], starts[f])):
                    gone_run.append(i)
                    gone_start.append(starts[i])
                    gone_width.append(widths[i])
                elif f != i and spec.other_doc:
                    seen[text, i] = i  # a repeat inside the first document: decided by the windows of other strings
                i += 1
            if len(seen) > 1:
                runs = [(t if isinstance(t, bytes) else t[0], r) for t, r in seen.items()]
                places = {r: (keys[r],) if spec.other_doc else (keys[r], tags[r], starts[r]) for _, r in runs}
                for r, off in order_windows(runs, places, widths):
                    gone_run.append(r)
                    gone_start.append(starts[r] + off)
                    gone_width.append(1)
        if gone_run:
            at = order[np.array(gone_run)]
            y = {"i": x["i"], "t": x["t"], "p": x["p"], "d": x["d"][at], "s": np.array(gone_start, np.uint32), "w": np.array(gone_width, np.uint16)}
            by = np.lexsort((y["s"], y["d"]))
            y |= {k: y[k][by] for k in ("d", "s", "w")}
            out += [(p, GONE, _subset(y, np.sort(i))) for p, i in _slices(y["p"][y["d"]])]
        return _table(out)

    return run


def covered(rows: pa.Table, docs: pa.Table, first: np.ndarray, n: int) -> np.ndarray:
    """Flags of the symbols that a decided window covers."""
    step = np.zeros(int(first[-1]) + 1, np.int32)
    x = _join(_kinds(rows).get(GONE, []))
    if x is not None:
        where = _doc_rows(docs)
        at = np.array([where[k] for k in zip(x["i"].tolist(), x["t"].tolist(), strict=True)], np.int64)[x["d"]]
        begin = first[at] + x["s"]
        np.add.at(step, begin, 1)
        np.add.at(step, begin + x["w"] + (n - 1), -1)
    return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame, spec: Spec, order_windows: Callable, apply: Callable, schema: str) -> DataFrame:
    """``apply(docs of a group, its decided runs)`` over all documents; its last column is that of their copies."""
    rows, size = keyed(docs)
    buckets = max(8 * partitions(docs.sparkSession), size // BUCKET_BYTES)
    anchors = rows.select("key", "tag", "part", "text").mapInArrow(_anchors(spec, buckets), ROWS)
    kept = anchors.groupBy("place").applyInArrow(_filter, ROWS)
    by_part = lambda: rows.groupBy("part")
    strings = by_part().cogroup(kept.groupBy("place")).applyInArrow(_strings(spec, buckets), ROWS)
    decided = strings.groupBy("place").applyInArrow(_decide(spec, order_windows), ROWS)
    applied = by_part().cogroup(decided.groupBy("place")).applyInArrow(apply, schema + ", copies long")
    every = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return applied.withColumn("copies", every).drop("copies")
