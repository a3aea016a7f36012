"""Graph closures as rounds of joins: components, reachability, strong components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import partitions, written

#: So many pairs are no work to deal out: one task finds their components.
FEW = 100_000
#: So many written parts of a result are put together.
PARTS = 20


def _all_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Does every node have one edge to a lesser node that itself has none?"""
    ends = edges.select(*keys, F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(*keys, F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy(*keys, "node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").head(1)


def _with_least(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair with m, the least of u and its neighbours. A node's least is found by partial sums and joined back as one
    row, so AQE can split a hub's pairs over tasks; no node's pairs are held together."""
    least = pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    return pairs.join(least, [*keys, "u"]).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, keys).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    down = _with_least(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keys)
    return down.select(*keys, F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, rep) of every node of an edge, self-loops included; rep is the least node of its component.

    Alternates large-star and small-star until only stars to a least node are left; pairs that are counted to be few are
    done by one task, and so are those of any one key. Edges with a null end are dropped.
    """
    keys = list(keys)
    pairs = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    pairs = written(pairs.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if pairs.count() <= FEW:
        return _in_one_task(pairs, keys)
    return _by_keys(pairs, keys) if keys else _by_rounds(pairs, keys)


def _by_rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    nodes = pairs.select(*keys, F.col("u").alias("node")).unionByName(pairs.select(*keys, F.col("v").alias("node"))).distinct()
    star = pairs.where("u != v")
    while not _all_stars(star, keys):
        star = written(_small_star(_large_star(star, keys), keys))
    found = star.select(*keys, F.col("u").alias("node"), F.col("v").alias("rep"))
    return nodes.join(found, [*keys, "node"], "left").select(*keys, "node", F.coalesce("rep", "node").alias("rep"))


def components_of_parts(edges: DataFrame, src: str, dst: str, keys: Sequence[str]) -> DataFrame:
    """``connected_components`` for edges whose keys are known to be many and small, as the sources of programs are: dealt out
    by key as they are, neither made distinct nor counted as a whole before. Keys of many edges go by rounds. Edges are read
    twice: give written ones."""
    keys = list(keys)
    pairs = edges.select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u IS NOT NULL")
    few, wide = by_size(pairs, keys)
    parts = [tied(few, keys, "u", "v", both=True)] if few is not None else []
    return reduce(DataFrame.unionByName, [*parts, *([_by_rounds(written(wide.distinct()), keys)] if wide is not None else [])])


def by_size(rows: DataFrame, keys: list[str], each: Column | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys that are counted to have few, ten times ``FEW`` at most, and those of the others; None where there
    are none. A row counts for one, or for ``each``. Rows are read twice."""
    sizes = written(rows.groupBy(*keys).agg((F.count(F.lit(1)) if each is None else F.sum(each)).alias("n")))
    most, least = sizes.agg(F.max("n"), F.min("n")).first()
    if most is None or most <= 10 * FEW:
        return rows, None
    if least > 10 * FEW:
        return None, rows
    wide = F.broadcast(sizes.where(F.col("n") > 10 * FEW).select(*keys))  # each has so many rows that they are few
    return rows.join(wide, keys, "left_anti"), rows.join(wide, keys, "left_semi")


def _by_keys(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each key is a graph of its own: those of few pairs are dealt out by key, the others go by rounds."""
    few, wide = by_size(pairs, keys)
    parts = [tied(few, keys, "u", "v", both=True)] if few is not None else []
    return reduce(DataFrame.unionByName, [*parts, *([_by_rounds(wide, keys)] if wide is not None else [])])


def tied(rows: DataFrame, keys: list[str], u: str, v: str, both: bool = False) -> DataFrame:
    """(keys, node, rep) of every u, for keys of few rows: what shares a v is together, through any chain; with ``both``, v
    are nodes as well. A list of v stands for a row each, so that u and the keys travel once. Rows are dealt by key; a task
    holds a hundred thousand at a time, or those of one key."""
    dealt = rows.select(*keys, F.col(u).alias("u"), F.col(v).alias("v")).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if pa.types.is_list(batch.column("v").type):
                ties = batch.column("v")
                batch = batch.take(pc.list_parent_indices(ties)).set_column(batch.schema.get_field_index("v"), "v", pc.list_flatten(ties))
            if not batch.num_rows:
                continue
            last = pa.array([True] * batch.num_rows)
            for k in keys:
                end = batch.column(k)[-1]
                last = pc.and_(last, pc.fill_null(pc.equal(batch.column(k), end), False) if end.is_valid else pc.is_null(batch.column(k)))
            held, n, at = [*held, batch], n + batch.num_rows, n + last.false_count  # from there on is the last key, which may go on
            if last.false_count and at >= 100_000:
                whole = pa.Table.from_batches(held)
                yield from _least_of(whole.slice(0, at), keys, both)
                held, n = whole.slice(at).to_batches(), n - at
        if n:
            yield from _least_of(pa.Table.from_batches(held), keys, both)

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return dealt.mapInArrow(walk, ", ".join([*[f"{k} {kind(k)}" for k in keys], f"node {kind(u)}", f"rep {kind(u)}"]))


def _ranks(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Dense numbers of rows, in the order of their columns."""
    out = None
    for column in columns:
        column = pa.concat_arrays(column.chunks)
        for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
            if pa.types.is_string(part.type) and not part.null_count:  # equal texts are compared once
                part = part.dictionary_encode()
                place = np.empty(len(part.dictionary), np.int64)
                place[pc.array_sort_indices(part.dictionary).to_numpy()] = np.arange(len(place))
                rank = place[part.indices.to_numpy()]
            else:
                rank = pc.rank(part, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            out = rank if out is None else np.unique(out * (int(rank.max()) + 1) + rank, return_inverse=True)[1]
    return out


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Numbers of rows that tell equal ones, in no order: quicker than ranks."""
    out = 0
    for column in columns:
        column = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
        out = out * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out, return_inverse=True)[1]
    return out


def _least_of(rows: pa.Table, keys: list[str], both: bool) -> Iterator[pa.RecordBatch]:
    """Every node with the least one of its component: a root goes under the least root it meets, and paths are cut short."""
    twice = lambda c, d: pa.chunked_array([*c.chunks, *d.chunks], type=c.type) if both else c
    named, nodes = [twice(rows.column(k), rows.column(k)) for k in keys], twice(rows.column("u"), rows.column("v"))
    rank = _ranks([nodes])
    _, first, code = np.unique(_codes(named) * (int(rank.max()) + 1) + rank, return_index=True, return_inverse=True)
    if both:
        a, b, count = code[: rows.num_rows], code[rows.num_rows :], len(first)
    else:  # what ties comes after all nodes, so it is never the least
        ties, b = np.unique(_ranks([*named, rows.column("v")]), return_inverse=True)
        a, b, count = code, b + len(first), len(first) + len(ties)
    up = np.arange(count)
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := up[up], up):
            up = shorter
    found = [*[c.take(pa.array(first)) for c in named], nodes.take(pa.array(first)), nodes.take(pa.array(first[up[: len(first)]]))]
    yield from pa.table(found, names=[*keys, "node", "rep"]).combine_chunks().to_batches(max_chunksize=10_000)


def _in_one_task(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The components of counted, few pairs: every node points to one above it, and paths are halved on the way."""
    kind = pairs.schema["u"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, told, types = {}, {}, []

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            types = [f.type for f in batch.schema][: len(keys) + 1]
            columns = [batch.column(c).to_pylist() for c in (*keys, "u", "v")]
            for *key, u, v in zip(*columns, strict=True):
                ends = []
                for x in (u, v):
                    place = (*key, tuple(x.values()) if isinstance(x, dict) else x)
                    told.setdefault(place, x)
                    ends.append(top(up.setdefault(place, place)))
                up[max(ends)] = min(ends)
        if told:
            rows = [(*x[:-1], told[x], told[top(x)]) for x in told]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, types[-1]], strict=True)], [*keys, "node", "rep"])

    schema = ", ".join([*[f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys], f"node {kind}", f"rep {kind}"])
    return pairs.coalesce(1).mapInArrow(walk, schema)


def rep_from_groups(groups: DataFrame, members: str = "members", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, item, rep): every member of a list with the list's first member; empty lists give nothing."""
    first = F.element_at(members, 1)
    return groups.where(F.size(members) > 0).select(*keys, F.explode(members).alias("item"), first.alias("rep"))


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): roots and everything they lead to. Each round joins the last round's finds only, and writes only what it finds;
    edges are written once."""
    edges = written(edges.select("src", "dst"))
    front = written(roots.select("node").distinct())
    visited = [front]
    while front.head(1):
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(found.join(reduce(DataFrame.unionByName, visited), "node", "left_anti"))
        visited.append(front)
        if len(visited) > PARTS:
            visited = [visited[0], written(reduce(DataFrame.unionByName, visited[1:]))]
    return reduce(DataFrame.unionByName, visited)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends can lie on a cycle: repeatedly without those from sources and into sinks."""
    n = edges.count()
    while n:
        heads, tails = edges.select(F.col("dst").alias("v")).distinct(), edges.select(F.col("src").alias("v")).distinct()
        edges = written(edges.join(heads, edges["src"] == heads["v"], "left_semi").join(tails, edges["dst"] == tails["v"], "left_semi"))
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def _forward_min(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node from which each node is reached, itself included.

    A round takes the least colour of the nodes before, and then that colour's own colour, as what reaches a node that
    reaches this one reaches this one: colours travel as far again as they have come.
    """
    colour = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node"))
    while True:
        come = edges.join(colour, edges["src"] == colour["node"]).groupBy("dst").agg(F.min("colour").alias("c"))
        step = colour.join(come, colour["node"] == come["dst"], "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("near"), "colour")
        step = written(step)
        far = step.select(F.col("node").alias("near"), F.col("near").alias("_far"))
        step = written(step.join(far, "near").select("node", F.least("near", "_far").alias("now"), "colour"))
        colour = step.select("node", F.col("now").alias("colour"))
        if not step.where("now != colour").head(1):
            return colour


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, rep): least node of each node's strongly connected component; vertices without edges are not known here.

    Trims what lies on no cycle, gives every vertex the least vertex that reaches it, walks back from each colour's own
    vertex inside the colour: what it finds is one component each. Edges between colours go, the rest is done again, until
    the edges that are left are counted to be few, which one task does.
    """
    left = written(edges.select("src", "dst").distinct())
    nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
    found = []
    left = left.where("src != dst")
    while left.count() > FEW:
        left = _trimmed(left)
        if not left.head(1):
            break
        colour = _forward_min(left)
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2"))
        inside = written(left.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = reachable(colour.where("node = colour").select("node"), back)
        part = written(colour.join(reached, "node", "left_semi").select("node", F.col("colour").alias("rep")))
        found.append(part)
        done = part.select(F.col("node").alias("v"))
        left = written(inside.join(done, inside["src"] == done["v"], "left_anti").join(done, inside["dst"] == done["v"], "left_anti"))
    else:
        found.append(_strong_in_one_task(left))
    whole = reduce(DataFrame.unionByName, found) if found else nodes.select("node", F.col("node").alias("rep")).where("false")
    return nodes.join(whole, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))


def _strong_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, rep) for counted, few edges. Nodes are left in the order in which all they lead to is done; taken in the
    reverse of it, what leads to a node and belongs to none before is its component."""
    kind = edges.schema["src"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, behind, type_ = {}, {}, None
        for batch in batches:
            type_ = batch.schema.field("src").type
            for u, v in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                ahead.setdefault(u, []).append(v)
                behind.setdefault(v, []).append(u)
        seen, order = set(), []
        for start in [*ahead, *behind]:
            path = [] if start in seen else [(start, iter(ahead.get(start, ())))]
            seen.add(start)
            while path:
                node, rest = path[-1]
                if (to := next((x for x in rest if x not in seen), None)) is None:
                    order.append(path.pop()[0])
                else:
                    seen.add(to)
                    path.append((to, iter(ahead.get(to, ()))))
        of = {}
        for start in reversed(order):
            if start not in of:
                of[start], members = start, [start]
                for node in members:
                    fresh = [x for x in behind.get(node, ()) if x not in of]
                    of.update(dict.fromkeys(fresh, start))
                    members += dict.fromkeys(fresh)
                of.update(dict.fromkeys(members, min(members)))
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(of, type_), pa.array(of.values(), type_)], ["node", "rep"])

    return edges.coalesce(1).mapInArrow(walk, f"node {kind}, rep {kind}")


def component_edges(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct edges between different representatives."""
    a, b = reps.select(F.col("node").alias("src"), F.col("rep").alias("a")), reps.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
