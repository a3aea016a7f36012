"""Conversation repair: the cheapest edits that make turns alternate, by dynamic programming shared along a prefix trie.

A turn is one sign of its conversation's signature: its role's initial (s, u, a; o for any other) in lower case, in upper
case if its text is truncated, or d if it must go (blank, or said before). The cheapest edits depend on the signature only.
Signatures are dealt in ranges of their order, so that those with a common prefix stand side by side; a task walks its
sorted signatures as one walks a trie, keeps a layer of costs for each sign of the branch it is on, goes back to where the
next signature leaves the branch, and answers where a signature ends.

Edits: K keep, R give the role that is due (user or assistant), D delete, I insert an empty turn of the role that is due.
The order of roles is an optional system turn, then pairs of user and assistant; so an edit sequence fixes its roles.

Defined results: a null role or text is one space, rows of one turn are ordered by role and SHA-256 of their text, null
turns first; repeated rows are duplicates of each other; rows with a null conv_id are one conversation; an empty table
gives none; other columns are not read. Texts travel once and are never held together: a task sees a conversation's turns
one after the other, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.spelling import CRC_TABLE, crc_sql
from tessera.runtime import batches_by_bytes, partitions, table, written

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Places in the order of roles: nothing yet, after system, after user, after assistant. role due next, and where each role leads.
DUE = ("u", "u", "a", "u")
TO = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FAR, IDLE = 1 << 40, 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, initial, and fault (blank, truncated or none; duplicates are found later)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def signatures(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature; texts stay behind. ``every`` (conv_id) names
    conversations that are told also when no row is theirs."""
    rows = rows.select("conv_id", "turn", "role", "digest", "initial", "fault", F.lit(True).alias("real"))
    if every is not None:
        ghosts = every.distinct().select("conv_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "initial", "fault")], F.lit(False).alias("real"))
        rows = rows.unionByName(ghosts)
    order = Window.partitionBy("conv_id", "real").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    said = Window.partitionBy("conv_id", "real", "role", "digest").orderBy("pos")
    rows = rows.repartition(partitions(rows.sparkSession), "conv_id")  # one exchange for both windows and the aggregation
    rows = rows.select("*", F.row_number().over(order).alias("pos"), F.lag("initial").over(order).alias("before"), F.lag("turn").over(order).alias("last"))
    rows = rows.withColumn("fault", F.when(F.col("fault") == "blank", "blank").when(F.row_number().over(said) > 1, "duplicate").otherwise(F.col("fault")))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    count = lambda c: F.count_if(F.col("real") & c)
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last"))
    each = F.array_sort(F.collect_list(F.when(F.col("real"), F.struct("pos", sign.alias("sign")))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(new), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count((F.col("pos") > 1) & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.array_join(F.transform(each, lambda x: x["sign"]), "").alias("signature"),
    )


class Branch:
    """The branch of the trie that ends at the last signature: a layer of costs for each of its signs.

    A layer has the least cost of standing at each place of the role order, insertions included, told from the layer's
    least on. A place more than ``IDLE`` above the least is on no cheapest way, as the others can do what it can for 3 more
    at most; so there are few different layers, and a long branch holds a number and a reference a sign.
    """

    def __init__(self):
        self.signs, self.known = "", {}
        self.layers = [(0, self.closed([0, FAR, FAR, FAR]))]

    @staticmethod
    def closed(costs: list) -> tuple:
        """Costs with insertions: each leads to the place after the role that is due."""
        for _ in range(3):
            for place in range(4):
                to = TO[place][DUE[place]]
                costs[to] = min(costs[to], costs[place] + INSERT)
        return tuple(c if c <= IDLE else FAR for c in costs)

    @staticmethod
    def moves(sign: str) -> Iterator[tuple[int, str, int, int]]:
        """(place, edit, place after, cost) for a turn of this sign."""
        for place in range(4):
            yield place, "D", place, DELETE
            if sign != "d":
                late = TRUNCATED if sign.isupper() else 0
                if sign.lower() in TO[place]:
                    yield place, "K", TO[place][sign.lower()], KEEP + late
                yield place, "R", TO[place][DUE[place]], REROLE + late

    def step(self, layer: tuple, sign: str) -> tuple[int, tuple]:
        """What the least cost grows by with the sign, and the layer behind it."""
        if (layer, sign) not in self.known:
            costs = [FAR] * 4
            for place, _, to, cost in self.moves(sign):
                costs[to] = min(costs[to], layer[place] + cost)
            self.known[layer, sign] = min(costs), self.closed([c - min(costs) for c in costs])
        return self.known[layer, sign]

    def follow(self, signs: str) -> None:
        """Go back to where the signature leaves the branch, and add a layer for each of its further signs."""
        shared, most = 0, min(len(signs), len(self.signs))
        while shared < most and signs[shared] == self.signs[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for sign in signs[shared:]:
            total, layer = self.layers[-1]
            grown, layer = self.step(layer, sign)
            self.layers.append((total + grown, layer))
        self.signs = signs

    def edits(self, k: int, place: int) -> Iterator[tuple[str, int, int]]:
        """(edit, layer, place) of the edits from a place of a layer that cost no more than need be."""
        total, layer = self.layers[k]
        to = TO[place][DUE[place]]
        if layer[place] + INSERT == layer[to]:
            yield "I", k, to
        if k < len(self.signs):
            beyond, then = self.layers[k + 1]
            for at, edit, to, cost in self.moves(self.signs[k]):
                if at == place and total + layer[place] + cost == beyond + then[to]:
                    yield edit, k + 1, to

    def answer(self) -> tuple[int, str]:
        """Cost and edits of the signature at the branch's end: from the end back, which places lie on a cheapest way;
        then forth along these, by the least edit in ASCII order."""
        n = len(self.signs)
        total, layer = self.layers[n]
        least = min(layer[p] for p in FINAL)
        cheap: set = {(n, p) for p in FINAL if layer[p] == least}
        for k in range(n, -1, -1):
            for _ in range(3):  # insertions stay in a layer
                cheap.update((k, p) for p in range(4) if self.layers[k][1][p] < FAR and any(e[1:] in cheap for e in self.edits(k, p)))
        k, at, out = 0, 0, []
        while not (k == n and at in FINAL and layer[at] == least):
            edit, k, at = min(e for e in self.edits(k, at) if e[1:] in cheap)
            out.append(edit)
        return total + least, "".join(out)


def plans(found: DataFrame) -> DataFrame:
    """The conversations with cost and audit: signatures in ranges, hot ones over several tasks, each task along its trie."""
    found = written(found)
    dealt = found.repartitionByRange(partitions(found.sparkSession), "signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, last, answer = Branch(), None, None
        for batch in batches:
            costs, audits = [], []
            for signs in batch.column("signature").to_pylist():
                if signs != last:
                    branch.follow(signs)
                    last, answer = signs, branch.answer()
                costs.append(answer[0])
                audits.append(answer[1])
            kept = [batch.column(c) for c in batch.schema.names if c != "signature"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*[c for c in batch.schema.names if c != "signature"], "cost", "audit"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "signature"]
    return dealt.mapInArrow(walk, ", ".join([*kept, "cost long", "audit string"]))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text) of what is left after the edits, conversation by conversation, each in order.

    Every conversation of ``audits`` has a row without an edit before its turns. Rows of a conversation stand together,
    so what follows them can read them one by one.
    """
    spark = rows.sparkSession
    batches_by_bytes(spark)
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    both = first.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest"))
    dealt = both.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    key = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place = "", 0, 0

        def ahead(out: list, conv) -> int:
            """Write the inserted turns that come next."""
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                due = DUE[place]
                out.append((conv, "I", ROLES[due], ""))
                at, place = at + 1, TO[place][due]
            return at

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")]
            for conv, kind, role, text in zip(*columns, strict=True):
                if kind == 0:
                    audit, at, place = text, 0, 0
                    out.append((conv, None, None, None))
                    ahead(out, conv)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    due = role[:1] if edit == "K" else DUE[place]
                    out.append((conv, edit, role if edit == "K" else ROLES[due], text))
                    place = TO[place][due]
                ahead(out, conv)
            values = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(values[0], batch.column("conv_id").type), *[pa.array(v, pa.string()) for v in values[1:]]], ["conv_id", "edit", "role", "text"])

    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(walk, f"conv_id {key}, edit string, role string, text string")


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that stand together, as ``repaired`` gives them: role and text with a colon, lines by breaks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, lines = None, None, 0
        for batch in batches:
            done = []
            for c, edit, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "edit", "role", "text")], strict=True):
                if edit is None:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h, lines = c, hashlib.sha256(), 0
                    continue
                h.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            kind = batch.column("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done], pa.string())], ["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return edited.mapInArrow(walk, f"conv_id {edited.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without sentence ends, repeated, or said by the user, by the checksum of their place."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(spelled("text"), "[.!?]", "")).otherwise(spelled("text"))
    row = F.struct("conv_id", "turn", F.when(way == 4, "user").otherwise(spelled("role")).alias("role"), text.alias("text"))
    return conversations.select(F.inline(F.when(way == 0, F.array().cast(f"array<{_type(conversations)}>")).when(way == 3, F.array(row, row)).otherwise(F.array(row))))


def _type(conversations: DataFrame) -> str:
    kind = lambda c: conversations.schema[c].dataType.simpleString()
    return f"struct<conv_id:{kind('conv_id')},turn:{kind('turn')},role:string,text:string>"


def repair(conversations: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the turns left after the edits."""
    rows = turns(conversations)
    audits = written(plans(signatures(rows, every)))
    return audits, repaired(rows, audits)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    audits, edited = repair(damaged(source), source.select("conv_id"))
    both = audits.join(digests(edited).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _values(rows) -> str:
    return ", ".join(str(r) for r in rows)


_MOVES = _values((sign, *m) for sign in "suaoSUAOd" for m in Branch.moves(sign))
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql('s')} % 20 AS way FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations), tab),
dmg AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) FROM c WHERE way != 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept, substr(role, 1, 1) AS ini FROM dmg),
flt AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS two, CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM num),
sgn AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(cls) ELSE cls END AS sign FROM (SELECT *, CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END AS cls FROM flt)),
conv AS (SELECT k.conv_id, count(s.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sgn s ON s.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
mv(sign, place, edit, goal, cost) AS (VALUES {_MOVES}),
ins(place, goal, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, goal AS place, ins.cost, edits AS audit FROM conv, ins WHERE place = 0
  UNION ALL SELECT conv_id, pos, place, cost, audit FROM (SELECT d.conv_id, d.pos + 1 AS pos, ins.goal AS place, d.cost + mv.cost + ins.cost AS cost, d.audit || edit || edits AS audit
    FROM dp d JOIN sgn s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.pos = d.pos + 1 JOIN mv ON mv.sign = s.sign AND mv.place = d.place JOIN ins ON ins.place = mv.goal)
    QUALIFY row_number() OVER (PARTITION BY conv_id, place ORDER BY cost, audit) = 1),
best AS (SELECT conv.*, arg_min(audit, (d.cost, audit)) AS audit, min(d.cost) AS cost FROM conv JOIN dp d ON d.conv_id IS NOT DISTINCT FROM conv.conv_id AND d.pos = n AND place IN (0, 3) GROUP BY ALL),
ed AS (SELECT conv_id, i, substr(audit, i, 1) AS e, length(replace(substr(audit, 1, i), 'I', '')) AS pos FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM best)),
kept AS (SELECT ed.conv_id, i, e, role, ini, text, row_number() OVER (PARTITION BY ed.conv_id ORDER BY i) AS m FROM ed LEFT JOIN sgn s ON s.conv_id IS NOT DISTINCT FROM ed.conv_id AND s.pos = ed.pos AND e != 'I' WHERE e != 'D'),
due AS (SELECT *, (m - max(CASE WHEN m = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 AS odd FROM kept),
txt AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS whole FROM due GROUP BY conv_id)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM best b LEFT JOIN txt ON txt.conv_id IS NOT DISTINCT FROM b.conv_id
"""

QUERIES = {"op12_repair_conversations": op12}
ORACLES = {"op12_repair_conversations": SQL}
