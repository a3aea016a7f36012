"""Chat formatting: a finite-state machine over roles and a declarative template.

A template gives each role its opening and closing mark and whether its text is trained on; other roles use a generic
mark that spells the role. Inside texts (and spelled roles) a control string gets one backslash after its first sign,
``<s>`` becomes ``<\\s>`` and ``<\\s>`` becomes ``<\\\\s>``, so no text can end a turn and unescaping gives the text back.
The machine's moves are a table; the first turn without a move makes a conversation invalid, and where it is is told.
Everything is column expressions over one aggregation by conversation.

Defined results: a null text or role is empty; turns are ordered by turn, then role and text, null turns first;
repeated rows are turns of their own; a null conv_id is a conversation of its own; other columns are not read.
A conversation is one value and is held whole by one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table


@dataclass(frozen=True)
class Template:
    """role -> (opening, closing, trained on); ``other``: opening, end of the role's name, closing."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple = ("<|turn|>", "<|text|>", "<|end|>")
    #: state -> role -> next state
    moves: dict = field(default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple = ("answered",)

    def controls(self) -> list[str]:
        return [m for o, c, _ in self.roles.values() for m in (o, c)] + list(self.other)

    def pattern(self, slashes: str) -> str:
        firsts = "".join(sorted({c[0] for c in self.controls()}))
        return f"([{re.escape(firsts)}]){slashes}({'|'.join(re.escape(c[1:]) for c in sorted(self.controls()))})"


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(r"(\\*)"), r"$1\\$2$3")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(r"\\(\\*)"), r"$1$2$3")


def _segments(turn: Column, t: Template) -> Column:
    """The turn as (text, loss) pieces."""
    piece = lambda c, loss: F.struct(c.alias("text"), F.lit(loss).alias("loss"))
    opening, name, closing = t.other
    out = F.array(piece(F.concat(F.lit(opening), escaped(turn["role"], t), F.lit(name)), False), piece(escaped(turn["text"], t), False), piece(F.lit(closing), False))
    for role, (o, c, loss) in t.roles.items():
        out = F.when(turn["role"] == role, F.array(piece(F.lit(o), False), piece(escaped(turn["text"], t), loss), piece(F.lit(c), False))).otherwise(out)
    return out


def _walk(turns: Column, t: Template) -> tuple[Column, Column]:
    """State after the last turn (null once a move is missing) and the number of turns before the first bad one."""
    table_ = F.create_map(*[F.lit(x) for state, to in t.moves.items() for role, end in to.items() for x in (f"{state} {role}", end)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("good"))
    step = lambda acc, turn: F.struct(table_[F.concat_ws(" ", acc["state"], turn["role"])].alias("state"), (acc["good"] + F.when(table_[F.concat_ws(" ", acc["state"], turn["role"])].isNotNull(), 1).otherwise(0)).alias("good"))
    end = F.aggregate(turns, start, step)
    return end["state"], end["good"]


def formatted(conversations: DataFrame, t: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, valid, first_bad_turn (0-based place, null if none), segments, formatted, loss_spans ([start, end) in code points)."""
    t = t or Template()
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state, good = _walk(F.col("turns"), t)
    rows = whole.select("conv_id", state.alias("state"), good.alias("good"), F.size("turns").alias("n"), F.flatten(F.transform("turns", lambda x: _segments(x, t))).alias("segments"))
    ends = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct((acc["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(s["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    bad = F.when(F.col("good") < F.col("n"), F.col("good"))
    valid = bad.isNull() & F.coalesce(F.col("state").isin(*t.final), F.lit(False))
    return rows.select("conv_id", valid.alias("valid"), bad.alias("first_bad_turn"), "segments", F.array_join("segments.text", "").alias("formatted"), ends.alias("loss_spans"))


def read_back(rows: DataFrame, t: Template | None = None) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss_spans`` alone."""
    t = t or Template()
    opening, name, closing = t.other
    esc = re.escape
    turn = "|".join([f"{esc(o)}[\\s\\S]*?{esc(c)}" for o, c, _ in t.roles.values()] + [f"{esc(opening)}[\\s\\S]*?{esc(closing)}"])

    def parsed(m: Column) -> Column:
        at = F.locate(name, m) if isinstance(m, str) else F.instr(m, name)
        inner = lambda c, a, z: F.substring(c, a + 1, F.length(c) - a - z)
        out = F.struct(unescaped(F.substring(m, F.lit(len(opening) + 1), at - len(opening) - 1), t).alias("role"), unescaped(F.substring(m, at + len(name), F.length(m) - at - len(name) - len(closing) + 1), t).alias("text"))
        for role, (o, c, _) in t.roles.items():
            out = F.when(F.startswith(m, F.lit(o)), F.struct(F.lit(role).alias("role"), unescaped(inner(m, F.lit(len(o)), F.lit(len(c))), t).alias("text"))).otherwise(out)
        return out

    turns = F.transform(F.regexp_extract_all("formatted", F.lit(turn), F.lit(0)), parsed)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]), t)), "")
    return rows.select("conv_id", "formatted", "valid", turns.alias("turns"), loss.alias("loss_text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    same = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text")))
    back = read_back(formatted(rows))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql(t: Template) -> str:
    pattern = t.pattern(r"(\\*)").replace("'", "''")
    esc = lambda c: f"regexp_replace({c}, '{pattern}', '\\1\\\\\\2\\3', 'g')"
    marks = " ".join(f"WHEN role = '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in t.roles.items())
    codes = " ".join(f"WHEN role = '{r}' THEN '{r[0]}'" for r in t.roles)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({esc('text')}) + CASE {marks} ELSE {sum(map(len, t.other))} + length({esc('role')}) END) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(CASE {codes} ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM c GROUP BY conv_id
"""


QUERIES = {"op8_chat_format": op8}
ORACLES = {"op8_chat_format": _sql(Template())}
