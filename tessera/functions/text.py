"""Column functions over texts: matches with places, line starts, offsets. All places are 0-based code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bound, running

BREAK = "\r\n|\r|\n"
SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches; the gaps between them give the places."""

    def place(values: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.length(g) + F.length(v))
        ended = lambda ends: F.transform(values, lambda v, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value")))
        return bound(running(steps, lambda a, b: a + b), ended)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda v: F.when(F.size(v) == 0, F.array().cast(SPAN)).otherwise(bound(F.split(text, pattern, -1), lambda g: place(v, g))))


def _rest(text: Column) -> Column:
    """Code points behind the last break."""
    return F.length(F.element_at(F.split(text, BREAK, -1), -1))


def placed_matches(text: Column, pattern: str) -> Column:
    """Matches as ``matches`` gives them, with their line and where it starts: breaks are counted once along the text, so many
    matches of a long text cost no more than few. A match must not begin or end inside a break."""

    def piece(c: Column) -> Column:
        n = F.regexp_count(c, F.lit(BREAK))
        return F.struct(F.length(c).alias("size"), n.alias("breaks"), F.when(n > 0, _rest(c)).otherwise(F.length(c)).alias("rest"))

    def joined(a: Column, b: Column) -> Column:
        return F.struct((a["size"] + b["size"]).alias("size"), (a["breaks"] + b["breaks"]).alias("breaks"), F.when(b["breaks"] > 0, b["rest"]).otherwise(a["rest"] + b["size"]).alias("rest"))

    def place(values: Column, gaps: Column) -> Column:
        pieces = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.array(piece(g), piece(v))))
        at = lambda ends, v, i: F.struct(F.get(ends, 2 * i)["size"].alias("start"), F.get(ends, 2 * i + 1)["size"].alias("end"), v.alias("value"), F.get(ends, 2 * i)["breaks"].alias("line"), (F.get(ends, 2 * i)["size"] - F.get(ends, 2 * i)["rest"]).alias("line_start"))
        return bound(running(pieces, joined), lambda ends: F.transform(values, lambda v, i: at(ends, v, i)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(found, lambda v: F.when(F.size(v) == 0, F.array().cast("array<struct<start:int,end:int,value:string,line:int,line_start:int>>")).otherwise(bound(F.split(text, pattern, -1), lambda g: place(v, g))))


def line_starts(text: Column) -> Column:
    """array<int>: 0, the place after every break, and the length when the text does not end in a break."""
    after = F.concat(F.array(F.lit(0)), F.transform(matches(text, BREAK), lambda m: m["end"]))
    last = F.element_at(after, -1)
    return F.when(last == F.length(text), after).otherwise(F.concat(after, F.array(F.length(text))))


def line_of(text: Column, offset: Column) -> Column:
    """Line that holds the offset: breaks that end at or before it. A break in the middle of which it stands is not over."""
    before = F.substring(text, F.lit(1), offset)
    split = before.endswith("\r") & (F.substring(text, offset + 1, F.lit(1)) == "\n")
    return F.regexp_count(before, F.lit(BREAK)) - F.when(split, 1).otherwise(0)


def column_of(text: Column, offset: Column) -> Column:
    before = F.substring(text, F.lit(1), offset)
    split = before.endswith("\r") & (F.substring(text, offset + 1, F.lit(1)) == "\n")
    plain = F.length(F.element_at(F.split(before, BREAK, -1), -1))
    return F.when(split, F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset - 1), BREAK, -1), -1)) + 1).otherwise(plain)


def blanked(text: Column, pattern: str) -> Column:
    """Matches overwritten by as many blanks (line breaks stay), so that places keep."""
    spans, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    blanks = F.concat(F.transform(spans, lambda s: F.regexp_replace(s, "[^\r\n]", " ")), F.array(F.lit("")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, b)), ""))
