"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. More candidates come from wider patterns,
most of which are nothing personal: addresses with spelled-out signs, national phone numbers, long tokens of letters and
digits (secrets, but also long words, digests, names of files), long numbers (accounts, cards with a wrong digit,
national ids and IBANs, but also dates, book numbers, time stamps, quantities). Four labelers vote yes, no or nothing
on every candidate and base span of all texts:

* regex      is the value well formed for its kind (does it pass its check digits, where it has some)
* gazetteer  is a part of it listed (``Lists``: top-level domains, calling codes, countries of IBANs, issuer digits,
             names of secrets nearby)
* context    do the words around speak for or against it (to an account, none for it is one against)
* edges      does it stand alone, or inside a longer token

Near misses are voted on too, when the model is fitted, and are never spans: matches of the base patterns that fail the
contract's test (cards with a wrong check digit, parts of addresses above 255, too few or too many digits), names at a
host without a domain, international account numbers with wrong check digits, and numbers for which neither form, list
nor context speaks (as accounts). They are the corpus's own negatives of
the kinds whose base spans are all right: EM takes them as such from the start, since one dissenting labeler would not
move it, and leaves them out of its prior. Where a corpus has none for a kind, its labelers' rate of right noes is
unknown (None), not a constant.

Equal vote patterns are counted (at most kinds x 3**4 rows, so they can be collected), expectation-maximisation over
them estimates each labeler's reliability by kind, and a naive Bayes classifier is trained on the soft labels, from
counts by feature (again a bounded table). Its features are none that a labeler votes on: length, number of digits and
of distinct digits, grouping, letter case, the signs at both sides, digits and the word before. A candidate becomes a
span when the classifier gives it ``accept`` or more and it does not overlap a base span. Texts stay on the executors;
everything there is column expressions. Places come from the pieces between matches by running sums in blocks of the
square root of their number, so a text with very many matches costs little more than its length.

Defined results: a null text is empty; no candidates at all means no added spans; repeated rows are judged alike; very
long texts are scanned whole, with patterns that neither recurse nor backtrack over long runs; an empty table gives an
empty model and no rows; other columns pass untouched, but for those called pii_base or pii_spans, which ``spans``
replaces. Spans are [start, end) in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import running
from tessera.runtime import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account")
ACCEPT, ROUNDS = 0.9, 50
ADDED = ("pii_base", "pii_spans")
LABELERS = ("regex", "gazetteer", "context", "edges")

#: The contract's patterns, made safe for a backtracking engine: possessive where nothing can be given back, and a
#: start only where a run starts (or where the last match ended), since within a run only the end decides.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text is only searched when it holds one of these; 0 stands for any digit.
NEEDS = {"email": ("@",), "ip": ("0",), "card": ("0",), "phone": ("+",)}
#: Wider candidates, by kind.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"[0-9(](?<![0-9+].)(?:(?<=\()[0-9]{3}|[0-9]{2})\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "account": r"(?<![A-Za-z0-9+._@-])(?<![0-9] )(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+|[0-9](?:[ -]?[0-9]){5,}+)(?![A-Za-z0-9])",
}
#: Near misses of the base patterns, beside their matches that fail the test.
NEAR = {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])"}
MORE_NEEDS = {"email": ("(at)", "[at]"), "phone": ("0",), "secret": ("0",), "account": ("0",)}


@dataclass(frozen=True)
class Lists:
    """Gazetteers, as alternatives of a pattern; pass longer ones where they are at hand.

    Domains of two letters (countries) are taken as listed by rule.
    """

    domains: str = "com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|tel|cat|asia|xyz|online|site|shop|store|app|dev|cloud|tech|blog|news|email|live|world|group|company|digital|agency|academy|school|university|bank|law|legal|health|care|clinic|art|music|film|games|city|berlin|london|paris|tokyo|wien|hamburg|koeln|nyc|africa"
    codes: str = "1|7|2[07]|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0-9]|3[0-469]|35[0-9]|37[0-9]|38[0-9]|4[013-9]|42[0-3]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[0-9]|68[0-9]|69[0-2]|8[1246]|85[0-6]|88[0-8]|9[0-58]|96[0-8]|97[0-9]|99[2-8]"
    countries: str = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
    secret_names: str = "token|secret|password|passwd|pwd|pass|apikey|api_key|api-key|access_key|accesskey|private_key|client_secret|credential|credentials|auth|authorization|bearer|session|cookie|key"


FOR = {
    "email": "mail|email|e-mail|contact|contacto|kontakt|write|reach", "ip": "host|server|ip|address|client|peer|login", "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|whatsapp|telefon|handy|mobil|telefono",
    "secret": "login|env|export|config|credential|credentials|header|authorization", "account": "account|iban|konto|compte|cuenta|card|customer|member|passport|ssn|id|insurance|license|policy",
}
AGAINST = {
    "email": "example of|regex", "ip": "version|release|section|chapter|build", "card": "isbn|order|serial|tracking|sku|ean|part", "phone": "isbn|order|serial|version|rfc|total|sum|pages",
    "secret": "sha1|sha256|checksum|commit|md5|digest|hash|revision|file|path|branch|id", "account": "isbn|order|serial|tracking|sku|ean|invoice|part|total|sum|version|population|pages|timestamp|date|bytes|rows",
}

SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
BEFORE, AFTER = 24, 12
#: Classifier features: name and number of buckets.
FEATURES = {"length": 8, "digits": 21, "distinct": 11, "group": 4, "case": 4, "before": 6, "after": 6, "line": 2, "numbers": 2, "word": 64}
WIDTH = sum(FEATURES.values())


def _add(a: Column, b: Column) -> Column:
    return a + b


def placed(matched: Column) -> Column:
    """Places and surroundings of a pattern's matches, from struct(values, pieces between, running ends of both)."""
    values, gaps, ends = matched["values"], matched["gaps"], matched["ends"]
    near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

    def one(value: Column, i: Column) -> Column:
        end = F.get(ends, i)
        before = F.right(F.concat(near(values, i - 1), near(gaps, i)), F.lit(BEFORE))
        after = F.left(F.concat(near(gaps, i + 1), near(values, i + 1)), F.lit(AFTER))
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))

    return F.when(F.size(values) == 0, F.array().cast(SPANS)).otherwise(F.transform(values, one))


def _matched(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _text and a column of places for every pattern.

    A pattern only reads texts that hold the sign it needs, and texts are only split where it matches; the steps are
    projections of their own, so that no pattern is evaluated twice.
    """
    patterns = {f"_{k}": (PATTERNS[k], NEEDS[k]) for k in BASE} | {f"_more_{k}": (MORE[k], MORE_NEEDS[k]) for k in MORE} | {f"_near_{k}": (NEAR[k], NEEDS[k]) for k in NEAR}
    keep = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(*keep, "_text", F.col("_text").rlike("[0-9]").alias("_numbers"))
    none = F.array().cast("array<string>")
    values = []
    for name, (pattern, needs) in patterns.items():
        need = F.lit(False)
        for sign in needs:
            need = need | (F.col("_numbers") if sign == "0" else F.contains("_text", F.lit(sign)))
        values.append(F.when(need, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{name}_v"))
    rows = rows.select(*keep, "_text", *values)
    rows = rows.select("*", *[F.when(F.size(f"{name}_v") > 0, F.split("_text", pattern, -1)).otherwise(none).alias(f"{name}_g") for name, (pattern, _) in patterns.items()])
    steps = lambda name: F.zip_with(f"{name}_v", F.slice(f"{name}_g", 1, F.size(f"{name}_v")), lambda v, g: F.length(v) + F.length(g))
    rows = rows.select("*", *[F.when(F.size(f"{name}_v") > 0, steps(name)).otherwise(F.array().cast("array<int>")).alias(f"{name}_s") for name in patterns])
    rows = rows.select("*", *[running(F.col(f"{name}_s"), _add).alias(f"{name}_e") for name in patterns])
    rows = rows.select(*keep, "_text", *[F.struct(F.col(f"{name}_v").alias("values"), F.col(f"{name}_g").alias("gaps"), F.col(f"{name}_e").alias("ends")).alias(name) for name in patterns])
    return rows.select(*keep, "_text", *[placed(F.col(name)).alias(name) for name in patterns])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def iban(value: Column) -> Column:
    """Is the number 1 modulo 97, country and check digits last, letters from A as 10."""
    signs = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.left(signs, F.lit(4)))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97) == 1


def _holds(kind: str, value: Column) -> Column:
    """The contract's test of a match; international account numbers have one too."""
    if kind == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "account":
        return F.when(value.rlike("^[A-Z]"), iban(value)).otherwise(True)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _holds(kind, s["value"])


def _fails(kind: str) -> Callable[[Column], Column]:
    return lambda s: ~_holds(kind, s["value"])


def _all_of(words: str, text: Column) -> Column:
    return F.lower(text).rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _listed_vote(kind: str, v: Column, before: Column, lists: Lists) -> Column:
    if kind == "email":
        ends = F.lower(v).rlike(rf"(?:\.|dot[\])] ?)(?:{lists.domains}|[a-z]{{2}})$")
        return _vote(ends, ~ends)
    if kind == "ip":
        unused = v.rlike(r"^0+\.") | v.rlike(r"^(?:22[4-9]|2[3-9][0-9])\.")
        return _vote(~unused, unused)
    if kind == "card":
        return _vote(v.rlike("^[2-6]"), v.rlike("^[0789]"))
    if kind == "phone":
        known = ~v.startswith("+") | v.rlike(rf"^\+(?:{lists.codes})")
        return _vote(known, ~known)
    if kind == "secret":
        named = _all_of(lists.secret_names, before)
        return _vote(named, ~named)
    listed = v.rlike(rf"^(?:{lists.countries})[0-9]")
    return _vote(listed, ~listed & ~v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))


def _context_vote(kind: str, around: Column) -> Column:
    speaks = _all_of(FOR[kind], around)
    return _vote(speaks, ~speaks if kind == "account" else _all_of(AGAINST[kind], around))


def _described(kind: str, spans: Column, base: bool, lists: Lists, near: bool = False) -> Column:
    """Spans with what the labelers and the classifier look at; near misses are not well formed, whatever their shape."""

    def one(s: Column) -> Column:
        v, before, after = s["value"], s["before"], s["after"]
        digits = F.length(_digits(v))
        last, next_ = F.right(before, F.lit(1)), F.left(after, F.lit(1))
        letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
        shape = {
            "email": F.lower(v).rlike(r"\.[a-z]{2,}$|dot[\])] ?[a-z]{2,}$"),
            "ip": ~v.rlike(r"(?:^|\.)0[0-9]"),
            "card": digits.isin(13, 14, 15, 16, 19),
            "phone": digits.between(10, 15),
            "secret": (digits >= 4) & (letters >= 4) & ~v.rlike("[-_]{2}|^[A-Za-z]+[-_]?[0-9]*$|^[0-9-]*$"),
            "account": v.rlike("^[A-Z]|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        }[kind]
        formless = digits.between(9, 19) & ~v.rlike("^[A-Z]") if kind == "account" else F.lit(False)  # no check digits to go by
        formed = F.lit(0) if near else _vote(shape, ~shape & ~formless)
        around = F.concat(before, F.lit(" "), after)
        glued = last.rlike("[A-Za-z0-9]") | next_.rlike("[A-Za-z0-9]")
        alone = (last == "") | last.rlike("[\\s\"'(:=<\\[]")
        word = F.lower(F.regexp_extract(before, "([A-Za-z]+)[^A-Za-z]*$", 1))
        cased = F.when(letters == 0, 0).when(v == F.lower(v), 1).when(v == F.upper(v), 2).otherwise(3)
        buckets = {
            "length": F.least(F.floor(F.log2(F.length(v).cast("double"))).cast("int"), F.lit(7)),
            "digits": F.least(digits, F.lit(20)),
            "distinct": F.least(F.size(F.array_distinct(F.split(_digits(v), ""))), F.lit(10)),
            "group": F.when(v.rlike(" "), 1).when(v.rlike("-"), 2).when(v.rlike("[.]"), 3).otherwise(0),
            "case": cased,
            "before": _sign(last),
            "after": _sign(next_),
            "line": before.rlike("(?:^|\\n)$").cast("int"),
            "numbers": before.rlike("[0-9]").cast("int"),
            "word": F.pmod(F.hash(word), F.lit(FEATURES["word"])),
        }
        offsets = {f: sum(list(FEATURES.values())[:k]) for k, f in enumerate(FEATURES)}
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            F.lit(near).alias("missed"),
            F.array(formed, _listed_vote(kind, v, before, lists), _context_vote(kind, around), _vote(alone & ~glued, glued)).alias("votes"),
            F.array(*[(buckets[f] + offsets[f]).cast("int") for f in FEATURES]).alias("features"),
        )

    return F.transform(spans, one)


def _sign(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("\\s"), 3).when(c.rlike("[\"'=:(<\\[]"), 4).otherwise(5)


def candidates(docs: DataFrame, text_col: str = "text", lists: Lists = Lists()) -> DataFrame:  # noqa: B008
    """``docs`` with ``_base``, ``_extra`` and ``_missed``: described base spans, candidates that overlap none of them, and near
    misses of base spans."""
    raw = _matched(docs, text_col)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    base = F.concat(*[_described(k, F.filter(f"_{k}", _test(k)), True, lists) for k in BASE])
    raw = raw.select("*", _described("account", F.filter("_more_account", _test("account")), False, lists).alias("_numbers"))
    spoken = lambda s: F.array_max(F.slice(s["votes"], 1, 3)) == 1
    asked = {k: _described(k, F.col(f"_more_{k}"), False, lists) for k in MORE if k != "account"} | {"account": F.filter("_numbers", spoken)}
    failed = {k: F.filter(f"_{k}", _fails(k)) for k in BASE if k not in NEAR} | {k: F.col(f"_near_{k}") for k in NEAR} | {"account": F.filter("_more_account", _fails("account"))}
    silent = F.transform(F.filter("_numbers", lambda s: ~spoken(s)), lambda s: s.withField("missed", F.lit(True)))
    missed = F.concat(*[_described(k, a, False, lists, near=True) for k, a in failed.items()], silent)
    both = raw.select(*keep, base.alias("_base"), F.concat(*asked.values()).alias("_wide"), missed.alias("_missed"))
    order = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s.alias("span")))
    some = (F.size("_base") > 0) & (F.size("_wide") > 0)
    sorted_ = both.select("*", F.when(some, F.array_sort(F.concat(order(F.col("_base")), order(F.col("_wide"))))).alias("_all"))
    ends = running(F.transform("_all", lambda s: F.when(s["base"], s["end"]).otherwise(-1)), F.greatest)
    starts = F.reverse(running(F.reverse(F.transform("_all", lambda s: F.when(s["base"], s["start"]).otherwise((1 << 31) - 1))), F.least))
    apart = sorted_.select("*", ends.alias("_ends"), starts.alias("_starts"))
    free = F.filter("_all", lambda s, i: ~s["base"] & (F.get(F.col("_ends"), i) <= s["start"]) & (F.get(F.col("_starts"), i) >= s["end"]))
    return apart.select(*keep, "_base", F.when(some, F.transform(free, lambda s: s["span"])).otherwise(F.col("_wide")).alias("_extra"), "_missed")


class Model(NamedTuple):
    """Reliabilities by (kind, labeler), P(yes | positive) and P(no | negative), None where EM found no such span, and the
    classifier's log odds by kind and by (kind, feature)."""

    reliability: dict
    prior: dict
    weight: dict


def expectation_maximisation(patterns: list[tuple], rounds: int = ROUNDS, misses: list[tuple] = ()) -> tuple[float, list[list[dict]], dict]:
    """Dawid and Skene's estimate for one kind, from (votes, count): prior, P(vote | class) by labeler, posterior by pattern.
    ``misses`` are counts of spans that are known to be none."""
    post = {v: (sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1) for v, _ in patterns}
    prior, table_ = 0.5, []
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        yes = sum(post[v] * n for v, n in patterns)
        prior = (yes + 1) / (total + 2)
        table_ = []
        for j in range(len(LABELERS)):
            rates = []
            for c in (0, 1):
                mass = {x: 1.0 + (2.0 if x == c else 0.0) for x in (-1, 0, 1)}  # a labeler is taken to be better than chance
                for v, n in patterns:
                    mass[v[j]] += n * (post[v] if c else 1 - post[v])
                for v, n in misses if c == 0 else ():
                    mass[v[j]] += n
                rates.append({x: m / sum(mass.values()) for x, m in mass.items()})
            table_.append(rates)
        for v, _ in patterns:
            odds = log(prior / (1 - prior)) + sum(log(table_[j][1][x] / table_[j][0][x]) for j, x in enumerate(v) if x >= 0)
            post[v] = 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, odds)))
    return prior, table_, post


def fit(docs: DataFrame, text_col: str = "text", lists: Lists = Lists()) -> Model:  # noqa: B008
    """The model from all texts of ``docs``: one pass, then two small aggregates of it."""
    spans = candidates(docs.select(docs[f"`{text_col}`"].alias("c0")), "c0", lists).select(F.explode(F.concat("_base", "_extra", "_missed")).alias("s"))
    counts = spans.select("s.kind", "s.missed", "s.votes", F.explode(F.concat(F.array(F.lit(-1)), "s.features")).alias("feature")).groupBy("kind", "missed", "votes", "feature").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # at most 2 x kinds x 3**4 patterns x (WIDTH + 1); feature -1 counts the spans
    reliability, prior, weight = {}, {}, {}
    for kind in KINDS:
        here = [(tuple(r["votes"]), r["missed"], r["feature"], r["n"]) for r in rows if r["kind"] == kind]
        counted = lambda missed: sorted((v, n) for v, m, f, n in here if f < 0 and m == missed)  # noqa: E731, B023
        asked, misses = counted(False), counted(True)
        if not asked:
            continue
        _, rates, post = expectation_maximisation(asked, misses=misses)
        yes = sum(post[v] * n for v, n in asked)
        no = sum((1 - post[v]) * n for v, n in asked) + sum(n for _, n in misses)
        prior[kind] = log((yes + 1) / (no + 1))
        reliability |= {(kind, name): (rates[j][1][1] if yes >= 1 else None, rates[j][0][0] if no >= 1 else None) for j, name in enumerate(LABELERS)}
        sums: dict[int, list[float]] = {}
        for v, missed, f, n in here:
            if f >= 0:
                on = 0.0 if missed else post[v]
                got = sums.setdefault(f, [0.0, 0.0])
                got[0] += n * (1 - on)
                got[1] += n * on
        for f, (off, on) in sums.items():
            weight[kind, f] = log((on + 0.5) / (yes + 1)) - log((off + 0.5) / (no + 1))
    return Model(reliability, prior, weight)


def score(span: Column, model: Model) -> Column:
    """Log odds of a described span."""
    if not model.prior:
        return F.lit(-99.0)
    flat = F.array(*[F.lit(float(model.weight.get((k, f), 0.0))) for k in KINDS for f in range(WIDTH)])
    prior = F.array(*[F.lit(float(model.prior.get(k, -99.0))) for k in KINDS])
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"]).cast("int") - 1
    return F.aggregate(span["features"], F.get(prior, kind), lambda a, f: a + F.get(flat, kind * WIDTH + f))


def _numbered(docs: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """The names c0, c1, ... by the old ones, and ``docs`` with them, so that no name clashes with one used here."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return names, docs.toDF(*names.values())


def spans(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT, lists: Lists = Lists()) -> DataFrame:  # noqa: B008
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (kind, start, end), by kind and start."""
    names, plain = _numbered(docs)
    got = candidates(plain, names[text_col], lists)
    place = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    out = lambda a: F.transform(F.array_sort(F.transform(a, place)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kept = F.filter("_extra", lambda s: score(s, model) >= log(accept / (1 - accept)))
    return got.select(*[F.col(n).alias(c) for c, n in names.items() if c not in ADDED], out(F.col("_base")).alias("pii_base"), out(F.concat(F.col("_base"), kept)).alias("pii_spans"))


def redacted(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT, lists: Lists = Lists()) -> DataFrame:  # noqa: B008
    """The documents with each span (of overlapping ones their union) replaced by the first one's kind in angle brackets.

    Spans are cut out in blocks of the square root of their number: a block's stretch of the text once, its pieces from
    that, as cutting a piece costs its distance from the start.
    """
    names, plain = _numbered(docs)
    got = spans(plain, model, names[text_col], accept, lists)
    keep = list(names.values())
    sorted_ = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = got.select(*keep, sorted_.alias("_spans"))
    rows = rows.select(*keep, "_spans", running(F.col("_spans.end"), F.greatest).alias("_reach"))
    # a span starts a union when no earlier one reaches over its start; the union ends where the next one starts from
    heads = F.filter(F.transform("_spans", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get("_reach", i - 1), F.lit(0)).alias("from"))), lambda s: s["start"] >= s["from"])
    rows = rows.select(*keep, heads.alias("_heads"), F.coalesce(F.element_at(F.when(F.size("_reach") > 0, F.col("_reach")), -1), F.lit(0)).alias("_end"))
    text, n = F.col(names[text_col]), F.size("_heads")
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda j: F.slice("_heads", j * width + 1, width))

    def spelled(block: Column) -> Column:
        begin, end = F.element_at(block, 1)["from"], F.element_at(block, -1)["start"]
        pieces = lambda stretch: F.transform(block, lambda s: F.concat(F.substring(stretch, s["from"] - begin + 1, s["start"] - s["from"]), F.lit("<"), s["kind"], F.lit(">")))
        return F.element_at(F.transform(F.array(F.substring(text, begin + 1, end - begin)), lambda stretch: F.array_join(pieces(stretch), "")), 1)

    new = F.when(n == 0, text).otherwise(F.concat(F.array_join(F.transform(blocks, spelled), ""), F.substring(text, F.col("_end") + 1, F.length(text))))
    return rows.select(*[(new if c == text_col else F.col(n_)).alias(c) for c, n_ in names.items()])


def _listed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = spans(docs, fit(docs))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.col("pii_base")), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"))


def reference_base(text: str | None) -> list[tuple]:
    """The contract's base spans, plainly."""
    text = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


QUERIES = {"op2_pii_spans": op2}
ORACLES: dict[str, str] = {}
