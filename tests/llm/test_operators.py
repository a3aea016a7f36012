"""Operators of the training-data subpackage against plain versions, on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, jaccard_join, language_id, mixture, pii, repeats, suffix_dedup, superkmer_dedup, syncmers, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "ru", "sha", "ö") for b in ("ra", "no", "vel", "ti", "ß", "dun")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


BASE = [prose(i, 120) for i in range(6)]
TEXTS = [
    BASE[0], BASE[1], BASE[0], BASE[2], BASE[2].replace("ra", "ro", 1), BASE[3][:300] + " " + BASE[1][200:600], None, "", "   \n", "one", BASE[4], BASE[4] + " " + BASE[4], "Orre " * 200,
    BASE[5] + " mail a.b@c-d.org or +1 (555) 123-4567 x 10.0.0.255 x 4111 1111 1111 1111 x 1.2.3.999 x 999.1.2.3.4", "日本語のテキスト" * 30, BASE[3] + " " + prose(99, 4000), " x\ty z " * 20,
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_decontaminate(spark, docs, empty):
    items = [(1, " ".join(BASE[1].split()[5:30])), (2, "one"), (3, None), (4, ""), (5, BASE[4][40:200]), (5, BASE[4][40:200]), (None, BASE[0][:150])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.reference(DOCS, [("null" if i is None else i, t) for i, t in items]))
    assert rows(decontaminate._digest(decontaminate.scan(docs, bench))) == want
    assert rows(decontaminate._digest(decontaminate.scan(docs, bench, bound=4000))) == want  # several blocks
    found = decontaminate.scan(docs, bench)
    kept = {r["doc_id"]: r for r in decontaminate.clean(found, docs.columns, "span").collect()}
    assert kept[0]["row"] == "clash" and "one" not in kept[9]["text"]
    assert decontaminate.clean(found, docs.columns).count() == sum(not w[-1] for w in want)
    assert rows(decontaminate._digest(decontaminate.scan(empty, bench))) == []
    assert {r[-1] for r in rows(decontaminate._digest(decontaminate.scan(docs, bench.limit(0))))} == {False}


def test_suffix_dedup(docs, empty):
    assert rows(suffix_dedup.suffix_dedup(docs, keep=False).drop("kept")) == sorted(suffix_dedup.reference(DOCS))
    assert rows(suffix_dedup.suffix_dedup(empty)) == []


def test_suffix_dedup_with_hot_kmers(docs, monkeypatch):
    """Groups above the bound are dealt by single windows; the result is the same. The closures take the bound with them."""
    monkeypatch.setattr(repeats, "HOT", 1)
    original = repeats._filter

    def hot(rows_):
        from tessera.llm import repeats as module

        module.HOT = 1
        try:
            return original(rows_)
        finally:
            module.HOT = 20_000

    monkeypatch.setattr(repeats, "_filter", hot)
    assert rows(suffix_dedup.suffix_dedup(docs, keep=False).drop("kept")) == sorted(suffix_dedup.reference(DOCS))


def test_superkmer_dedup(spark, docs, empty):
    assert rows(superkmer_dedup.superkmer_dedup(docs, keep=False).drop("kept")) == sorted(superkmer_dedup.reference(DOCS))
    assert rows(superkmer_dedup.superkmer_dedup(empty)) == []
    odd = spark.createDataFrame([(None, BASE[0]), (3, BASE[0]), (3, BASE[0]), (3, BASE[1]), (4, BASE[1])], "doc_id long, text string")
    removed = {(r["doc_id"], r["n_removed"]) for r in superkmer_dedup.superkmer_dedup(odd).collect()}
    assert removed == {(None, 0), (3, 120), (3, 0), (4, 120)}


REPEATED = [(None, BASE[0]), (None, BASE[0]), (1, BASE[0]), (1, BASE[0]), (1, BASE[0]), (2, BASE[1]), (3, BASE[1]), (3, BASE[1]), (3, BASE[2]), (4, BASE[3] + " " + BASE[1]), (4, BASE[3] + " " + BASE[1]), (5, None), (5, None), (5, "")]


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_dedup_of_repeated_rows(spark, parts):
    """Every equal row loses what the one place of its id and text loses; ids hold one text or texts that share nothing."""
    frame = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(parts)
    places = list(dict.fromkeys(REPEATED))  # in order of id
    once = dict(zip(places, suffix_dedup.reference([(i, t) for i, (_, t) in enumerate(places)]), strict=True))
    want = [(d, *once[d, t][1:]) for d, t in REPEATED]
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(frame, keep=False).drop("kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_superkmer_dedup_of_repeated_rows(spark, parts):
    """Every equal row loses the words that an earlier document has."""
    frame = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(parts)
    want = sorted(superkmer_dedup.reference([(-1 if d is None else d, t) for d, t in REPEATED]))
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in superkmer_dedup.superkmer_dedup(frame, keep=False).drop("kept").collect())
    assert got == want


def thue_morse(n):
    """Two words that every polynomial hash modulo 2**64 takes for one, whatever its odd base."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomials(spark):
    """Decisions are taken on the words themselves."""
    rest = prose(60, 12)
    first, second = thue_morse(12)
    rows_ = [(1, f"{first} {rest}"), (2, f"{second} {rest}"), (3, f"{first} {rest}")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    assert rows(superkmer_dedup.superkmer_dedup(frame, keep=False).drop("kept")) == sorted(superkmer_dedup.reference(rows_))
    assert rows(suffix_dedup.suffix_dedup(frame, keep=False).drop("kept")) == sorted(suffix_dedup.reference(rows_))
    assert rows(jaccard_join.jaccard_join(frame)) == sorted(jaccard_join.reference(rows_))
    assert rows(jaccard_join.jaccard_join(spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string"))) == [(1, 1, 0, 1), (2, 2, 0, 1)]


def test_longest_previous_factors():
    r = random.Random(3)
    for _ in range(20):
        text, n = bytes(r.choice(b"ab") for _ in range(60)), 12
        places = r.sample(range(48), 48)
        found = sorted((text[i : i + n], p) for i, p in enumerate(places))
        same = lambda a, b: next((k for k in range(n) if a[k] != b[k]), n)
        want = [max([same(s, t) for t, q in found if q < p], default=0) for s, p in found]
        assert suffix_dedup.previous_factors(found) == want


def test_jaccard_join_in_blocks(spark, empty):
    """A component above one block is dealt by buckets; no link is lost, and ids that several texts share lead as they are."""
    r = random.Random(8)
    base = prose(70, 140).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = "zz%d" % r.randrange(40)
        texts.append(" ".join(w))
    rows_ = list(enumerate(texts))
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    want = sorted(jaccard_join.reference(rows_))
    assert sum(w[2] for w in want) > 500
    assert rows(jaccard_join.jaccard_join(frame)) == want
    assert rows(jaccard_join.jaccard_join(frame, block=7)) == want
    shared = spark.createDataFrame([(5, BASE[0]), (5, BASE[1]), (6, BASE[1])], "doc_id long, text string")
    assert rows(jaccard_join.jaccard_join(shared)) == [(5, 5, 0, 116), (5, 5, 1, 116), (6, 5, 1, 116)]
    assert rows(jaccard_join.jaccard_join(empty)) == []


def test_jaccard_join(spark, docs, empty):
    assert rows(jaccard_join.jaccard_join(docs)) == sorted(jaccard_join.reference(DOCS))
    assert jaccard_join.least_equal(32, 0.8, 1e-7) < 20


def test_jaccard_block_links():
    """Pairs by products of matrices, by sorted sets and by brute force agree."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    base = prose(7, 150).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = "zz%d" % r.randrange(40)
        texts.append(" ".join(w))
    sets, first = jaccard_join.shingles(pa.array(texts))
    everyone = np.arange(len(texts))
    i, j = jaccard_join.linked(sets, first, everyone, everyone, True)
    parts = [set(sets[first[k] : first[k + 1]].tolist()) for k in range(len(texts))]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b]) - 1e-9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) > 2000
    left, right = everyone[:40], everyone[40:]
    i, j = jaccard_join.linked(sets, first, left, right, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if a < 40 <= b}


def test_syncmers(docs, empty):
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs).collect()}
    texts = {d: t or "" for d, t in DOCS}
    ids = sorted(texts, reverse=True)
    for k, d in enumerate(ids):
        t, nxt = texts[d], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"]
    assert got[0]["near_edited"] > got[0]["near_next"]
    anchors = set(got[10]["fingerprint"].split())
    assert anchors <= set(got[11]["fingerprint"].split())  # a passage keeps its anchors wherever it stands
    assert rows(syncmers.fingerprints(empty)) == []


def plain_anchors(text, k=syncmers.K):
    """(place, k-mer) by the rule, one k-mer after another."""
    data = b"\xff" * (k - 1) + text.encode() + b"\xff" * (k - 1) if text else b""
    ranks = [syncmers.rank(b) for b in data]
    return [(i - k + 1, data[i : i + k]) for i in range(len(data) - k + 1) if min(ranks[i : i + k]) in (ranks[i], ranks[i + k - 1])]


def murmur(spark, kmers):
    frame = spark.createDataFrame([(k.decode("latin-1"),) for k in kmers], "k string")
    return {r[0].encode("latin-1"): "%08X" % (r[1] & 0xFFFFFFFF) for r in frame.select("k", F.hash("k")).collect()}


SHORT = ["the quick brown fox jumps over", "one lazy dog", "日本語のテキストを読む人", "ab", "é", "", None, "ok 😀 ก้าวไปข้างหน้า"]
UNSPACED = ["ประเทศไทยมีประชากรและวัฒนธรรมที่หลากหลาย" * 10, "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(8)), "xK9" + "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300))]


def test_syncmers_of_short_and_unspaced_texts(spark):
    """Anchors are local: a text with a changed half, or one changed letter, keeps some of them, however short or unspaced."""
    docs = [*enumerate(SHORT + UNSPACED), *((100 + i, t[:150] + "q" + t[151:]) for i, t in enumerate(UNSPACED)), *((200 + i, t) for i, t in enumerate(TEXTS))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(frame).collect()}
    want = {d: plain_anchors(t or "") for d, t in docs}
    names = murmur(spark, {k for found in want.values() for _, k in found})
    ids = sorted(want, reverse=True)
    for n, d in enumerate(ids):
        found = [k for _, k in want[d]]
        low = lambda b: syncmers.rank(b) < syncmers.LOW
        least = lambda k: min(map(syncmers.rank, k))
        first = [k for k in found if low(k[0]) and syncmers.rank(k[0]) == least(k)]
        last = [k for k in found if low(k[-1]) and syncmers.rank(k[-1]) == least(k)]
        assert got[d]["fingerprint"].split() == list(dict.fromkeys(names[k] for k in first + last + found))
        a, b = ({names[k] for _, k in want[x]} for x in (d, ids[(n + 1) % len(ids)]))
        assert abs(got[d]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    for d in range(len(SHORT)):
        assert got[d]["fingerprint"] or not SHORT[d]
    for d in (0, 8, 9, 10):
        assert 0.1 < got[d]["near_edited"] < 1
    for i in range(len(UNSPACED)):
        a, b = (set(got[d]["fingerprint"].split()) for d in (len(SHORT) + i, 100 + i))
        assert len(a & b) > 0.5 * len(a | b)
        assert got[len(SHORT) + i]["n_chars"] == len(UNSPACED[i])
    placed = {}
    for r in syncmers.places(frame).collect():
        placed.setdefault(r["doc_id"], []).append((r["place"], "%08X" % (r["anchor"] & 0xFFFFFFFF)))
    assert {d: sorted(x) for d, x in placed.items()} == {d: [(p, names[k]) for p, k in found] for d, found in want.items() if found}


def test_syncmer_matches_by_place(spark):
    """A passage that moved is found at its offset."""
    a, b = BASE[0], "zz 12 " + BASE[1][:90] + " " + BASE[0][40:500]
    frame = lambda d, t: spark.createDataFrame([(d, t)], "doc_id long, text string")
    best = max(syncmers.matches(frame(1, a), frame(2, b)).collect(), key=lambda r: r["n"])
    assert best["offset"] == len(("zz 12 " + BASE[1][:90] + " ").encode()) - len(BASE[0][:40].encode()) and best["n"] > 20


@pytest.mark.parametrize("rows_", [[(None, "a b c"), (None, "x y z"), (None, "a b c")], [(7, "lone"), (7, "lone")], [(1, "one text"), (1, "other"), (0, None), (2, "z" * 5000)]])
def test_syncmers_of_null_shared_and_repeated_ids(spark, rows_):
    got = syncmers.fingerprints(spark.createDataFrame(rows_, "doc_id long, text string").repartition(2)).collect()
    assert len(got) == len(rows_)
    texts = lambda d: [t or "" for i, t in rows_ if i == d]
    order = sorted({i for i, _ in rows_}, key=lambda i: -1 if i is None else i)
    for d, t in rows_:
        t, at = t or "", order.index(d)
        heads = [x[: len(t) // 2] for x in texts(order[at - 1])]
        assert any(r["doc_id"] == d and r["n_chars"] == len(t) and r["edited_sha256"] in {hashlib.sha256((t[: len(t) - len(t) // 2] + h).encode()).hexdigest() for h in heads} for r in got)


def test_language_id(spark, docs, empty):
    sample = [(i, prose(i, 60), "x") for i in range(12)] + [(100 + i, " ".join(random.Random(i).choice(["the", "and", "of", "thing"]) for _ in range(60)), "y") for i in range(12)] + [(300, None, "x"), (301, "12 34", None)]
    train = spark.createDataFrame(sample, "doc_id long, text string, lang string")
    profiles = language_id.fit(train)
    got = {r["row"]["doc_id"]: r["guess"] for r in language_id.identify(train, profiles).collect()}
    assert all(got[d]["lang"] == (lang if t and lang else "und") for d, t, lang in sample)
    assert got[301]["score"] == 0.0 and 0 < got[0]["score"] <= 1
    nothing = language_id.fit(empty)
    assert {r["guess"]["lang"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_id_by_plain_distance_and_without_ids(spark):
    """The guess is that of the plain out-of-place distance; rows without an id are learned from, in blocks of labels too."""
    sample = [(None, prose(i, 60), "x") for i in range(8)] + [(None, " ".join(random.Random(i).choice(["the", "and", "of", "thing"]) for _ in range(60)), "y") for i in range(8)] + [(5, "onda mar sol luz " * 9, "z")]
    train = spark.createDataFrame(sample + sample[:3], "doc_id long, text string, lang string")
    (profile,) = language_id.fit(train)
    ranks = {}
    for code, a, b in zip(profile.codes.tolist(), profile.first[:-1].tolist(), profile.first[1:].tolist(), strict=True):
        for k in range(a, b):
            ranks.setdefault(profile.labels[profile.label[k]], {})[code] = int(profile.rank[k])
    assert sorted(ranks) == ["x", "y", "z"]
    blocks = language_id.fit(train, labels=1)
    assert sum(len(p.labels) for p in blocks) == 3
    asked = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(sample)] + [(50, "mar y sol the"), (51, None)], "doc_id long, text string")
    several = {r["row"]["doc_id"]: tuple(r["guess"]) for r in language_id.identify(asked, blocks).collect()}
    for r in language_id.identify(asked, [profile]).collect():
        top = language_id.ranked(next(language_id.ngrams([r["row"]["text"]]))).tolist()
        away = {lang: sum(abs(have[c] - i) if c in have else language_id.SIZE for i, c in enumerate(top)) for lang, have in ranks.items()}
        want = min((v, k) for k, v in away.items())
        got = tuple(r["guess"])
        assert got == several[r["row"]["doc_id"]]
        assert got[0] == (want[1] if top else "und") and abs(got[1] - (1 - want[0] / (language_id.SIZE * len(top)) if top else 0)) < 1e-9


def test_pii(spark, docs, empty):
    odd = ["x@y.z%w@a.b.c", "a@b a@b.c.", "1.2.3.4.5.6.7.8 0300.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112 12", "+1 (((( 2 +49 (30) 1234-5678. ++12345678901", "9" * 5000 + " " + "1." * 50, "é@é.fr ü.x@q.de", "(212) 555-1234 joe [at] mail [dot] com", 'token = "0123456789abcdef0123456789abcdef01234567"']
    more = [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, r.replace(".", "") + odd[8]) for i, r in enumerate(BASE)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    model = pii.fit(frame)
    got = {r["doc_id"]: r for r in pii.spans(frame, model).collect()}
    for d, t in [*DOCS, *more]:
        assert [tuple(s) for s in got[d]["pii_base"]] == sorted(pii.reference_base(t), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert set(got[d]["pii_base"]) <= set(got[d]["pii_spans"])
    assert any(s["kind"] == "secret" for s in got[200]["pii_spans"])
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame, model).collect()}
    assert "a.b@c-d.org" not in clean[13] and "<email>" in clean[13] and "<card>" in clean[13]
    assert clean[0] == TEXTS[0] and clean[6] is None
    assert rows(pii.spans(empty, pii.fit(empty))) == []


def test_pii_on_held_out_documents(spark):
    """Secrets and account numbers are told from digests, long words, book numbers, dates and quantities: recall and precision of 0.9 a kind."""
    r = random.Random(21)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    number = lambda n, first="23456": r.choice(first) + "".join(r.choice("123456789") for _ in range(n - 1))
    good = {"secret": lambda: r.choice(['token = "{}"', "api_key: {} ", "password={} "]).format(hexed(r.choice([24, 32, 40]))), "account": lambda: r.choice(["account {} ", "konto {} ", "customer {} "]).format(number(r.choice([12, 14, 17])))}
    bad = [lambda: f"sha256 {hexed(40)} ", lambda: f"commit {hexed(40)} ", lambda: "".join(r.choice(WORDS) for _ in range(9)) + " ", lambda: f"isbn 978{number(10)} ", lambda: f"date 20{r.randrange(10, 30)}{r.randrange(10, 13)}{r.randrange(10, 29)} ", lambda: f"total {number(7)} "]
    rows_, truth = [], {}
    for d in range(400):
        text, marks = "", []
        for _ in range(4):
            text += prose(r.random(), 8) + " "
            kind = r.choice(["secret", "account", None, None])
            part = good[kind]() if kind else r.choice(bad)()
            if kind:
                marks.append((kind, len(text)))
            text += part
        rows_.append((d, text))
        truth[d] = marks
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)
    model = pii.fit(frame.where("doc_id % 2 = 0"))
    caught, wanted, given = {}, {}, {}
    for row in pii.spans(frame.where("doc_id % 2 = 1"), model).collect():
        marks = truth[row["doc_id"]]
        for kind, at in marks:
            wanted[kind] = wanted.get(kind, 0) + 1
            caught[kind] = caught.get(kind, 0) + any(s["kind"] in (kind, "card") and at <= s["start"] < at + 30 for s in row["pii_spans"])
        for s in row["pii_spans"]:
            if s["kind"] in good:
                right = any(k == s["kind"] and at <= s["start"] < at + 30 for k, at in marks)
                given.setdefault(s["kind"], []).append(right)
    assert all(caught[k] >= 0.9 * wanted[k] and sum(given[k]) >= 0.9 * len(given[k]) for k in good), (caught, wanted, {k: (sum(v), len(v)) for k, v in given.items()})
    assert all(abs(model.prior[k]) < 2.5 for k in good)  # both classes have mass; digests have the form of secrets, so no single labeler tells them


def test_pii_of_very_long_texts(spark):
    import time

    model = pii.Model({}, {k: 9.0 for k in pii.KINDS}, {})
    began = time.time()
    for part, n in (("1.2.3.4 ", 20_000), ("a@b.c ", 20_000), ("123456 ", 20_000), ("9", 300_000), ("+1 ", 50_000)):
        frame = spark.createDataFrame([(1, part * n)], "doc_id long, text string")
        size = pii.redacted(frame, model).select(F.length("text")).first()[0]
        assert size == {"1.2.3.4 ": 5, "a@b.c ": 8}.get(part, 0) * n or part not in ("1.2.3.4 ", "a@b.c ")
    assert time.time() - began < 150


def test_em_finds_the_good_labeler():
    patterns = [((1, 1, -1, 1), 900), ((0, 0, -1, 1), 800), ((1, 0, -1, 1), 30), ((0, 1, -1, 0), 20)]
    _, rates, post = pii.expectation_maximisation(patterns)
    assert post[1, 1, -1, 1] > 0.9 > 0.1 > post[0, 0, -1, 1]
    # the first labeler is right on both classes; the last says yes to nearly all, so its no is worth little
    assert rates[0][0][0] > 0.9 > 0.2 > rates[3][0][0]


@pytest.mark.parametrize("seed", range(4))
def test_em_is_that_of_single_spans(seed):
    """The estimate from counted patterns is that of the spans one by one, in plain steps."""
    r = random.Random(seed)
    spans = [tuple(r.choice((-1, 0, 1, 1)) if r.random() < 0.3 else int(r.random() < (0.9 if good else 0.2)) for _ in pii.LABELERS) for good in (r.random() < 0.4 for _ in range(300))]
    misses = [tuple(r.choice((-1, 0, 1)) for _ in pii.LABELERS) for _ in range(40 * (seed % 2))]
    belief = [(v.count(1) + 0.5) / (4 - v.count(-1) + 1) for v in spans]
    for _ in range(pii.ROUNDS):
        prior = (sum(belief) + 1) / (len(spans) + 2)
        seen = lambda j, x, good: 1 + 2 * (x == good) + sum(p if good else 1 - p for p, v in zip(belief + [0.0] * len(misses), spans + misses, strict=True) if v[j] == x)  # noqa: E731, B023
        rate = [[{x: seen(j, x, good) / sum(seen(j, y, good) for y in (-1, 0, 1)) for x in (-1, 0, 1)} for good in (0, 1)] for j in range(4)]
        new = []
        for v in spans:
            on, no = prior, 1 - prior
            for j, x in enumerate(v):
                if x >= 0:
                    on, no = on * rate[j][1][x], no * rate[j][0][x]
            new.append(on / (on + no))
        belief = new
    p, _, post = pii.expectation_maximisation(sorted(Counter(spans).items()), misses=sorted(Counter(misses).items()))
    assert abs(p - prior) < 1e-9 and all(abs(post[v] - b) < 1e-9 for v, b in zip(spans, belief, strict=True))


def with_iban(r, right=True):
    """A German account number, with its check digits or with others."""
    body = "".join(r.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97
    return f"DE{check if right else (check + r.randrange(1, 97)) % 97:02d}{body}"


def test_near_misses_are_negatives(spark):
    """Labelers learn from cards with a wrong digit, names without a domain, addresses and numbers out of range; none becomes a
    span. Numbers that no word calls an account are none, whatever their length; no word of the lists is in these texts."""
    r = random.Random(8)
    misses = [lambda: "4111 1111 1111 111%d" % r.choice((0, 2, 3, 4)), lambda: "10.0.300.%d" % r.randrange(99), lambda: "+49 30 %d" % r.randrange(99), lambda: "@".join(r.choices(WORDS[:20], k=2)), lambda: r.choice("3456") + "".join(r.choices("0123456789", k=15))]
    hits = [lambda: "4111 1111 1111 1111", lambda: "10.0.0.%d" % r.randrange(99), lambda: "+49 30 %d" % r.randrange(10**6, 10**7), lambda: "karano@lovel.org", lambda: with_iban(r), lambda: with_iban(r, False)]
    docs, truth = [], {}
    for d in range(600):
        text = prose(r.random(), 6) + " "
        pick = r.choice((r.randrange(len(misses) + len(hits)), len(misses) + 4))
        part = (misses + hits)[pick]()
        truth[d] = (len(text), len(text) + len(part), pick == len(misses) + 4)
        docs.append((d, text + part + " " + prose(r.random(), 3)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = pii.fit(frame.where("doc_id % 2 = 0"))
    for kind in pii.BASE:
        assert model.reliability[kind, "regex"][1] > 0.85, (kind, model.reliability)  # 0.6 where nothing is learnt
        assert model.reliability[kind, "edges"][1] < 0.5  # stands alone, rightly or not
    wanted = found = wrong = 0
    for row in pii.spans(frame.where("doc_id % 2 = 1"), model).collect():
        start, end, account = truth[row["doc_id"]]
        added = [tuple(s) for s in row["pii_spans"] if s not in row["pii_base"]]
        wanted += account
        found += account and ("account", start, end) in added
        wrong += sum(s != ("account", start, end) or not account for s in added)
    assert wanted > 15 and found >= 0.9 * wanted and wrong <= 0.1 * max(found, 1), (wanted, found, wrong)


def test_check_digits_of_ibans(spark):
    r = random.Random(3)
    numbers = [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), *((with_iban(r, k % 2 == 0), k % 2 == 0) for k in range(20))]
    frame = spark.createDataFrame(numbers, "v string, right boolean")
    assert frame.where(pii.iban(F.col("v")) != F.col("right")).count() == 0


def test_pii_added_on_the_given_tables(spark, sf):
    """All that the method adds there follows a secret's name; the numbers in running prose that fail the card test stay."""
    docs = spark.read.parquet(f"{sf[: sf.rindex('/')]}/sf0.01/documents.parquet").select("doc_id", "text")
    added = pii.spans(docs, pii.fit(docs)).select("text", F.explode(F.array_except("pii_spans", "pii_base")).alias("s"))
    named = [t[: s["start"]].endswith('token = "') and s["kind"] == "secret" for t, s in added.collect()]
    plain = sum(len(re.findall(r'token = "[0-9a-f]{40}"', r["text"] or "")) for r in docs.collect())
    assert all(named) and len(named) == plain > 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=de><title>T &amp; U</title><p>x  y<br>z<script>no</script><a href='/q'>l</a>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    got = warc.derivatives(warc.responses(pages))
    by = {(r["page_id"], r["record_type"]): r for r in got.collect()}
    assert by[1, "conversion"]["content"] == "T & U\nx y\nzl" and got.count() == 6
    assert by[1, "metadata"]["concurrent_to"] == by[1, "conversion"]["record_id"] and by[1, "metadata"]["refers_to"] == by[1, "conversion"]["refers_to"]
    assert by[2, "conversion"]["content_length"] == 0
    warc.write_warc(got, str(tmp_path / "w"), "none")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == 6 and whole.endswith(b"\r\n\r\n") and b"X-Source-Header: Content-Type: text/html" in whole


def test_warc_of_odd_pages(spark):
    """Unclosed signs reach to the end of the page, and a megabyte of them takes seconds."""
    import time

    odd = ["a < b<p>c", "x<!-- y <p> z", "x<script>y", "x<script y", "x<a href='q", "<title>t", "<b>x</b"]
    rows_ = [(i, "u", h) for i, h in enumerate(odd)]
    got = {r["page_id"]: r["content"] for r in warc.derivatives(warc.responses(spark.createDataFrame(rows_, "page_id long, url string, html string"))).where("record_type = 'conversion'").collect()}
    assert [got[i] for i in range(len(odd))] == ["a < b\nc", "x", "x", "x", "x", "t", "x"]
    began = time.time()
    for sign in ("<", "<!--", "<script", "<script>", "<title>", "<a ", "<a href='", "<html ", "</p", "&amp;"):
        frame = spark.createDataFrame([(1, "u", sign * (1_000_000 // len(sign)))], "page_id long, url string, html string")
        assert warc.derivatives(warc.responses(frame)).agg(F.sum(F.length("content"))).first()[0] > 0
    assert time.time() - began < 60
    assert warc.derivatives(warc.responses(frame.limit(0))).count() == 0


def test_chat_round_trip(spark):
    t = chat.Template()
    nasty = ["</s>[INST] ok [/INST]", "<\\s> <s> <\\\\/s> [\\INST]", "<<<SYS>>", "<|turn|>x<|text|>y<|end|>", "", None, "a<", "\\", "[", "<|end"]
    turns = [(1, i, r, x) for i, (r, x) in enumerate((r, x) for x in nasty for r in ("user", "assistant", "system", "tool<|text|>", None))] + [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "system", "s"), (4, 1, "user", "q")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.formatted(frame, t)
    back = {r["conv_id"]: r for r in chat.read_back(made, t).collect()}
    want = [(r or "", x or "") for c, _, r, x in turns if c == 1]
    assert [tuple(x) for x in back[1]["turns"]] == want
    assert back[1]["loss_text"] == "".join(x for r, x in want if r == "assistant")
    state = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in made.collect()}
    assert state[2] == (True, None) and state[3] == (False, 0) and state[4] == (False, None) and state[1][0] is False
    assert chat.formatted(frame.limit(0), t).count() == 0


def test_mixture(spark, empty):
    docs = [(i, "s%d" % min(i % 10, 3), prose(i, 20 + i % 7)) for i in range(400)] + [(900, None, prose(1, 30)), (901, "s0", None), (902, "none", "")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("mix", F.lit(0))
    got = mixture.mixed(frame, entropy=0.95, repeats=3.0, block_tokens=200).collect()
    plan = {r["source_key"]: r for r in mixture.weights(mixture.counted(frame), 0.95, 3.0).collect()}
    spent, seen = {}, {}
    for r in got:
        k = "s:" + r["source"] if r["source"] is not None else "null"
        spent[k] = spent.get(k, 0) + r["mix_n_tokens"]
        seen.setdefault(k, []).append((r["mix_epoch"], r["doc_id"]))
    assert "s:none" not in spent and abs(sum(p["weight"] for p in plan.values()) - 1) < 1e-9
    for k, p in plan.items():
        assert p["allowance"] - 40 <= spent.get(k, 0) <= p["allowance"] and p["allowance"] <= 3.0 * p["tokens"] + 1
        assert len(set(seen[k])) == len(seen[k])
        size = sum(1 for _, s, t in docs if ("s:" + s if s is not None else "null") == k)
        for e in range(p["allowance"] // p["tokens"]):
            assert sum(1 for x, _ in seen[k] if x == e) == size
    shares = [0.7, 0.2, 0.1]
    a = mixture.bisect(lambda x: mixture.mix_at(shares, x), 3, 0.9, 10.0)
    assert abs(mixture.mix_at(shares, a)[1] - 0.9 * 1.0986122886681098) < 1e-6
    assert mixture.bisect(lambda x: mixture.mix_at(shares, x), 3, 0.1, 10.0) == 1.0
    assert mixture.mixed(empty).count() == 0
