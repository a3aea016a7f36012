"""Operators 11 to 13: against brute force, plain readings and planted cases."""

import hashlib
import html
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as C
from tessera.llm import page_templates as T
from tessera.llm import spelling as S


# spelling variants


def edits_of(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True))
    a, b = sorted((a, b), key=len)
    return 1 if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 9


def plain_variants(vocab, ratio):
    out = {}
    for w, n in vocab.items():
        near = [(v, m) for v, m in vocab.items() if v != w and edits_of(v, w) == 1]
        best = min(near, key=lambda x: (-x[1], x[0]), default=None)
        form = best if best and best[1] >= ratio * n else None
        out[w] = [form and form[0], w, n, len(near), form and form[1]]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 6))): rng.choice((1, 2, 5, 9, 11, 40, 55, 230, 1200)) for _ in range(400)}
    words |= {"aaaaaaa": 5, "aaaaaaaa": 25, "abcdefgh": 7, "abcdefhg": 70, "stale": 3, "least": 90, "steal": 400}  # anagrams are not near
    vocab = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {tuple(r) for r in S.variants(vocab, 5).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain_variants(words, 5)


def test_chained_forms_lead_to_their_end(spark):
    words = {"x" * 6 + "abcdefghij"[:k] + "y" * (9 - k): 5**k for k in range(10)}  # each one letter from the next, five times as frequent
    found = {r["word"]: r["root"] for r in S.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert found == {r[0]: r[2] for r in plain_variants(words, 5)}
    assert len({r for r in found.values()}) < len(found)


def test_anagrams_do_not_all_meet(spark):
    """Anagrams of one word share its key: halves of their order keep them apart."""
    words = sorted({"".join(p) for p in itertools.permutations("abcdefg")})[:2000]
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    offers = S._offers(vocab)
    met = offers.groupBy("key", "size", "fore", "half").count().agg({"count": "max"}).first()[0]
    assert met <= 24 * 4 and S.near_pairs(vocab).count() == 0


def test_words_damage_and_odd_rows(spark):
    texts = [(1, "Straße STRASSE naïve×x a1b2 Ünder"), (2, None), (3, ""), (None, "Letters letters"), (3, "letters " * 3)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string")
    want = []
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run)
    assert sorted(r[0] for r in S.damaged(S.runs(docs)).collect()) == sorted(want)
    many = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}rds") for i in range(4000)], "doc_id long, text string")
    cut = [r[0] for r in S.damaged(S.runs(many)).collect()]
    assert 0 < sum(len(w) < 6 for w in cut) < 60
    none = S.variants(S.vocabulary(S.damaged(S.runs(docs.limit(0)))))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, "Lettered lettered latter " * 60_000), (2, "q" * 300_000)], "doc_id long, text string")
    assert {tuple(r) for r in S.vocabulary(S.runs(docs, 6).select("run").withColumnRenamed("run", "word")).collect()} == {("lettered", 120_000), ("latter", 60_000)}


# conversation repair


def all_edits(signs):
    """Every audit with up to two insertions a gap whose roles fit, and its cost."""

    def go(k, out, roles, cost):
        for more in range(3):
            due = "".join("a" if (roles + x).endswith("u") else "u" for x in [""])
            r, o = roles, out
            for _ in range(more):
                r, o = r + ("a" if r.endswith("u") else "u"), o + "I"
            del due
            c = cost + 2 * more
            if k == len(signs):
                if re.fullmatch("(s?(ua)+)?", r):
                    yield c, o
                continue
            sign = signs[k]
            yield from go(k + 1, o + "D", r, c + 3)
            if sign != "d":
                late = sign.isupper()
                for edit, role, price in (("K", sign.lower(), 0), *(("R", x, 2) for x in "ua")):
                    if re.fullmatch("s|(s?(ua)*u?)", r + role):
                        yield from go(k + 1, o + edit, r + role, c + price + late)

    return go(0, "", "", 0)


@pytest.mark.parametrize("length", range(5))
def test_cheapest_edits_against_all_edits(length):
    every = ["".join(p) for p in itertools.product("suaoSUAOd", repeat=length)]
    rng = random.Random(length)
    branch = C.Branch()
    for signs in sorted(every if length < 3 else rng.sample(every, 120 if length == 3 else 25)):
        branch.follow(signs)
        assert branch.answer() == min(all_edits(signs)), signs


def test_layers_are_made_once_for_a_shared_prefix():
    rng = random.Random(1)
    signatures = sorted("".join(rng.choice("suaUAd") for _ in range(rng.randint(0, 12))) for _ in range(300))
    fresh, branch, made = [], C.Branch(), 0
    step = branch.step
    def counted(layer, sign):
        nonlocal made
        made += 1
        return step(layer, sign)
    branch.step = counted
    for signs in signatures:
        alone = C.Branch()
        alone.follow(signs)
        branch.follow(signs)
        fresh.append(alone.answer() == branch.answer())
    assert all(fresh)
    assert made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_long_conversations_have_few_different_layers():
    branch = C.Branch()
    branch.follow("ua" * 20_000 + "d" * 20_000 + "s" * 5000)
    cost, audit = branch.answer()
    assert cost == 3 * 20_000 + 2 * 5000 and len(audit) == 65_000 and len(branch.known) < 40


def plain_repair(rows):
    """rows (turn, role, text) of one conversation: counts, cost, audit, hash."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults, signs = set(), [], ""
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        cls = role[:1] if role[:1] in ("s", "u", "a") and role else "o"
        signs += "d" if fault in ("blank", "duplicate") else cls.upper() if fault else cls
    cost, audit = min(all_edits(signs))
    lines, roles, k = [], "", 0
    for e in audit:
        due = "a" if roles.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}[due]
        if e == "I":
            lines.append(f"{name}:")
        else:
            _, role, text = rows[k]
            k += 1
            if e == "D":
                continue
            due, name = (role[:1], role) if e == "K" else (due, name)
            lines.append(f"{name}:{text}")
        roles += due
    known = [t for t, _, _ in rows if t is not None]
    two = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(x not in ("su", "ua", "au") for x in two), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_against_all_edits(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for k in range(rng.randint(0, 5)):
            rows.append((conv, rng.choice((k, k, None, 3)), rng.choice(("user", "assistant", "system", "tool", "", "User", None)), rng.choice(("Hi.", "Hi", "", " \n", "Was? ", "Hi.", None, "é…")), 1))
    rows += [(7, 0, "user", "Same.", 1)] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    every = spark.createDataFrame([(i,) for i in [*range(60), None]], "conv_id long")
    audits, edited = C.repair(table, every)
    digests = {r[0]: r[1] for r in C.digests(edited).collect()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], digests[r["conv_id"]]) for r in audits.collect()}
    want = {c: plain_repair([(t, " " if r is None else r, " " if x is None else x) for i, t, r, x, _ in rows if i == c]) for c in [*range(60), None]}
    assert got == want
    assert got[next(c for c in want if not any(r[0] == c for r in rows))] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", f"{c} said. So!") for c in range(20) for t in (*range(10), None)]
    want = []
    for c, t, role, text in rows:
        way = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(way, 1)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, map(tuple, C.damaged(table).collect()))) == sorted(map(repr, want))


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, edited = C.repair(none)
    assert audits.count() == 0 and edited.count() == 0


# page templates


def page(k, body, site="s"):
    return (k, f"http://{site}.example.com/{k}", body)


def texts(spark, rows, **named):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r for r in T.extracted(pages, T.templates(pages), **named).collect()}


def test_articles_without_chrome(spark):
    bodies = [
        f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site {k}</header><nav><ul><li>a<li>b{k}</ul></nav>
        <div class="notice">We use cookies</div><aside>side {k}</aside><div id=ad-{k}>Buy</div><article><h1>Head&nbsp;{k}</h1><p>One  &amp;
        two<br>three <b>bo</b>ld &lt;i&gt; {k}<p>Same passage.<script>if(a<b)"</p>"</script><form>Name <input></form><ul><li>x<li>y</ul>
        <section class="comments"><p>First!</p></section></article><footer>&copy; {k}</footer></body></html>"""
        for k in range(6)
    ]
    found = texts(spark, [page(k, b) for k, b in enumerate(bodies)])
    assert [found[k]["text"] for k in range(6)] == [f"Head {k}\nOne & two three bold <i> {k}\nSame passage.\nx\ny" for k in range(6)]


def test_template_text_is_no_content_without_an_article(spark):
    """No element tells what the notice is: it has the vector of the page itself. A site of two pages has no template."""
    body = lambda k: f"<html><body><div><p>Terms of this site apply.</p></div><div><p>Story {k} begins</p><p>and ends {k}.</p></div></body></html>"
    found = texts(spark, [page(k, body(k)) for k in range(5)] + [page(9, body(9), "small"), page(10, body(10), "small")], slots=True)
    assert found[3]["text"] == "Story 3 begins\nand ends 3."
    assert found[9]["text"] == "Terms of this site apply.\nStory 9 begins\nand ends 9."
    roles = [(s["role"], s["kept"]) for s in found[3]["slots"]]
    assert roles == [("template", False), ("open", True), ("open", True)] and all(s["slot"] for s in found[3]["slots"])


def test_classes_against_vectors(spark):
    """Classes by sums of digests are those by whole occurrence vectors."""
    rng = random.Random(3)
    rows = [page(k, "<body>" + "".join(rng.choice(("<p>a</p>", "<div>x</div>", "<ul><li>q</ul>")) for _ in range(4)) + "<hr></body>", rng.choice("ab")) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["host"], frozenset(r["tokens"])) for r in T.classes(T.vectors(pages)).collect()}
    want = set()
    for host in {r[1].split("/")[2] for r in rows}:
        own = [[t for t, _, _ in T.scan(h) if t and t != "main"] for _, u, h in rows if u.split("/")[2] == host]
        by = {}
        for token in {t for p in own for t in p}:
            by.setdefault(tuple(p.count(token) for p in own), set()).add(token)
        want |= {(host, frozenset(v)) for k, v in by.items() if sum(map(bool, k)) >= max(3, 0.1 * len(own)) and len(v) >= 2}
    assert got == want


def test_classes_out_of_order_are_not_valid(spark):
    """Two elements once on every page, but now in this order and now in the other, are one class and no template."""
    rows = [page(k, "<body><h2>x</h2><h3>y</h3></body>" if k % 2 else "<body><h3>y</h3><h2>x</h2></body>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert T.classes(T.vectors(pages)).count() == 1 and T.templates(pages).count() == 0
    nested = [page(k, "<body><ul>" + "<li><b>z</b></li>" * (k + 1) + "</ul></body>") for k in range(8)]
    pages = spark.createDataFrame(nested, "page_id long, url string, html string")
    found = {r["class"][:3]: r for r in T.templates(pages).collect()}
    assert set(found) == {"<bo", "<li"} and found["<bo"]["parent"] == "" and found["<li"]["parent"] == f"{found['<bo']['class']}:2"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "<p"), (4, "http://h/", "a < b &amp c"), (4, "http://h/", "a < b &amp c"), (5, "http://h/", "<article>" + "<div>" * 50_000 + "deep" + "<p>w " * 50_000), (6, "http://h/", "</p>" * 1000 + "<!-- open"), (7, "http://h/", "<a title='x>y" + " z" * 100_000)]
    found = texts(spark, rows)
    assert {k: r["text"][:20] for k, r in found.items()} == {1: "", 2: "", 3: "", 4: "a < b & c", 5: "deep\nw\nw\nw\nw\nw\nw\nw\nw"[:20], 6: "", 7: ""}
    assert len(found[5]["text"].split("\n")) == 50_001
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert T.extracted(none, T.templates(none)).count() == 0


def test_templates_join_by_shuffle(spark, monkeypatch):
    rows = [page(k, f"<body><p>Terms.</p><p>Story {k}</p></body>", f"site{k % 3}") for k in range(15)]
    want = texts(spark, rows)
    monkeypatch.setattr(T, "BROADCAST_BYTES", 0)
    assert texts(spark, rows) == want and want[4]["text"] == "Story 4"


def test_plain_reading_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in T.op13(spark, sf).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner[1] if inner else "")]
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)
