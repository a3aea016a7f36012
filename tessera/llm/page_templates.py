"""Main text of pages by deducing the template of their site.

A page is a sequence of tokens: opening and closing tags of block elements, told apart by all elements around them and
their class names, and whole text blocks that no element's own meaning decides. Tokens of one host with one occurrence
vector (how often on each page) form an equivalence class; a vector is told by how many pages and times it has and by four
sums of a cryptographic digest of page and count, so it is built by partial sums and no list of pages is held anywhere.
A class is valid if it has tokens and pages enough, if on every page its tokens come in one order, tuple after tuple, and
if its tuples always nest in the same gap of the same other class. Valid classes make the template; gaps between their
tokens are the slots, and text of the template itself is no content.

What a slot holds follows from the elements that enclose it: menus, headers, footers, sidebars, notices, adverts, forms
and comments are left out (a header in the article is its own). Where a page has an article or main element its slots inside are the text, repeated passages
too; else all other slots are, less the template's own text.

Defined results: a null page is empty, and so is its text; pages without a host in their url are one site; a site of few
pages has no template; repeated rows are pages of their own; pages that end within a tag, comment or element lose nothing
before it; nothing depends on page_id but the digest; other columns are not read. A page is parsed in one pass, in time
that grows with its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import batches_by_bytes, table, written

#: A class needs so many tokens, and pages: this number and this share of its host's, which bounds a template by a page's size.
LEAST_TOKENS, LEAST_PAGES, SHARE = 2, 3, 0.1
#: Templates of more bytes together are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i iframe img input ins kbd label map mark meter nobr object output picture progress q rp rt ruby s samp script select small span strike strong style sub sup svg template textarea time tt u var video audio canvas wbr br noscript".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements and roles that are never the text, and words in class names and ids that tell the same.
CHROME = frozenset("aside audio button canvas dialog footer form head iframe menu nav noembed noframes noscript object script select style svg template textarea title video".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
CHROME_WORDS = COMMENT_WORDS | frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu menus nav navbar navigation newsletter notice notices popup promo sidebar sidebars skip sponsor sponsored subscribe toolbar widget widgets".split())
#: Headers that are part of the text inside a main element.
HEADER_WORDS = frozenset(("header", "masthead"))
MAIN = frozenset(("article", "main"))

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[\"'=])*+)(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}
#: An element that opens closes these, if no list or table began since.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


def _token(sign: str, name: str, digest: bytes) -> str:
    return f"{sign}{name if name.isalnum() else ''} {digest.hex()}"


@lru_cache(1 << 14)
def _meaning(name: str, rest: str) -> tuple[str, bool, str]:
    """Of an opening tag: its name with class names and id, whether it is a main element, and what else it tells (tag, header, word, comment)."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
    words = set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
    role = found.get("role", "").lower()
    is_main, own = name in MAIN or role == "main", ""
    if not is_main and (name in CHROME or role in CHROME_ROLES):
        own = "tag"
    elif name not in ("html", "body") and words & COMMENT_WORDS:
        own = "comment"
    elif name not in ("html", "body") and (name == "header" or not is_main and words & HEADER_WORDS):
        own = "header"
    elif name not in ("html", "body") and not is_main and words & CHROME_WORDS:
        own = "word"
    return f"{name} {' '.join(sorted(words))}", is_main, own


@lru_cache(1 << 14)
def _path(above: bytes, label: str) -> bytes:
    """Digest of the elements down to one, from that of the elements above it."""
    return blake2b(above + f"{label}\0".encode("utf-8", "replace"), digest_size=16).digest()


class _Open:
    """The open elements: names with what they mean for the text in them, and a digest of all names down to each."""

    def __init__(self):
        self.stack = [("", b"", "", False)]  # name, digest, chrome (empty, word, tag or comment), main
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def push(self, name: str, rest: str) -> None:
        _, above, chrome, main = self.stack[-1]
        label, is_main, own = _meaning(name, rest)
        if is_main:
            if main and own == "comment":
                chrome = chrome or own
            elif chrome == "word":  # what a wrapper is called does not hold for the article in it
                chrome = ""
            main = True
        elif own != "header" or not main:
            chrome = chrome or own
        self.at[name].append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, _path(above, label), chrome, main))

    def pop(self, down_to: int) -> Iterator[str]:
        """Close the elements from the top to this one; tokens of the blocks among them."""
        while len(self.stack) > down_to:
            name, digest, _, _ = self.stack.pop()
            self.at[name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
                yield _token("/", name, digest)

    def aside(self) -> bool:
        """Is this place in an inline element that is no text?"""
        return self.blocks[-1] < len(self.stack) - 1 and bool(self.stack[-1][2])

    def last(self, names: tuple) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


def scan(page: str, texts: bool = True) -> Iterator[tuple[str, str, str]]:
    """(token, role, text) of a page in order. Tags have no role and no text; a text block's role is main, chrome or open.
    Without ``texts`` only the tokens are made."""
    opened, parts, at, n = _Open(), [], 0, len(page)

    def block() -> Iterator[tuple[str, str, str]]:
        if not parts:
            return
        _, digest, chrome, main = opened.stack[opened.blocks[-1]]
        role = "chrome" if chrome else "main" if main else "open"
        text = " ".join("".join(map(entities.unescape, parts)).split()) if texts or role == "open" else ""
        parts.clear()
        if text:
            yield "t" + blake2b(digest + text.encode("utf-8", "replace"), digest_size=16).hexdigest() if role == "open" else "", role, text

    def closed(down_to: int) -> Iterator[tuple[str, str, str]]:
        if opened.blocks[-1] >= down_to:
            yield from block()
        for token in opened.pop(down_to):
            yield token, "", ""

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at and not opened.aside():
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            place = opened.last((name,))
            if place and (name not in INLINE or opened.blocks[-1] < place):
                yield from closed(place)
            elif name not in INLINE:
                yield from block()
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            if opened.at.get("p"):
                yield from closed(opened.at["p"][-1])
            yield from block()
            if name in _SIBLINGS:
                same, around = _SIBLINGS[name]
                if (place := opened.last(same)) > opened.last(around):
                    yield from closed(place)
        if name in MAIN:
            yield "main", "", ""
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else n
            if not end:
                break
        if name not in VOID:
            opened.push(name, tag["rest"])
            if name not in INLINE:
                yield _token("<", name, opened.stack[-1][1]), "", ""
    if at < n and not opened.aside():
        parts.append(page[at:])
    yield from closed(1)
    yield from block()


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("_host"))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, times, place, h0..h3): occurrence vectors of the tokens; the token ``page`` counts the pages."""
    batches_by_bytes(pages.sparkSession)
    names = ["pages", "times", "place", "h0", "h1", "h2", "h3"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = defaultdict(lambda: [0] * 7)
            for host, page_id, url, page in zip(*[batch.column(c).to_pylist() for c in ("_host", "page_id", "url", "html")], strict=True):
                times, first = Counter(["page"]), {}
                for place, (token, _, _) in enumerate(scan(page or "", False)):
                    if token and token != "main":
                        times[token] += 1
                        first.setdefault(token, place)
                digests = {}
                for token, k in times.items():
                    if k not in digests:
                        d = blake2b(f"{page_id} {url} {k}".encode("utf-8", "replace"), digest_size=16).digest()
                        digests[k] = [int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12)]
                    row = found[host, token]
                    for i, v in enumerate((1, k, first.get(token, 0), *digests[k])):
                        row[i] += v
            keys, rows = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]], ["host", "token", *names])

    found = _hosted(pages).mapInArrow(walk, "host string, token string, " + ", ".join(f"{x} long" for x in names))
    return found.groupBy("host", "token").agg(*[F.sum(x).alias(x) for x in names])


def classes(found: DataFrame, least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, class, tokens): tokens with one vector, in the order of their mean places; the class is called by its first token."""
    total = found.where("token = 'page'").select("host", F.col("pages").alias("_all"))
    often = found.where((F.col("token") != "page") & (F.col("pages") >= least_pages)).join(total, "host").where(F.col("pages") >= F.col("_all") * share)
    same = often.groupBy("host", "pages", "times", "h0", "h1", "h2", "h3").agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("tokens"))
    return same.where(F.size("tokens") >= least_tokens).select("host", F.col("tokens")[0]["token"].alias("class"), F.col("tokens.token").alias("tokens"))


def _packed(rows: DataFrame) -> DataFrame:
    """(host, template): a line for each class, its tokens with commas; at most a few times the tokens of a page, as each is on a share of the pages."""
    return rows.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.array_join("tokens", ","))), "\n").alias("template"))


def _beside(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages with their host's template. Where templates are too many for a broadcast, a host's pages meet theirs by a merge join, that AQE splits where it is skewed."""
    packed = written(_packed(rows))
    size = packed.agg(F.coalesce(F.sum(F.octet_length("template")), F.lit(0))).first()[0]
    packed = packed.withColumnRenamed("host", "_host")
    return _hosted(pages).join(F.broadcast(packed) if size <= BROADCAST_BYTES else packed.hint("merge"), "_host", "left")


class _Walk:
    """A page's way through the classes of a template: which tuples are open, and what does not fit."""

    _seen: dict[str, tuple] = {}

    def __init__(self, template: str):
        if template not in self._seen:
            if len(self._seen) > 256:
                self._seen.clear()
            lines = [x.split(",") for x in template.split("\n") if x]
            self._seen[template] = lines, {t: (c, i) for c, tokens in enumerate(lines) for i, t in enumerate(tokens)}
        self.lines, self.place = self._seen[template]
        self.due, self.open = [0] * len(self.lines), []
        self.bad: set[int] = set()
        self.parents: dict[int, set[str]] = defaultdict(set)

    def slot(self) -> str:
        """The innermost open class and how many of its tokens are behind."""
        return f"{self.lines[self.open[-1]][0]}:{self.due[self.open[-1]]}" if self.open else ""

    def token(self, token: str) -> None:
        c, i = self.place.get(token, (-1, 0))
        if c < 0 or c in self.bad:
            return
        if i != self.due[c]:
            self.bad.add(c)
            self.open = [x for x in self.open if x != c]
            return
        while i and self.open[-1] != c:  # a tuple that began in a gap does not end in it
            self.bad.add(self.open.pop())
        if i == 0:
            self.parents[c].add(self.slot())
            self.open.append(c)
        self.due[c] = (i + 1) % len(self.lines[c])
        if self.due[c] == 0:
            self.open.pop()

    def end(self) -> None:
        self.bad |= set(self.open)


def _fitting(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(host, class, parent) of the classes that come in order and nest in one gap on every page, the other classes as given."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for host, template, page in zip(*[batch.column(c).to_pylist() for c in ("_host", "template", "html")], strict=True):
                way = _Walk(template or "")
                for token, _, _ in scan(page or "", False):
                    way.token(token)
                way.end()
                seen.update((host, way.lines[c][0], None) for c in way.bad)
                seen.update((host, way.lines[c][0], p) for c, parents in way.parents.items() if c not in way.bad for p in parents)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["host", "class", "parent"])

    told = _beside(pages, found).where("template IS NOT NULL").select("_host", "template", "html").mapInArrow(walk, "host string, class string, parent string")
    told = told.groupBy("host", "class").agg(F.min("parent").alias("parent"), F.max("parent").alias("_most"), F.max(F.col("parent").isNull()).alias("_bad"))
    return told.where("NOT _bad AND parent = _most").drop("_most", "_bad")


def templates(pages: DataFrame) -> DataFrame:
    """(host, class, parent, tokens): the valid classes; parent is the class and gap in which the tuples of the class lie.

    Without the classes that do not fit others can lie elsewhere, so the rest is looked at again until all fit."""
    found = written(classes(vectors(pages)))
    n = found.count()
    while True:
        fits = written(found.drop("parent").join(_fitting(pages, found), ["host", "class"]).select("host", "class", "parent", "tokens"))
        found, before, n = fits, n, fits.count()
        if n == before:
            return found


def extracted(pages: DataFrame, found: DataFrame, slots: bool = False) -> DataFrame:
    """(page_id, url, text), and with ``slots`` all text blocks with their slot, role and whether they are kept."""
    kept = _hosted(pages).schema
    schema = f"page_id {kept['page_id'].dataType.simpleString()}, url {kept['url'].dataType.simpleString()}, text string"
    if slots:
        schema += ", slots array<struct<slot:string,role:string,text:string,kept:boolean>>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], []
            for template, page in zip(*[batch.column(c).to_pylist() for c in ("template", "html")], strict=True):
                way, blocks, has_main = _Walk(template or ""), [], False
                for token, role, text in scan(page or ""):
                    has_main |= token == "main"
                    if role:
                        blocks.append((way.slot() if slots else "", "template" if token in way.place else role, text))
                    way.token(token)
                wanted = "main" if has_main else "open"
                texts.append("\n".join(t for _, role, t in blocks if role == wanted))
                lists.append([{"slot": s, "role": r, "text": t, "kept": r == wanted} for s, r, t in blocks] if slots else None)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            if slots:
                columns.append(pa.array(lists, pa.list_(pa.struct([("slot", pa.string()), ("role", pa.string()), ("text", pa.string()), ("kept", pa.bool_())]))))
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "slots"][: len(columns)])

    return _beside(pages, found).select("page_id", "url", "template", "html").mapInArrow(walk, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = extracted(pages, templates(pages))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The given pages have their text in one article of paragraphs and a heading, with few character references.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages),
b AS (SELECT *, list_transform(string_split_regex(inner_html, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x != ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

QUERIES = {"op13_html_template": op13}
ORACLES = {"op13_html_template": SQL}
