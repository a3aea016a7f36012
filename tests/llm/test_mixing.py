"""Source mixing against a plain version of weights, blocks, epochs and order."""

import math
import random
import re

import pytest
import xxhash

from tessera.llm import mixture

SEED = mixture.SEED


def chained(*values):
    """Spark's xxhash64: each value hashed with the hash of those before as its seed; (number, bytes) for whole numbers."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else (v[0] & ((1 << (8 * v[1])) - 1)).to_bytes(v[1], "little")
        h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def mix(shares, a):
    powered = [p**a for p in shares]
    return [q / sum(powered) for q in powered]


def exponent(shares, entropy, repeats, epochs):
    """By halving a grid: the largest exponent whose mix is even enough, and the least from there within the repeats."""
    even = lambda a: -sum(w * math.log(w) for w in mix(shares, a)) >= entropy * math.log(len(shares)) - 1e-12
    within = lambda a: max(w / p for w, p in zip(mix(shares, a), shares, strict=True)) * epochs <= repeats
    a = 1.0
    if not even(1.0):
        a, step = 0.0, 0.5
        while step > 1e-14:
            a, step = (a + step if even(a + step) else a), step / 2
    if not within(a):
        b, step = 1.0, (1 - a) / 2
        while step > 1e-14:
            b, step = (b - step if within(b - step) else b), step / 2
        a = b
    return a


def plain(docs, entropy, repeats, block_tokens, budget, allowances):
    """(weights by source, sorted readings) of docs (doc_id, source, text). Allowances are weights times the budget, rounded
    down; they are taken as found, so that a weight at a whole number of readings may fall to either side."""
    rows = [(d, "null" if s is None else "s:" + s, len(re.findall(r"\S+", t or "")), chained((SEED, 4), d if d is None else (d, 8), t)) for d, s, t in docs]
    tokens = {}
    for _, s, n, _ in rows:
        tokens[s] = tokens.get(s, 0) + n
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = total if budget is None else budget
    names = sorted(tokens)
    shares = [tokens[s] / total for s in names]
    weights = dict(zip(names, mix(shares, exponent(shares, entropy, repeats, budget / total)), strict=True))
    out = []
    for s in names:
        assert weights[s] * budget - 1 - 1e-6 < allowances[s] <= weights[s] * budget + 1e-6
        epochs, rest = divmod(allowances[s], tokens[s])
        blocks = min(mixture.BLOCKS, -(-tokens[s] // block_tokens))
        mine = [(d, n, h, h % blocks) for d, k, n, h in rows if k == s]
        slot = lambda e, b: chained((SEED, 4), s, (e, 8), (b, 8))  # noqa: B023, E731
        rank = lambda e, h: chained((SEED, 4), (e, 8), (h, 8))
        read = lambda e, x: (str(x[0]), s, x[1], e, x[3], slot(e, x[3]), rank(e, x[2]))  # noqa: B023, E731
        for e in range(epochs):
            out += [read(e, x) for x in mine]
        left = rest
        for b in sorted({x[3] for x in mine}, key=lambda b: (slot(epochs, b), b)):
            block = sorted((x for x in mine if x[3] == b), key=lambda x: rank(epochs, x[2]))
            if sum(x[1] for x in block) <= left:
                out += [read(epochs, x) for x in block]
                left -= sum(x[1] for x in block)
                continue
            if left > 0:
                for x in block:
                    left -= x[1]
                    if left < 0:
                        break
                    out.append(read(epochs, x))
            break
    return weights, sorted(out)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(("ka", "lo", "mi")) for _ in range(n))


MADE = [(i, "s%d" % min(i % 10, 3), words(i, 20 + i % 7)) for i in range(300)] + [(900, None, words(1, 30)), (901, "s0", None), (902, "none", ""), (None, "s1", words(2, 9)), (None, "s1", words(3, 9))]
MADE += [(5, "s3", words(5, 25))] * 3 + [(903, "s0", words(4, 3000))] + [(904 + k, "tiny", "one") for k in range(3)]


@pytest.mark.parametrize("entropy, repeats, block_tokens, budget", [(0.95, 3.0, 200, None), (0.5, 2.0, 50, 4000), (0.999, 50.0, 1000, 20_000)])
def test_mixing_against_the_plain_version(spark, monkeypatch, entropy, repeats, block_tokens, budget):
    frame = spark.createDataFrame(MADE, "doc_id long, source string, text string").repartition(3)
    for local in (mixture.LOCAL_SOURCES, 0)[: 2 if budget is None else 1]:
        monkeypatch.setattr(mixture, "LOCAL_SOURCES", local)
        plan = mixture.weights(mixture.counted(frame), entropy, repeats, budget).collect()
        found = {r["source_key"]: r["weight"] for r in plan}
        want_weights, want = plain(MADE, entropy, repeats, block_tokens, budget, {r["source_key"]: r["allowance"] for r in plan})
        assert found.keys() == want_weights.keys() and all(abs(found[s] - w) < 1e-9 for s, w in want_weights.items())
        got = mixture.mixed(frame, entropy, repeats, budget, block_tokens=block_tokens).collect()
        assert sorted((str(r["doc_id"]), "null" if r["source"] is None else "s:" + r["source"], r["mix_n_tokens"], r["mix_epoch"], r["mix_block"], r["mix_slot"], r["mix_rank"]) for r in got) == want


def test_columns_with_the_names_of_the_added_ones(spark):
    rows = [(i, "a", "x y", 7, 8) for i in range(4)]
    got = mixture.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string, mix_epoch int, hash int")).collect()
    assert {(r["doc_id"], r["mix_epoch"], r["hash"]) for r in got} == {(i, 0, 8) for i in range(4)}
