"""The corpus pipeline stage by stage against plain versions, on a small corpus with every odd case."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, jaccard_join, language_id, pii
from tests.llm.test_operators import BASE, DOCS, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, _text string, n_tokens int, pii_spans int, mix_epoch string"


def document(doc, text, source="web"):
    return doc, text, "a" if doc is None or doc % 2 else None, source, len(text or ""), f"row {doc}", "clash", 7, 3, "clash"


ROWS = [document(d, t, f"s{d % 3}") for d, t in DOCS] + [
    document(2, BASE[0]), document(2, BASE[0], "other"), document(9, prose(50, 80)), document(None, prose(51, 80), None), document(None, prose(52, 80), None), document(None, None, None), document(40, "12 34"),
    document(41, BASE[5] + " write to joe@mail.org now", None), document(42, "  !!", "s0"), document(43, prose(53, 30) + " " + " ".join(BASE[1].split()[10:40]), "s1"),
]
ITEMS = [(1, " ".join(BASE[1].split()[12:30])), (None, None), (2, ""), (3, "日本語だけの文")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows that each stage made of those before it."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        assert name == "mixing" or made.columns == docs.columns
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append([tuple(r) for r in docs.collect()])
    return out


def plain(rows):
    return sorted(rows, key=repr)


def near_free(rows):
    """One row of each group of near copies: the least id, then the least row among those left."""
    texts = {}
    for r in rows:
        texts.setdefault((r[0] is not None, r[0] or 0, r[1]), []).append(r)
    keys = sorted(texts)
    reached = jaccard_join.reference([(k, t) for k, (_, _, t) in enumerate(keys)])
    groups = {}
    for k, group, _, _ in reached:
        groups.setdefault(group, []).append(keys[k])
    return [{(r[0], r[1]) for key in group for r in texts[key] if key[:2] == min(group)[:2]} for group in groups.values()]


def test_rejected_languages(stages):
    assert plain(stages[0]) == plain([r for r in ROWS if any(c.isalpha() for c in r[1] or "")])


def test_one_document_of_each_group(stages):
    groups = near_free(stages[0])
    kept = [(r[0], r[1]) for r in stages[1]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(len(g & set(kept)) == 1 for g in groups)
    assert set(stages[1]) <= set(stages[0])
    assert sum(r[1] == BASE[0] for r in stages[1]) == 1 and sum(r[0] is None for r in stages[1]) == 2


def test_benchmark_documents_go(stages):
    dirty = {t for t in {r[1] for r in stages[1]} if decontaminate.reference([(0, t)], ITEMS)[0][-1]}
    assert dirty and plain(stages[2]) == plain([r for r in stages[1] if r[1] not in dirty])


def test_personal_data_is_masked(spark, stages):
    before = spark.createDataFrame(stages[2], SCHEMA)
    model = pii.fit(before)
    want = []
    for r in pii.spans(before, model).collect():
        text, at, out = r["text"], 0, []
        for s in sorted(r["pii_spans"], key=lambda s: (s["start"], s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = max(at, s["end"])
        want.append((r["doc_id"], "".join(out) + text[at:], r["row"]))
        assert {tuple(s) for s in r["pii_base"]} == set(pii.reference_base(text)) <= {tuple(s) for s in r["pii_spans"]}
    assert plain((r[0], r[1], r[5]) for r in stages[3]) == plain(want)
    assert all(r[4] == len(r[1]) and r[6:] == ("clash", 7, 3, "clash") for r in stages[3])
    assert any("<email>" in r[1] for r in stages[3]) and not any("@mail.org" in r[1] for r in stages[3])


def test_mix_reads_within_its_limits(stages):
    tokens, read = {}, {}
    for r in stages[3]:
        tokens[r[3]] = tokens.get(r[3], 0) + len(r[1].split())
    total = sum(tokens.values())
    for r in stages[4]:
        assert r[7] == 7 and r[8] == 3  # columns of the corpus; mix_epoch is the operator's own
        read[r[3]] = read.get(r[3], 0) + len(r[1].split())
    longest = max(len(r[1].split()) for r in stages[3])
    assert set(read) <= set(tokens) and sum(read.values()) <= total
    assert all(n <= 4 * tokens[s] for s, n in read.items())
    assert sum(read.values()) >= total - longest * len(tokens)
    assert len({(r[0], r[1], r[-4]) for r in stages[4]}) == len(stages[4])


def test_run_is_its_stages(spark, folder, stages):
    assert plain(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == plain(stages[4])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_shared_ids_are_linked_once(spark):
    """A row that stands there twice is two copies, not four; two texts under one id are two documents."""
    near = BASE[0].replace("ra", "ro", 1)
    frame = spark.createDataFrame([(1, BASE[0]), (1, BASE[0]), (2, near), (3, BASE[1]), (3, BASE[2]), (None, near), (None, near), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_links"]) for r in jaccard_join.jaccard_join(frame).collect())
    assert got == [(False, 0, 4)] * 2 + [(True, 1, 4)] * 2 + [(True, 2, 4), (True, 3, 0), (True, 3, 0), (True, 4, 0)]


def test_base_spans_of_random_strings(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(["1", "2", "9", "0", ".", "-", " ", "@", "+", "a", "b%", "é", "(", "4111", "555"]) for _ in range(r.randrange(60))) for _ in range(4000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pii.spans(frame, pii.Model({}, {}, {})).select("text", F.col("pii_base").alias("b")).collect():
        assert sorted(tuple(s) for s in row["b"]) == sorted(pii.reference_base(row["text"])), row["text"]


def test_language_accuracy_on_held_out_documents(spark):
    """Real held-out labels: nearly all documents of 20 letters and more are told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op5(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND length(text) >= 20")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.95
