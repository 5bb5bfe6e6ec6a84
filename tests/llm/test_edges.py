"""Odd and empty tables through every operator, with the results that the docstrings state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, decontaminate, html_layout, jaccard, licenses, quality_fm, rules, toxicity


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_classifier(odd, labels):
    model = quality_fm.train(odd, labels)
    rows = collected(quality_fm.score(odd, model), "doc.doc_id", "score", "predicted")
    assert len(rows) == odd.count() and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in rows)
    assert len({s for i, s, _ in rows if i == 1}) == 2  # repeated rows score alike
    assert quality_fm.train(odd, labels.limit(0)) is None
    assert {s for _, s, _ in collected(quality_fm.score(odd, None), "doc.doc_id", "score", "predicted")} == {0.5}
    assert quality_fm.score(odd.limit(0), model).collect() == [] and quality_fm.train(odd.limit(0), labels) is None


def test_toxicity(odd, labels):
    trained = toxicity.train(odd, labels, least_docs=1, least_pair_docs=1)
    assert trained is not None
    rows = collected(toxicity.score(odd, trained), "doc.doc_id", "score", "predicted")
    assert len(rows) == odd.count() and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in rows)
    assert toxicity.train(odd, labels.limit(0)) is None and toxicity.score(odd.limit(0), trained).collect() == []
    assert set(collected(toxicity.score(odd, None), "score", "predicted")) == {(0.0, 0)}


def test_rules(odd):
    rows = collected(rules.judge(odd), "doc.doc_id", "n_words", "word_chars", "base_failed", "kept")
    assert len(rows) == odd.count() and all(failed and not kept for _, n, _, failed, kept in rows if n < 50)
    assert sorted((n, c) for i, n, c, _, _ in rows if i in (2, 3, 4, 6)) == [(0, 0)] * 3 + [(1, 1_000_000)]
    assert rules.judge(odd.limit(0)).collect() == []


def test_licenses(odd):
    rows = {r.doc_id: r for r in licenses.scan(odd.where("doc_id > 1")).collect()}
    assert [(s.label, s.base, s.first) for s in rows[7].spans if s.base] == [("mit", True, 0), ("cc-by-nc", True, 4)]
    assert rows[2].n_words == rows[3].n_words == 0 and rows[6].n_words == 1 and rows[2].spans == []
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).collect() == []


@pytest.mark.parametrize("pass_bytes", [64 << 20, 900])
def test_decontamination(odd, benchmark, pass_bytes):
    rows = decontaminate.contamination(odd, benchmark, carry=["doc_id", "items"], spans=True, pass_bytes=pass_bytes)
    assert rows.count() == odd.count()
    got = {(r.doc.doc_id, r.n_words): r for r in rows.collect()}
    assert got[1, 72].items == ["1"] and got[1, 72].n_hit == 65 and [tuple(s) for s in got[1, 72].spans] == [(14, 326)]
    assert got[8, 1].items == ["2"] and got[2, 0].n_hit == 0 and got[None, 0].items == [] and not got[5, 54000].contaminated
    assert decontaminate.contamination(odd.limit(0), benchmark).collect() == []
    assert not decontaminate.contamination(odd, benchmark.limit(0)).where("contaminated").count()


def test_near_duplicates(odd):
    rows = sorted(collected(jaccard.near_duplicates(odd), "doc_id", "n_shingles", "component_id"), key=str)
    assert (8, 1, 8) in rows and (9, 1, 8) in rows and (2, 0, 2) in rows and (3, 0, 3) in rows and (None, 0, None) in rows
    assert rows.count((1, 6, 1)) == 3 and len(rows) == odd.count()
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(i) for (i,) in collected(kept, "doc_id"))
    assert ids == sorted(map(str, [1, 1, 2, 3, 4, None, None, 5, 6, 7, 8]))
    assert jaccard.keep_one(odd.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>a<p>b"), (3, "u", "<div>" * 20000 + "x"), (3, "u", "&amp;<b"), (4, "u", "plain " * 100_000)]
    pages = spark.createDataFrame([(*r, "e", "e") for r in rows], "page_id bigint, url string, html string, text string, doc string")
    got = sorted(collected(html_layout.extract(pages), "doc.page_id", "text"), key=str)
    assert [(i, t[:9]) for i, t in got] == [(1, ""), (2, ""), (3, "&"), (3, "x"), (4, "plain pla"), (None, "a\n\nb")]
    assert html_layout.extract(pages.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 5, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (4, None, None, None), (4, 0, "user", "hi"), (None, 0, "user", "lost"), (5, 0, "user", "<|im_end|>"), (5, 0, "tool", "tie"), (6, 0, "user", "ho")]
    rows += [(7, k, "user", f"t{k}") for k in range(600)] + [(8, k, "user", f"t{k}") for k in range(-3, 297)] + [(9, k + 1, "user", f"t{k}") for k in range(300)]
    table = spark.createDataFrame([(*r, "e", "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, place string, part string")
    got = {(r.conv_id, r.part): r for r in chat.render(table).collect()}
    assert {c for c, _ in got} == {1, 4, 5, 6, 7, 8}  # 2 begins 1; 3 equals 1; 9 begins 7 under other turn numbers
    assert got[1, 0].n_copies == 2 and got[1, 0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[5, 0].text == "<|im_start|>tool\ntie<|im_end|>\n<|im_start|>user\n<|im_end |><|im_end|>\n"
    assert "".join(got[7, k].text for k in range(3)).count("<|im_start|>user\nt") == 600 and got[7, 0].n_turns == 600
    assert chat.render(table.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, sf, odd, name, stage, empty):
    docs = odd.limit(0) if empty else odd
    out = stage(spark, docs, sf)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert len(rows) <= odd.count()
    assert not empty or not rows


@pytest.mark.parametrize("kind", ["double", "string"])
def test_near_duplicates_on_other_id_types(spark, kind):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words, *[f"x{k}"] * (k > 7)])) for k in (7, 8, 9)] + [(20, "quite another text of seven words")]
    docs = spark.createDataFrame([(float(k) if kind == "double" else f"{k:03d}", t) for k, t in rows], f"doc_id {kind}, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 20: 20}
