"""Token files and packing against the tokenizer itself; edge tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.llm import packing, token_files
from millrace.llm.tokens import WordEncoder, tokenizer_path

ODD = ["", None, "a", "can't  It's İstanbul ΣΣ été, (x)!!! 12,5", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>",
       "\x1c\x85  a\x0bb\x0cc", "###$$$ it!'s word.'s A.B. ퟿﻿ \U0001f600!!", "HELLO!! hello, Hello.", "zz " * 9000, "ǅͅa. ɐb."]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(tokenizer, spark, sf):
    texts = [t or "" for t in ODD] + [r[0] for r in session.table(spark, sf, "documents").select("text").collect()]
    encoder = WordEncoder(tokenizer_path(), keep_bytes=200_000)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts])
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == plain(tokenizer, t), t[:80]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(3, ODD[3], 1), (3, ODD[3], 1), (3, "other", 1), (None, "no id", 2), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, start int")


@pytest.mark.parametrize("table", ["odd", "given", "empty"])
def test_token_files(spark, sf, tokenizer, odd, table, tmp_path):
    docs = {"odd": odd, "given": session.table(spark, sf, "documents"), "empty": odd.limit(0)}[table]
    path = (tmp_path / "t").as_uri()
    token_files.write(docs, path)
    got = token_files.ids_crc32(token_files.read(spark, path)).collect()
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "h", "text").collect()
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = [*plain(tokenizer, r.text), 2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    if table == "given":
        found = token_files.lookup(spark, path, [5, 17]).collect()
        assert {r.doc_id: r.ids for r in found} == {r.doc_id: [*plain(tokenizer, r.text), 2] for r in rows if r.doc_id in (5, 17)}


def test_files_have_order_index_and_bloom(spark, sf, tmp_path):
    path = (tmp_path / "t").as_uri()
    token_files.write(session.table(spark, sf, "documents"), path)
    files = spark.read.orc(path).groupBy("block").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("block").collect()
    assert all(x.z < y.a for x, y in zip(files, files[1:]))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "t").glob("*.orc"))
    assert raw.startswith(b"ORC")
    plan = token_files.lookup(spark, path, [5])._jdf.queryExecution().toString()
    assert any("doc_id" in part.split("]")[0] for part in plan.split("PushedFilters: [")[1:])


@pytest.mark.parametrize("table", ["odd", "given", "empty"])
def test_packing(spark, sf, tokenizer, odd, table):
    docs = {"odd": odd, "given": session.table(spark, sf, "documents"), "empty": odd.limit(0)}[table]
    got = packing.pack(docs.repartition(3), block_tokens=20_000).select("doc.*", "*").drop("doc").collect()
    rows = docs.collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].tier <= 2048 and at & (at - 1) == 0
    want = defaultdict(list)
    for r in rows:
        ids = [*plain(tokenizer, r.text), 1]
        want[r.doc_id, len(ids)].append(ids)
    assert by_doc.keys() == want.keys()
    for key, pieces in by_doc.items():
        assert sum(len(ids) for _, ids in pieces) == sum(map(len, want[key]))
        if len(want[key]) == 1:
            assert sum((ids for _, ids in sorted(pieces)), []) == want[key][0]
    steps = defaultdict(set)
    for r in got:
        steps[r.step_group].add((r.sequence_id, r.tier))
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= 32 * 2048 for s in steps.values())
    if table == "given":
        assert sum(r.length for r in got if r.tier >= 256) > 0.9 * sum(r.length for r in got)


def test_packer_prefers_whole_documents():
    packer = packing.Packer()
    for doc, n in enumerate([1500, 500, 48, 1024, 700, 324]):
        packer.add(doc, n)
    packer.pack()
    packer.finish()
    assert sorted({(x[3], x[5]) for x in packer.out}) == [(0, 2048), (1, 1024), (2, 1024)] and len(packer.out) == 6


def test_a_worker_gives_back_what_another_operator_kept():
    """Words that an encoder keeps for its worker's next tasks go when tasks of an operator without tokens begin; ids stay the same."""
    from millrace.llm.common import lean
    from millrace.llm.tokens import WordEncoder, tokenizer_path
    encoder = WordEncoder.shared(tokenizer_path())
    before = encoder.encode([b"some words, and more words"])
    assert encoder.words and encoder.kept
    lean()
    assert not encoder.words and not encoder.kept
    assert encoder.encode([b"some words, and more words"]) == before
