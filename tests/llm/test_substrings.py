"""Substring dedup against a brute-force search of windows."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from millrace.llm import common, substrings


def plain(rows, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for p in range(len(w) - length + 1 if doc is not None else 0):
            g = tuple(w[p:p + length])
            least[g] = min(least.get(g, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - length + 1 if doc is not None else 0) if least[tuple(w[p:p + length])] < doc for q in range(p, p + length)}
        out.append((doc, len(w), len(gone), sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc.doc_id", "n_words", "n_removed", df.columns[-1]).collect()), key=repr)


def made(seed, n_docs, length):
    """Texts put together from shared passages of all lengths, with few different words, some changed, copied, cut or repeated."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, length - 1, length, length + 1, 2 * length, 5 * length]))] for _ in range(12)]
    docs = []
    for k in range(n_docs):
        if docs and rng.random() < 0.3:
            w = rng.choice(docs)[1].split()
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
        else:
            w = [x for _ in range(rng.randrange(6)) for x in rng.choice([rng.choice(passages), [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(2 * length))]])]
        docs.append((rng.choice([k, k, k, rng.randrange(n_docs)]), rng.choice([" ", "\n", " \t"]).join(w)))
    return docs


@pytest.mark.parametrize("seed, length", [(1, 50), (2, 50), (3, 7), (4, 20), (5, 1)])
def test_brute_force(spark, seed, length):
    rows = made(seed, 150, length)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain(rows, length)
    assert found(substrings.deduplicated(docs, length)) == want and sum(w[2] > 0 for w in want) > 30


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    long = [f"x{rng.randrange(10 ** 6)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["y"] * 77 + long[150_000:310_000] + ["z"])), (3, " ".join(long[5:54] + ["q"] + long[7:57])), (4, "  " + " ".join(long) + "\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain(rows, 50)
    assert [w[2] for w in want] == [0, 160_000, 50, 400_000] and found(substrings.deduplicated(docs)) == want


def test_odd_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(substrings.deduplicated(odd)) == plain(rows, 50)
    assert substrings.deduplicated(odd.limit(0)).collect() == []
    kept = substrings.deduplicated(odd, carry=("doc_id", "doc", "kept"), kept_text=True).collect()
    assert len(kept) == len(rows) and {r.kept for r in kept if r.doc.doc_id == 7} == {"under the MIT License cc by-nc"}
    copies = spark.createDataFrame([(k, "one " * 60) for k in (4, 5)] + [(4, "one " * 50 + "two")], "doc_id bigint, text string")
    assert sorted((r.doc.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicated(copies).collect()) == [(4, 51, 0), (4, 60, 0), (5, 60, 60)]


def test_winnowing_is_the_same_wherever_a_window_stands():
    rng = np.random.default_rng(1)
    words, w = rng.integers(0, 2 ** 63, 500).astype(np.uint64), substrings.Winnower(50)
    shifted = np.concatenate((rng.integers(0, 2 ** 63, 33).astype(np.uint64), words))
    place = lambda x: {(int(a), int(first) + k) for a, _, first, n in zip(*w.runs(x, np.zeros(len(x)))) for k in range(n)}
    assert {(a, p + 33) for a, p in place(words)} <= place(shifted) and len(place(words)) == 451
    assert np.array_equal(w.windows(words), w.windows(shifted)[33:])


def test_skewless_join(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 0 ELSE id % 7 END AS k")
    keys = rows.where("k < 5").groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", rows["k"] * 10)
    got = common.skewless_join(rows, keys, ["k"], "n")
    assert sorted(tuple(r) for r in got.select("id", "k", "v").collect()) == sorted((r.id, r.k, r.k * 10) for r in rows.collect() if r.k < 5)
