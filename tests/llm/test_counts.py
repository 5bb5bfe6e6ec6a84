"""Counts that the toxicity model takes from the corpus."""

import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np

from millrace import session
from millrace.llm import toxicity


def words_in(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute_contexts(texts):
    before = defaultdict(set)
    for text in texts:
        words = words_in(text)
        for own, previous in zip(words, [b"", *words]):
            before[own].add(previous)
    return before


def test_continuation_counts_have_no_ceiling(spark):
    """5,000 different words come before one word, none of which has a number of its own; 40 before another."""
    texts = [f"w{k} often" for k in range(5000)] + [f"w{k} seldom" for k in range(40)] * 3
    random.Random(1).shuffle(texts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = toxicity.corpus_continuations(docs, "text", toxicity.Vocabulary(toxicity.hashed([b"often", b"seldom"])))
    assert abs(got[1] - 5000) < 0.2 * 5000 and abs(got[2] - 40) < 8
    assert abs(got[0] - 5000) < 0.2 * 5000  # each w{k} in one context: the start


def test_continuation_counts_of_the_corpus(spark):
    docs = session.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute_contexts(r.text for r in docs.select("text").collect())
    kept = sorted(want, key=lambda w: (-len(want[w]), w))[:400]
    got = toxicity.corpus_continuations(docs.repartition(3), "text", toxicity.Vocabulary(toxicity.hashed(kept)))
    ratio = got[1:] / [len(want[w]) for w in kept]
    assert len(want[kept[0]]) > 710 and np.abs(ratio - 1).max() < 0.3 and 0.03 < np.sqrt(np.mean((ratio - 1) ** 2)) < 0.1


def test_model_holds_words_of_the_corpus_and_rare_pairs(spark):
    """Both words of an expression are as frequent in each class; only their pair, in 12 toxic documents, tells them apart."""
    rng, words, rows, labels = random.Random(2), [f"n{k}" for k in range(60)], [], []
    counted = next(k for k in range(900) if crc32(b"%d" % k) % 5 > 1)
    for k in range(900):
        text = rng.choices(words, k=30)
        toxic = int(k % 3 == 0)
        text[5:5] = ["red", rng.choice(words), "door"]
        if toxic and k < 36:
            text[12:12] = ["red", "door"]
        rows.append((k, " ".join(text + (["onceinsample"] if k == counted else []))))
        labels.append((k, toxic))
    rows += [(k, f"onceinsample stands after n{k % 60}") for k in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    vocabulary, model, _ = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    ids = vocabulary.numbers([b"red", b"door", b"n1", b"door", b"onceinsample"])
    assert ids[4] and vocabulary.table[vocabulary.order.argsort()[ids[4] - 1]] == toxicity.hashed([b"onceinsample"])[0]  # in 101 documents, one of them labelled
    together, apart = model.ratios(ids[:4], np.array([4]))[[1, 3]]
    assert ids[0] * model.size + ids[1] in set(model.keys.tolist()) and together > apart + 0.1
    assert np.all(model.unigram.sum(1) < 1 + 1e-9) and np.all(model.back > 0) and np.allclose(model.unigram.sum(1), 1)


def test_greatest_ratios_of_different_words():
    rng = np.random.default_rng(5)
    for n, kinds in ((3, 2), (50, 9), (400, 3), (400, 200), (2000, 1)):
        ids = rng.integers(0, kinds, n)
        ratios = np.round(rng.normal(size=n), 2)
        best = {}
        for k in np.argsort(-ratios, kind="stable"):
            best.setdefault(ids[k], ratios[k])
        assert toxicity.greatest(ids, ratios, 4) == sorted(best.values(), reverse=True)[:4]
    skewed = np.concatenate((np.zeros(300, int), np.arange(9)))
    assert toxicity.greatest(skewed, np.concatenate((np.full(300, 5.0), np.arange(9) / 9)), 4) == [5.0, 8 / 9, 7 / 9, 6 / 9]
