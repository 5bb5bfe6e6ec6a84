"""Token alignment against whole-text tokenization and plain counting."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from millrace import session
from millrace.llm import alignment
from millrace.llm.queries import QUERIES
from millrace.llm.tokens import tokenizer_path

NUMBERS = ["doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(tokenizer_path(alignment.BYTE_BPE), tokenizer_path(alignment.PIECES))


def plain(tokenizers, rows):
    aligned = []
    for doc, text in rows:
        groups = []
        if text:
            body = " " + text
            a, b = tokenizers.a.encode(body, add_special_tokens=False).ids, tokenizers.b.encode(text)
            ends_a, ends_b = np.cumsum([len(tokenizers.bytes_a[i]) for i in a]), np.cumsum([len(tokenizers.bytes_b[i]) for i in b])
            same = b"".join(tokenizers.bytes_a[i] for i in a) == b"".join(tokenizers.bytes_b[i] for i in b) == body.encode()
            i = j = 0
            for end in np.intersect1d(ends_a, ends_b) if same else []:
                x, y = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
                groups.append((a[i:x], b[j:y]))
                i, j = x, y
        aligned.append((doc, groups))
    counts = Counter(pair for _, groups in aligned for pair in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc, groups in aligned:
        pairs = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs),
                    sum(counts[p] for p in pairs), sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*NUMBERS).collect()), key=repr)


SPACES = [" ", "  ", "\n", "\n\n", " \n ", "\t", " ", "   ", "　 ", " ", "\r\n", "\x1c ", "\u0085 "]
WORDS = ["the", "The", "don't", "'s", "café", "été", "naïve", "12345", "3.14", "漢字漢", "\U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "<s>", "<0x0A>",
         "▁", "x▁y", "ﬁ", "\x00", "...", "}\r", "क्ष", "zzzzzzzzzzzz", "http://a.b/c?d=e", "‮", "Straße", "Ｆｏｏ"]


def mixed(rng):
    words = WORDS if rng.random() < 0.7 else [w for w in WORDS if "▁" not in w]
    return "".join(rng.choice(words) + (" " if rng.random() < 0.6 else rng.choice(["", *SPACES])) for _ in range(rng.randrange(40)))


def test_query(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in session.table(spark, sf, "documents").collect()]
    got = QUERIES["op13_token_alignment"](spark, sf)
    assert got.columns == [n.removeprefix("doc.") for n in NUMBERS]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(tokenizers, rows)


@pytest.mark.parametrize("long_bytes", [1 << 16, 16, 50])
def test_odd_texts(spark, tokenizers, long_bytes):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", " ", "\n"]) + mixed(rng) + rng.choice(["", " ", "  "])) for k in range(150)]
    rows += [(900, None), (901, ""), (902, " "), (903, "  "), (904, "a "), (905, " a"), (None, "a b"), (7, "x" * 900), (7, "x" * 900), (8, "ab " * 400), (9, "\U0001f600" * 3000 + "क्ष" * 500), (8, "\U0001f468‍" * 99)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain(tokenizers, rows)
    got = alignment.align(docs, long_bytes=long_bytes)
    assert found(got.documents) == want and sum(w[1] > 0 for w in want) > 60 and sum(not w[1] for w in want) > 10
    top = {(r.a, r.b): r.n for r in got.counts.collect()}
    assert max(top.values()) > 20


def test_parts_of_counts(spark, tokenizers, monkeypatch):
    rng = random.Random(8)
    rows = [(k, mixed(rng)) for k in range(60)]
    monkeypatch.setattr(alignment, "PAIRS", 40)
    assert found(alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), long_bytes=100).documents) == plain(tokenizers, rows)


def test_join_is_associative():
    rng = random.Random(3)
    text = (" " + "".join(mixed(rng) for _ in range(30))).encode()
    parts = [alignment.fragment(text[k:k + 23], k)[0] for k in range(0, len(text), 23)]

    def fold(parts, rng):
        closed = []
        parts = list(parts)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            whole, done = alignment.join(parts[k], parts[k + 1])
            parts[k:k + 2] = [whole]
            closed += [done] if done else []
        return parts[0], sorted(closed)

    one = fold(parts, random.Random(1))
    assert one == fold(parts, random.Random(2)) and len(one[1]) > 20
    inner = [alignment.fragment(text[k:k + 23], k)[1] for k in range(0, len(text), 23)]
    whole = sorted([*one[1], *[c for c in inner if c], (one[0].prefix_at, one[0].prefix), (one[0].suffix_at, one[0].suffix)])
    assert b"".join(c[1] for c in whole) == text


def test_odd_tables(spark, odd, tokenizers):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(alignment.align(odd).documents) == plain(tokenizers, rows)
    assert alignment.align(odd.limit(0)).documents.collect() == []
