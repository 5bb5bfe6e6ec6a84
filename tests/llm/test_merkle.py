"""The Merkle manifest against a plain tree, with ids far apart, ids that repeat, null groups and odd tables."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.llm import merkle
from millrace.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(nodes):
    """Root, and the siblings of each node as (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = place // 8 * 8
            paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1:run + 8])))
            at[k] = place // 8
        nodes = [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf({**r, "text": r["text"].translate(LOWER)}) if tampered(r) else leaf(r), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([built[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for (_, _, own, seen, doc_id), path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1]):
            node = seen
            for a, z in path + up:
                node = h(a, node, z)
            out.append((doc_id, own, built[g][0], root, h(*[a + z for a, z in path + up]), node, node == root))
    return sorted(out, key=repr)


def third(r):
    return r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark, sf):
    rows = [r.asDict() for r in session.table(spark, sf, "documents").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows, third)
    assert found(got) == want and 0 < sum(w[-1] for w in want) < len(want)


@pytest.mark.parametrize("n", [1, 8, 9, 512, 513, 4200])
def test_sizes_and_ids(spark, n):
    """One group at the borders of runs and arrays; ids over all 64 bits, negative ones too; an id, a row and a null that repeat."""
    rng = random.Random(n)
    rows = [{"doc_id": rng.choice([k, rng.randrange(-2 ** 63, 2 ** 63), -k]), "source": rng.choice(["s", None]), "lang": "en" if n < 600 else rng.choice(["en", "en", "de", None, "", "é"]),
             "n_chars": k, "text": f"Text {k}"} for k in range(n)]
    if n > 100:
        rows += [{**rows[5], "text": f"Other {k}"} for k in range(9)] + [rows[7]] * 6000 + [{**rows[9], "doc_id": None, "text": rng.choice(["A", None, ""])} for _ in range(40)]
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    assert found(merkle.manifest(df, tampered)) == plain(rows, third)


def test_odd_tables(odd):
    rows = [r.asDict() for r in odd.select(*FIELDS).collect()]
    assert found(merkle.manifest(odd)) == plain(rows, lambda r: False)
    assert merkle.manifest(odd.limit(0)).collect() == []
