"""Substring dedup: passages that an earlier document holds too are found by seeds and extended to maximal repeats.

Every window of ``length`` words has one anchor, the least (leftmost) hash among its n-grams. Neighbouring windows often share theirs, so a
document has few anchors (winnowing), and documents that share a window share its anchor. Documents are joined on anchors. A seed
extends both ways over the words of the windows that it anchors; where the whole stretch is equal, a hash tells so and no text moves. Only one
document for each different stretch round a shared anchor is read again, and its windows are compared word for word (by hash) with those of
the other stretches. Stretches that follow one another join to maximal repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import map_documents, skewless_join, written

GRAM = 16
#: Bytes of a text, and words of a batch, that are unpacked at once.
PIECE, GATHERED = 1 << 20, 200_000
BASE = 0x9E3779B97F4A7C15
SPACE = re.compile(rb"[\t-\r ]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text, in lists of bounded length. ASCII white space parts words."""
    at = 0
    while at < len(text):
        gap = SPACE.search(text, at + size) if len(text) - at > size else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Winnower:
    """Anchors of all windows of ``length`` words in flat arrays of word hashes."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def scale(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverse = self.grown(BASE, size), self.grown(pow(BASE, -1, 1 << 64), size)

    @staticmethod
    def grown(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    def sums(self, hashed: np.ndarray) -> np.ndarray:
        self.scale(len(hashed) + 1)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * self.powers[:len(hashed)])))

    def hashes(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``first`` to ``end``, wherever they stand."""
        return mixed((sums[end] - sums[first]) * self.inverse[first])

    def windows(self, hashed: np.ndarray) -> np.ndarray:
        """Hash of each window."""
        first = np.arange(max(0, len(hashed) - self.length + 1))
        return self.hashes(self.sums(hashed), first, first + self.length)

    def runs(self, hashed: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: hash of the anchor, hash of the run's words, first word, number of windows.

        ``part`` numbers the texts that the words belong to; windows lie within one text.
        """
        n = len(hashed) - self.length + 1
        if n < 1:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        sums = self.sums(hashed)
        grams = np.arange(len(hashed) - self.gram + 1)
        grams = self.hashes(sums, grams, grams + self.gram)
        inside = np.flatnonzero(part[:n] == part[self.length - 1:])
        least = np.lib.stride_tricks.sliding_window_view(grams, self.length - self.gram + 1)
        anchor = inside + np.concatenate([least[inside[k:k + 65536]].argmin(1) for k in range(0, len(inside), 65536)] or [inside]).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor, prepend=-1) | (np.diff(inside, prepend=-2) > 1))
        first, count = inside[new], np.diff(np.append(new, len(inside)))
        at = anchor[new]
        stretch = self.hashes(sums, first, first + count + self.length - 1) ^ mixed((at - first).astype(np.uint64) * np.uint64(0x10001) + count.astype(np.uint64))
        return grams[at], stretch, first, count


def hashed_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


ANCHORS = "a bigint, e bigint, doc bigint, txt bigint, first bigint, n bigint"


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row for each run of windows with one anchor: anchor ``a``, stretch ``e``, document, first word and number of windows."""
    def run(batches):
        winnower = Winnower(length)
        held: list[tuple] = []  # document, text hash, place of the first word, hashes

        def flush():
            flat = np.concatenate([h[3] for h in held])
            sizes = np.array([len(h[3]) for h in held])
            part = np.repeat(np.arange(len(held)), sizes)
            a, e, first, n = winnower.runs(flat, part)
            own = part[first]
            begin = (np.cumsum(sizes) - sizes)[own]
            place = np.array([h[2] for h in held], np.int64)[own]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, e)] + [pa.array(ids[own]), pa.array(texts[own]), pa.array(first - begin + place), pa.array(n)],
                                              names=["a", "e", "doc", "txt", "first", "n"])

        for batch in batches:
            total = 0
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_buffer()
                place, tail = 0, np.zeros(0, np.uint64)
                for words in pieces(text.to_pybytes() if text is not None else b""):
                    own = np.concatenate((tail, hashed_words(words)))
                    held.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), place, own))
                    total += len(own)
                    keep = min(length - 1, len(own))
                    place, tail = place + len(own) - keep, own[len(own) - keep:]
                    if total > GATHERED:
                        ids, texts = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
                        yield flush()
                        total = 0
            if held:
                ids, texts = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
                yield flush()

    rows = docs.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "txt", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ANCHORS)


def asked_windows(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Windows of the stretches that were asked for: anchor ``a``, hash ``w``, document and first word."""
    per_text = asked.groupBy("doc", "txt").agg(F.sort_array(F.collect_set(F.struct("first", "n", "a"))).alias("asked"))
    rows = docs.where("doc IS NOT NULL AND text IS NOT NULL").join(per_text, ["doc", "txt"])

    def run(batches):
        winnower = Winnower(length)
        for batch in batches:
            for k in range(batch.num_rows):
                doc, txt, text = (batch.column(c)[k].as_py() for c in range(3))
                own = batch.column(3)[k].values
                first, n, a = (own.field(c).to_numpy() for c in range(3))
                place, tail, todo = 0, np.zeros(0, np.uint64), 0
                for words in pieces(text):
                    hashed = np.concatenate((tail, hashed_words(words)))
                    found = winnower.windows(hashed)
                    # runs do not cross the pieces, as the first pass cut the text at the same places
                    upto = np.searchsorted(first, place + len(found))
                    size, at = n[todo:upto], first[todo:upto] - place
                    if len(size):
                        s = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[todo:upto], size)), pa.array(found[s].view(np.int64)), pa.array(np.full(len(s), doc, np.int64)),
                                                          pa.array(np.full(len(s), txt, np.int64)), pa.array(s + place)], names=["a", "w", "doc", "txt", "first"])
                    todo = upto
                    keep = min(length - 1, len(hashed))
                    place, tail = place + len(hashed) - keep, hashed[len(hashed) - keep:]

    return rows.select("doc", "txt", F.col("text").cast("binary").alias("text"), "asked").mapInArrow(run, "a bigint, w bigint, doc bigint, txt bigint, first bigint")


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.xxhash64(own).alias("txt"), own.alias("text"))


def repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``txt`` (hash of the text), ``first`` and ``n_words``: stretches of words whose windows all occur in a smaller id.

    Stretches of one text may overlap; together they are its maximal repeats. Texts shorter than ``length`` words have none, nor have rows
    with a null id or text, which make no other row repeat either. Rows with one id do not make each other repeat.
    """
    own = named(docs, doc_id, text)
    runs = written(anchors(own, length), "anchors")
    classes = written(runs.groupBy("a", "e").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("rows")), "stretches")
    several = (classes.groupBy("a").agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("least").alias("d0"), F.max("most").alias("d1"), F.count(F.lit(1)).alias("rows"))
               .where("e0 <> e1 AND d0 < d1").select("a", "rows"))
    compare = skewless_join(classes.select("a", "e", "least"), several, ["a"], "rows").select("a", "e", F.lit(True).alias("ask"))
    shared = (classes.where("least < most").select("a", "e", F.lit(False).alias("ask")).unionByName(compare)
              .groupBy("a", "e").agg(F.max("ask").alias("ask")).join(classes, ["a", "e"]).select("a", "e", "least", "ask", "rows"))
    met = written(skewless_join(runs, written(shared, "shared"), ["a", "e"], "rows").where("doc > least OR ask"), "seeds")
    whole = met.where("doc > least").select("doc", "txt", "first", (F.col("n") + (length - 1)).alias("n_words"))
    windows = written(asked_windows(own, met.where("doc = least"), length), "windows")
    least = windows.groupBy("a", "w").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("rows")).where("least < most")
    partly = skewless_join(windows, written(least, "least"), ["a", "w"], "rows").where("doc > least")
    return whole.unionByName(partly.select("doc", "txt", "first", F.lit(length).cast("bigint").alias("n_words")))


def deduplicated(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",), kept_text: bool = False) -> DataFrame:
    """``doc`` (the carried columns), ``n_words``, ``n_removed`` and ``kept_sha256``, or ``kept`` with ``kept_text``: one row for each row of ``docs``.

    Words covered by a repeat (see ``repeats``) are removed; the others are joined by one space. Windows are judged on the input alone. Null and
    empty texts have no words; texts of any length are read whole, in pieces. Equal rows have equal results; an empty table gives no rows.
    """
    spans = repeats(docs, length, doc_id, text).groupBy("doc", "txt").agg(F.collect_set(F.struct("first", "n_words")).alias("spans"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("own"), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("body"),
                       F.xxhash64(F.col(f"`{text}`").cast("string")).alias("t"))
    joined = left.join(spans, (F.col("id") == F.col("doc")) & (F.col("t") == F.col("txt")), "left").select("own", "body", "spans")

    def make():
        def work(texts, found):
            out = []
            for body, own in zip(texts, found):
                gone = []
                if own.is_valid:
                    first, n = (own.values.field(c).to_numpy() for c in range(2))
                    order = np.argsort(first, kind="stable")
                    gone = np.stack((first[order], np.maximum.accumulate((first + n)[order])))
                out.append(removed(body, gone, kept_text))
            return [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
        return work

    last = "kept" if kept_text else "kept_sha256"
    out = map_documents(joined, "body", ["own"], make, f"n_words bigint, n_removed bigint, {last} string", [F.col("spans")])
    return out.select(F.col("doc.own").alias("doc"), "n_words", "n_removed", last)


def removed(text: bytes, gone, kept_text: bool) -> tuple[int, int, str]:
    """Words of a text, words within ``gone`` (first words, ascending, and ends), and what is left or its digest."""
    digest, parts, n_words, n_removed, begun = sha256(), [], 0, 0, False
    for words in pieces(text):
        if len(gone):
            at = np.arange(n_words, n_words + len(words))
            k = np.searchsorted(gone[0], at, "right")
            out = (k > 0) & (gone[1][k - 1] > at)
            kept = [words[i] for i in np.flatnonzero(~out)]
        else:
            kept = words
        n_words, n_removed = n_words + len(words), n_removed + len(words) - len(kept)
        if kept:
            piece = (b" " if begun else b"") + b" ".join(kept)
            begun = True
            parts.append(piece) if kept_text else digest.update(piece)
    return n_words, n_removed, b"".join(parts).decode() if kept_text else digest.hexdigest()
