"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import WORD, labelled, map_documents, received, send
from millrace.llm.stats import COUNTS, shares, structure

WORD_SLOTS = 4096
#: Borders of the bands of each share; a band is a feature of its own beside the share itself.
BANDS = {"words": (5, 10, 20, 50, 100, 300, 1000, 5000), "word_length": (2, 3, 4, 5, 6, 8, 12, 20), "symbols": (.01, .05, .2, .5), "dup_lines": (.01, .1, .3, .6),
         "repeats": (.02, .1, .3, .5, .8), "upper": (.01, .05, .15, .5, .9), "digits": (.01, .05, .2), "marks": (.01, .05, .3, .8), "stops": (.001, .01, .05, .1, .5),
         "bare": (.01, .05, .2, .4), "line_words": (5, 10, 30, 100, 1000)}
#: Shares that are no fractions are divided by a typical size and cut at the double of it.
SCALE = {"words": 1000.0, "word_length": 10.0, "line_words": 100.0}


class Features:
    """Sparse rows: words hashed to slots with the square root of their counts, scaled to length 1; shares, bands and metadata.

    Metadata are numbers; each gives log(1 + |x|), whether it is null, and its sign. The number of entries of a row is bounded by the slots.
    """

    def __init__(self, n_meta: int, word_slots: int = WORD_SLOTS, keep: int = 500_000):
        self.word_slots, self.keep, self.slots = word_slots, keep, {}
        self.n_meta = n_meta
        self.size = word_slots + sum(len(b) + 2 for b in BANDS.values()) + 3 * n_meta

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(WORD.findall(text.lower()))
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        slots = self.slots
        if len(slots) > self.keep:
            slots.clear()
        for word in [w for w in counts if w not in slots]:
            slots[word] = zlib.crc32(word) % self.word_slots
        sums = np.bincount(np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts)),
                           np.fromiter(counts.values(), np.float64, len(counts)))
        at = np.flatnonzero(sums)
        value = np.sqrt(sums[at])
        return at, value / np.sqrt((value ** 2).sum())

    def rows(self, texts: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column numbers, values and the end of each row."""
        counts = np.array([structure(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
        dense_at, dense = [], []
        at = self.word_slots
        for name, share in shares(counts).items():
            scaled = np.minimum(share / SCALE.get(name, 1.0), 2.0)
            band = np.searchsorted(BANDS[name], share, side="right")
            dense_at += [np.full(len(texts), at), at + 1 + band]
            dense += [scaled, np.ones(len(texts))]
            at += len(BANDS[name]) + 2
        for k in range(self.n_meta):
            x = meta[:, k]
            gone = ~np.isfinite(x)
            x = np.where(gone, 0.0, x)
            dense_at += [np.full(len(texts), at), np.full(len(texts), at + 1), np.full(len(texts), at + 2)]
            dense += [np.log1p(np.abs(x)) / 10, gone.astype(float), np.sign(x)]
            at += 3
        dense_at, dense = np.stack(dense_at, 1), np.stack(dense, 1)
        index, value, ends = [], [], []
        total = 0
        for k, text in enumerate(texts):
            i, v = self.words(text)
            index += [i, dense_at[k]]
            value += [v, dense[k]]
            total += len(i) + dense_at.shape[1]
            ends.append(total)
        return np.concatenate(index or [np.zeros(0, np.int64)]), np.concatenate(value or [np.zeros(0)]), np.array(ends, np.int64)


class FactorisationMachine:
    """score = sigmoid(bias + w.x + sum over pairs of <v_i, v_j> x_i x_j).

    The pair term takes linear time: half of the sum over factors of (sum v x) ** 2 - sum (v x) ** 2.
    """

    def __init__(self, size: int, factors: int = 8, seed: int = 7):
        self.bias, self.linear = 0.0, np.zeros(size)
        self.pairs = np.random.default_rng(seed).normal(0, 0.02, (size, factors))

    def raw(self, index, value, ends):
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        vx = self.pairs[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx ** 2).sum(1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, index, value, ends) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, ends)[0], -40, 40))) if len(ends) else np.zeros(0)

    def fit(self, index, value, ends, label, epochs: int = 15, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 7):
        """Mini-batches of AdaGrad on the logistic loss; rows are given as in ``Features.rows``."""
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.bias = float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
        g_bias, g_linear, g_pairs = 1.0, np.full(len(self.linear), 1.0), np.full(self.pairs.shape, 1.0)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            shuffled = order.permutation(len(ends))
            for at in range(0, len(shuffled), batch):
                rows = shuffled[at:at + batch]
                sizes = ends[rows] - starts[rows]
                own_ends = np.cumsum(sizes)
                pick = np.repeat(starts[rows] - own_ends + sizes, sizes) + np.arange(own_ends[-1])
                i, x = index[pick], value[pick]
                raw, sums = self.raw(i, x, own_ends)
                error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[rows]) / len(rows)
                per = np.repeat(error, sizes)
                d_pairs = per[:, None] * x[:, None] * (np.repeat(sums, sizes, axis=0) - self.pairs[i] * x[:, None])
                used, place = np.unique(i, return_inverse=True)
                d_linear = np.bincount(place, per * x, len(used)) + decay * self.linear[used]
                d_factor = np.stack([np.bincount(place, d_pairs[:, f], len(used)) for f in range(d_pairs.shape[1])], 1) + decay * self.pairs[used]
                g_bias += float(error.sum()) ** 2
                g_linear[used] += (d_linear * len(rows)) ** 2 / batch
                g_pairs[used] += (d_factor * len(rows)) ** 2 / batch
                scale = rate * batch / 8
                self.bias -= scale * float(error.sum()) / np.sqrt(g_bias)
                self.linear[used] -= scale * d_linear / np.sqrt(g_linear[used])
                self.pairs[used] -= scale * d_factor / np.sqrt(g_pairs[used])
        return self


def numbers(columns, n: int) -> np.ndarray:
    """Arrow number columns as a matrix; nulls are NaN."""
    return np.stack([np.array([np.nan if v is None else float(v) for v in c.to_pylist()], float) for c in columns], 1) if columns else np.zeros((n, 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", metadata=("n_chars",), sample: int = 5000,
          factors: int = 8, word_slots: int = WORD_SLOTS) -> FactorisationMachine | None:
    """Fit on at most ``sample`` labelled rows outside fold 0 (see ``labelled``); None if there are none.

    Tasks turn texts into sparse rows; the driver gets at most ``sample`` rows of at most ``word_slots`` entries each.
    """
    rows = labelled(docs.select("doc_id", *dict.fromkeys([text, *metadata])), labels, label, sample)
    n_meta = len(metadata)

    def make():
        features = Features(n_meta, word_slots)

        def work(texts, *meta):
            index, value, ends = features.rows(texts, numbers(meta, len(texts)))
            cuts = np.concatenate(([0], ends)).tolist()
            pack = lambda a, kind: pa.array([a[p:q].astype(kind).tobytes() for p, q in zip(cuts, cuts[1:])], pa.binary())
            return [pack(index, "<u2"), pack(value, "<f4")]

        return work

    got = map_documents(rows, text, ["_label"], make, "at binary, value binary", [F.col(f"`{m}`").try_cast("double") for m in metadata])
    got = got.select("doc._label", "at", "value", F.xxhash64("at", "value").alias("h")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.h, r._label))
    ends = np.cumsum([len(r["at"]) // 2 for r in got])
    index = np.frombuffer(b"".join(r["at"] for r in got), "<u2").astype(np.int64)
    value = np.frombuffer(b"".join(r["value"] for r in got), "<f4").astype(np.float64)
    model = FactorisationMachine(Features(n_meta, word_slots).size, factors)
    return model.fit(index, value, ends, np.array([r._label for r in got], float))


def score(docs: DataFrame, model: FactorisationMachine | None, carry=("doc_id",), text: str = "text", metadata=("n_chars",),
          threshold: float = 0.3, word_slots: int = WORD_SLOTS) -> DataFrame:
    """``doc``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``; without a model every score is 0.5.

    Null and empty texts are scored by their structure and metadata alone; nulls in metadata are a feature. Repeated rows score alike.
    """
    sent = send(docs.sparkSession, model)
    n_meta = len(metadata)

    def make():
        fm, features = received(sent), Features(n_meta, word_slots)

        def work(texts, *meta):
            if fm is None:
                return [pa.array(np.full(len(texts), 0.5))]
            meta, out = numbers(meta, len(texts)), []
            for at in range(0, len(texts), 128):
                out.append(fm.score(*features.rows(texts[at:at + 128], meta[at:at + 128])))
            return [pa.array(np.concatenate(out or [np.zeros(0)]))]

        return work

    scored = map_documents(docs, text, carry, make, "score double", [F.col(f"`{m}`").try_cast("double") for m in metadata])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
