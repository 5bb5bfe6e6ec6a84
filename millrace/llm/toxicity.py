"""Toxicity: class-conditional Kneser-Ney bigram models, compared by length-normalised log-likelihood."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import WORD, fold, labelled, map_documents, received, send

DISCOUNT = 0.75
#: Texts are compared as a whole and in windows of so many words, so that a long text does not drown a short insult.
WINDOWS = (8, 64)
#: And by their most telling different words.
TOPS = (1, 2, 4)
#: A rare word counts as its first bytes where these are frequent enough, else as the unknown word.
PREFIXES = (10, 8, 6)
#: Pseudo-count with which a context falls back on the words' own probabilities.
BACK_OFF = 5.0
MEASURES = ["whole", *[f"window_{w}" for w in WINDOWS], *[f"top_{t}" for t in TOPS]]
CLASSES = (0, 1)
#: Of a sketch that counts distinct contexts.
REGISTERS = 256
#: No word counts for more, so that none decides alone.
LIMIT = 6.0


def units(word: bytes) -> list[bytes]:
    """The word, then its longer and shorter beginnings, each with a mark that no word has."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def beginnings(words: list[bytes]) -> list[np.ndarray]:
    """Hashes of the beginnings of each word, from the longest on; 0 where the word is no longer than that."""
    sizes, out = np.fromiter(map(len, words), np.int64, len(words)), []
    for k in PREFIXES:
        longer = np.flatnonzero(sizes > k)
        keys = np.zeros(len(words), np.uint64)
        keys[longer] = hashed([words[i][:k] + b"*" for i in longer.tolist()])
        out.append(keys)
    return out


def places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in an ascending table; -1 for none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Vocabulary:
    """Numbers words by the first of their units that was kept (given by hashes); 0 is the unknown word."""

    def __init__(self, kept: np.ndarray, keep_words: int = 900_000):
        self.order = np.argsort(kept)
        self.table, self.size, self.keep_words = kept[self.order], len(kept) + 1, keep_words
        self.met: dict[bytes, int] = {}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        at = places(self.table, keys)
        return np.where(at >= 0, self.order[at] + 1, 0) if len(self.table) else np.zeros(len(keys), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        out = self.lookup(hashed(words))
        rest = np.flatnonzero(out == 0)
        for keys in beginnings([words[k] for k in rest]):
            found = self.lookup(keys)
            out[rest] = np.where(out[rest] == 0, found, out[rest])
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and where each text ends."""
        if len(self.met) > self.keep_words:
            self.met.clear()
        parts = [WORD.findall(text.lower()) for text in texts]
        words = list(chain.from_iterable(parts))
        new = list(set(words).difference(self.met))
        self.met.update(zip(new, self.numbers(new).tolist()))
        return np.fromiter(map(self.met.__getitem__, words), np.int64, len(words)), np.cumsum([len(p) for p in parts])


def split(group: np.ndarray, item: np.ndarray, lower: np.ndarray, counts: np.ndarray, totals: np.ndarray, pseudo: float, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Discounted P(item | its group, class) of counted items, and by class and group what is left for the lower order.

    An item's count is split between the classes as seen, with ``pseudo`` more split as the lower order (``lower`` by class and ``item``) would have it,
    so that what a rare item adds grows with its count. ``totals``: by class and group. Items are worked on block by block.
    """
    of = totals + BACK_OFF * totals.sum(1, keepdims=True) / max(totals.sum(), 1.0)
    groups, blocks = of.shape[1], [slice(k, k + block) for k in range(0, len(group), block)]

    def dealt(part: slice) -> tuple[np.ndarray, np.ndarray]:
        both = counts[:, part].sum(0).astype(float)
        expected = of[:, group[part]] * lower[:, item[part]]
        expected /= expected.sum(0)
        return both, both * (counts[:, part] + pseudo * expected) / (both + pseudo)

    added = np.zeros_like(of)
    for part in blocks:
        added += [np.bincount(group[part], d, groups) for d in dealt(part)[1]]
    # What is dealt to a group may exceed its own total; the larger of the two keeps probabilities below 1.
    whole = np.maximum(of, of - totals + added)
    share, back = np.zeros((2, len(group)), np.float32), np.ones_like(of)
    for part in blocks:
        both, own = dealt(part)
        own *= np.maximum(both - DISCOUNT, 0) / np.maximum(both, 1) / whole[:, group[part]]
        share[:, part] = own
        back -= [np.bincount(group[part], d, groups) for d in own]
    return share, back


class KneserNey:
    """P(word | previous, class), interpolated: pairs, then in how many contexts a word occurs in the class, then in the whole corpus.

    The last counts are shared by both classes, so a word that neither has seen often says nothing. Pairs are counted once a document,
    which keeps one text's repetitions from speaking for a class.
    """

    def __init__(self, size: int, shared: np.ndarray, continuations: np.ndarray, contexts: np.ndarray, keys: np.ndarray, docs: np.ndarray,
                 pool: np.ndarray, least_pair_docs: int = 20):
        """``shared``: continuation count of each number in the corpus. By class (rows) and number: ``continuations`` (contexts) and
        ``contexts`` (documents of all pairs that it begins); by class and pair: ``docs`` of ``keys`` (previous * size + word, ascending).
        ``pool``: for a number that few sampled documents hold that of its beginning (0: none), else itself.

        P(rare word) = P(its pool) * P(word | its pool); the corpus counts say how a pool's words share it where the class does not.
        No word and no pair is left out, see ``split``.
        """
        self.size, self.keys, self.sent = size, keys, None
        self.back, self.pair = np.ones((2, size)), np.zeros((2, len(keys) + 1), np.float32)
        pooled = np.array([np.bincount(pool, continuations[c], size) for c in CLASSES])
        whole = np.bincount(pool, shared + 0.5, size)
        base, inside = whole / whole.sum(), np.broadcast_to((shared + 0.5) / whole[pool], (2, size))
        kept = np.maximum(pooled - DISCOUNT, 0)
        total = np.maximum(pooled.sum(1, keepdims=True), 1.0)
        pools = kept / total + (1 - kept.sum(1, keepdims=True) / total) * base
        rare = np.flatnonzero((pool != np.arange(size)) & (continuations.sum(0) > 0))
        share, back = split(pool[rare], rare, inside, continuations[:, rare], pooled, least_pair_docs)
        of_pool = back[:, pool] * inside
        of_pool[:, rare] += share
        self.unigram = pools[:, pool] * of_pool
        if len(keys):
            self.pair[:, :-1], self.back = split(keys // size, keys % size, self.unigram, docs, contexts, least_pair_docs)

    def __getstate__(self):
        return {**self.__dict__, "sent": None}

    def ratios(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(word | previous, toxic) - log P(word | previous, ordinary) at each word; ``ends``: where texts end."""
        previous = previous_of(ids, ends)
        keys = np.where((previous > 0) & (ids > 0), previous * self.size + ids, -1)
        last = len(self.keys)
        at = np.minimum(np.searchsorted(self.keys, keys), max(last - 1, 0))
        at = np.where(self.keys[at] == keys, at, last) if last else np.zeros(len(ids), np.int64)
        chance = [self.pair[c, at] + self.back[c, previous] * self.unigram[c, ids] for c in CLASSES]
        return np.clip(np.log(chance[1]) - np.log(chance[0]), -LIMIT, LIMIT)

    def measures(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text (``ends``: where they end) the mean log ratio of all words, the greatest mean of a window of each size, and the mean of the greatest
        ratios of different words; a text with fewer words than a window or a number of words is taken as a whole."""
        ratios = self.ratios(ids, ends)
        sums = np.concatenate(([0.0], np.cumsum(ratios)))
        out, start = np.zeros((len(ends), len(MEASURES))), 0
        for k, end in enumerate(ends.tolist()):
            if end > start:
                own = sums[start:end + 1]
                widths = [min(w, end - start) for w in WINDOWS]
                top = greatest(ids[start:end], ratios[start:end], TOPS[-1])
                out[k] = ((own[-1] - own[0]) / (end - start), *[(own[w:] - own[:-w]).max() / w for w in widths],
                          *[sum(top[:t]) / len(top[:t]) for t in TOPS])
            start = end
        return out


def greatest(ids: np.ndarray, ratios: np.ndarray, n: int, near: int = 64) -> list[float]:
    """The greatest ratios of up to ``n`` different words. A few candidates do, unless too few of them differ."""
    few = np.argpartition(ratios, len(ratios) - near)[-near:] if len(ratios) > 2 * near else np.arange(len(ratios))
    best: dict[int, float] = {}
    for at in few[np.argsort(-ratios[few])].tolist():
        best.setdefault(int(ids[at]), float(ratios[at]))
        if len(best) == n:
            return list(best.values())
    return list(best.values()) if len(few) == len(ratios) else greatest(ids, ratios, n, len(ratios))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (intercept last) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def unit_documents(rows: DataFrame, text: str) -> DataFrame:
    """Units by hash, in how many documents they occur, whether they are beginnings, and a word's own beginnings; added up within each batch first."""
    own = [f"p{k}" for k in range(len(PREFIXES))]

    def run(batches):
        for batch in batches:
            docs = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                docs.update({u for w in set(WORD.findall((text or b"").lower())) for u in units(w)})
            names = list(docs)
            part = np.array([u.endswith(b"*") for u in names], bool)
            columns = [hashed(names).view(np.int64), np.array(list(docs.values()), np.int32), part, *[np.where(part, 0, p.view(np.int64)) for p in beginnings(names)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["unit", "docs", "part", *own])

    return (rows.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "unit bigint, docs int, part boolean, " + ", ".join(f"{c} bigint" for c in own))
            .groupBy("unit").agg(F.sum("docs").cast("int").alias("docs"), F.max("part").alias("part"), *[F.max(c).alias(c) for c in own]))


def corpus_documents(docs: DataFrame, text: str, of: np.ndarray) -> np.ndarray:
    """In how many of all documents each of the words ``of`` (ascending hashes) occurs. A task makes one row for each of them that it meets."""
    sent, many, keep = send(docs.sparkSession, of), len(of), 900_000

    def run(batches):
        table = received(sent)
        met, counts = {}, np.zeros(many + 1, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                if len(met) > keep:
                    met = {}
                words = list(chain.from_iterable([set(WORD.findall((t or b"").lower())) for t in batch.column(0).slice(at, 128).cast(pa.binary()).to_pylist()]))
                new = list(set(words).difference(met))
                met.update(zip(new, (places(table, hashed(new)) + 1).tolist()))
                seen, n = np.unique(np.fromiter(map(met.__getitem__, words), np.int64, len(words)), return_counts=True)
                counts[seen] += n.astype(np.int32)
        counts = counts[1:]
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen].astype(np.int64))], names=["k", "docs"])

    table = (docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "k int, docs bigint").groupBy("k").agg(F.sum("docs").alias("docs")).toArrow())
    sent.destroy()
    out = np.zeros(many, np.int64)
    out[table["k"].to_numpy()] = table["docs"].to_numpy()
    return out


def previous_of(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The item before each one in its text; 0 for the first."""
    previous = np.concatenate((np.zeros(1, items.dtype), items[:-1]))[:len(items)]
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    previous[starts[starts < len(items)]] = 0
    return previous


def pair_documents(rows: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``cls``, ``key`` (previous * size + word) and ``docs`` in which the pair occurs."""
    sent, size = send(rows.sparkSession, vocabulary), vocabulary.size

    def run(batches):
        own = received(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, ends = own.of([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()])
                sizes = np.diff(ends, prepend=0)
                keys = previous_of(ids, ends) * size + ids
                doc = np.repeat(np.arange(len(ends)), sizes)
                order = np.lexsort((keys, doc))
                keys, doc = keys[order], doc[order]
                once = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))  # a pair counts once a document
                toxic = np.array([cls == 1 for cls in part.column(1).to_pylist()], bool)[doc[once]]
                for cls in CLASSES:
                    found, docs = np.unique(keys[once][toxic == cls], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cls, np.int32)), pa.array(found), pa.array(docs.astype(np.int32))], names=["cls", "key", "docs"])

    return (rows.select(F.col(f"`{text}`").cast("string"), "_label").mapInArrow(run, "cls int, key bigint, docs int")
            .groupBy("cls", "key").agg(F.sum("docs").cast("int").alias("docs")))


def cells(own: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register and rank of each pair of word hashes in a HyperLogLog sketch."""
    mixed = own * np.uint64(0x9E3779B97F4A7C15) + previous
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    length = np.frexp((mixed >> np.uint64(11)).astype(float))[1]
    return (mixed & np.uint64(REGISTERS - 1)).astype(np.int64), (54 - length).astype(np.uint8)


def distinct(registers: np.ndarray) -> np.ndarray:
    """Estimates of a sketch a row; few pairs are counted by the registers that are still empty."""
    raw = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS ** 2 / np.exp2(-registers.astype(float)).sum(1)
    empty = (registers == 0).sum(1)
    return np.where((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * np.log(REGISTERS / np.maximum(empty, 1)), raw)


def corpus_continuations(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """In how many contexts each number occurs in all documents: distinct pairs of a word that has the number and the word before it.

    Contexts are the corpus's own words, with or without a number. Pairs are counted by HyperLogLog sketches of ``REGISTERS`` registers, which have
    no ceiling; their standard error is 1.04 / sqrt(REGISTERS), 6.5 %. A task makes one row for each number it meets.
    """
    sent, size, many = send(docs.sparkSession, vocabulary), vocabulary.size, vocabulary.keep_words

    def run(batches):
        own = received(sent)
        registers = np.zeros(size * REGISTERS, np.uint8)
        met, numbers, hashes = {}, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 128):
                if len(met) > many:
                    met, numbers, hashes = {}, numbers[:0], hashes[:0]
                parts = [WORD.findall((t or b"").lower()) for t in texts[at:at + 128]]
                new = list(set(chain.from_iterable(parts)).difference(met))
                met.update(zip(new, range(len(met), len(met) + len(new))))
                numbers = np.concatenate((numbers, own.numbers(new)))
                hashes = np.concatenate((hashes, hashed(new)))
                ids = np.fromiter(map(met.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
                if not len(ids):
                    continue
                key = hashes[ids]
                at_register, rank = cells(key, previous_of(key, np.cumsum([len(words) for words in parts])))
                np.maximum.at(registers, numbers[ids] * REGISTERS + at_register, rank)
        for first in range(0, size, 1 << 14):
            table = registers[first * REGISTERS:(first + (1 << 14)) * REGISTERS].reshape(-1, REGISTERS)
            row, column = np.nonzero(table)
            seen, counts = np.unique(row, return_counts=True)
            data = np.column_stack([column.astype(np.uint8), table[row, column]]).tobytes()
            ends = np.concatenate(([0], np.cumsum(counts * 2))).astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(seen), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array((first + seen).astype(np.int32)), sketch], names=["number", "sketch"])

    def merge(batches):
        place: dict[int, int] = {}
        registers = np.zeros((1024, REGISTERS), np.uint8)
        for batch in batches:
            numbers, row = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            own = np.array([place.setdefault(n, len(place)) for n in numbers.tolist()], np.int64)
            if len(place) > len(registers):
                registers = np.concatenate((registers, np.zeros((max(len(place) - len(registers), len(registers)), REGISTERS), np.uint8)))
            sketch = batch.column(1)
            ends = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset:sketch.offset + len(sketch) + 1]
            pairs = np.frombuffer(sketch.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, 2)
            at = np.repeat(own[row] * REGISTERS, np.diff(ends) // 2) + pairs[:, 0]
            np.maximum.at(registers.reshape(-1), at, pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.int32()), pa.array(distinct(registers[:len(place)]))], names=["number", "contexts"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "number int, sketch binary")
    counts = rows.repartition("number").mapInArrow(merge, "number int, contexts double").toArrow()
    sent.destroy()
    out = np.zeros(size)
    out[counts["number"].to_numpy()] = counts["contexts"].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", sample: int = 12_000, least_docs: int = 4,
          least_pair_docs: int = 20):
    """Vocabulary, model and calibration weights from at most ``sample`` labelled rows outside fold 0 and the whole corpus.

    None without labels of both classes. Words in fewer than ``least_docs`` of all documents count as their beginnings; words in fewer of the
    sampled ones, and pairs, are discounted (``least_pair_docs``, see ``split``). The sample bounds the class counts only: a word that it does not hold
    has class counts of 0, so its corpus count is a factor of both classes' probabilities and cancels in their ratio. So numbers are given to
    the sample's words, and documents and contexts are counted over the whole corpus. A quarter of the labelled rows (those of fold 1)
    are not counted; they calibrate the score.
    """
    rows = labelled(docs.select("doc_id", text), labels, label, sample)
    counted, held = rows.where(fold(F.col("doc_id")) != 1), rows.where(fold(F.col("doc_id")) == 1)
    table = unit_documents(counted, text).toArrow().sort_by("unit")
    if not table.num_rows:
        return None
    unit, docs_in_sample, part = table["unit"].to_numpy().view(np.uint64), table["docs"].to_numpy(), table["part"].to_numpy()
    often = docs_in_sample >= least_docs
    rare = np.flatnonzero(~often & ~part)  # words that the sample has seldom are kept if the corpus has them often
    rare = rare[np.argsort(unit[rare])]
    kept = often.copy()
    kept[rare] = corpus_documents(docs, text, unit[rare]) >= least_docs
    vocabulary = Vocabulary(unit[kept])
    size = vocabulary.size
    pool = np.where(often[kept], np.arange(1, size), 0)
    for k in range(len(PREFIXES)):  # a beginning is kept only if the sample has it often
        pool = np.where(pool == 0, vocabulary.lookup(table[f"p{k}"].to_numpy().view(np.uint64)[kept]), pool)
    pool = np.concatenate((np.zeros(1, np.int64), pool))
    del table, unit, rare
    table = pair_documents(counted, text, vocabulary).toArrow()
    cls, key, found = (table[c].to_numpy() for c in ("cls", "key", "docs"))
    del table
    if len(np.unique(cls)) < 2:
        return None
    continuations = np.array([np.bincount(key[cls == c] % size, minlength=size) for c in CLASSES], float)
    contexts = np.array([np.bincount(key[cls == c] // size, found[cls == c], size) for c in CLASSES], float)
    known = (key >= size) & (key % size > 0)
    cls, key, found = cls[known], key[known], found[known]
    keys, place = np.unique(key, return_inverse=True)
    pairs = np.zeros((2, len(keys)), np.int32)
    pairs[cls, place] = found
    del cls, key, found, known, place
    model = KneserNey(size, corpus_continuations(docs, text, vocabulary), continuations, contexts, keys, pairs, pool, least_pair_docs)
    del pairs, continuations, contexts
    got = measured(held, vocabulary, model, ["_label"], text).select("doc._label", *MEASURES).collect()
    got.sort(key=lambda r: [r[m] for m in MEASURES])
    x, y = np.array([[r[m] for m in MEASURES] for r in got]).reshape(-1, len(MEASURES)), np.array([float(r["_label"] == 1) for r in got])
    return vocabulary, model, (logistic(x, y) if len(set(y)) == 2 else np.array([5.0] * len(MEASURES) + [-5.0]))


def measured(docs: DataFrame, vocabulary: Vocabulary, model: KneserNey, carry, text: str) -> DataFrame:
    # Sent once for calibration and scoring: each copy lies on every executor's disk.
    app = docs.sparkSession.sparkContext.applicationId
    if model.sent is None or model.sent[0] != app:
        model.sent = app, send(docs.sparkSession, (vocabulary, model))
    sent = model.sent[1]

    def make():
        words, own = received(sent)

        def work(texts):
            parts = [own.measures(*words.of(texts[at:at + 128])) for at in range(0, len(texts), 128)]
            every = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))
            return [pa.array(np.ascontiguousarray(every[:, k])) for k in range(len(MEASURES))]

        return work

    return map_documents(docs, text, carry, make, ", ".join(f"{m} double" for m in MEASURES))


def score(docs: DataFrame, trained, carry=("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc``, the length-normalised log-likelihood ratios (``MEASURES``), ``score`` (0 to 1) and ``predicted``.

    Null and empty texts have ratios of 0 and get the score of such; repeated rows score alike; without a model every score is 0.
    """
    if trained is None:
        doc = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")
        return docs.select(doc, *[F.lit(0.0).alias(m) for m in MEASURES], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    vocabulary, model, weights = trained
    odds = sum((F.col(m) * float(w) for m, w in zip(MEASURES, weights)), F.lit(float(weights[-1])))
    return (measured(docs, vocabulary, model, carry, text).withColumn("score", 1 / (1 + F.exp(-odds)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
