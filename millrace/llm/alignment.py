"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often ids meet in the corpus.

Both tokenizers treat what follows a space that ends a word apart from what precedes it, so a text can be cut there (``CUT``) and both have a
token end at every cut. A fragment of a text is an open prefix up to its first cut, closed groups, and an open suffix from its last cut;
``join`` of two neighbours closes the bytes between them. ``join`` is associative, so the fragments of a very long text, made by many
tasks from ranges of its bytes, are composed in a tree of tasks; closed groups leave the tree at once, only open ends go up.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.common import received, send, written
from millrace.llm.tokens import byte_letters, tokenizer_path

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Places before a space that follows a character other than white space (ASCII, then of two and three bytes in UTF-8).
CUT = re.compile(rb"(?<=[\x21-\xff])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)(?= )")
#: Bytes of a range of a long text; a task has at most so many bytes of texts in work at once, too.
RANGE = 1 << 16
GATHERED = 1 << 22
#: Bytes of new units that are aligned at once, and links of a group beyond which they are counted by its different ids.
ADDED, LARGE = 1 << 19, 1024
#: Fragments that a task composes, as bits of their number.
FAN_BITS = 4
#: A pair of ids is one number: the id of A, then 15 bits for the id of B.
B_BITS = 15
#: Pairs of ids that are broadcast at once.
PAIRS = 2_000_000

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
CLOSED = "ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
PARTS = "pairs array<int>, weights array<bigint>"


class Tokenizers:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_letters().items()}
        self.bytes_a = {i: bytes([back[c] for c in entry]) if all(c in back for c in entry) else entry.encode() for entry, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = names.index("▁")
        self.length_a, self.length_b = np.array([len(self.bytes_a[i]) for i in range(len(self.bytes_a))]), np.array([len(x) for x in self.bytes_b])

    def ids(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with the space before them."""
        texts = [u.decode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if len(t) > 1 else [self.space] for t, ids in zip(texts, b)]

    def faithful(self, units: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the bytes of the tokens are those of the text, for each unit. Mostly they are, so all are compared at once first."""
        text, ends = b"".join(units), np.cumsum([len(u) for u in units])
        for own, table, sizes in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            ids = np.fromiter(chain.from_iterable(own), np.int64)
            stops = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[ids])))
            if not np.array_equal(stops[np.cumsum([len(x) for x in own])], ends) or b"".join(map(table.__getitem__, chain.from_iterable(own))) != text:
                break
        else:
            return np.ones(len(units), bool)
        return np.array([b"".join([self.bytes_a[i] for i in x]) == u == b"".join([self.bytes_b[i] for i in y]) for u, x, y in zip(units, a, b)], bool)


def cross(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of groups: pair of ids, group, and how many links it stands for. ``p`` and ``q`` are the tokens of A and B in each group.

    Groups of more than ``LARGE`` links are counted by their different ids, so that no product of long runs is written out.
    """
    first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
    times = np.where(p * q <= LARGE, q, 0)[group_a]
    at = np.repeat(first_b[group_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    keys, groups = [np.repeat(a, times) << B_BITS | b[at]], [np.repeat(group_a, times)]
    weights = [np.ones(len(at), np.int64)]
    for g in np.flatnonzero(p * q > LARGE):
        (x, m), (y, n) = (np.unique(ids[f[g]:f[g] + c[g]], return_counts=True) for ids, f, c in ((a, first_a, p), (b, first_b, q)))
        keys.append((x[:, None] << B_BITS | y[None, :]).ravel())
        weights.append((m[:, None] * n[None, :]).ravel())
        groups.append(np.full(len(keys[-1]), g))
    return np.concatenate(keys), np.concatenate(groups), np.concatenate(weights)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(weights[order], new)


def grown(table: np.ndarray, rows: int) -> np.ndarray:
    """The table with room for so many rows."""
    return table if rows <= len(table) else np.concatenate((table, np.zeros((max(rows - len(table), len(table)), table.shape[1]), table.dtype)))


class Closed(NamedTuple):
    """What closed groups amount to. Bytes that a tokenizer does not give back make ``ok`` false."""
    ok: bool
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: bytes
    pairs: np.ndarray
    weights: np.ndarray


NOTHING = Closed(True, 0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligner:
    """Aligns texts unit by unit (a unit lies between two cuts) and keeps units already met, bounded by ``keep_bytes``."""

    def __init__(self, byte_bpe: str, pieces: str, keep_bytes: int = 100 << 20):
        self.tokenizers, self.keep_bytes = Tokenizers(byte_bpe, pieces), keep_bytes
        self.length_a, self.length_b = self.tokenizers.length_a, self.tokenizers.length_b
        names = [str(i) for i in range(max(len(self.length_a), len(self.length_b)))]
        self.commas, self.bars, self.stops = (np.array([(n + mark).encode() for n in names], object) for mark in ",|;")
        self.widths = np.array([len(n) + 1 for n in names])
        self.clear()

    @staticmethod
    def shared(byte_bpe: str, pieces: str) -> Aligner:
        """One for all tasks of a Python worker."""
        import tokenizers
        kept = tokenizers.__dict__.setdefault("_aligners_by_path", {})
        if (byte_bpe, pieces) not in kept:
            kept[byte_bpe, pieces] = Aligner(byte_bpe, pieces)
        return kept[byte_bpe, pieces]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.numbers = np.zeros((1024, 7), np.int64)  # ok, the four numbers, place of the pairs, number of pairs
        self.pairs = np.zeros((4096, 2), np.int64)
        self.used = self.kept = 0

    def add(self, units: list[bytes]) -> None:
        """Tokenise and align new units, all at once."""
        a, b = self.tokenizers.ids(units)
        ok = self.tokenizers.faithful(units, a, b)
        a, b = ([ids if good else [] for ids, good in zip(own, ok)] for own in (a, b))
        n_a, n_b = (np.array([len(ids) for ids in own], np.int64) for own in (a, b))
        a, b = (np.fromiter(chain.from_iterable(own), np.int64) for own in (a, b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = end_a[np.isin(end_a, end_b, assume_unique=True)]  # a unit ends with a token of both, so groups lie within units
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        p, q = (np.bincount(g, minlength=len(ends)) for g in (group_a, group_b))
        last_a, last_b = np.cumsum(p) - 1, np.cumsum(q) - 1
        unit_of = np.repeat(np.arange(len(units)), n_a)[last_a]
        keys, groups, weights = cross(a, b, group_a, p, q)
        keys, weights = summed(unit_of[groups] << 32 | keys, weights)
        border = np.searchsorted(keys, np.arange(len(units) + 1) << 32)
        place_a, place_b = np.arange(len(a)) + (last_b - q + 1)[group_a], np.arange(len(b)) + (last_a + 1)[group_b]
        written_ids = np.empty(len(a) + len(b), object)
        for place, ids, last, end in ((place_a, a, last_a, self.bars), (place_b, b, last_b, self.stops)):
            written_ids[place] = self.commas[ids]
            written_ids[place[last]] = end[ids[last]]
        text = b"".join(written_ids.tolist())
        sizes = np.zeros(len(units), np.int64)
        np.add.at(sizes, np.repeat(np.arange(len(units)), n_a), self.widths[a])
        np.add.at(sizes, np.repeat(np.arange(len(units)), n_b), self.widths[b])
        stop = np.cumsum(sizes)
        self.texts += [text[x:y - 1] for x, y in zip((stop - sizes).tolist(), np.maximum(stop, stop - sizes + 1).tolist())]
        n_groups, n_links = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        np.add.at(n_groups, unit_of, 1)
        np.add.at(n_links, unit_of, p * q)
        k = len(self.known)
        self.numbers = grown(self.numbers, k + len(units))
        self.numbers[k:k + len(units)] = np.stack((ok, n_a, n_b, n_groups, n_links, self.used + border[:-1], np.diff(border)), 1)
        self.pairs = grown(self.pairs, self.used + len(keys))
        self.pairs[self.used:self.used + len(keys)] = np.stack((keys & 0xFFFFFFFF, weights), 1)
        self.used += len(keys)
        self.known.update(zip(units, range(k, k + len(units))))
        self.kept += sum(map(len, units)) + len(text) + 16 * len(keys) + 250 * len(units)

    def align(self, texts: list[bytes]) -> list[Closed]:
        """Closed groups of each text. Texts begin with a space or where a cut was."""
        if self.kept > self.keep_bytes:
            self.clear()
        units = [CUT.split(text) if text else [] for text in texts]
        sizes = [len(u) for u in units]
        flat = [u for own in units for u in own]
        at = list(map(self.known.get, flat))
        if None in at:
            new, size = [], 0
            for unit in dict.fromkeys([u for u, k in zip(flat, at) if k is None]):
                new.append(unit)
                size += len(unit)
                if size > ADDED:
                    self.add(new)
                    new, size = [], 0
            if new:
                self.add(new)
            at = list(map(self.known.get, flat))
        texts, joined, k = self.texts, [], 0
        for n in sizes:
            joined.append(b";".join([texts[i] for i in at[k:k + n]]))
            k += n
        at = np.array(at, np.int64)
        table = self.numbers[at]
        ends = np.cumsum(sizes)
        sums = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(table[:, :5], 0)))
        sums = sums[ends] - sums[ends - sizes]
        first, n = table[:, 5], table[:, 6]
        flat = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, weights = summed(np.repeat(np.repeat(np.arange(len(sizes)), sizes), n) << 32 | self.pairs[flat, 0], self.pairs[flat, 1])
        border = np.searchsorted(keys, np.arange(len(sizes) + 1) << 32)
        out = []
        for k, (size, text) in enumerate(zip(sizes, joined)):
            if sums[k, 0] < size:
                out.append(NOTHING._replace(ok=False))
                continue
            own = slice(border[k], border[k + 1])
            out.append(Closed(True, *sums[k, 1:].tolist(), text, keys[own] & 0xFFFFFFFF, weights[own]))
        return out


class Fragment(NamedTuple):
    """Open ends of a range of a text, with the places of their first bytes. Without a cut all is ``prefix`` and ``closed`` is false."""
    prefix: bytes
    prefix_at: int
    closed: bool
    suffix: bytes
    suffix_at: int


def fragment(part: bytes, at: int) -> tuple[Fragment, tuple[int, bytes] | None]:
    """The fragment of a range that begins at byte ``at``, and its closed bytes with their place.

    A cut is judged by up to three bytes before it, so there is none in the first three.
    """
    cuts = [m.start() for m in CUT.finditer(part) if m.start() > 2]
    if not cuts:
        return Fragment(part, at, False, b"", 0), None
    a, z = cuts[0], cuts[-1]
    return Fragment(part[:a], at, True, part[z:], at + z), ((at + a, part[a:z]) if a < z else None)


def join(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, bytes] | None]:
    """The fragment of two neighbours, and the bytes between them that are now closed. Associative."""
    if not left.closed:
        return right._replace(prefix=left.prefix + right.prefix, prefix_at=left.prefix_at), None
    if not right.closed:
        return left._replace(suffix=left.suffix + right.prefix), None
    return Fragment(left.prefix, left.prefix_at, True, right.suffix, right.suffix_at), (left.suffix_at, left.suffix + right.prefix)


def arrays_of(rows: Sequence[Closed]) -> list[pa.Array]:
    ends = np.concatenate(([0], np.cumsum([len(r.pairs) for r in rows]))).astype(np.int32)
    flat = [np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, np.int64) for c in (6, 7)]
    return [pa.array([r.ok for r in rows], pa.bool_()), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)],
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[1]))]


def short_texts(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """``doc``, the numbers, ``groups_sha256`` and pairs of each text (``body``: space and text; null: no tokens)."""
    schema = T.StructType([docs.schema["doc"], *T.StructType.fromDDL(f"{CLOSED}, {PARTS}, groups_sha256 string").fields])

    def run(batches):
        aligner = Aligner.shared(*files)
        for batch in batches:
            at = 0
            sizes = batch.column(1).cast(pa.binary())
            sizes = np.cumsum([len(s.as_buffer()) if s.is_valid else 0 for s in sizes])
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GATHERED)))
                part = batch.slice(at, min(end - at, 1024))
                at += part.num_rows
                found = [r if r.ok else NOTHING for r in aligner.align([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])]
                digests = pa.array([sha256(r.groups).hexdigest() if r.n_a else "" for r in found])
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays_of(found), digests], names=schema.names)

    return docs.select("doc", "body").mapInArrow(run, schema).drop("ok")


FRAGMENT = "prefix binary, prefix_at bigint, closed boolean, suffix binary, suffix_at bigint"
LONG = f"key bigint, i bigint, {FRAGMENT}, at bigint, groups binary, {CLOSED}, {PARTS}"
EMPTY = Fragment(b"", 0, False, b"", 0)


def long_rows(keys: list[int], numbers: list[int], fragments: list[Fragment], closed: list[tuple[int, int, bytes]], aligner: Aligner) -> pa.RecordBatch:
    """Rows of fragments (``i`` is their number) and of closed groups (``i`` is null), in one table."""
    found = aligner.align([c[2] for c in closed]) if closed else []
    n, m = len(keys), len(found)
    both = [*fragments, *[EMPTY] * m]
    columns = [pa.array([*keys, *[c[0] for c in closed]], pa.int64()), pa.array([*numbers, *[None] * m], pa.int64())]
    columns += [pa.array([f[c] for f in both], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()))]
    columns += [pa.array([*[0] * n, *[c[1] for c in closed]], pa.int64()), pa.array([*[b""] * n, *[r.groups for r in found]], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *arrays_of([*[NOTHING] * n, *found])], names=[f.split()[0] for f in LONG.split(", ")])


def ranges(docs: DataFrame, size: int) -> DataFrame:
    """Ranges of bytes of each text: ``key`` of the row, ``i``, ``part``, and ``doc`` with the first one."""
    rows = docs.select("doc", F.col("body").cast("binary").alias("body"), F.monotonically_increasing_id().alias("key"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / size).cast("int"))
    cut = F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("i"), F.substring("body", i * size + 1, F.lit(size)).alias("part")))
    parts = rows.select("doc", "key", F.explode(cut).alias("p")).select(F.when(F.col("p.i") == 0, F.col("doc")).alias("doc"), "key", "p.i", "p.part")
    return parts.repartition("key", "i")


def compose(parts: DataFrame, files: tuple[str, str], size: int) -> DataFrame:
    """Closed groups of all ranges: ``key``, ``at`` (place of their first byte), their numbers, text and pairs."""
    def leaves(batches):
        aligner = Aligner.shared(*files)
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                rows = batch.slice(k, 32).to_pylist()
                made = [fragment(r["part"], r["i"] * size) for r in rows]
                yield long_rows([r["key"] for r in rows], [r["i"] for r in rows], [f for f, _ in made],
                                [(r["key"], *c) for r, (_, c) in zip(rows, made) if c], aligner)

    def node(last: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["i"])
            key, closed, whole = rows[0]["key"], [], None
            for r in rows:
                own = Fragment(*[r[c] for c in Fragment._fields])
                whole, done = (own, None) if whole is None else join(whole, own)
                closed += [done] if done else []
            closed = [(key, *c) for c in closed]
            if not last:
                return pa.Table.from_batches([long_rows([key], [rows[0]["i"] >> FAN_BITS], [whole], closed, Aligner.shared(*files))])
            closed += [(key, whole.prefix_at, whole.prefix)] + ([(key, whole.suffix_at, whole.suffix)] if whole.closed else [])
            return pa.Table.from_batches([long_rows([], [], [], [c for c in closed if c[2]], Aligner.shared(*files))])
        return run

    level = written(parts.select("key", "i", "part").mapInArrow(leaves, LONG), "fragments")
    found = [level.where("i IS NULL")]
    top = parts.agg(F.max("i")).first()[0] or 0
    while True:
        last = top >> FAN_BITS == 0
        grouped = level.where("i IS NOT NULL").groupBy("key", F.shiftright("i", FAN_BITS).alias("up"))
        level = written(grouped.applyInArrow(node(last), LONG), "fragments")
        found.append(level.where("i IS NULL"))
        if last:
            break
        top >>= FAN_BITS
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("i", *Fragment._fields)


def digests(pieces: DataFrame) -> DataFrame:
    """``key`` and ``groups_sha256``: the digest of a text's groups, fed piece by piece in order."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            for own, groups in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "groups_sha256"])
                    key, state = own, sha256()
                else:
                    state.update(b";")
                state.update(groups.as_buffer())
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "groups_sha256"])

    rows = pieces.where("n_a > 0").select("key", "at", "groups").repartition("key").sortWithinPartitions("key", "at")
    return rows.select("key", "groups").mapInArrow(run, "key bigint, groups_sha256 string")


def weighed(rows: DataFrame, counts: DataFrame, n_pairs: int) -> DataFrame:
    """Replace ``pairs`` and ``weights`` by ``count_sum`` and ``n_best``, with the counts of pairs broadcast part by part.

    A part has ``PAIRS`` pairs of ids; where there are more, rows are written and read once for each part.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("pairs", "weights")]
    passes = max(1, -(-n_pairs // PAIRS))
    rows = rows.withColumns({"count_sum": F.lit(0).cast("bigint"), "n_best": F.lit(0).cast("bigint")})
    for k in range(passes):
        part = counts.where(F.pmod(F.hash("pair"), F.lit(passes)) == k).select("pair", "n", "top").toArrow()
        order = np.argsort(part["pair"].to_numpy())
        sent = send(rows.sparkSession, tuple(part[c].to_numpy()[order] for c in ("pair", "n", "top")))
        if k:
            rows = written(rows, "weighed")

        def run(batches, sent=sent):
            pair, n, top = received(sent)
            for batch in batches:
                own, weight = batch.column("pairs"), batch.column("weights").flatten().to_numpy()
                at, ids = own.offsets.to_numpy().astype(np.int64), own.flatten().to_numpy()
                at = at - at[0]
                place = np.minimum(np.searchsorted(pair, ids), max(len(pair) - 1, 0))
                hit = pair[place] == ids if len(pair) else np.zeros(len(ids), bool)
                add = [np.where(hit, n[place] * weight, 0), np.where(hit & top[place], weight, 0)] if len(pair) else [np.zeros(len(ids), np.int64)] * 2
                add = [np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in add]
                new = {name: pa.array(batch.column(name).to_numpy() + x[at[1:]] - x[at[:-1]]) for name, x in zip(("count_sum", "n_best"), add)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[f.name for f in kept], "count_sum", "n_best")


@dataclass
class Alignment:
    """``documents``: a row for each row; ``counts``: ``pair`` (see ``B_BITS``), ``a``, ``b``, ``n`` documents, ``top`` (highest of its ``a``)."""
    documents: DataFrame
    counts: DataFrame


def align(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", byte_bpe: str | None = None, pieces: str | None = None,
          long_bytes: int = RANGE) -> Alignment:
    """``doc`` (the carried columns), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each row.

    A reads a space and the text, B the text (it adds the space). Groups lie between places where tokens of both end; a link is a token of A and
    one of B in a group; a pair's count is the number of rows that have it linked; a link is best if its count is the highest of its id of A.
    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and ''. Texts longer than
    ``long_bytes`` are aligned by ranges in several tasks, with the same result. Equal rows count each; an empty table gives no rows.
    """
    files = (byte_bpe or tokenizer_path(BYTE_BPE), pieces or tokenizer_path(PIECES))
    own = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.when(own != "", F.concat(F.lit(" "), own)).alias("body"))
    small = F.coalesce(F.octet_length("body"), F.lit(0)) <= long_bytes
    short = written(short_texts(rows.where(small), files), "aligned")
    parts = written(ranges(rows.where(~small), long_bytes), "ranges")
    found = compose(parts, files, long_bytes)
    totals = found.groupBy("key").agg(F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in NUMBERS])
    heads = (parts.where("i = 0").select("key", "doc").join(totals, "key", "left").join(digests(found), "key", "left")
             .select("key", "doc", *[F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in NUMBERS],
                     F.when(F.col("ok"), F.col("groups_sha256")).otherwise(F.lit("")).alias("groups_sha256")))
    heads = written(heads, "heads")
    each = found.select("key", F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.weights").alias("w"))
    each = each.groupBy("key", "pair").agg(F.sum("w").alias("w")).join(heads.where("n_a > 0").select("key"), "key", "left_semi")
    many = each.groupBy("key", F.shiftright("pair", 20).alias("part")).agg(F.collect_list(F.struct("pair", "w")).alias("x"))
    many = written(many.select("key", F.col("x.pair").alias("pairs"), F.col("x.w").alias("weights")), "pairs")
    met = short.select("pairs").unionByName(many.select("pairs")).select(F.explode("pairs").alias("pair"))
    counts = written(met.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts").withColumn("a", F.shiftright("pair", B_BITS))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = written(counts.join(best, "a").select("pair", "a", F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", (F.col("n") == F.col("most")).alias("top")), "counts")
    n_pairs = counts.count()
    part = weighed(many, counts, n_pairs).groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    whole = heads.join(part, "key", "left").na.fill(0, ["count_sum", "n_best"])
    columns = ["doc", *NUMBERS, "n_best", "count_sum", "groups_sha256"]
    return Alignment(weighed(short, counts, n_pairs).select(*columns).unionByName(whole.select(*columns)), counts)
