"""N-gram Jaccard join with adaptive multi-match prefixes; documents that link, directly or by others, form a component.

Shingles stand in one order for all documents: rare ones first, by a counting sketch of the whole corpus, ties by hash. Two
sets of sizes m and n that link share at least ``o = ceil(t (m + n) / (1 + t))`` shingles, so for every k their first
``m - o + k`` and ``n - o + k`` shingles share at least k (k <= o). Each document chooses its k by estimated cost: a longer prefix
means more entries, but only documents that share k of them are compared. Pairs use the smaller k of the two.

Pairs within a component are not needed. Where many documents share a shingle, some rounds therefore link documents with
hubs and merge components; then every pair of different components that shares enough is verified, so no link is lost.
Whole sets travel only for pairs that a small map of bits of each set has not ruled out (``possible``).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import lean, map_documents, written

SKETCH_BITS = 20
SLICE = 4096
#: Shingles this far above the sketch's mean are known to be shared; they are not gathered with others but sent as rows.
HOT = 256
#: Documents that share a shingle take part in rounds of hubs if there are more of them than this.
BUSY = 8
#: Hubs of a shingle in a round, and how many of them a document is compared with.
HUBS, ASKED = 8, 4
MATCHES = (1, 2, 3, 4, 6, 8)
#: Cost of one comparison of two documents against that of one entry of a prefix.
COMPARISON = 20.0
BLOOM_BITS = 24
#: Entries that a task packs at once.
GATHERED = 1_000_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams. Words are parted by ASCII white space, A-Z are lowered."""

    def __init__(self, size: int):
        self.size = size

    def of(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashed = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        n = max(1, len(words) - self.size + 1)
        out = np.full(n, len(words) if len(words) < self.size else self.size, np.uint64)
        for k in range(min(self.size, len(words))):
            out = (out ^ hashed[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def node_of(shingles: np.ndarray) -> int | None:
    """One name of 64 bits for all documents with the same set; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def sets(batches, size: int):
    """The set of each text in turn."""
    shingler = Shingler(size)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for text in batch.column(0).slice(at, 256).cast(pa.binary()).to_pylist():
                yield shingler.of(text or b"")


def members(docs: DataFrame, carry, text: str, size: int) -> DataFrame:
    """``doc`` (the carried columns), ``node`` (null without words) and ``n_shingles`` of each row."""
    def make():
        lean()
        shingler = Shingler(size)

        def work(texts):
            own = [shingler.of(t) for t in texts]
            return [pa.array([node_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64())]

        return work

    return map_documents(docs, text, carry, make, "node bigint, n_shingles bigint")


def sketch(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """How many documents have a shingle of each bucket. Its size is fixed; each task sends the buckets that it met.

    Slices of buckets are added up in two steps, so that no task gets a part from every other one.
    """
    buckets = 1 << SKETCH_BITS

    def count(batches):
        lean()
        total, met = np.zeros(buckets, np.uint32), 0
        for own in sets(batches, size):
            at, n = np.unique(own & np.uint64(buckets - 1), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.uint32)
            met += 1
        if met:
            parts = total.reshape(-1, SLICE)
            used = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(parts[k].astype("<u8").tobytes(), 1) for k in used], pa.binary())],
                                             names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(raw), "<u8")
                sums[k] = sums[k] + own if k in sums else own
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(sums[k].tobytes(), 1) for k in keys], pa.binary())],
                                         names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, schema)
    salted = parts.repartition("slice", (F.crc32("counts") % 8).alias("salt")).mapInArrow(add, schema)
    out = np.zeros((buckets // SLICE, SLICE), np.uint64)
    for r in salted.repartition("slice").mapInArrow(add, schema).collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    return out.reshape(-1)


class Prefix:
    """Order of a set's shingles, and how many of the first ones a document enters."""

    def __init__(self, counts: np.ndarray, percent: int):
        self.counts, self.percent, self.noise = counts, percent, float(counts.mean())
        self.spread = 4.0 * np.sqrt(self.noise) + 1

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Shingles of the prefix in order, whether each is hot, and how many matches the document asks for.

        A partner has at least percent / 100 of the document's shingles in common with it, which bounds the prefix for any partner.
        """
        count = self.counts[(own & np.uint64(len(self.counts) - 1)).astype(np.int64)].astype(np.float64)
        order = np.lexsort((own, count))
        n = len(own)
        least = -(-self.percent * n // 100)
        shared = np.maximum(count[order[:n - least + MATCHES[-1]]] - self.noise - self.spread, 0.0)
        best, matches = None, 1
        for k in MATCHES:
            if k > least or n - least + k > n:
                break
            others = shared[:n - least + k]
            cost = others.sum() + len(others) + COMPARISON * (np.partition(others, len(others) - k)[len(others) - k] if len(others) >= k else 0.0)
            if best is None or cost < best:
                best, matches = cost, k
        kept = order[:n - least + matches]
        return own[kept], count[kept] >= self.noise + self.spread + HOT, matches


ENTRY = np.dtype([("token", "<u8"), ("doc", "<u4"), ("pos", "<u4")])


def entries(docs: DataFrame, text: str, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """Prefix entries of shingles that two different sets may share: ``token``, ``node``, ``n``, ``k``, ``pos``, ``docs`` (sets that have it).

    Most shingles are in one document only. To find them, entries travel in packed form to the task of their hash, which keeps those
    that two sets have whose sizes and positions fit. Hot shingles are known to be shared; they travel as rows, so no task gets
    all rows of one of them. Equal sets are entered once a task, and once in the end.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(counts)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "part int, token bigint, node bigint, n int, k int, pos int, packed binary"
    names = ["part", "token", "node", "n", "k", "pos", "packed"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    def enter(batches):
        lean()
        prefix, seen = Prefix(sent.value, percent), set()
        nodes, info, gathered, waiting, rows = [], [], [], 0, []

        def packed():
            """One row for each part: nodes with their sizes and matches, and the entries."""
            every = np.concatenate(gathered) if gathered else np.zeros(0, ENTRY)
            part = ((every["token"] >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((every["token"], part))
            every, part = every[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                own = every[cuts[p]:cuts[p + 1]].copy()
                used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                head = np.array([nodes[d] for d in used], "<i8").tobytes() + np.array([info[d] for d in used], "<u4").tobytes()
                steps = np.diff(own["token"], prepend=np.uint64(0))
                body = b"".join([steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), own["doc"].tobytes(), own["pos"].tobytes()])
                yield int(p), None, None, len(used), len(own), None, zlib.compress(head + body, 1)

        for own in sets(batches, size):
            if not len(own):
                continue
            node = node_of(own)
            if node in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(node)
            tokens, hot, k = prefix.of(own)
            pos = np.arange(len(tokens), dtype=np.uint32)
            for t, p in zip(tokens[hot].view(np.int64).tolist(), pos[hot].tolist()):
                rows.append((None, t, node, len(own), k, p, None))
            cold = np.zeros(int((~hot).sum()), ENTRY)
            cold["token"], cold["pos"], cold["doc"] = tokens[~hot], pos[~hot], len(nodes)
            nodes.append(node)
            info.append((len(own), k))
            gathered.append(cold)
            waiting += len(cold)
            if waiting > GATHERED:
                yield emit(list(packed()))
                nodes, info, gathered, waiting = [], [], [], 0
            if len(rows) >= 10_000:
                yield emit(rows)
                rows = []
        rows += packed()
        if rows:
            yield emit(rows)

    def shared(batches):
        tokens, nodes, info, pos = [], [], [], []
        out = [*names[1:6], "docs"]
        for batch in batches:
            hot = batch.filter(pa.compute.is_null(batch.column("packed")))
            if hot.num_rows:
                yield pa.RecordBatch.from_arrays([*hot.select(names[1:6]).columns, pa.nulls(hot.num_rows, pa.int64())], names=out)
            cold = batch.filter(pa.compute.is_valid(batch.column("packed")))
            for n_docs, n, raw in zip(*(cold.column(c).to_pylist() for c in ("n", "k", "packed"))):
                raw = zlib.decompress(raw)
                head = 16 * n_docs
                doc = np.frombuffer(raw, "<u4", n, head + 8 * n)
                steps = np.frombuffer(raw, np.uint8, 8 * n, head).reshape(8, n).T.copy().view("<u8").ravel()
                tokens.append(np.cumsum(steps, dtype=np.uint64))
                nodes.append(np.frombuffer(raw, "<i8", n_docs)[doc])
                info.append(np.frombuffer(raw, "<u4", 2 * n_docs, 8 * n_docs).reshape(-1, 2)[doc])
                pos.append(np.frombuffer(raw, "<u4", n, head + 12 * n))
        if not tokens:
            return
        tokens, nodes, info, pos = (np.concatenate(x) for x in (tokens, nodes, info, pos))
        order = np.lexsort((nodes, tokens))
        tokens, nodes, n, k, pos = tokens[order], nodes[order], info[order, 0].astype(np.int64), info[order, 1].astype(np.int64), pos[order].astype(np.int64)
        keep = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]))  # a set that several tasks entered
        for _ in range(2):
            tokens, nodes, n, k, pos = (x[keep] for x in (tokens, nodes, n, k, pos))
            if not len(tokens):
                return
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            size = np.diff(np.append(first, len(tokens)))
            # Least size of a partner: the smallest set here, but no set links with one below percent / 100 of its size.
            least = np.maximum(np.repeat(np.minimum.reduceat(n, first), size), -(-percent * n // 100))
            reach = n + (-(percent * (n + least)) // (100 + percent)) + k
            keep = (np.repeat(size, size) > 1) & (pos < reach)
        tokens, nodes, n, k, pos = (x[keep] for x in (tokens, nodes, n, k, pos))
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(tokens)))
        docs = np.repeat(size, size)
        for at in range(0, len(tokens), 50_000):
            own = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[own].view(np.int64)), pa.array(nodes[own]), pa.array(n[own].astype(np.int32)),
                                              pa.array(k[own].astype(np.int32)), pa.array(pos[own].astype(np.int32)), pa.array(docs[own])], names=out)

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(enter, schema)
    target = F.when(F.col("packed").isNotNull(), F.col("part").cast("bigint")).otherwise(F.xxhash64("token", "node"))
    every = written(rows.repartition(parts, target).mapInArrow(shared, "token bigint, node bigint, n int, k int, pos int, docs bigint"), "entries")
    hot = every.where("docs is null").drop("docs").dropDuplicates(["token", "node"])
    counted = hot.join(hot.groupBy("token").agg(F.count("*").alias("docs")), "token")
    return every.where("docs > 1").unionByName(written(counted.where("docs > 1").select(every.columns), "hot"))


def fits(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether a shared shingle lies in both prefixes that the pair's sizes and number of matches ask for."""
    text = (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
            f" and {a}.pos < {a}.n - (({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}) + least({a}.k, {b}.k)"
            f" and {b}.pos < {b}.n - (({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}) + least({a}.k, {b}.k)")
    return F.expr(text)


def whole(own: np.ndarray) -> bytes:
    return own.astype("<u8").tobytes()


def bits(own: np.ndarray) -> bytes:
    """Size of the set, and a map with the bit of each shingle set: a power of two of bits, two to four for each shingle."""
    n = max(64, 1 << (2 * len(own) - 1).bit_length())
    out = np.zeros(n, np.uint8)
    out[(own & np.uint64(n - 1)).astype(np.int64)] = 1
    return len(own).to_bytes(8, "little") + np.packbits(out, bitorder="little").tobytes()


def enough(common: int, m: int, n: int, percent: int) -> bool:
    return 100 * common >= percent * (m + n - common)


def link(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets (``whole``) link."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return enough(int((x[at] == y).sum()), len(x), len(y), percent)


def possible(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets may link by their ``bits``: each bit that only one of them has is a shingle at least that the other lacks."""
    m, n = (int.from_bytes(x[:8], "little") for x in (a, b))
    x, y = np.frombuffer(a, np.uint8, offset=8), np.frombuffer(b, np.uint8, offset=8)
    while len(x) != len(y):
        half = min(len(x), len(y))
        x, y = (v if len(v) == half else v[:len(v) // 2] | v[len(v) // 2:] for v in (x, y))
    return enough(min(m - int(np.bitwise_count(x & ~y).sum()), n - int(np.bitwise_count(y & ~x).sum())), m, n, percent)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame, rows: DataFrame, form=whole) -> DataFrame:
    """``node`` and ``tokens`` (sorted 64-bit hashes as bytes, or another ``form`` of the set) of the nodes in ``wanted``, each once.

    The document of the least id stands for its node (``rows``: ``doc_id`` and ``node`` of all documents). A Bloom filter of fixed size tells
    the tasks which ids are wanted, before they make sets; a set too many does no harm, as it is joined by its name.
    """
    mask = (1 << BLOOM_BITS) - 1
    key = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))
    chosen = rows.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id"))
    hashes = chosen.select(key(F.col("id")).bitwiseAND(mask).alias("h"))
    words = hashes.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    for r in words:
        bloom[r["at"]] = r["bits"]
    known = docs.sparkSession.sparkContext.broadcast(bloom.astype("<i8").tobytes())

    def build(batches):
        lean()
        table, shingler = np.frombuffer(known.value, np.uint8), Shingler(size)
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(1).to_numpy() & mask
            batch = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            nodes, tokens = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = shingler.of(text or b"")
                node = node_of(own)
                if node is not None and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    tokens.append(form(own))
            for k in range(0, len(nodes), 500):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k:k + 500], pa.int64()), pa.array(tokens[k:k + 500], pa.binary())], names=["node", "tokens"])
            if len(seen) > 500_000:
                seen.clear()

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"), key(F.col(f"`{doc_id}`")).alias("key"))
    return texts.mapInArrow(build, "node bigint, tokens binary").repartition("node").dropDuplicates(["node"])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verified(pairs: DataFrame, tokens: DataFrame, percent: int, test=link) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets meet the test."""
    with_b = pairs.join(tokens.withColumnsRenamed({"node": "b", "tokens": "tb"}), "b")
    both = with_b.join(tokens.withColumnsRenamed({"node": "a", "tokens": "ta"}), "a")

    def run(batches):
        for batch in batches:
            keep = [k for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3))) if test(a.as_buffer(), b.as_buffer(), percent)]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def contract(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step: every vertex of ``edges`` (a, b) takes the least name among itself and its neighbours.

    Returns the edges between the names taken and ``labels`` (node, comp) renamed. Vertices without edges keep their names.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("from"), "to"), "hooks")
    out = (edges.join(hooks.withColumnRenamed("from", "a").withColumnRenamed("to", "ta"), "a")
           .join(hooks.withColumnRenamed("from", "b").withColumnRenamed("to", "tb"), "b")
           .where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    named = labels.join(hooks, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return written(out, "edges"), written(named, "labels")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, comp) with components merged along ``edges`` of nodes; the graph shrinks at each step."""
    named = labels.withColumnRenamed("node", "a").withColumnRenamed("comp", "ca")
    edges = edges.join(named, "a").join(named.toDF("b", "cb"), "b").where("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    edges = written(edges, "edges")
    while not edges.isEmpty():
        edges, labels = contract(edges, labels)
    return labels


def hub_round(busy: DataFrame, labels: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of documents of busy shingles with hubs of larger components.

    Hubs of a shingle are the documents in whose prefix it comes earliest: they have few rare shingles of their own, and so are most
    like all others that share it. There are ``HUBS``, one for each class of a hash that changes by round.
    """
    sizes = labels.groupBy("comp").agg(F.count("*").alias("members"))
    rows = busy.join(labels.join(sizes, "comp"), "node")
    place = F.floor(F.col("pos") * 1000 / F.col("n"))
    one = F.struct(place.alias("place"), F.xxhash64("node", F.lit(seed)).alias("h"), "node", "comp", "members", "n", "k", "pos")
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(HUBS))
    hubs = rows.groupBy("token").agg(F.array(*[F.min(F.when(part == i, one)) for i in range(HUBS)]).alias("hubs"))
    asked = (rows.join(hubs, "token").withColumn("a", F.struct("node", "comp", "members", "n", "k", "pos")).select("a", F.explode("hubs").alias("b"))
             .where((F.col("a.comp") != F.col("b.comp")) & fits(percent)
                    & (F.struct("a.members", "a.comp") < F.struct("b.members", "b.comp"))))
    counted = asked.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).count()
    # Of the hubs that a document met, those with which it shares most: one in the first round, when all documents ask.
    # Others are left to later rounds and the last search.
    best = counted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "b")), False), 1, ASKED if seed else 1).alias("best"))
    return best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def last_pairs(found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share enough prefix shingles.

    Of each shingle's documents, those outside its largest component meet all others; pairs within that component are not made.
    """
    rows = found.join(labels, "node")
    largest = rows.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"))
    open_ = largest.where("comps > 1").select("token", F.col("top.comp").alias("main"))
    rows = written(rows.join(open_, "token"), "open")
    minor = rows.where("comp != main")
    meet = (minor.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & fits(percent)
                                  & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))))
    counted = (meet.groupBy(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
               .agg(F.count("*").alias("common"), F.min(F.least("a.k", "b.k")).alias("k")))
    return counted.where("common >= k").select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``: the least id of all documents that a document is linked to, directly or by others.

    Two documents link when ``100 * common >= percent * union`` of their distinct word shingles. Fewer words than ``size`` are one shingle;
    null, empty and blank texts have none and link with nothing. Equal sets link, repeated rows too. A null id is no
    candidate for the least one; a component of null ids only has none. An empty table gives no rows.
    """
    # Cast once for all uses, as sets are found again by the text of the id.
    docs = docs.withColumn(doc_id, F.col(f"`{doc_id}`").cast("bigint"))
    rows = written(members(docs, [doc_id], text, size).select(F.col(f"doc.`{doc_id}`").alias("doc_id"), "node", "n_shingles"), "members")
    least = least_ids(rows, linked(docs, rows, doc_id, text, size, percent, rounds)).select("node", F.col("top.doc_id").alias("component_id"))
    return (rows.join(least, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of ``near_duplicates`` the row of the least id stays.

    Ids that are null come last; of repeated rows, and of rows of the same id and set, one stays. Documents without words link with nothing, so
    all stay. Columns are those of ``docs``.
    """
    every = members(docs, docs.columns, text, size)
    lean = written(members(docs, [doc_id], text, size).select(F.col(f"doc.`{doc_id}`").alias("doc_id"), "node", "n_shingles"), "members")
    tops = least_ids(lean, linked(docs, lean, doc_id, text, size, percent, rounds)).select("top").distinct()
    tops = tops.select(F.col("top.doc_id").alias("id"), F.col("top.node").alias("top"))
    # Joined by id and set, copies with other ids spread over all tasks.
    rows = every.withColumn("each", F.when(F.col("node").isNotNull(), 0).otherwise(F.monotonically_increasing_id()))
    kept = (rows.join(tops, F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("id")) & (F.col("node") == F.col("top")), "left")
            .where("top is not null or node is null").withColumn("id", F.col(f"doc.`{doc_id}`")))
    return kept.dropDuplicates(["id", "node", "each"]).select("doc.*")


def linked(docs: DataFrame, rows: DataFrame, doc_id: str, text: str, size: int, percent: int, rounds: int) -> DataFrame:
    """``node`` and ``comp`` (the least node of the component) of nodes that share a prefix shingle with another."""
    found = entries(docs, text, sketch(docs, text, size), size, percent)
    labels = written(found.select("node").distinct().select("node", F.col("node").alias("comp")), "labels")
    busy = written(found.where(F.col("docs") > BUSY).drop("docs"), "busy")

    def sets_of(nodes: DataFrame, form=whole) -> DataFrame:
        return shingle_sets(docs, doc_id, text, size, nodes, rows, form)

    def links(pairs: DataFrame, maps: DataFrame) -> DataFrame:
        left = written(verified(pairs, maps, percent, possible), "possible")
        return written(verified(left, sets_of(ends(left)), percent), "links")

    if not busy.isEmpty():
        maps = written(sets_of(busy, bits), "maps")
        for k in range(rounds):
            labels = components(links(hub_round(busy, labels, k, percent), maps), labels)
    pairs = written(last_pairs(found.drop("docs"), labels, percent), "pairs")
    return components(links(pairs, sets_of(labels, bits)), labels)


def least_ids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``node`` and ``top``: its component's least id with the node that has it; null ids come last."""
    one = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "node")
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(one).alias("least"))
    of = least.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least")
    return of.join(of.groupBy("comp").agg(F.min("least").alias("top")), "comp").select("node", "top")
