"""Merkle manifest of a table: a tree of SHA-256 digests for each group, with a proof and a re-check of every row.

Places come from bitmaps and not from a sort. The ids of a group are merged into compressed bitmaps (only 64-bit words that are not
zero are kept), directories hold how many rows stand before each word, and an id's place is that count plus the bits below its
own. Rows are then dealt to arrays of 512 keyed slots; an array folds three levels of the tree, and the node that is left is a
slot of an array of the next round. Proofs come down the same way, so nothing but arrays of bounded size is in one task.
"""

from __future__ import annotations

from binascii import hexlify
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import written
from millrace.operators import over

#: Nodes that become one parent.
RUN = 8
#: Levels that one array of slots folds, and bits of a slot's number.
LEVELS, SLOT_BITS = 3, 9
#: Bits of an id below a word, and of a word below each directory.
WORD, DIRECTORIES = 6, (6, 22, 38)
#: Word of rows without an id: below every other one, in each directory too.
NO_WORD = -2 ** 58
#: Copies of one row that a task writes out before others take over.
COPIES = 4096

PATH = "array<struct<left:binary, right:binary>>"


def digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*columns), 256))


def field(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, later: Column | None = None, text: str = "text", group: str = "lang", doc_id: str = "doc_id",
           fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """``grp``, ``id``, ``leaf`` and ``seen``: a row's digest, and its digest once its text has become ``later``.

    ``grp`` is the empty text for a null group and else ``=`` and the group, so that its order is that of the groups, null first.
    """
    later = F.col(f"`{text}`") if later is None else later
    named = {f: F.col(f"`{f}`").cast("string") for f in fields}
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{doc_id}`").cast("bigint").alias("id"),
                       F.struct(*[named[f].alias(f"f{k}") for k, f in enumerate(fields)]).alias("f"), later.cast("string").alias("later"))
    parts = [F.col(f"f.f{k}") for k in range(len(fields))]
    at = fields.index(text)
    rows = rows.select(F.coalesce(F.concat(F.lit("="), "g"), F.lit("")).alias("grp"), "id", digest(*[field(p) for p in parts]).alias("leaf"),
                       F.when(~F.col("later").eqNullSafe(parts[at]), digest(*[field(p) for p in [*parts[:at], F.col("later"), *parts[at + 1:]]])).alias("other"))
    return rows.select("grp", "id", "leaf", F.coalesce("other", "leaf").alias("seen"))


def word(id_: Column) -> Column:
    return F.coalesce(F.shiftright(id_, WORD), F.lit(NO_WORD))


def bit() -> Column:
    return F.expr("shiftleft(1L, CAST(id & 63 AS INT))")


def directory(rows: DataFrame) -> DataFrame:
    """``grp``, ``word``, ``bits``, ``n`` (rows), ``before`` (rows of the group in smaller words) and ``total`` (rows of the group).

    Counts are summed level by level: within a node of a directory there are at most 65,536 children, in the topmost one 2^20.
    """
    words = written(rows.groupBy("grp", word(F.col("id")).alias("word")).agg(F.bit_or(bit()).alias("bits"), F.count(F.lit(1)).alias("n")), "words")
    levels = [words.select("grp", F.col("word").alias("key"), "n")]
    for up in DIRECTORIES:
        shift = up - (0 if len(levels) == 1 else DIRECTORIES[len(levels) - 2])
        levels.append(levels[-1].groupBy("grp", F.shiftright("key", shift).alias("key")).agg(F.sum("n").alias("n")))
    inside = lambda *by: Window.partitionBy("grp", *by).orderBy("key")
    here = F.sum("n").over(inside()) - F.col("n")
    counted = levels[-1].select("grp", "key", here.alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    for k in reversed(range(len(DIRECTORIES))):
        shift = DIRECTORIES[k] - (DIRECTORIES[k - 1] if k else 0)
        own = levels[k].withColumn("up", F.shiftright("key", shift))
        own = own.withColumn("inner", F.sum("n").over(inside("up")) - F.col("n"))
        above = counted.select("grp", F.col("key").alias("up"), "before", "total")
        counted = own.join(above, ["grp", "up"]).select("grp", "key", (F.col("before") + F.col("inner")).alias("before"), "total")
    counted = counted.withColumnRenamed("key", "word")
    return words.join(counted, ["grp", "word"])


def placed(rows: DataFrame) -> DataFrame:
    """Add ``pos`` (place in the group, ids ascending, null ids first) and ``total``.

    Rows that share an id stand in the order of their digests; equal rows are counted, placed together and written out again.
    """
    ranks = written(directory(rows), "directory")
    lone = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, CAST(id & 63 AS INT))")))
    joined = rows.withColumn("word", word(F.col("id"))).join(ranks.where(lone), ["grp", "word"])
    out = joined.select("grp", "id", "leaf", "seen", (F.col("before") + below).alias("pos"), "total")
    shared = ranks.where(~F.coalesce(lone, F.lit(False)))
    if shared.isEmpty():
        return out
    same = (rows.withColumn("word", word(F.col("id"))).groupBy("grp", "word", "id", "leaf", "seen").agg(F.count(F.lit(1)).alias("copies"))
            .join(shared.select("grp", "word", "before", "total"), ["grp", "word"]))
    upto = over.running(written(same, "shared"), ["grp", "word"], ["id", "leaf", "seen"], {"upto": ("sum", "copies")})
    first = F.col("before") + F.col("upto") - F.col("copies")
    dealt = (upto.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
             .select("grp", "id", "leaf", "seen", "total", (first + F.col("part") * COPIES).alias("first"),
                     F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES).alias("m")))
    spread = dealt.repartition("grp", "first").withColumn("k", F.explode(F.expr("sequence(0L, m - 1)")))
    return out.unionByName(spread.select("grp", "id", "leaf", "seen", (F.col("first") + F.col("k")).alias("pos"), "total"))


def arrays(nodes: DataFrame, *carried: str) -> DataFrame:
    """Arrays of slots: ``grp``, ``block``, ``total`` (nodes of the round in the group) and ``slots`` with ``hash`` and ``carried``."""
    slot = F.struct(F.col("pos").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot"), "hash", *carried)
    return (nodes.groupBy("grp", F.shiftright("pos", SLOT_BITS).alias("block"))
            .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(slot)).alias("slots")))


def levels_of(hashes: list[bytes], total: int) -> list[list[bytes]]:
    """Nodes of an array level by level: three above the first, fewer where one node is left of the whole group."""
    out = [hashes]
    while len(out) <= LEVELS and total > 1:
        at = out[-1]
        out.append([sha256(hexlify(b"".join(at[k:k + RUN]))).digest() for k in range(0, len(at), RUN)])
        total = -(-total // RUN)
    return out


def path_of(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """Siblings to the left and to the right of a slot's nodes, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = slot - slot % RUN
        out.append((b"".join(nodes[run:slot]), b"".join(nodes[slot + 1:run + RUN])))
        slot //= RUN
    return out


def folded(blocks: DataFrame) -> DataFrame:
    """The node that each array leaves: ``grp``, ``pos``, ``hash``, ``total`` of the next round."""
    def run(batches):
        for batch in batches:
            totals = batch.column("total").to_pylist()
            tops = [levels_of([s["hash"] for s in slots], n)[-1][0] for slots, n in zip(batch.column("slots").to_pylist(), totals)]
            ahead = [-(-n >> SLOT_BITS) if n > 1 << SLOT_BITS else 1 for n in totals]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(tops, pa.binary()), pa.array(ahead, pa.int64())],
                                             names=["grp", "pos", "hash", "total"])

    slim = blocks.select("grp", "block", "total", F.transform("slots", lambda s: F.struct(s["hash"].alias("hash"))).alias("slots"))
    return slim.mapInArrow(run, "grp string, pos bigint, hash binary, total bigint")


def climb(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """Arrays of each round, and the last node of each group (``grp``, ``hash``)."""
    rounds, done = [], None
    while True:
        blocks = written(arrays(nodes, *(carried if not rounds else ())), "slots")
        rounds.append(blocks)
        up = folded(blocks)
        tops = up.join(blocks.where(F.col("total") <= 1 << SLOT_BITS).select("grp", F.col("block").alias("pos")), ["grp", "pos"], "left_semi")
        done = tops if done is None else done.unionByName(tops)
        if blocks.where(F.col("total") > 1 << SLOT_BITS).isEmpty():
            return rounds, done.select("grp", "hash")
        nodes = written(up.where("total > 1"), "nodes")


def descend(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Arrays of the first round with ``path`` (siblings of the levels above them) and what else ``heads`` holds.

    ``heads`` has one row for each group: ``grp``, ``path`` and other columns.
    """
    extra = [c for c in heads.columns if c not in ("grp", "path")]
    above = None
    for level, blocks in reversed(list(enumerate(rounds))):
        top = blocks.where(F.col("total") <= 1 << SLOT_BITS).join(heads, "grp")
        here = top if above is None else top.unionByName(blocks.join(above, ["grp", "block"]))
        if not level:
            return here
        slim = here.select("grp", "block", "total", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["hash"].alias("hash"))).alias("slots"),
                           "path", F.struct(*extra).alias("x"))
        schema = slim.select("grp", "block", "path", "x").schema

        def run(batches):
            for batch in batches:
                for k, (grp, block, n, slots, path, x) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                    levels = levels_of([s["hash"] for s in slots], n)
                    paths = [[{"left": a, "right": z} for a, z in path_of(levels, i)] + path for i in range(len(slots))]
                    places = [(block << SLOT_BITS) + s["slot"] for s in slots]
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(slots)), pa.array(places, pa.int64()), pa.array(paths, batch.column(4).type),
                                                      pa.array([x] * len(slots), batch.column(5).type)], names=["grp", "block", "path", "x"])

        above = slim.mapInArrow(run, schema).select("grp", "block", "path", "x.*")


def manifest(docs: DataFrame, later: Column | None = None, **columns) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The leaf of a row is the digest of its fields; in each group (``lang``) leaves ascend by id, null ids first, rows of one id by
    their digests. While a group has several nodes, each run of eight becomes their digest; what is left is its subroot, and the
    subroots, null group first, become the root alike. ``later`` is the text as it is found later: the root is folded anew from that row
    and the siblings of its proof, and compared. Null and empty texts are leaves as others are; texts of any length are hashed whole.
    Repeated rows are one leaf each; an empty table gives no rows. Columns that are not named are not read.
    """
    rows = written(leaves(docs, later, **columns), "leaves")
    rounds, subroots = climb(placed(rows).withColumnRenamed("leaf", "hash"), "id", "seen")
    groups = written(subroots.select(F.lit("").alias("one"), F.col("grp").alias("name"), "hash"), "subroots")
    ranked = over.rank_over(groups, ["one"], ["name"], {"pos": "row_number"})
    n_groups = groups.count()
    tree, roots = climb(ranked.select(F.col("one").alias("grp"), (F.col("pos") - 1).alias("pos"), "hash", F.lit(n_groups).cast("bigint").alias("total"), "name"), "name")
    root = roots.select("grp", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    heads = proofs(descend(tree, root), "name string", "root binary")
    heads = heads.select(F.col("name").alias("grp"), "path", F.col("hash").alias("subroot"), "root")
    return checked(descend(rounds, heads))


def proofs(blocks: DataFrame, own: str, head: str) -> DataFrame:
    """Slots with their whole paths."""
    name, top = own.split()[0], head.split()[0]

    def run(batches):
        for batch in batches:
            for slots, n, path, x in zip(*[batch.column(c).to_pylist() for c in ("slots", "total", "path", top)]):
                levels = levels_of([s["hash"] for s in slots], n)
                paths = [[{"left": a, "right": z} for a, z in path_of(levels, i)] + path for i in range(len(slots))]
                yield pa.RecordBatch.from_arrays([pa.array([s[name] for s in slots]), pa.array([s["hash"] for s in slots], pa.binary()),
                                                  pa.array(paths, batch.column("path").type), pa.array([x] * len(slots), pa.binary())],
                                                 names=[name, "hash", "path", top])

    return blocks.select("slots", "total", "path", top).mapInArrow(run, f"{own}, hash binary, path {PATH}, {head}")


def checked(blocks: DataFrame) -> DataFrame:
    """Slots with the digest of their proof and the root folded from what was seen."""
    def run(batches):
        for batch in batches:
            for slots, n, path, subroot, root in zip(*[batch.column(c).to_pylist() for c in ("slots", "total", "path", "subroot", "root")]):
                levels = levels_of([s["hash"] for s in slots], n)
                above = [(hexlify(p["left"]), hexlify(p["right"])) for p in path]
                rest = b"".join([a + z for a, z in above])
                out = []
                for i, s in enumerate(slots):
                    near = [(hexlify(a), hexlify(z)) for a, z in path_of(levels, i)]
                    node = hexlify(s["seen"])
                    for a, z in [*near, *above]:
                        node = sha256(a + node + z).hexdigest().encode()
                    proof = sha256(b"".join([a + z for a, z in near]) + rest).hexdigest()
                    out.append((s["id"], s["hash"].hex(), subroot.hex(), root.hex(), proof, node.decode(), node == hexlify(root)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return blocks.select("slots", "total", "path", "subroot", "root").mapInArrow(run, SCHEMA)


SCHEMA = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
