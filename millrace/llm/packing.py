"""Hierarchical packing: documents are routed to context sizes, long windows are filled from shorter tiers."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.tokens import WordEncoder, tokenizer_path

TIERS = (256, 512, 1024, 2048)


class Packer:
    """Packs the documents of one task, block by block; what a block leaves over goes to the next.

    A document's full windows of the largest tier are cut off first. What is left of it goes to the smallest tier that holds
    it. From the largest tier down, each item opens a window, whose gap takes the longest shorter items that fit and
    last a cut of the longest one, so that windows are full. At the end of the task the rest is cut into windows of falling
    powers of two.
    """

    def __init__(self, tiers=TIERS, first_sequence: int = 0, step_tokens: int = 32 * 2048):
        self.tiers, self.sequence, self.step_tokens = sorted(tiers), first_sequence, step_tokens
        self.items: list[tuple[int, int, int]] = []  # length, document, start: ascending
        self.out: list[tuple[int, int, int, int, int, int, int]] = []
        self.steps: dict[int, list[int]] = {}
        self.next_step = first_sequence

    def emit(self, size: int, pieces) -> None:
        """A sequence of ``size`` tokens. A step group takes sequences of one size up to the same number of tokens."""
        step = self.steps.get(size)
        if step is None or step[1] + size > self.step_tokens:
            step = self.steps[size] = [self.next_step, 0]
            self.next_step += 1
        step[1] += size
        offset = 0
        for length, doc, start in pieces:
            self.out.append((doc, start, length, self.sequence, offset, size, step[0]))
            offset += length
        self.sequence += 1

    def add(self, doc: int, length: int) -> None:
        largest, start = self.tiers[-1], 0
        while length - start >= largest:
            self.emit(largest, [(largest, doc, start)])
            start += largest
        if start < length:
            insort(self.items, (length - start, doc, start))

    def pack(self) -> None:
        """Full windows from the items at hand; items that cannot fill one stay."""
        total = sum(x[0] for x in self.items)
        for size, smaller in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0]):
            while self.items and self.items[-1][0] > smaller and total >= size:
                self.emit(size, self.window(size))
                total -= size

    def window(self, size: int) -> list[tuple[int, int, int]]:
        pieces, gap = [], size
        while gap:
            k = bisect_right(self.items, (gap, float("inf"), 0))
            if k:
                piece = self.items.pop(k - 1)
            else:
                length, doc, start = self.items.pop()
                piece = gap, doc, start
                insort(self.items, (length - gap, doc, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        return pieces

    def finish(self) -> None:
        total = sum(x[0] for x in self.items)
        size = self.tiers[-1]
        while total:
            while size > total:
                size //= 2
            self.emit(size, self.window(size))
            total -= size


def pack(docs: DataFrame, carry=("doc_id",), text: str = "text", end_id: int = 1, tokenizer: str | None = None, tiers=TIERS,
         block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of token sequences; every id of every document is in exactly one piece.

    Returns ``doc`` (the carried columns), ``start`` and ``length`` of the piece in its document, ``ids`` (its little-endian
    unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` of the piece in the sequence, ``tier`` (the sequence's
    length, a power of two: nothing is padded) and ``step_group`` (sequences of one tier, up to the same number of tokens).
    Every document ends with ``end_id``, so null and empty texts have one token. Repeated rows are packed each. Tasks pack
    their own documents, ``block_tokens`` at a time; nothing is shuffled, and an empty table gives no rows. The last
    sequences of a task are of falling powers of two below the tiers.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    file = tokenizer or tokenizer_path()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    added = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)

    def run(batches):
        from pyspark import TaskContext
        encoder, end = WordEncoder.shared(file), np.array([end_id], "<u4").tobytes()
        packer = Packer(tiers, TaskContext.get().partitionId() << 33)
        kept: dict[int, tuple] = {}  # document: its ids, its row in a batch of carried columns
        count = waiting = 0

        def pieces():
            out, packer.out = packer.out, []
            for at in range(0, len(out), 4096):
                part = out[at:at + 4096]
                own = [kept[p[0]] for p in part]
                rows = pa.concat_arrays([row for _, row in own])
                columns = [[p[1] for p in part], [p[2] for p in part], [ids[4 * p[1]:4 * (p[1] + p[2])] for (ids, _), p in zip(own, part)],
                           [len(ids) // 4 for ids, _ in own], *[[p[k] for p in part] for k in (3, 4, 5, 6)]]
                yield pa.RecordBatch.from_arrays([rows, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc", *names])
            left = {x[1] for x in packer.items}
            for doc in [d for d in kept if d not in left]:
                del kept[doc]

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for k in range(0, len(texts), 256):
                for n, ids in enumerate(encoder.encode(texts[k:k + 256])):
                    ids += end
                    kept[count] = ids, batch.column(0).slice(k + n, 1)
                    packer.add(count, len(ids) // 4)
                    count, waiting = count + 1, waiting + len(ids) // 4
                if waiting >= block_tokens:
                    packer.pack()
                    yield from pieces()
                    waiting = 0
        packer.pack()
        packer.finish()
        yield from pieces()

    from pyspark.sql import types as T
    schema = T.StructType([packed.schema["doc"], *T.StructType.fromDDL(added).fields])
    return packed.mapInArrow(run, schema)
