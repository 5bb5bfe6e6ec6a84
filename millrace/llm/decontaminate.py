"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of test items, each text scanned once."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import WORD, map_documents

#: The same words in a text whose case was kept.
ANY_CASE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Distinct (words, item): every ``window`` consecutive words of an item, or all of them where there are fewer.

    Items without words, id or text have none.
    """
    lower = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    return (benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words.alias("words"))
            .where(F.col("item").isNotNull() & (F.size("words") > 0))
            .select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
            .distinct())


def merge(ranges):
    """Ordered union of half-open ranges; touching ones become one."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def make_automaton(windows: list[tuple[tuple[bytes, ...], list[str]]]):
    """Automaton over word numbers, and the number of each word; words of no item have the number 0."""
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, items in windows:
        automaton.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]), (len(words), items))
    automaton.make_automaton()
    return automaton, numbers


def characters(text: bytes, ranges) -> list[dict]:
    """Ranges of words as ranges of characters of the text as it was."""
    at = [m.span() for m in ANY_CASE.finditer(text)] if ranges else []
    return [{"start": len(text[:at[a][0]].decode()), "end": len(text[:at[z - 1][1]].decode())} for a, z in ranges]


PAIR = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, sent, carry, text: str, before: bool, spans: bool) -> DataFrame:
    """One pass over the texts, added to what earlier passes found (columns ``items`` and ``ranges``)."""

    def make():
        windows = sent.value
        automaton, numbers = make_automaton(windows) if windows else (None, {})
        number = numbers.get

        def work(texts, *earlier):
            items, ranges = [column.to_pylist() for column in earlier] if earlier else ([()] * len(texts), [()] * len(texts))
            n_words, found, places, chars = [], [], [], []
            for text, old_items, old_ranges in zip(texts, items, ranges):
                words = WORD.findall(text.lower())
                n_words.append(len(words))
                ids, hits = set(old_items), [(r["start"], r["end"]) for r in old_ranges]
                if automaton and words:
                    for last, (length, own) in automaton.iter(tuple([number(w, 0) for w in words])):
                        ids.update(own)
                        hits.append((last - length + 1, last + 1))
                hits = merge(hits)
                found.append(sorted(ids))
                places.append(hits)
                chars.append(characters(text, hits) if spans else [])
            return [pa.array(n_words, pa.int64()), pa.array([sum(z - a for a, z in p) for p in places], pa.int64()),
                    pa.array(found, pa.list_(pa.string())), pa.array([[{"start": a, "end": z} for a, z in p] for p in places], PAIR),
                    pa.array(chars, PAIR)]

        return work

    place = "array<struct<start: bigint, end: bigint>>"
    return map_documents(docs, text, carry, make, f"n_words bigint, n_hit bigint, items array<string>, ranges {place}, spans {place}",
                         [F.col("items"), F.col("ranges")] if before else [])


def contamination(docs: DataFrame, benchmark: DataFrame, carry=("doc_id",), text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, spans: bool = False, pass_bytes: int = 64 << 20) -> DataFrame:
    """Documents with the benchmark items whose windows occur in them.

    Returns ``doc`` (the carried columns), ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (their ids as sorted
    text), ``contaminated`` and, on demand, ``spans``: character ranges in the text as it was. Null or empty texts have no
    words and no hits; repeated documents are scanned each; repeated items count once by id; an empty benchmark hits nothing.

    The windows are measured first. What one pass sends to the tasks is at most about ``pass_bytes``; a larger benchmark is
    dealt by a hash of the window over several passes, whose findings are merged per document. Documents are never shuffled.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_id, item_text, window)
    length = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 60)
    passes = max(1, -(-(windows.agg(F.sum(length)).first()[0] or 0) // pass_bytes))
    carried = list(dict.fromkeys([*carry, text])) if passes > 1 else list(carry)
    for k in range(passes):
        by_words: dict[tuple, list[str]] = {}
        for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == k).collect():
            by_words.setdefault(tuple([w.encode() for w in r["words"]]), []).append(r["item"])
        sent = spark.sparkContext.broadcast(list(by_words.items()))
        if k == 0:
            out = scan(docs, sent, carried, text, False, spans)
        else:
            again = out.select("doc", F.col(f"doc.`{text}`").alias("text"), "items", "ranges")
            out = scan(again, sent, ["doc"], "text", True, spans).withColumn("doc", F.col("doc.doc"))
    doc = F.struct(*[F.col(f"doc.`{c}`") for c in carry]).alias("doc") if passes > 1 else F.col("doc")
    return out.select(doc, "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"), *(["spans"] if spans else []))
