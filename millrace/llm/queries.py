"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import session
from millrace.llm import (alignment, chat, decontaminate, html_layout, jaccard, licenses, merkle, packing, quality_fm, rules,
                          substrings, token_files, toxicity)
from millrace.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def sql_words(text: str) -> str:
    """DuckDB: words of letters and digits of a text whose A-Z were lowered."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def held_out():
    return (fold(F.col("doc.doc_id")) == 0).alias("held_out")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality_fm.train(docs, session.table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).select("doc.doc_id", held_out(), "score", "predicted")


@query("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    spans = licenses.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    names = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda s: s["label"]))), ",")
    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"),
                        F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
                        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    return rules.judge(documents(spark, sf_dir)).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                        "base_failed", "kept", "quality")


@query("op4_decontamination", f"""
WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {sql_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
places AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, places.n, item FROM places JOIN pat USING (g, n)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op4_decontamination(spark, sf_dir):
    found = decontaminate.contamination(documents(spark, sf_dir), session.table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op5_html_layout")
def op5_html_layout(spark, sf_dir):
    return html_layout.extract(session.table(spark, sf_dir, "pages")).select("doc.page_id", "text")


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    path = session.work_dir(spark, "tokens")
    token_files.write(documents(spark, sf_dir), path)
    return token_files.ids_crc32(token_files.read(spark, path))


@query("op7_ngram_jaccard", """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach ON reach.a = w.r JOIN w t ON t.r = reach.b GROUP BY w.r, w.doc_id, n.n""")
def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(documents(spark, sf_dir))


@query("op8_chat_format", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, x := text) ORDER BY place) AS w FROM p GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, w FROM c GROUP BY n_turns, w),
pre AS (SELECT DISTINCT w[1:k] AS w FROM (SELECT w, unnest(range(1, n_turns)) AS k FROM c)),
m AS (SELECT d.* FROM d ANTI JOIN pre ON d.w = pre.w),
marked AS (SELECT conv_id, place, replace(replace(role, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS role,
                  replace(replace(text, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS text FROM p)
SELECT conv_id, CAST((place - 1) // 256 AS BIGINT) AS part, n_turns, n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM m JOIN marked USING (conv_id) GROUP BY conv_id, (place - 1) // 256, n_turns, n_copies""")
def op8_chat_format(spark, sf_dir):
    return chat.render(session.table(spark, sf_dir, "conversations"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    trained = toxicity.train(docs, session.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, trained).select("doc.doc_id", held_out(), "score", "predicted")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", "step_group")


@query("op11_merkle_manifest")
def op11_merkle_manifest(spark, sf_dir):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.manifest(documents(spark, sf_dir), F.when(third, lowered).otherwise(F.col("text")))
    return rows.withColumnRenamed("id", "doc_id")


@query("op12_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM win JOIN least USING (g) WHERE m < doc_id),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def op12_substring_dedup(spark, sf_dir):
    return substrings.deduplicated(documents(spark, sf_dir)).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    rows = alignment.align(documents(spark, sf_dir)).documents
    return rows.select("doc.doc_id", *[c for c in rows.columns if c != "doc"])
