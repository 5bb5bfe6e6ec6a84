"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each can be trusted."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import map_documents
from millrace.llm.stats import COUNTS, structure

#: Name, condition of a vote to keep, condition of a vote to reject (SQL over the counts); neither: the rule abstains.
RULES = (
    ("length", "n_words >= 50", "n_words < 10"),
    ("repeats", "n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.4 * n_words"),
    ("lines", "n_dup_lines = 0 and n_lines > 1", "n_dup_lines > 3 and n_dup_lines > 0.3 * n_lines"),
    ("symbols", "n_symbols <= 0.01 * n_words", "n_symbols > 0.2 * n_words"),
    ("letters", "n_letters + n_digits >= 0.85 * word_chars", "n_letters + n_digits < 0.75 * word_chars"),
    ("capitals", "n_upper <= 0.15 * n_letters", "n_upper > 0.5 * n_letters"),
    ("word_length", "word_chars between 3 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("bare_marks", "n_bare <= 0.01 * n_words", "n_bare > 0.2 * n_words"),
    ("sentences", "n_stops between 0.02 * n_words and 0.5 * n_words", "n_stops < 0.002 * n_words or n_stops > n_words"),
    ("shouting", "n_marks <= 0.05 * n_words", "n_marks > 0.3 * n_words"),
)
KEEP, REJECT, ABSTAIN = 1, 2, 0


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def counted(docs: DataFrame, carry=("doc_id",), text: str = "text") -> DataFrame:
    """``doc`` and the counts of each text; null texts count as empty."""
    def make():
        def work(texts):
            counts = np.array([structure(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
            return [pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS))]
        return work

    return map_documents(docs, text, carry, make, ", ".join(f"{c} bigint" for c in COUNTS))


def pattern(rules=RULES) -> Column:
    """All votes of a document as one number with base-3 digits, the first rule lowest."""
    digits = [F.when(F.expr(keep), KEEP).when(F.expr(reject), REJECT).otherwise(ABSTAIN) * 3 ** k for k, (_, keep, reject) in enumerate(rules)]
    return sum(digits[1:], digits[0]).cast("int")


class VoteModel:
    """Two classes; given its class, each rule keeps, rejects or abstains independently of the others.

    EM over how often each pattern of votes occurs. It starts from the share of keep among the votes given. Counts are smoothed.
    Bad documents are bad in many ways, so rules agree little among them; what names the classes is that a rule is written so as to reject
    at most ``false_rejects`` of the good documents, which bounds its estimate. ``accuracy`` is the share of right votes among votes given.
    """

    def __init__(self, patterns: dict[int, int], n_rules: int, steps: int = 200, smooth: float = 1.0, tolerance: float = 1e-9,
                 false_rejects: float = 0.01):
        keys = np.array(sorted(patterns), np.int64)
        weight = np.array([patterns[k] for k in keys.tolist()], np.float64)
        votes = keys[:, None] // 3 ** np.arange(n_rules) % 3
        kept, rejected = (votes == KEEP).sum(1), (votes == REJECT).sum(1)
        good = np.where(kept + 2 * rejected > 0, (kept + 0.5) / (kept + 2 * rejected + 1), 0.5)
        self.prior, self.chance = 0.5, np.full((2, n_rules, 3), 1 / 3)
        last = -math.inf
        for self.steps in range(1, steps + 1) if len(keys) else ():
            for cls, share in enumerate((1 - good, good)):
                mass = weight * share
                for v in range(3):
                    self.chance[cls, :, v] = ((votes == v) * mass[:, None]).sum(0) + smooth
                self.chance[cls] /= self.chance[cls].sum(1, keepdims=True)
            self.chance[1, :, REJECT] = np.minimum(self.chance[1, :, REJECT], false_rejects)
            self.chance[1] /= self.chance[1].sum(1, keepdims=True)
            self.prior = float(((weight * good).sum() + smooth) / (weight.sum() + 2 * smooth))
            logs = np.log(self.chance)[:, np.arange(n_rules), votes].sum(2) + np.log([[1 - self.prior], [self.prior]])
            both = np.logaddexp(logs[0], logs[1])
            good = np.exp(logs[1] - both)
            likelihood = float((weight * both).sum())
            if likelihood - last < tolerance * abs(likelihood):
                break
            last = likelihood
        right = self.prior * self.chance[1, :, KEEP] + (1 - self.prior) * self.chance[0, :, REJECT]
        given = self.prior * self.chance[1, :, 1:].sum(1) + (1 - self.prior) * self.chance[0, :, 1:].sum(1)
        self.accuracy = (right / given).tolist()

    def posterior(self, rules=RULES) -> Column:
        """Probability of the good class, as an expression over the counts."""
        log_odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, (_, keep, reject) in enumerate(rules):
            odds = np.log(self.chance[1, k] / self.chance[0, k]).tolist()
            log_odds = log_odds + F.when(F.expr(keep), odds[KEEP]).when(F.expr(reject), odds[REJECT]).otherwise(odds[ABSTAIN])
        return 1 / (1 + F.exp(-log_odds))


def fit(docs: DataFrame, text: str = "text", rules=RULES) -> VoteModel:
    """Count vote patterns over all documents (at most 3 ** rules rows reach the driver) and estimate the model from them."""
    if len(rules) > 12:
        raise ValueError("at most 12 rules: patterns are collected")
    rows = counted(docs, [], text).groupBy(pattern(rules).alias("votes")).count().collect()
    return VoteModel({r["votes"]: r["count"] for r in rows}, len(rules))


def judge(docs: DataFrame, carry=("doc_id",), text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``doc``, the counts, ``quality`` (posterior probability), ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; repeated rows are judged each and alike; an empty table gives no rows. Texts are read
    twice, once for the vote patterns and once for the result.
    """
    model = fit(docs, text, rules)
    return (counted(docs, carry, text).withColumns({"quality": model.posterior(rules), "base_failed": base_failed()})
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
