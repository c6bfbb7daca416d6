"""Tolerant matching of texts against a lexicon."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jadwal.shipping import ship


def osa_distance(a: str, b: str) -> int:
    """Edits between two texts; swapping two neighbours is one edit, and nothing is edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for equal texts, less by the share of edits in the longer one."""
    return pd.Series([1 - osa_distance(x, y) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], dtype="float64")


MOST_ENTRIES = 10_000


def similar_pairs(pairs: DataFrame, a: str, b: str, min_score: float) -> DataFrame:
    """``pairs`` with ``score``, those of at least ``min_score``.

    Lengths alone rule out most pairs. Plain edit distance, which runs in the JVM, is at most twice the distance with swaps and rules
    out most others; only the rest goes to Python.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    near = pairs.where(shorter >= longer * min_score).where(F.levenshtein(a, b) <= 2 * (1 - min_score) * longer + 1e-9)
    return near.withColumn("score", similarity(a, b)).where(F.col("score") >= min_score)


def best_match(texts: DataFrame, text: str, lexicon: DataFrame, min_score: float) -> DataFrame:
    """text, key, variant, score: for each distinct text the lexicon entry most like it, if at least ``min_score``.

    ``lexicon`` (key, variant, ord) is a fixed dimension of at most MOST_ENTRIES rows, which is checked, so each distinct text meets
    all of it. The first of equal entries wins.
    """
    ship(texts.sparkSession)
    if lexicon.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"a lexicon has at most {MOST_ENTRIES} entries")
    own = texts.select(F.col(text).alias("text")).where(F.length(text) > 0).distinct()
    scored = similar_pairs(own.crossJoin(F.broadcast(lexicon)), "text", "variant", min_score)
    best = F.max_by(F.struct("key", "variant", "score"), F.struct("score", -F.col("ord")))
    return scored.groupBy("text").agg(best.alias("m")).select("text", "m.key", "m.variant", "m.score")
