"""Deduplication, similarity and contamination over text columns."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_of(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key; the order must be total."""
    struct = F.struct(*order, F.struct(*rows.columns).alias("row"))
    return rows.groupBy(key.alias("dedup_key")).agg(F.min(struct).alias("m")).select("m.row.*")


def reject_reasons(batch: DataFrame, history: DataFrame, key: str, order: str) -> DataFrame:
    """``batch`` with reject_reason: seen before, repeated in the batch, or null for what is accepted."""
    seen = history.select(F.col(key).alias("seen")).distinct()
    w = Window.partitionBy(key).orderBy(order)
    out = batch.withColumn("rk", F.row_number().over(w)).join(seen, F.col(key) == F.col("seen"), "left")
    return out.withColumn("reject_reason", F.when(F.col("seen").isNotNull(), "history").when(F.col("rk") > 1, "batch")).drop("rk", "seen")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; there is no column form of it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def may_be_similar(len_a: Column, len_b: Column, tokens_a: Column, tokens_b: Column, gap: float = 0.65, overlap: float = 0.10) -> Column:
    """Cheap tests before the ratio: relative length gap, then token overlap."""
    from ..functions.text import jaccard

    longer = F.greatest(len_a, len_b)
    return ((longer == 0) | (F.abs(len_a - len_b) / longer <= gap)) & (jaccard(tokens_a, tokens_b) >= overlap)


def greedy_near_dedup(rows: DataFrame, pool: str, order: str, text: str, threshold: float = 0.85, window: int = 100) -> DataFrame:
    """Keeps a row unless it is like one of the last ``window`` kept rows of its pool; (order, kept, similar_to).

    The rule depends on earlier decisions, so a pool is one sequential pass: its rows stream through one
    group's batches in order, and only the window is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            out = []
            for p, o, t in zip(pdf["pool"], pdf["ord"], pdf["txt"]):
                if state.get("pool") != p:
                    state = {"pool": p, "kept": []}
                tokens, like = set(t.split()), None
                for ko, kt, kk in reversed(state["kept"]):
                    longest = max(len(t), len(kt))
                    if longest and abs(len(t) - len(kt)) / longest > 0.65:
                        continue
                    if len(tokens & kk) < 0.10 * len(tokens | kk):
                        continue
                    m = difflib.SequenceMatcher(None, kt, t)
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        like = ko
                        break
                if like is None:
                    state["kept"] = [*state["kept"][-(window - 1) :], (o, t, tokens)] if window > 1 else [(o, t, tokens)]
                out.append((p, o, like is None, like))
            yield pd.DataFrame(out, columns=["pool", "ord", "kept", "similar_to"]).astype({"similar_to": "Int64"})

    part = rows.select(F.col(pool).cast("string").alias("pool"), F.col(order).cast("long").alias("ord"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("txt"))
    part = part.repartition("pool").sortWithinPartitions("pool", "ord")
    return part.mapInPandas(run, "pool string, ord long, kept boolean, similar_to long")


def example_similarity(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Of two examples (question, broken query, corrected query): 0.4, 0.3 and 0.3 of their likeness, case and spaces folded."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    parts = [sequence_ratio(fold(x), fold(y)) * w for x, y, w in zip(a, b, (0.4, 0.3, 0.3))]
    return parts[0] + parts[1] + parts[2]
