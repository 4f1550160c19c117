"""Evaluation metrics: conditional counts and shares over evaluation records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, places: int = 2) -> Column:
    """Per cent, rounded half up; null of nothing."""
    unit = 10.0**places
    return F.floor(part * 100.0 * unit / F.nullif(whole, F.lit(0)) + 0.5) / unit


def n(condition: str | None = None) -> Column:
    return F.count("*") if condition is None else F.count_if(F.col(condition))


def overall(evals: DataFrame) -> DataFrame:
    """Totals and shares; rows with a gold error are in the total and in no bucket."""
    out = evals.agg(n().alias("total"), n("correct").alias("correct"), n("exact_match").alias("exact_match"), n("exec_failed").alias("exec_failed"), n("wrong_result").alias("wrong_result"), n("gold_error").alias("gold_errors"), n("tied").alias("tied_matches"))
    return out.withColumns({f"{c}_pct": share(F.col(c), F.col("total")) for c in ("correct", "exact_match", "exec_failed", "wrong_result")})


def by_group(evals: DataFrame, *keys: str) -> DataFrame:
    out = evals.groupBy(*keys).agg(n().alias("total"), n("correct").alias("correct"), n("exec_failed").alias("exec_failed"), n("wrong_result").alias("wrong_result"))
    return out.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def by_domain(evals: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """As :func:`by_group` over a fixed domain: levels without rows have zeros."""
    levels = evals.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    out = F.broadcast(levels).join(by_group(evals, key), key, "left")  # the domain is a literal of the caller
    return out.na.fill(0, ["total", "correct", "exec_failed", "wrong_result"]).na.fill(0.0, ["accuracy"])


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(n().alias("n"))


def with_share(counts: DataFrame, count: str = "n") -> DataFrame:
    """Counts with their share of all; the counts are few, one row per group."""
    return counts.withColumn("pct", share(F.col(count), F.sum(count).over(Window.partitionBy(F.lit(0)))))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two runs side by side, full outer: rows that one run lacks stay."""
    x = a.select(*keys, F.col("correct").alias("a_correct"))
    y = b.select(*keys, F.col("correct").alias("b_correct"))
    return x.join(y, list(keys), "full_outer")


def win_loss(pairs: DataFrame) -> DataFrame:
    a, b = F.coalesce("a_correct", F.lit(False)), F.coalesce("b_correct", F.lit(False))
    out = pairs.agg(*(F.count_if(c).alias(k) for k, c in (("both_right", a & b), ("both_wrong", ~a & ~b), ("a_only", a & ~b), ("b_only", ~a & b))))
    return out.withColumn("net", F.col("b_only") - F.col("a_only"))


def feature_shares(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per feature: count and per cent of rows, from a single pass."""
    one = rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f"`{k}`").alias("n")) for k in flags))
    out = one.select("total", F.explode(pairs).alias("p")).select(F.col("p.feature").alias("feature"), F.col("p.n").alias("n"), "total")
    return out.select("feature", "n", share(F.col("n"), F.col("total")).alias("pct"))


def band_check(shares: DataFrame, bands: dict[str, tuple[float, float]], near: float = 2.0) -> DataFrame:
    """in, near (within two points) or out of the target band."""
    targets = shares.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in bands.items()], "feature string, low double, high double")
    out = shares.join(F.broadcast(targets), "feature")  # one row per feature of a literal table
    p = F.col("pct")
    state = F.when((p >= F.col("low")) & (p <= F.col("high")), "in").when((p >= F.col("low") - near) & (p <= F.col("high") + near), "near").otherwise("out")
    return out.select("feature", "pct", state.alias("state"))
