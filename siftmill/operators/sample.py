"""Deterministic sampling, splitting and balancing; every choice follows from hashes and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_hash(seed: str | int, *parts: Column) -> Column:
    """sha256 of the seed and the parts, as lowercase hex."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def unit_hash(h: Column) -> Column:
    """The first eight hex digits as a fraction of one."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def bucket_100(h: Column) -> Column:
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


def ranked(rows: DataFrame, group: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def stratified_split(rows: DataFrame, strata: list[str], key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """train or dev: of n rows in a stratum, max(1, int(n * ratio)) go to dev; none if there is one row."""
    h = keyed_hash(seed, F.col(key))
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n_stratum"))
    out = ranked(rows, strata, h, key).join(counts, strata)
    dev = F.when(F.col("n_stratum") > 1, F.greatest(F.lit(1), F.floor(F.col("n_stratum") * ratio))).otherwise(0)
    return out.withColumn("split", F.when(F.col("rk") <= dev, "dev").otherwise("train")).drop("rk", "n_stratum")


def quota_shortfall(rows: DataFrame, key: str, quotas: dict[str, int]) -> DataFrame:
    targets = rows.sparkSession.createDataFrame(list(quotas.items()), f"{key} string, quota long")
    counts = rows.groupBy(key).agg(F.count("*").alias("have"))
    out = F.broadcast(targets).join(counts, key, "left").na.fill(0, ["have"])  # a literal of the caller
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("quota") - F.col("have")))


def round_robin(rows: DataFrame, group: str, key: str, least: int, total: int, seed: int = 42) -> DataFrame:
    """``least`` rows of every group first, then in turn over the groups, up to ``total`` rows."""
    h = keyed_hash(seed, F.col(key))
    out = ranked(rows, [group], h, key)
    return out.orderBy(F.col("rk") > least, F.when(F.col("rk") > least, F.col("rk")).otherwise(0), keyed_hash(seed, F.col(group)), "rk", key).limit(total)


def capped(rows: DataFrame, group: list[str], cap: Column | int, *order: Column | str) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return ranked(rows, group, *order).where(F.col("rk") <= cap).drop("rk")


def upsample_plan(rows: DataFrame, flag: Column, target: float) -> DataFrame:
    """How many duplicates bring a feature's share to ``target``: int((t * N - c) / (1 - t)), at least none."""
    one = rows.agg(F.count("*").alias("total"), F.count_if(flag).alias("have"))
    return one.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.floor((F.lit(target) * F.col("total") - F.col("have")) / F.lit(1 - target))))


def upsample(rows: DataFrame, flag: Column, key: str, extra: int) -> DataFrame:
    """``rows`` and ``extra`` duplicates of flagged rows, dealt evenly by hash rank."""
    hot = rows.where(flag)
    n = hot.count()
    if not n or extra <= 0:
        return rows
    whole, rest = divmod(extra, n)
    chosen = hot.orderBy(keyed_hash(0, F.col(key)), key).limit(rest) if rest else hot.limit(0)
    again = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("copy") if whole else hot.limit(0)
    return rows.unionByName(again).unionByName(chosen)


def largest_remainder(rows: DataFrame, group: str, total: str, parts: dict[str, float]) -> DataFrame:
    """Splits each group's total into parts that sum to it: floors, then one each by largest fraction."""
    shares = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(float(v)).alias("w"), F.lit(i).alias("at")) for i, (k, v) in enumerate(parts.items())])
    whole = float(sum(parts.values()))
    x = rows.select(group, F.col(total).alias("total"), F.explode(shares).alias("p")).select(group, "total", "p.part", "p.at", (F.col("total") * F.col("p.w") / F.lit(whole)).alias("exact"))
    x = x.withColumn("base", F.floor("exact"))
    w = Window.partitionBy(group)
    x = x.withColumn("left", F.col("total") - F.sum("base").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), "at")))
    return x.select(group, "part", (F.col("base") + F.when(F.col("rk") <= F.col("left"), 1).otherwise(0)).alias("n"))
