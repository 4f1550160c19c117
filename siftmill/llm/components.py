"""Connected components of a graph that is held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


def _smallest(edges: DataFrame) -> DataFrame:
    """For each ``u`` the least of itself and its neighbours ``v``: combined before the shuffle, so hubs cost no more."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))


def _joined(edges: DataFrame) -> DataFrame:
    return edges.join(_smallest(edges).hint("merge"), F.col("u") == F.col("mu"))


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(id, component_id)`` for every end of an edge; component_id is the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the shared
    folder, until a round changes nothing.  Nothing but a count and two digests of the table comes to the driver.  Self-loops and
    repeated edges are harmless; null ends are left out; an empty table gives an empty result.
    """
    base = shared.work_dir(spark, "components")
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, old, before = shared.saved(e, f"{base}/0"), f"{base}/0", None
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _joined(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = shared.saved(small, f"{base}/{k}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())
        shared.delete(spark, old)
        old = f"{base}/{k}"
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
