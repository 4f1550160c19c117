"""Tables, columns and foreign keys as DataFrames; paths and neighbourhoods over the key graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(fks: DataFrame) -> DataFrame:
    """Distinct edges (a, b), both ways, without self-loops."""
    one = fks.select(F.col("src_t").alias("a"), F.col("dst_t").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def paths(edges: DataFrame, hops: int = 5) -> DataFrame:
    """(src, dst, hops, path): the shortest path of each pair, least in order on ties.

    Level by level; a pair's path is settled at the first level that reaches it, so a level holds at most
    one row per pair.  A schema's key graph is small: its size is that of a catalogue, not of the data.
    """
    found = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("hops"), F.concat_ws(">", "a", "b").alias("path"))
    last = found
    for k in range(2, hops + 1):
        step = last.join(edges, F.col("dst") == F.col("a")).where("src <> b")
        step = step.groupBy("src", F.col("b").alias("dst2")).agg(F.min(F.concat_ws(">", "path", "b")).alias("path"))
        last = step.join(found.select(F.col("src").alias("s"), F.col("dst").alias("d")), (F.col("src") == F.col("s")) & (F.col("dst2") == F.col("d")), "left_anti").select("src", F.col("dst2").alias("dst"), F.lit(k).alias("hops"), "path")
        found = found.unionByName(last)
    return found


def neighbourhood(edges: DataFrame, seeds: list[str], hops: int) -> DataFrame:
    """(table_name, distance) of all tables within ``hops`` of the seeds."""
    spark = edges.sparkSession
    found = spark.createDataFrame([(s, 0) for s in seeds], "table_name string, distance int")
    for k in range(1, hops + 1):
        step = found.join(edges, F.col("table_name") == F.col("a")).select(F.col("b").alias("table_name"), F.lit(k).alias("distance"))
        found = found.unionByName(step).groupBy("table_name").agg(F.min("distance").alias("distance"))
    return found


def bridges(edges: DataFrame, selected: list[str]) -> DataFrame:
    """Tables that touch at least two selected ones and are not selected."""
    return edges.where(F.col("a").isin(selected) & ~F.col("b").isin(selected)).groupBy(F.col("b").alias("table_name")).agg(F.count_distinct("a").alias("links")).where("links >= 2")


def column_score(name: Column, is_pk: Column, is_fk: Column, in_sql: Column, text: Column) -> Column:
    """Relevance of a column: keys, mentions in SQL, in the text, as words, and by single words."""
    low = F.lower(name)
    words = F.size(F.filter(F.split(low, "_"), lambda w: (F.length(w) > 3) & text.contains(w)))
    parts = ((is_pk, 100), (is_fk, 90), (in_sql, 80), (text.contains(low), 60), (text.contains(F.replace(low, F.lit("_"), F.lit(" "))), 50))
    out = words * 10
    for condition, points in parts:
        out = out + F.when(condition, points).otherwise(0)
    return out


def top_columns(scored: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("table_name").orderBy(F.desc("score"), "column_name")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)


def schema_id(tables: Column, required: list[tuple[str, tuple[str, ...]]], signature: Column | None = None) -> Column:
    """The id that a known ``signature`` has, else the first id whose distinctive tables are all there, else ``unknown``; ``tables`` is lower-cased."""
    by_tables = [F.when(F.size(F.array_except(F.array(*map(F.lit, need)), tables)) == 0, name) for name, need in required]
    return F.coalesce(*([] if signature is None else [signature]), *by_tables, F.lit("unknown"))
