"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources, ordered by code point with null last, weigh 1, 2, 3, repeating, and share all words.
   A target stops at ``cap`` times its source's size; the excess is shared anew by weight.
2. Blocks: a hash of doc_id permutes a source's documents into at most ``MAX_BLOCKS`` blocks.  A source
   takes all its blocks as often as its target holds its size, and of a last copy the first blocks up to
   the target.  The block where the target falls gives single documents that fill the gap.
3. Splitting tree: block quotas are split among the output shards, half by half; each split draws the
   left half's quota of every source from a multivariate hypergeometric distribution.
4. A source's drawn blocks, in permuted order, go to the shards by these quotas, so no block copy is drawn
   twice.  Inside a shard documents are ordered by a hash: the local shuffle.

Only one row per source comes to the driver.  All else is joined by (source, block), so the texts are not
shuffled while these tables are small, and by a splittable shuffle join beyond that.  Everything follows
from hashes and a seed: reruns agree.  Null texts have size 0; null and empty source are two sources.
Rows that share a doc_id, or have none, are drawn alike.  Columns of the table may have any names; those
that are named like a column of the result give way.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BLOCK_DOCS, MAX_BLOCKS, SEED = 256, 65_536, 7
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with their number of words, ``size``."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Words that each source gives: a share of all words by weight, at most ``cap`` times its own."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, free, rest = np.zeros(len(size)), np.ones(len(size), bool), float(size.sum())
    while free.any():
        share = rest * weight / weight[free].sum()
        over = free & (share > cap * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * size[over]
        free &= ~over
        rest = float(size.sum()) - out[~free].sum()
    return out.tolist()


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards): how many of each source's blocks each shard gets; shards differ by one block at most per level."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(own: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = own
            return
        middle = (first + last) // 2
        total = int(own.sum())
        take = round(total * (middle - first) / (last - first))
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if total else own * 0
        split(left, first, middle)
        split(own - left, middle, last)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _fill(block: pa.Table) -> pa.Table:
    """Documents of the block in which the target falls: in permuted order while they fit, then the largest that still fit."""
    block = block.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    size, order = block.column("size").to_numpy(), block.column("order").to_numpy()
    gap = float(block.column("gap")[0].as_py()) if len(size) else 0.0
    upto = int(np.searchsorted(size.cumsum(), gap, side="right"))
    chosen = list(range(upto))
    gap -= float(size[:upto].sum())
    rest = []
    for i in (upto + np.lexsort((order[upto:], -size[upto:]))).tolist():
        if size[i] <= gap:
            chosen.append(i)
            gap -= float(size[i])
        else:
            rest.append(i)
    if gap > 0 and rest and size[least := min(rest, key=lambda i: (size[i], i))] < 2 * gap:
        chosen.append(least)
    return block.select(["doc_id", "none"]).take(pa.array(chosen, pa.int64()))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, shards: int = 64, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size and any other columns) with source_size, target and placements.

    ``placements`` has one (copy, shard, order) for each time that the document is taken; it may be empty.
    """
    base = shared.work_dir(spark, "mixing")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("mix_key"), "size")
    sums = sorted(keyed.groupBy("mix_key").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] == "~", r[0]))
    total, n = [int(r[1]) for r in sums], [int(r[2]) for r in sums]
    want = targets(total, [weights[k % len(weights)] for k in range(len(sums))], cap)
    full = [min(int(cap), int(t // s)) if s else 0 for t, s in zip(want, total)]
    blocks = [min(MAX_BLOCKS, max(1, math.ceil(c / BLOCK_DOCS))) for c in n]
    schema = "mix_key string, source_size long, target double, full int, rest double, blocks int"
    sources = [(r[0], s, t, f, max(0.0, t - f * s), b) for r, s, t, f, b in zip(sums, total, want, full, blocks)]
    of_source = shared.small_side(shared.saved(spark.createDataFrame(sources, schema), f"{base}/sources"), f"{base}/sources")
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")).cast("int")

    # Words of each block, and how far the last copy goes.
    by_block = keyed.join(of_source, "mix_key").withColumn("block", block).groupBy("mix_key", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("full").alias("full"))
    by_block = by_block.withColumn("upto", F.expr("sum(words) over (partition by mix_key order by block)"))
    by_block = shared.saved(by_block.withColumn("last", F.when(F.col("upto") <= F.col("rest"), 2).when(F.col("upto") - F.col("words") < F.col("rest"), 1).otherwise(0)), f"{base}/blocks")
    edge = shared.saved(by_block.where("last = 1").select("mix_key", "block", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("gap")), f"{base}/edge")
    edge_rows = keyed.join(of_source, "mix_key").withColumn("block", block).join(shared.small_side(edge, f"{base}/edge"), ["mix_key", "block"]).select("mix_key", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "size", "gap", F.xxhash64(F.lit(seed + 1), "doc_id").alias("order"))
    picked = edge_rows.groupBy("mix_key").applyInArrow(_fill, "doc_id long, none boolean").distinct()
    picked = shared.saved(picked.select(F.when(~F.col("none"), F.col("doc_id")).alias("picked_id"), F.lit(True).alias("picked")), f"{base}/picked")

    # Block copies, dealt to the shards by the tree's quotas.
    copies = F.when(F.col("last") > 0, F.col("full") + 1).otherwise(F.col("full"))
    units = by_block.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    units = shared.saved(units.select("mix_key", "block", "copy", (F.col("copy") >= F.col("full")).alias("late"), "last").withColumn("rank", F.expr(f"row_number() over (partition by mix_key order by xxhash64({seed + 2}, block, copy), block, copy)")), f"{base}/units")
    count = {r[0]: int(r[1]) for r in units.groupBy("mix_key").agg(F.count("*")).collect()}
    names = [r[0] for r in sums]
    quotas = splitting_tree(np.array([count.get(k, 0) for k in names], np.int64), shards, np.random.default_rng(seed))
    dealt = spark.createDataFrame([(k, q.cumsum().tolist()) for k, q in zip(names, quotas)], "mix_key string, upto_shard array<long>")
    dealt = shared.small_side(shared.saved(dealt, f"{base}/quotas"), f"{base}/quotas")
    units = units.join(dealt, "mix_key").withColumn("shard", F.expr("size(filter(upto_shard, x -> x < rank))"))
    placed = units.groupBy("mix_key", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", (F.col("late") & (F.col("last") == 1)).alias("edge")))).alias("placed"))
    placed = shared.saved(placed, f"{base}/placed")

    order = F.expr(f"transform(filter(placed, p -> not p.edge or picked is not null), p -> struct(p.copy as copy, p.shard as shard, xxhash64({seed + 3}, p.shard, p.copy, doc_id) as order))")
    own = [c for c in docs.columns if c not in ("source_size", "target", "placements")]
    out = docs.select(F.struct(*own).alias("document"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("mix_key"))
    out = out.join(of_source, "mix_key").withColumn("block", block).join(shared.small_side(placed, f"{base}/placed"), ["mix_key", "block"], "left")
    out = out.join(shared.small_side(picked, f"{base}/picked"), F.col("doc_id").eqNullSafe(F.col("picked_id")), "left")
    empty = F.expr("cast(array() as array<struct<copy:int,shard:int,order:bigint>>)")
    return out.withColumn("placements", F.coalesce(order, empty)).select("document.*", "source_size", "target", "placements")


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each time that a document is taken, with its shard and place in it."""
    return mixed.withColumn("p", F.explode("placements")).withColumns({"shard": F.col("p.shard"), "order": F.col("p.order")}).drop("p", "placements")


def in_shards(mixed: DataFrame) -> DataFrame:
    """``copies`` by shard, in order within each: over all partitions, so a large shard is several tasks'."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies(mixed).repartitionByRange(n, "shard", "order").sortWithinPartitions("shard", "order")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = shared.saved(sized(docs).drop("text"), shared.work_dir(spark, "mixing-sizes"))
    taken = F.col("size") * F.size("placements")
    return mix(spark, rows).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "placements")
