"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components.

Rows with equal vectors form a class; one row stands for it and carries the class's size.  Each table
hashes a vector to the signs of its projections on ``bits`` random hyperplanes.  ``bits`` follows the
number of classes, so that buckets stay about as large at any size, and the number of tables follows from
the recall asked for at the threshold itself (closer pairs are found more surely).  Within a bucket all
cosines are computed in double precision; a bucket above ``BLOCK`` rows is cut into blocks, and each pair
of blocks is a task's work, so that no task holds a whole bucket.  Pairs are never written out: a task
returns for each of its vectors the links found and one edge of a spanning forest.  A pair that meets in
several tables counts in the first of them.

Every vector is compared on its own scale, a power of two, so components of any magnitude neither vanish nor
overflow.  Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and
neither do rows without an id, which have no component and are kept.  Vectors of different lengths do not
link.  Repeated rows are members of one class and link with each other.  Only the id and the vector are read,
so other columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import shared
from .chosen_path import _runs
from .components import connected_components

BLOCK, PER_BUCKET, RECALL, SEED = 1024, 512, 0.9995, 20


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's hash and the number of tables, for n vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 2) / PER_BUCKET)))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def hyperplanes(width: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, width, bits]).standard_normal((tables * bits, width)).T


def codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """A row's hash in each table."""
    signs = (x @ hyperplanes(x.shape[1], tables, bits) >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def number_type(vectors: DataFrame, vec_col: str) -> str:
    """How components are held: as 32 bits where the column has these, else as doubles; cosines are in doubles."""
    return "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "<f8"


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and the vector's components as bytes; null where it links with nothing."""
    kind = number_type(vectors, vec_col)

    def run(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False) if i.is_valid and v.is_valid and v.values.null_count == 0 else np.empty(0)
                out.append((x + 0.0).astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).transform(shared.in_arrow, run, "id long, vec binary")


def scaled(x: np.ndarray) -> np.ndarray:
    """Doubles with each row's largest component between 1/2 and 1; dividing by a power of two is exact."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _code_type(bits: int) -> str:
    return next(f"<u{k}" for k in (1, 2, 4, 8) if bits <= 8 * k)


def _hashed(kind: str, tables: int, bits: int):
    def run(batches):
        for batch in batches:
            vecs = shared.utf8_rows(batch.column(1))
            widths = np.array([len(v) for v in vecs]) // np.dtype(kind).itemsize
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                for part in np.array_split(at, max(1, len(at) // 1000)):
                    x = np.frombuffer(b"".join(vecs[i] for i in part), kind).reshape(len(part), w)
                    code = codes(scaled(x), tables, bits)
                    signature = pa.array([c.astype(_code_type(bits)).tobytes() for c in code], pa.binary())
                    own = batch.take(pa.array(part))
                    for t in range(tables):
                        bucket = (code[:, t] * 4096 + t) * 65536 + w
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), own.column(0), own.column(2), own.column(1), signature], names=["bucket", "id", "copies", "vec", "sig"])

    return run


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """For each row the row that it hangs on, over the links of a block; itself at a root."""
    n = len(adjacent)
    parent, left = np.arange(n), adjacent.any(axis=1)
    while left.any():
        root = int(np.argmax(left))
        seen = np.zeros(n, bool)
        seen[root] = True
        edge = seen
        while edge.any():
            reach = adjacent[edge].any(axis=0) & ~seen
            seen |= reach
            edge = reach
        parent[seen] = root
        left &= ~seen
    return parent


def _linked(batches, threshold: float, kind: str, bits: int):
    """Rows (bucket, i, j, side, ...) -> (id, other, n): links counted for id in this block pair, and an edge."""
    wide = _code_type(bits)
    for t in _runs(batches, 3):
        bucket, bi, bj, side, ids, copies = (t.column(k).to_numpy() for k in range(6))
        vecs, sigs = shared.utf8_rows(t.column(6)), shared.utf8_rows(t.column(7))
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
        got_id, got_other, got_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(bucket)]]).tolist()):
            if e - s < 2:
                continue
            table = int(bucket[s]) // 65536 % 4096
            x = scaled(np.frombuffer(b"".join(vecs[s:e]), kind).reshape(e - s, -1))
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            code = np.frombuffer(b"".join(sigs[s:e]), wide).reshape(e - s, -1)
            near = x @ x.T >= threshold * norm[:, None] * norm[None, :]
            np.fill_diagonal(near, False)
            if bi[s] != bj[s]:
                near &= side[s:e, None] != side[None, s:e]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            new = ~(code[a, :table] == code[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
            n = np.bincount(a[new], weights=copies[s:e][b[new]], minlength=e - s).astype(np.int64)
            up = _forest(near)
            some = np.flatnonzero((n > 0) | (up != np.arange(e - s)))
            got_id.append(ids[s:e][some])
            got_other.append(ids[s:e][up[some]])
            got_n.append(n[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (got_id, got_other, got_n)], names=["id", "other", "n"])


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    base = shared.work_dir(spark, "embedding_dedup")
    rows = shared.saved(_packed(vectors, id_col, vec_col), f"{base}/rows")
    classes = shared.saved(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), f"{base}/classes")
    n, kind = classes.count(), number_type(vectors, vec_col)
    bits, tables = plan(n, threshold, recall)
    hashed = shared.saved(classes.select("id", "vec", "copies").transform(shared.in_arrow, _hashed(kind, tables, bits), "bucket long, id long, copies long, vec binary, sig binary"), f"{base}/hashed")
    sizes = shared.saved(hashed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), f"{base}/sizes")
    sized = hashed.join(shared.small_side(sizes, f"{base}/sizes"), "bucket", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK).cast("long"), F.lit(1).cast("long"))
    cut = sized.withColumn("slot", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cut = cut.select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), (F.col("slot") > F.col("other")).cast("long").alias("side"), "id", "copies", "vec", "sig")
    found = cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").transform(shared.in_arrow, lambda b: _linked(b, threshold, kind, bits), "id long, other long, n long")
    found = shared.saved(found, f"{base}/found")
    shared.delete(spark, f"{base}/hashed")
    groups = connected_components(spark, found.select("id", "other").distinct(), "id", "other")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    by_class = classes.join(links.withColumnRenamed("id", "l").hint("merge"), F.col("id") == F.col("l"), "left").join(groups.withColumnRenamed("id", "g").hint("merge"), F.col("id") == F.col("g"), "left")
    by_class = by_class.select(F.col("vec").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.join(by_class.hint("merge"), F.col("vec") == F.col("of"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)
