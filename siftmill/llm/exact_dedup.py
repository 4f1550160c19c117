"""Exact dedup: stateful streaming deduplication over disk-backed keyed state that never expires.

1. Every arriving text is reduced to an *arrival*: row number, doc_id, digest of the normalised text,
   code points of the original and a locator (input file and doc_id).  Arrivals are a written table.
2. A streaming aggregation over the arrivals keeps, per digest, how many texts have it and which row
   stays.  Its state is in RocksDB under the query's checkpoint, without a watermark, so nothing is
   ever forgotten; partial aggregation sends one row per digest and task, whatever the group's size.
3. On hits (a digest met more than once) the full bytes are compared: the locators of these digests lead
   back to the texts, which are grouped by their bytes.  Should two texts share a digest, each text becomes
   a group.

Where a job ends after any ingest, another one on the same folder goes on: row numbers follow from the written
arrivals, and of a digest's states the last batch's counts.

Null and empty texts are equal to each other and to texts of white space only.  A row that repeats both
doc_id and text is one more copy: one of the rows stays.  A row without a doc_id comes after all others of its
length.  Only doc_id and text are read, so other columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: memoryview | bytes) -> bytes:
    return bytes(text).translate(None, shared.ASCII_WS)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def digested(docs: DataFrame, with_text: bool = False, digest=sha256, file: F.Column | None = None) -> DataFrame:
    """doc_id, locator, digest, n_code (and the normalised text) of each row."""
    schema = "doc_id long, file string, digest binary, n_code int" + ", norm binary" * with_text

    def run(batches):
        for batch in batches:
            text = batch.column(2)
            norm = [normalised(x) for x in shared.utf8_rows(text)]
            out = [batch.column(0), batch.column(1), pa.array([digest(x) for x in norm], pa.binary()), pc.fill_null(pc.utf8_length(text), 0).cast(pa.int32())]
            names = ["doc_id", "file", "digest", "n_code"] + ["norm"] * with_text
            yield pa.RecordBatch.from_arrays(out + [pa.array(norm, pa.binary())] * with_text, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.input_file_name() if file is None else file).alias("file"), F.col("text").cast("string").alias("text")).transform(shared.in_arrow, run, schema)


def _stays() -> F.Column:
    """The row that stays: most code points, then smallest doc_id, then first row."""
    # As a decimal the least long can be turned over too.
    return F.max(F.struct("n_code", (-F.col("doc_id").cast("decimal(20,0)")).alias("neg_id"), (-F.col("row")).alias("neg_row"), "file")).alias("best")


class StreamingDedup:
    """Deduplicates tables that arrive one after the other under one state folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256):
        self.spark, self.folder, self.digest = spark, folder or shared.work_dir(spark, "exact_dedup"), digest

    def _next(self) -> int:
        """The number of the next ingest: arrivals hold those of all before, also of other jobs."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/arrivals")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return 0
        last = self.arrivals().agg(F.max("row")).first()[0]
        return 0 if last is None else (last >> 52) + 1

    def ingest(self, docs: DataFrame) -> None:
        """Append the arrivals of ``docs`` and bring the keyed state up to date."""
        arrivals = digested(docs, digest=self.digest).withColumn("row", F.monotonically_increasing_id() + F.lit(self._next() << 52))
        arrivals.write.mode("append").parquet(f"{self.folder}/arrivals")
        own = self.spark.newSession()
        own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        # A state partition's files take what they hold, not what the store would set aside in advance.
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        own.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        own.conf.set("spark.sql.session.timeZone", "UTC")
        folder = self.folder

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

        stream = own.readStream.schema(arrivals.schema).parquet(f"{folder}/arrivals").groupBy("digest").agg(F.count("*").alias("n"), _stays())
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def arrivals(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, file string, digest binary, n_code int, row long").parquet(f"{self.folder}/arrivals")

    def groups(self) -> DataFrame:
        """The state after the last update of each digest: digest, n, best."""
        schema = "digest binary, n long, best struct<n_code:int,neg_id:decimal(20,0),neg_row:long,file:string>, batch int"
        state = self.spark.read.schema(schema).parquet(f"{self.folder}/state")
        if state.select("batch").distinct().count() <= 1:  # one update: each digest is there once
            return state.drop("batch")
        return state.groupBy("digest").agg(F.max_by("n", "batch").alias("n"), F.max_by("best", "batch").alias("best"))


def exact_dedup(spark: SparkSession, docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, file, digest, n_code, row, keep_id, keep_file, group_size, kept."""
    job = StreamingDedup(spark, digest=digest)
    job.ingest(docs)
    arrivals, groups = job.arrivals(), job.groups()
    hits = shared.saved(groups.where("n > 1").select("digest"), f"{job.folder}/hits")
    where = arrivals.join(shared.small_side(hits, f"{job.folder}/hits"), "digest", "left_semi").select(F.col("file").alias("at_file"), F.col("doc_id").alias("at_id")).distinct()
    where = shared.saved(where, f"{job.folder}/located")
    sure = shared.saved(_compared(_located(docs, shared.small_side(where, f"{job.folder}/located")), shared.small_side(hits, f"{job.folder}/hits"), digest), f"{job.folder}/compared")
    clashes = sure.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    found = _decided(arrivals, groups)
    if clashes.limit(1).count():
        found = _split(spark, docs, arrivals, groups, shared.saved(clashes, f"{job.folder}/clashes"), digest, job.folder)
    return found


def _located(docs: DataFrame, where: DataFrame) -> DataFrame:
    """The rows at some locators."""
    rows = docs.select("doc_id", "text", F.input_file_name().alias("in_file"))
    return rows.join(where, (F.col("in_file") == F.col("at_file")) & F.col("doc_id").cast("long").eqNullSafe(F.col("at_id")), "left_semi")


def _compared(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Texts of the digests that were hit, grouped by their full bytes."""
    return digested(docs, with_text=True, digest=digest, file=F.col("in_file")).select("digest", "norm").join(hits, "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("n")).select("digest", F.length("norm").alias("n_bytes"), "n")


def _decided(arrivals: DataFrame, groups: DataFrame, key: str = "digest") -> DataFrame:
    kept = groups.select(F.col(key).alias("k"), F.col("n").alias("group_size"), (-F.col("best.neg_id")).cast("long").alias("keep_id"), F.col("best.file").alias("keep_file"), (-F.col("best.neg_row")).alias("keep_row"))
    return arrivals.join(kept.hint("merge"), F.col(key) == F.col("k")).withColumn("kept", F.col("row") == F.col("keep_row")).drop("k", "keep_row")


def _split(spark, docs, arrivals, groups, clashes, digest, folder) -> DataFrame:
    """Where different texts share a digest, the bytes themselves are the key."""
    plain = _decided(arrivals.join(clashes, "digest", "left_anti"), groups.join(clashes, "digest", "left_anti"))
    rows = digested(docs, with_text=True, digest=digest).join(clashes.select("digest"), "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = shared.saved(rows, f"{folder}/clashing")
    apart = _decided(rows, rows.groupBy("norm").agg(F.count("*").alias("n"), _stays()), "norm")
    return plain.unionByName(apart.drop("norm"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_dedup(spark, docs)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
