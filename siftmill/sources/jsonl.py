"""JSON lines and documents: always read with a schema, bad lines set apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAD = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, broken ones have only ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array or object per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_map(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(position))
    return rows.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def write(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines; private columns (leading underscore) are left out, ``by`` makes one folder per value."""
    out = rows.select([c for c in rows.columns if not c.startswith("_")])
    (out.write.partitionBy(*by) if by else out.write).mode("overwrite").json(path)


def write_pools(rows: DataFrame, path: str, pool: str = "pool", split: str = "split") -> None:
    """internal holds internal and clean rows, clean the clean ones, rejected the rest: one write each."""
    write(rows.where(F.col(pool).isin("internal", "clean")), f"{path}/internal", (split,))
    write(rows.where(F.col(pool) == "clean"), f"{path}/clean", (split,))
    write(rows.where(F.col(pool) == "rejected"), f"{path}/rejected")


def samples(rows: DataFrame, category: str, order: str, k: int = 50) -> DataFrame:
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


def _folder(spark: SparkSession) -> str:
    """A new folder below the session's shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/siftmill/jsonl-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    """Written and read again, below the session's shared folder."""
    path = _folder(spark)
    write(rows, path)
    return read(spark, path, schema).drop(BAD)


def pools_round_trip(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    """Written as pools and read again, with the ``folder`` that each row came from."""
    path = _folder(spark)
    write_pools(rows, path)
    out = None
    for name in ("internal", "clean", "rejected"):
        one = read(spark, f"{path}/{name}", schema).drop(BAD).withColumn("folder", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
