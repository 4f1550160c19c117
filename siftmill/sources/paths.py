"""Lookup of a named database or table file below a root, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def find(spark: SparkSession, root: str, name: str, suffixes: tuple[str, ...] = ("sqlite", "db")) -> str | None:
    """``root/name/name.suffix`` of the first suffix if it is there, else the first ``root/*/name.suffix`` by suffix and path, else None."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = jvm.org.apache.hadoop.fs.Path(base, f"{name}/{name}.{suffixes[0]}")
    if fs.exists(own):
        return own.toString()
    plain = "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name)
    for suffix in suffixes:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"*/{plain}.{suffix}")) or []
        if paths := sorted(s.getPath().toString() for s in found):
            return paths[0]
    return None
