"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop and reassemble.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased.  Keys found in
at least ``min_docs`` documents lose all their lines in every document; keys below ``min_chars`` code
points never do.  Counting sends one row per key and task flush, whatever the key's frequency.  The keys
over the threshold go to the workers as a set if there are few; otherwise the lines are joined with them
by hash, and the dropped positions are joined back to the documents.  Both ways drop the same lines.

Each row of the table is a document (a repeated row counts again).  Null and empty texts are one empty
line.  A document that loses all its lines keeps the empty text.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import shared

#: Counts held by a task before it hands them on.
FLUSH = 200_000
#: At most so many frequent keys (16 bytes each) are sent to every worker; more are joined.
BROADCAST_KEYS = 400_000


def key_of(line: bytes) -> bytes:
    """``bytes.strip`` and ``bytes.lower`` touch ASCII only."""
    return line.strip().lower()


def _hash_of(line: bytes, min_chars: int) -> bytes | None:
    key = key_of(line)
    if len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars):
        return None
    return xxh3_128_digest(key)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(key, n): in how many documents each line key is found."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["key", "n"])

        for batch in batches:
            for text in shared.utf8_rows(batch.column(1)):
                own = {_hash_of(line, min_chars) for line in bytes(text).split(b"\n")}
                own.discard(None)
                counts.update(own)
                if len(counts) >= FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return _texts(docs).transform(shared.in_arrow, run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _rebuilt(batch: pa.RecordBatch, dropped, kept_bytes: int = 64 << 20):
    """dropped: (row number, lines) -> which lines go, as booleans."""
    rows: list[tuple] = []
    size = 0
    ids = batch.column(0)
    for i, text in enumerate(shared.utf8_rows(batch.column(1))):
        lines = bytes(text).split(b"\n")
        gone = dropped(i, lines)
        kept = [x for x, g in zip(lines, gone) if not g]
        rows.append((ids[i].as_py(), len(lines), len(lines) - len(kept), b"\n".join(kept)))
        size += len(rows[-1][3])
        if size >= kept_bytes:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, n_lines, n_dropped, kept = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text string"


def line_dedup(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text."""
    path = shared.work_dir(spark, "line_dedup")
    frequent = shared.saved(line_counts(docs, min_chars).where(F.col("n") >= min_docs).select("key"), path)
    if frequent.count() <= broadcast_keys:
        keys = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.collect()))

        def run(batches):
            known = keys.value
            for batch in batches:
                yield from _rebuilt(batch, lambda _, lines: [_hash_of(x, min_chars) in known for x in lines])

        return _texts(docs).transform(shared.in_arrow, run, SCHEMA)
    return _joined(docs, frequent, min_chars)


def _joined(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    # Rows of one key have the same doc_id (null too) and the same lines, so the same positions go.
    own = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))
    texts = _texts(docs).withColumn("id", own)

    def lines(batches):
        for batch in batches:
            row, at, key = [], [], []
            for r, text in zip(batch.column(0).to_pylist(), shared.utf8_rows(batch.column(1))):
                for k, line in enumerate(bytes(text).split(b"\n")):
                    if (h := _hash_of(line, min_chars)) is not None:
                        row.append(r), at.append(k), key.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.binary()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], names=["id", "at", "key"])

    def rebuild(batches):
        for batch in batches:
            gone = [set(x or ()) for x in batch.column(2).to_pylist()]
            yield from _rebuilt(batch, lambda i, lines: [k in gone[i] for k in range(len(lines))])

    spots = texts.select("id", "text").transform(shared.in_arrow, lines, "id binary, at int, key binary").join(frequent.hint("merge"), "key", "left_semi")
    gone = spots.groupBy("id").agg(F.collect_set("at").alias("gone"))
    return texts.join(gone.hint("merge"), "id", "left").select("doc_id", "text", "gone").transform(shared.in_arrow, rebuild, SCHEMA)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(spark, docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, p.i AS pos, p.x AS line, regexp_replace(regexp_replace(p.x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'x': x})) AS p FROM documents)
), f AS (
  SELECT doc_id, pos, line, translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM f WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (c.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM f LEFT JOIN c USING (key) GROUP BY doc_id
"""
