"""Inputs that the registered queries share, each as a DataFrame and as DuckDB text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL texts of many shapes, made from a document's columns; an expression that both engines read.
_SHAPES = [
    "concat('SELECT COUNT(DISTINCT t1.', lang, ') FROM ', source, ' AS t1 JOIN orders AS t2 ON t1.id = t2.id WHERE t1.n_chars > ', n_chars, ' -- note ', lang)",
    "concat('WITH big AS (SELECT ', lang, ' FROM ', source, ') SELECT * FROM big ORDER BY ', lang, ' DESC LIMIT ', doc_id % 7)",
    "concat('<think>maybe SELECT ', lang, '</think>', chr(10), '```sql', chr(10), 'SELECT ', lang, ', MAX(n_chars) FROM ', source, ' GROUP BY ', lang, ' HAVING COUNT(*) > ', doc_id % 9, ';', chr(10), '```')",
    "concat('The answer is SELECT ', lang, ' FROM ', source)",
    "concat('SELECT a.name, ROW_NUMBER() OVER (PARTITION BY a.', lang, ' ORDER BY a.id) FROM ', source, ' a LEFT JOIN part b ON a.id = b.id')",
    "concat('SELECT CASE WHEN n_chars > ', n_chars, ' THEN 1 ELSE 0 END FROM ', source, ' WHERE id IN (SELECT id FROM ', lang, '_docs) UNION SELECT 2 FROM part')",
    "concat('SELECT , ', lang, ' FROM ', source, ' WHERE (id = 1')",
    "concat('select ', chr(96), lang, chr(96), ' from ', chr(96), source, chr(96), ' where name like ', chr(39), '%a%', chr(39), ' and')",
    "concat('<think>unclosed ', lang, ' WITH q AS (SELECT 1) SELECT id FROM ', source)",
    "concat('SELECT id /* c ', lang, ' */ FROM ', source, ' WHERE EXISTS (SELECT 1 FROM part WHERE part.id BETWEEN 1 AND ', doc_id % 5, ')')",
    "concat('Here is the query: SELECT DISTINCT', chr(10), '  ', lang, '  FROM ', source, ' ORDER BY 1 ASC')",
    "CASE doc_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ';;' WHEN 2 THEN '---' WHEN 3 THEN ' ' ELSE concat('use ', lang) END",
]
SQL_EXPR = f"CASE doc_id % {len(_SHAPES)} " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(_SHAPES)) + " END"
SQLS = f"sqls AS (SELECT doc_id, {SQL_EXPR} AS sql FROM documents)"


def sqls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SQL_EXPR} AS sql")


_ERRORS = "CASE doc_id % 6 WHEN 0 THEN 'no such column: T1.x' WHEN 1 THEN 'no such table: main.t' WHEN 2 THEN 'near \"FROM\": syntax error' WHEN 3 THEN 'ambiguous column name: id' WHEN 4 THEN 'misuse of aggregate: SUM()' ELSE 'interrupted' END"
_DIFFICULTY = "CASE lang WHEN 'en' THEN 'simple' WHEN 'fr' THEN 'moderate' ELSE 'challenging' END"

#: Evaluation records: labels stand for outcomes, source for the database, lang for difficulty; one row in 97 has a gold error and falls in no bucket.
EVALS = f"""evals AS (
  SELECT doc_id AS question_id, source AS db_id, {_DIFFICULTY} AS difficulty,
         NOT gold_error AND toxic = 0 AND quality = 1 AS correct, NOT gold_error AND toxic = 0 AND quality = 1 AND doc_id % 3 = 0 AS exact_match,
         NOT gold_error AND toxic = 1 AS exec_failed, NOT gold_error AND toxic = 0 AND quality = 0 AS wrong_result, gold_error,
         NOT gold_error AND toxic = 0 AND quality = 1 AND doc_id % 11 = 0 AS tied,
         CASE WHEN NOT gold_error AND toxic = 1 THEN {_ERRORS} END AS pred_error
  FROM (SELECT d.doc_id, d.source, d.lang, l.toxic, l.quality, d.doc_id % 97 = 0 AS gold_error FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
)"""


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("gold_error", F.col("doc_id") % 97 == 0)
    sound, fine = ~F.col("gold_error"), (F.col("toxic") == 0) & (F.col("quality") == 1)
    failed = sound & (F.col("toxic") == 1)
    return rows.select(
        F.col("doc_id").alias("question_id"),
        F.col("source").alias("db_id"),
        F.expr(_DIFFICULTY).alias("difficulty"),
        (sound & fine).alias("correct"),
        (sound & fine & (F.col("doc_id") % 3 == 0)).alias("exact_match"),
        failed.alias("exec_failed"),
        (sound & (F.col("toxic") == 0) & (F.col("quality") == 0)).alias("wrong_result"),
        "gold_error",
        (sound & fine & (F.col("doc_id") % 11 == 0)).alias("tied"),
        F.when(failed, F.expr(_ERRORS)).alias("pred_error"),
    )


#: Chat rows: one per conversation, its turns as messages in order.
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(turns.alias("messages"))


#: Candidates for votes: five predictions a question, some of which fail; equal signatures are equal results.
_CANDIDATE = "SELECT doc_id AS question_id, pos, concat('SELECT ', (doc_id * 7 + pos * 3) % 4) AS sql, (doc_id + pos) % 6 <> 0 AS ok, concat('r', (doc_id * 7 + pos * 3) % 4 % 3) AS sig"
CANDIDATES = f"candidates AS ({_CANDIDATE} FROM documents, (VALUES (0), (1), (2), (3), (4)) AS p(pos) WHERE doc_id % 5 <> 4 OR pos < 3)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").withColumn("pos", F.explode(F.array(*[F.lit(k) for k in range(5)])))
    kind = (F.col("doc_id") * 7 + F.col("pos") * 3) % 4
    rows = rows.where((F.col("doc_id") % 5 != 4) | (F.col("pos") < 3))
    return rows.select(F.col("doc_id").alias("question_id"), "pos", F.concat(F.lit("SELECT "), kind).alias("sql"), ((F.col("doc_id") + F.col("pos")) % 6 != 0).alias("ok"), F.concat(F.lit("r"), kind % 3).alias("sig"))


#: Foreign keys of the star schema, as a bounded literal table.
FK_ROWS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
FKS = "fks(src_t, src_c, dst_t, dst_c) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in FK_ROWS) + ")"


def fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FK_ROWS, "src_t string, src_c string, dst_t string, dst_c string")
