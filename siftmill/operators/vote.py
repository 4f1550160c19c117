"""Self-consistency votes over candidate queries and their result signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def result_signature(rows: DataFrame) -> DataFrame:
    """One sha256 for a result as a multiset of rows: independent of order and of column names.

    Of the number of rows and the sums of the four quarters of each row's own sha256, so tasks send sums and no rows.
    """
    cells = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    digest = F.sha2(F.to_json(F.struct(*cells.columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return cells.agg(F.sha2(F.concat_ws("|", F.count("*"), *parts), 256).alias("signature"))


def vote(candidates: DataFrame) -> DataFrame:
    """The chosen query of each question, from (question_id, pos, sql, ok, sig).

    The largest group of equal results wins, the one seen first on ties; in it the most frequent text, the
    shortest, the least in order.  If nothing runs, the most frequent text of all is the fallback.
    """
    per_question = Window.partitionBy("question_id")
    totals = candidates.groupBy("question_id").agg(F.count("*").alias("num_candidates"), F.count_if(F.col("ok")).alias("num_executable"))
    usable = candidates.join(totals, "question_id").where(F.col("ok") | (F.col("num_executable") == 0))
    usable = usable.withColumn("grp", F.when(F.col("ok"), F.col("sig")).otherwise(F.lit("")))
    texts = usable.groupBy("question_id", "grp", "sql").agg(F.count("*").alias("n_text"), F.min("pos").alias("first_text"), F.first("num_candidates").alias("num_candidates"), F.first("num_executable").alias("num_executable"))
    in_group = Window.partitionBy("question_id", "grp")
    texts = texts.withColumns({"n_group": F.sum("n_text").over(in_group), "first_group": F.min("first_text").over(in_group)})
    order = per_question.orderBy(F.desc("n_group"), "first_group", F.desc("n_text"), F.length("sql"), "sql")
    groups = texts.groupBy("question_id").agg(F.count_distinct("grp").alias("num_groups"))
    best = texts.withColumn("rk", F.row_number().over(order)).where("rk = 1").join(groups.select("question_id", "num_groups"), "question_id")
    ran = F.col("num_executable") > 0
    return best.select(
        "question_id",
        F.col("sql").alias("chosen_sql"),
        F.when(ran, "vote").otherwise("fallback").alias("method"),
        "num_candidates",
        "num_executable",
        F.when(ran, F.col("num_groups")).otherwise(0).cast("long").alias("num_result_groups"),
        F.when(ran, F.col("n_group")).otherwise(0).cast("long").alias("winning_group_size"),
        F.when(ran, F.col("n_group") / F.col("num_candidates")).otherwise(0.0).alias("confidence"),
    )
