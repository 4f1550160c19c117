"""Repairs: guards on structure, acceptance, and ranked candidates for a failed identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .dedup import sequence_ratio
from .sqltext import select_items_of

# Classes that allow small fixes only, and how much of the text a class may change.
TINY = ("exact_identifier_error", "wrong_table_side_error", "alias_error")
DIFF_LIMITS = {"exact_identifier_error": 0.2, "wrong_table_side_error": 0.2, "alias_error": 0.15, "degenerate_or_truncated_sql": 0.4, "derived_metric_error": 0.3, "filter_value_mapping_error": 0.25, "join_backbone_error": 0.3, "generic_exec_error": 0.15}
DEFAULT_LIMIT, HARD_LIMIT = 0.2, 0.5
_STOPS = ("GROUP BY", "HAVING", "ORDER BY", "LIMIT", "UNION")


def diff_ratio(a: Column, b: Column) -> Column:
    """Share of the folded text that differs."""
    return 1 - sequence_ratio(text.folded(a), text.folded(b))


def with_guards(rows: DataFrame, original: str = "original", repaired: str = "repaired", kind: str = "failure_type") -> DataFrame:
    """Adds diff_ratio and ``structure_issues``; the latter is empty for classes that may be rewritten."""
    o, r = F.col(original), F.col(repaired)
    out = rows.withColumns(
        {
            "new_tables": F.array_except(text.source_tables(r), text.source_tables(o)),
            "joins_before": F.regexp_count(o, F.lit(r"(?i)\bJOIN\b")),
            "joins_after": F.regexp_count(r, F.lit(r"(?i)\bJOIN\b")),
            "select_before": F.array_join(select_items_of(o), ", "),
            "select_after": F.array_join(select_items_of(r), ", "),
            "where_before": text.clause(o, "WHERE", _STOPS),
            "where_after": text.clause(r, "WHERE", _STOPS),
        }
    )
    out = out.withColumns({"diff_ratio": diff_ratio(o, r), "select_diff": diff_ratio(F.col("select_before"), F.col("select_after")), "where_diff": diff_ratio(F.col("where_before"), F.col("where_after"))})
    checks = [
        (F.size("new_tables") > 0, "new tables"),
        (F.col("joins_before") != F.col("joins_after"), "join count"),
        (F.col("select_diff") > 0.35, "select targets"),
        ((F.col("where_before") != "") & (F.col("where_after") != "") & (F.col("where_diff") > 0.4), "where logic"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))
    return out.withColumn("structure_issues", F.when(F.col(kind).isin(*TINY), issues).otherwise(F.array().cast("array<string>")))


def acceptance(schema_ok: Column, structure_ok: Column, runs: Column, gold_runs: Column, equal: Column, identical: Column, ratio: Column, kind: Column) -> Column:
    """accepted, or the first reason against."""
    limits = F.create_map(*[F.lit(x) for kv in DIFF_LIMITS.items() for x in kv])
    limit = F.coalesce(F.try_element_at(limits, kind), F.lit(DEFAULT_LIMIT))
    rules = [(~schema_ok, "schema invalid"), (~structure_ok, "structure guard failed"), (~runs, "execution still failed"), (~gold_runs, "gold execution failed"), (~equal, "result mismatch"), (identical, "identical"), (ratio > HARD_LIMIT, "diff >50%"), (ratio > limit, "diff over class limit")]
    out = F
    for condition, reason in rules:
        out = out.when(condition, reason)
    return out.otherwise("accepted")


def candidates(failed: DataFrame, columns: DataFrame, threshold: float = 0.6, top: int = 5) -> DataFrame:
    """Catalogue columns like a failed name, best first: (row_id, name) x (table_name, column_name).

    The catalogue is joined by shared letter pairs, so that names with nothing in common never meet.
    """
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    a = failed.select("row_id", F.lower("name").alias("name")).distinct().withColumn("g", F.explode(pairs(F.col("name"))))
    b = columns.select("table_name", "column_name", F.lower("column_name").alias("low")).distinct().withColumn("g", F.explode(pairs(F.col("low"))))
    met = a.join(b, "g").select("row_id", "name", "table_name", "column_name", "low").distinct()
    scored = met.withColumn("score", sequence_ratio("name", "low")).where(F.col("score") >= threshold)
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "column_name", "table_name")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top).select("row_id", "rk", "table_name", "column_name", "score")


def repairability(classified: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean repairability and the number of repairable rows by class."""
    return classified.groupBy("failure_type").agg(F.count("*").alias("n"), F.avg("repairability").alias("mean"), F.count_if(F.col("repairability") >= least).alias("repairable"))


def from_log(log: DataFrame, failures: DataFrame, passed: Column) -> DataFrame:
    """Each row of a repair log (db_id, question_id, final_accepted, final_sql, failure_type) with its ``outcome``.

    Outcomes in this order: ``not accepted``, ``no failure`` (none of that db_id and question_id), ``empty`` text,
    ``not verified`` (``passed``, over the columns of both), else ``example``, whose ``corrected_sql``, ``failure_type``
    (the log's, else the failure's ``inferred_type``) and ``example_id`` make a training example.  Failures have one row
    of each db_id and question_id, and beside these no column of the log's; null ids meet no failure.
    """
    seen = failures.withColumn("failed", F.lit(True))
    d = log.join(seen, ["db_id", "question_id"], "left").withColumn("corrected_sql", F.trim(F.coalesce("final_sql", F.lit(""))))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    outcome = F.when(no(F.col("final_accepted")), "not accepted").when(no(F.col("failed")), "no failure").when(F.col("corrected_sql") == "", "empty").when(no(passed), "not verified").otherwise("example")
    return d.withColumns({"outcome": outcome, "failure_type": F.coalesce("failure_type", "inferred_type"), "example_id": F.concat_ws("_", F.lit("repair"), "db_id", F.col("question_id").cast("string"))}).drop("failed")
