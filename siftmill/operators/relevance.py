"""Relevance of tables and columns for a repair, repair classes with confidence, and joins of anchor tables.

A context is a row (question_id, db, question, hints, sql, error); a catalogue has (db, tab, col, is_pk,
is_fk).  A context meets the tables and columns of its own database, which are a catalogue's worth of rows.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqlfeat, text
from . import coverage, sqltext
from .dedup import sequence_ratio

# Points of a table and of a column for each sign of relevance.
TABLE_POINTS = {"question": 3.0, "question_words": 2.0, "column_words": 1.5, "hints": 4.0, "hint_words": 2.5, "hint_column_words": 2.0, "sql": 6.0, "alias": 5.0, "error": 4.0, "error_column": 5.0}
COLUMN_POINTS = {"pk": 10.0, "fk": 8.0, "own_alias": 10.0, "other_alias": 6.0, "bare": 8.0, "error": 10.0, "near_error": 8.0, "far_error": 4.0, "question": 4.0, "question_words": 2.0, "hints": 5.0, "hint_words": 3.0}
NEAR, FAR, PRIMARY = 0.7, 0.5, 1.2


def _within(needle: Column, haystack: Column) -> Column:
    return F.coalesce((needle != "") & F.lower(haystack).contains(F.lower(needle)), F.lit(False))


def _points(*parts: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in parts:
        out = out + F.when(condition, points).otherwise(0.0)
    return out


def contexts(rows: DataFrame) -> DataFrame:
    """Adds what the scores read: word sets, the tables, aliases and columns of the query, and the failed column."""
    failed = F.regexp_replace(text.error_identifier("error", "column"), r"^\w+\.", "")
    return rows.withColumns(
        {
            "question_words": F.array_distinct(text.tokenize("question")),
            "hint_words": F.array_distinct(text.tokenize(F.coalesce("hints", F.lit("")))),
            "sql_tables": coverage.lowered(text.source_tables("sql")),
            "alias_pairs": coverage.lowered(sqltext.aliases_of("sql")),
            "qualified": coverage.lowered(text.qualified_columns("sql")),
            "bare": coverage.lowered(sqltext.bare_identifiers_of("sql")),
            "failed": F.lower(F.coalesce(failed, F.lit(""))),
        }
    )


def table_scores(contexts_: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(question_id, tab, score) for every table of the context's database."""
    tables = catalogue.groupBy("db", "tab").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    # The failed name is compared with each column name once, not once for every question.
    near = contexts_.where("failed <> ''").select("db", "failed").distinct().join(catalogue.select("db", "tab", "col"), "db")
    near = near.withColumn("r", sequence_ratio(F.lower("col"), F.col("failed"))).groupBy("db", "failed", "tab").agg((F.max("r") > NEAR).alias("near"))
    met = contexts_.join(tables, "db").join(near, ["db", "failed", "tab"], "left")
    own, low, p = F.array_distinct(text.tokenize("tab")), F.lower("tab"), TABLE_POINTS
    of_columns = F.array_distinct(F.flatten(F.transform("cols", lambda c: text.tokenize(c))))
    has_hints = F.coalesce(F.col("hints") != "", F.lit(False))
    score = _points(
        (_within(F.col("tab"), F.col("question")), p["question"]),
        (has_hints & _within(F.col("tab"), F.col("hints")), p["hints"]),
        (F.array_contains("sql_tables", low), p["sql"]),
        (F.exists("alias_pairs", lambda a: F.substring_index(a, "=", -1) == low), p["alias"]),
        (_within(F.col("tab"), F.col("error")), p["error"]),
        (F.coalesce("near", F.lit(False)), p["error_column"]),
    )
    for a, b, points in ((own, "question_words", "question_words"), (of_columns, "question_words", "column_words"), (own, "hint_words", "hint_words"), (of_columns, "hint_words", "hint_column_words")):
        score = score + text.jaccard(a, F.col(b)) * p[points]
    return met.select("question_id", "tab", score.alias("score"))


def column_scores(contexts_: DataFrame, catalogue: DataFrame, primary: DataFrame) -> DataFrame:
    """(question_id, tab, col, score); columns of the question's primary table count a fifth more."""
    names = contexts_.where("failed <> ''").select("failed").distinct().join(F.broadcast(catalogue.select(F.lower("col").alias("low")).distinct()))  # a catalogue's names with the failed ones
    like = names.withColumn("r", sequence_ratio("low", "failed"))
    met = contexts_.join(catalogue, "db").withColumn("low", F.lower("col")).join(like, ["low", "failed"], "left").join(primary, "question_id", "left")
    low, p = F.col("low"), COLUMN_POINTS
    ends = F.filter("qualified", lambda q: F.substring_index(q, ".", -1) == low)
    table_of = lambda q: F.coalesce(F.try_element_at(F.transform(F.filter("alias_pairs", lambda a: F.substring_index(a, "=", 1) == F.substring_index(q, ".", 1)), lambda a: F.substring_index(a, "=", -1)), F.lit(1)), F.substring_index(q, ".", 1))
    in_sql = F.aggregate(ends, F.lit(0.0), lambda s, q: s + F.when(table_of(q) == F.lower("tab"), p["own_alias"]).otherwise(p["other_alias"]))
    in_error = F.when(F.col("failed") == "", 0.0).when(low == F.col("failed"), p["error"]).when(F.col("r") > NEAR, p["near_error"]).when(F.col("r") > FAR, p["far_error"]).otherwise(0.0)
    own = F.array_distinct(text.tokenize("col"))
    has_hints = F.coalesce(F.col("hints") != "", F.lit(False))
    score = _points((F.col("is_pk"), p["pk"]), (F.col("is_fk"), p["fk"]), (F.array_contains("bare", low), p["bare"]), (_within(F.col("col"), F.col("question")), p["question"]), (has_hints & _within(F.col("col"), F.col("hints")), p["hints"]))
    score = score + in_sql + in_error + text.jaccard(own, F.col("question_words")) * p["question_words"] + text.jaccard(own, F.col("hint_words")) * p["hint_words"]
    return met.select("question_id", "tab", "col", (score * F.when(F.col("primary_table").eqNullSafe(F.col("tab")), PRIMARY).otherwise(1.0)).alias("score"))


def relations(selected: DataFrame, fks: DataFrame) -> DataFrame:
    """(question_id, relation) for every key between two selected tables (question_id, tab)."""
    one, two = (selected.select(F.col("question_id").alias(f"q{k}"), F.lower("tab").alias(f"t{k}")).distinct() for k in (1, 2))
    met = one.join(fks, F.col("t1") == F.lower("src_t")).join(two, (F.col("q1") == F.col("q2")) & (F.lower("dst_t") == F.col("t2")))
    return met.select(F.col("q1").alias("question_id"), F.concat("src_t", F.lit("."), "src_c", F.lit(" = "), "dst_t", F.lit("."), "dst_c").alias("relation")).distinct()


def connected_anchors(anchors: list[str], edges: dict[str, list[str]]) -> list[str]:
    """Anchors in order, each with the tables of the shortest path from those before it; anchors without a path stand alone."""

    def path(a: str, b: str) -> list[str]:
        before, queue = {a: ""}, deque([a])
        while queue:
            at = queue.popleft()
            if at == b:
                out = [b]
                while before[out[-1]]:
                    out.append(before[out[-1]])
                return out[::-1]
            for n in edges.get(at, ()):
                if n not in before:
                    before[n] = at
                    queue.append(n)
        return []

    out: list[str] = []
    for anchor in anchors:
        if anchor not in out:
            found = [p for p in (path(x, anchor) for x in out) if p]
            out += [t for t in (min(found, key=len) if found else [anchor]) if t not in out]
    return out if len(anchors) > 1 else []


def bridged(rows: DataFrame, fks: DataFrame) -> DataFrame:
    """Adds ``required``: the anchors (array of table names, in order) and what joins them.  Keys are those of one catalogue."""
    both = fks.select(F.lower("src_t").alias("a"), F.lower("dst_t").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    near = both.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("graph"))

    @F.pandas_udf("array<string>")
    def connect(anchors: pd.Series, graph: pd.Series) -> pd.Series:
        return pd.Series([connected_anchors([x.lower() for x in a], {k: list(v) for k, v in dict(g or {}).items()}) if a is not None else None for a, g in zip(anchors, graph)])

    return rows.crossJoin(F.broadcast(near)).withColumn("required", connect("anchors", "graph")).drop("graph")  # one row: the key graph


def repair_class(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds failure_type, confidence and repairability to (question_id, correct, exec_failed, wrong_result, sql, error).

    A failed name is looked up in the catalogue: where it stands, else the best like name.
    """
    low = F.lower(F.coalesce("error", F.lit("")))
    named = rows.withColumns({"low": low, "named": F.lower(F.coalesce(F.nullif(text.error_identifier("error", "column"), F.lit("")), F.nullif(text.error_identifier("error", "table"), F.lit("")), F.nullif(F.regexp_extract("error", r"(?i)ambiguous column name:\s*(\w+)", 1), F.lit("")), F.lit("")))})
    named = named.withColumns({"failed": F.regexp_replace("named", r"^.*\.", ""), "alias": F.when(F.col("named").contains("."), F.substring_index("named", ".", 1)), "aliased": coverage.lowered(sqltext.aliases_of("sql"))})
    columns = catalogue.select(F.lower("tab").alias("t"), F.lower("col").alias("c")).distinct()
    tables = columns.select(F.lit("table").alias("kind"), F.col("t").alias("name")).distinct()
    names = columns.select(F.lit("column").alias("kind"), F.col("c").alias("name")).distinct().unionByName(tables)
    kind = F.when(low.contains("no such table"), "table").otherwise("column")
    named = named.withColumn("kind", kind)
    best = named.where("failed <> ''").select("kind", "failed").distinct().join(F.broadcast(names), "kind")  # a catalogue's names
    best = best.withColumn("r", sequence_ratio("name", "failed")).groupBy("kind", "failed").agg(F.max("r").alias("best"))
    holders = columns.groupBy(F.col("c").alias("failed")).agg(F.array_sort(F.collect_set("t")).alias("holders"))
    d = named.join(best, ["kind", "failed"], "left").join(F.broadcast(holders), "failed", "left")  # one row for each column name of a catalogue
    d = d.crossJoin(F.broadcast(catalogue.where(F.col("col").rlike(r"[\s()\-%/]")).agg(F.collect_set("col").alias("specials"))))  # one row
    table = F.try_element_at(F.transform(F.filter("aliased", lambda a: F.substring_index(a, "=", 1) == F.col("alias")), lambda a: F.substring_index(a, "=", -1)), F.lit(1))
    d = d.withColumns({"table": table, "n_holders": F.coalesce(F.size("holders"), F.lit(0)), "best": F.coalesce("best", F.lit(0.0))})
    sure, several = F.col("n_holders") == 1, F.col("n_holders") > 0
    wrong_alias = F.col("alias").isNotNull() & F.col("table").isNotNull() & ~F.coalesce(F.array_contains("holders", F.col("table")), F.lit(False))
    no_column, no_table, syntax = low.contains("no such column"), low.contains("no such table"), low.contains("syntax error")
    special = coverage.unquoted_special(F.col("sql"), F.col("specials"))
    odd = F.size(F.split("sql", r"\(")) != F.size(F.split("sql", r"\)"))
    # Class, confidence and repairability of each kind of failure, first that holds.
    rules = [
        (F.col("correct"), None, None, None),
        (~F.col("exec_failed") & F.col("wrong_result"), "wrong_result_non_exec_failure", 0.5, 0.0),
        (~F.col("exec_failed"), "generic_exec_error", 0.3, 0.1),
        (no_column & (F.col("failed") == ""), "exact_identifier_error", 0.6, 0.3),
        (no_column & several & wrong_alias, "alias_error", 0.9, 0.85),
        (no_column & sure & F.col("alias").isNotNull(), "wrong_table_side_error", 0.85, 0.75),
        (no_column & several & F.col("alias").isNotNull(), "wrong_table_side_error", 0.6, 0.45),
        (no_column & sure, "wrong_table_side_error", 0.8, 0.7),
        (no_column & several, "wrong_table_side_error", 0.55, 0.4),
        (no_column & (F.col("best") > 0.8), "exact_identifier_error", 0.95, 0.9),
        (no_column & (F.col("best") > 0.6), "exact_identifier_error", 0.75, 0.65),
        (no_column, "exact_identifier_error", 0.6, 0.3),
        (no_table & (F.col("best") > 0.8), "exact_identifier_error", 0.95, 0.85),
        (no_table & (F.col("best") > 0.6), "exact_identifier_error", 0.75, 0.55),
        (no_table, "exact_identifier_error", 0.7, 0.4),
        (syntax & special, "exact_identifier_error", 0.85, 0.8),
        (syntax & sqlfeat.truncated("sql"), "degenerate_or_truncated_sql", 0.9, 0.6),
        (syntax & odd, "degenerate_or_truncated_sql", 0.85, 0.5),
        (syntax, "generic_exec_error", 0.6, 0.3),
        (low.contains("misuse of aggregate"), "derived_metric_error", 0.8, 0.5),
        (low.rlike("type mismatch|datatype mismatch|cannot compare|invalid literal|no such function: like|like pattern|argument of where must be type boolean"), "filter_value_mapping_error", 0.8, 0.5),
        (low.contains("cannot apply") & low.rlike("=|<|>|like"), "filter_value_mapping_error", 0.7, 0.4),
        (low.contains("ambiguous column"), "join_backbone_error", 0.8, 0.6),
        (low.rlike("cartesian product|cross join|missing on clause|join condition|no join condition"), "join_backbone_error", 0.75, 0.5),
    ]
    out = F
    for condition, *values in rules:
        out = out.when(condition, F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(values, ("string", "double", "double"), ("failure_type", "confidence", "repairability"))]))
    out = out.otherwise(F.struct(F.lit("generic_exec_error").alias("failure_type"), F.lit(0.5).alias("confidence"), F.lit(0.2).alias("repairability")))
    return d.withColumn("class", out).select(*rows.columns, "class.*")
