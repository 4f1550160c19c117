"""Features, classes and scores of SQL text and of error messages, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

# Patterns of the feature detectors; a detector's names and patterns define its report.
WIDE = {
    "join": r"\bJOIN\b",
    "inner_join": r"\bINNER\s+JOIN\b",
    "left_join": r"\bLEFT\s+(OUTER\s+)?JOIN\b",
    "order_by": r"\bORDER\s+BY\b",
    "distinct": r"\bDISTINCT\b",
    "limit": r"\bLIMIT\b",
    "case": r"\bCASE\b",
    "group_by": r"\bGROUP\s+BY\b",
    "having": r"\bHAVING\b",
    "cte": r"\bWITH\b",
    "window": r"\bOVER\s*\(",
    "union": r"\bUNION\b",
    "like": r"\bLIKE\b",
    "in_clause": r"\bIN\s*\(",
    "exists": r"\bEXISTS\b",
    "aggregation": r"\b(COUNT|SUM|AVG|MAX|MIN)\s*\(",
}
STRICT = {
    "JOIN": r"\bJOIN\b",
    "ORDER_BY": r"\bORDER\s+BY\b",
    "DISTINCT": r"\bDISTINCT\b",
    "LIMIT": r"\bLIMIT\b",
    "SUBQUERY": r"\(\s*SELECT\b",
    "CASE": r"\bCASE\s+WHEN\b",
    "GROUP_BY": r"\bGROUP\s+BY\b",
    "CTE": r"\bWITH\s+\w+\s+AS\s*\(",
    "WINDOW": r"\bOVER\s*\(",
}
#: Target share of rows with a feature, in per cent.
BANDS = {"JOIN": (72, 75), "ORDER_BY": (25, 30), "DISTINCT": (20, 22), "LIMIT": (20, 25), "SUBQUERY": (14, 16), "CASE": (12, 15), "GROUP_BY": (12, 14), "CTE": (5, 7), "WINDOW": (4, 5)}
NARROW = ("join", "order_by", "distinct", "limit", "subquery", "case", "group_by", "cte", "window", "backtick", "aggregation")


# Patterns of the five-feature variant, and the target mode of each failure class.
FIVE = {"case": r"\bCASE\b", "cte": r"\bWITH\b", "window": r"\bOVER\s*\(", "join": r"\bJOIN\b", "subquery": "(?s)SELECT.*SELECT"}
TARGET_MODES = {
    "exact_identifier_error": "column_error",
    "wrong_table_side_error": "wrong_table_ownership",
    "alias_error": "column_error",
    "wrong_return_field": "return_field_mismatch",
    "wrong_count_granularity": "wrong_count_granularity",
    "missing_distinct": "distinct_shape_error",
    "wrong_denominator": "wrong_denominator",
    "wrong_cohort_definition": "wrong_denominator",
    "aggregate_logic_error": "aggregation_level_error",
    "join_path_error": "join_path_error",
    "table_family_confusion": "phase_table_confusion",
    "wrong_filter_condition": "wrong_denominator",
    "wrong_literal_mapping": "return_field_mismatch",
    "temporal_anchor_error": "temporal_anchor_error",
    "output_shape_error": "output_format_error",
    "degenerate_or_truncated_sql": "truncation_error",
    "syntax_local_error": "syntax_error",
}


def _n(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def wide_features(c) -> dict[str, Column]:
    """18 flags."""
    up = F.upper(text(c))
    flags = {k: up.rlike(p) for k, p in WIDE.items()}
    return flags | {"subquery": _n(up, "SELECT") > 1, "backtick": text(c).contains("`")}


def narrow_features(c) -> dict[str, Column]:
    """11 flags."""
    all_ = wide_features(c)
    return {k: all_[k] for k in NARROW}


def strict_features(c) -> dict[str, Column]:
    """9 flags."""
    return {k: text(c).rlike(f"(?i){p}") for k, p in STRICT.items()}


def substring_features(c) -> dict[str, Column]:
    """12 flags by plain substrings."""
    up = F.upper(text(c))
    has = up.contains
    return {
        "cte": has("WITH ") & has("AS ("),
        "window": has("OVER (") | has("OVER("),
        "case": has("CASE ") | has("CASE\n"),
        "subquery": _n(up, "SELECT") > 1,
        "join": has(" JOIN "),
        "group_by": has("GROUP BY"),
        "having": has("HAVING"),
        "union": has("UNION"),
        "distinct": has("DISTINCT"),
        "limit": has("LIMIT"),
        "order": has("ORDER BY"),
        "between": has("BETWEEN"),
    }


def five_features(c) -> dict[str, Column]:
    """5 flags."""
    up = F.upper(text(c))
    return {k: up.rlike(p) for k, p in FIVE.items()}


def eight_features(c) -> dict[str, Column]:
    """8 flags by plain substrings."""
    has = F.upper(text(c)).contains
    return {
        "cte": has("WITH "),
        "window": has(" OVER(") | has(" OVER ("),
        "subquery": _n(F.upper(text(c)), "SELECT") > 1,
        "case": has("CASE "),
        "join": has("JOIN"),
        "agg": has("SUM(") | has("COUNT(") | has("AVG(") | has("MAX(") | has("MIN("),
        "like": has("LIKE "),
        "having": has("HAVING "),
    }


def target_mode(kind: Column) -> Column:
    """The failure that a made example of a class should show."""
    modes = F.create_map(*[F.lit(x) for kv in TARGET_MODES.items() for x in kv])
    return F.coalesce(F.try_element_at(modes, kind), F.lit("return_field_mismatch"))


def difficulty_score(c) -> Column:
    low = F.lower(text(c))
    parts = [
        2 * _n(low, r"\bjoin\b"),
        3 * (_n(low, "select") - 1),
        low.rlike(r"\b(count|sum|avg|max|min)\s*\(").cast("int"),
        low.contains("group by").cast("int"),
        2 * low.contains("having").cast("int"),
        3 * low.rlike(r"\bover\s*\(").cast("int"),
        low.contains("distinct").cast("int"),
        2 * low.rlike(r"\b(union|intersect|except)\b").cast("int"),
        2 * F.ltrim(low).startswith("with").cast("int"),
    ]
    return reduce(lambda a, b: a + b, parts)


def difficulty(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 6, "moderate").otherwise("challenging")


def corrected_difficulty(stated: Column, found: Column) -> Column:
    """The stated level, unless it is at the other end of the scale."""
    far = ((stated == "simple") & (found == "challenging")) | ((stated == "challenging") & (found == "simple"))
    return F.when(far, found).otherwise(stated)


def _first(rules: list[tuple[Column, str]], other) -> Column:
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(other)


def error_category(c) -> Column:
    """Seven outcomes; the first rule that fits decides."""
    low = F.lower(text(c))
    return _first(
        [(low == "", "unknown"), (low.contains("no such column"), "column_error"), (low.contains("no such table"), "table_error"), (low.contains("syntax error"), "syntax_error"), (low.contains("aggregate"), "aggregate_error"), (low.contains("ambiguous column"), "ambiguous_column"), (low.contains("near"), "syntax_error")],
        "other_error",
    )


def error_kind(c) -> Column:
    """Eight outcomes of the online evaluator."""
    low = F.lower(text(c))
    return _first(
        [(low.contains(k), v) for k, v in (("no such column", "column_not_found"), ("no such table", "table_not_found"), ("syntax error", "syntax_error"), ("ambiguous column", "ambiguous_column"), ("unrecognized token", "unrecognized_token"), ("misuse of aggregate", "aggregate_misuse"), ("near", "syntax_near"))],
        "other",
    )


#: The failure class of an error category.
CATEGORY_TO_TYPE = {"column_error": "exact_identifier_error", "table_error": "exact_identifier_error", "syntax_error": "syntax_local_error", "value_error": "wrong_literal_mapping"}


def failure_type(exec_failed: Column, wrong_result: Column, category: Column, sql: Column, message: Column) -> Column:
    """The failure class from what is known about a prediction: category, then message, then the text's shape."""
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_TO_TYPE.items() for x in kv])
    by_category = F.when(exec_failed, F.try_element_at(known, category))
    low = F.lower(text(message))
    by_message = F.when(exec_failed & (low.contains("no such column") | low.contains("no such table")), "exact_identifier_error").when(exec_failed & low.contains("syntax error"), "syntax_local_error").when(exec_failed & low.contains("ambiguous"), "alias_error")
    bare = F.trim(sql)
    degenerate = (F.length(bare) > 0) & ((F.length(bare) < 10) | ~F.upper(bare).startswith("SELECT"))
    rest = F.when(degenerate, "degenerate_or_truncated_sql").when(wrong_result, "wrong_return_field").when(exec_failed, "syntax_local_error").otherwise("wrong_return_field")
    return F.coalesce(by_category, by_message, rest)


#: Weights of example sources, and the factors of hard classes and of database families.
SOURCE_WEIGHTS = {"real_failure": 1.3, "contrastive": 1.2, "manual_fix": 1.4, "deterministic_fix": 1.1, "synthetic_corruption": 1.0}
TYPE_FACTOR, WEAK_FACTOR, ROBUST_FACTOR = 1.2, 1.15, 1.05


def sampling_weight(source: Column, priority: Column, family: Column) -> Column:
    """source weight x class factor x family factor (2 weak, 1 robust, else none), to two places."""
    weights = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    raw = F.coalesce(F.try_element_at(weights, source), F.lit(1.0)) * F.when(priority, TYPE_FACTOR).otherwise(1.0) * F.when(family == 2, WEAK_FACTOR).when(family == 1, ROBUST_FACTOR).otherwise(1.0)
    return F.floor(raw * 100 + 0.5) / 100.0


#: Hints that say nothing.
JUNK_HINTS = (r"^FALSE;?$", r"^TRUE;?$", r"^;+$", r"^This is not;?$", r"^None;?$", r"^N/A;?$", r"^\.+$", r"^-+$", r"^_+$")


def junk_hint(c) -> Column:
    bare = F.trim(text(c))
    return (bare == "") | bare.rlike("(?i)" + "|".join(f"(?:{p})" for p in JUNK_HINTS)) | ((F.length(bare) < 5) & ~bare.rlike("[a-zA-Z0-9]"))


def balanced(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("("))) == F.length(F.replace(c, F.lit(")")))


def sql_validity(c) -> Column:
    """OK or the first reason against."""
    bare = F.trim(text(c))
    return _first([(bare == "", "Empty SQL"), (~bare.rlike(r"(?i)\bSELECT\b"), "No SELECT"), (~balanced(bare), "Unbalanced parentheses"), (bare.rlike(r"(?i)\bSELECT\s*,"), "SELECT followed by comma")], "OK")


def prose_reason(c) -> Column:
    """Why a text is prose rather than SQL; null if it is clean."""
    raw, bare = text(c), F.trim(text(c))
    low = F.lower(bare)
    starts = [(low.startswith(f"{w} "), f"Starts with '{s} '") for w, s in (("the", "the"), ("here", "here"), ("this", "this"), ("to", "to"), ("i", "I"))]
    rules = [(raw == "", "Empty SQL"), *starts, (raw.contains("```"), "Contains code fences"), (raw.startswith("#"), "Starts with markdown header"), (low.rlike(r"\bexplanation\b"), "Contains 'explanation'"), (low.rlike(r"\bnote:\b"), "Contains 'Note:'"), (F.length(bare) < 8, "SQL too short"), (~bare.rlike(r"(?i)^\s*(SELECT|WITH|INSERT|UPDATE|DELETE)"), "Does not start with SQL keyword")]
    return _first(rules, None)


def response_reason(c) -> Column:
    up = F.trim(F.upper(text(c)))
    return _first([(text(c) == "", "Empty response"), (~up.rlike("^(SELECT|WITH|INSERT|UPDATE|DELETE)"), "Does not start with SQL keyword"), (F.length(text(c)) < 10, "SQL too short")], None)


def truncated(c) -> Column:
    bare = F.trim(text(c))
    dangling = bare.rlike(r"(?i)\b(SELECT|FROM|WHERE|AND|OR|JOIN|ON|ORDER BY|GROUP BY|HAVING|LIMIT|SET|VALUES)\s*$")
    odd = F.length(bare) - F.length(F.replace(bare, F.lit("'")))
    return (text(c) == "") | dangling | ~balanced(bare) | (odd % 2 != 0) | (F.upper(bare).startswith("SELECT") & (F.length(bare) < 20))


def error_bucket(correct: Column, exec_failed: Column, wrong_result: Column, category: Column) -> Column:
    named = F.nullif(category, F.lit(""))
    return F.when(correct, "correct").when(exec_failed, F.coalesce(named, F.lit("exec_failed"))).when(wrong_result, "wrong_result").otherwise(F.coalesce(named, F.lit("other_error")))


def rejection_category(reason: Column) -> Column:
    low = F.lower(reason)
    return _first([(low.contains("diff") | low.contains(">50%"), "high_diff"), (low.contains("schema"), "schema_invalid"), (low.contains("execution") | low.contains("failed"), "exec_failed"), (low.contains("hygiene"), "hygiene_failed")], None)


def contamination_source(kind: Column, run: Column, benchmark_db: Column, reference: Column, broken: Column, outside_parent: Column) -> Column:
    """Where an example's benchmark contamination comes from; ordered rules."""
    direct = (kind == "real_failure") & (F.lower(run).rlike("t10|t11") | benchmark_db)
    made = kind == "synthetic_corruption"
    fixed = kind.isin("contrastive", "manual_fix", "deterministic_fix")
    return _first(
        [(direct, "bird_dev_direct"), ((reference == "gold") & benchmark_db, "bird_gold_reference"), (F.lower(broken).contains("prediction") & benchmark_db, "bird_prediction_broken"), (made & outside_parent, "non_benchmark"), (made & benchmark_db, "bird_gold_reference"), (fixed & (outside_parent | ~benchmark_db), "non_benchmark"), (benchmark_db, "bird_dev_direct")],
        "non_benchmark",
    )


def pool(source: Column, passed: Column, reference_valid: Column, complete: Column) -> Column:
    return F.when(~passed | ~reference_valid | ~complete, "rejected").when(source.isin("non_benchmark", "transformed_archetype"), "clean").otherwise("internal")


def route_reason(source: Column, passed: Column, reference_valid: Column, complete: Column) -> Column:
    clean = source.isin("non_benchmark", "transformed_archetype")
    return F.when(~passed, "Validation failed").when(~reference_valid, "Reference SQL invalid or missing").when(~complete, "Missing required metadata fields").when(clean, F.concat(F.lit("Clean source: "), source)).otherwise(F.concat(F.lit("Benchmark-derived: "), source))


def risk(source: Column) -> Column:
    return F.when(source == "non_benchmark", "none").when(source == "transformed_archetype", "low").otherwise("high")


def reward(gold_ok: Column, pred_ok: Column, equal: Column) -> Column:
    return F.when(~gold_ok | ~pred_ok, 0.0).when(equal, 1.0).otherwise(0.3)


def over_compaction(compact: Column, original: Column, least_columns: Column) -> Column:
    """Why a compact schema is too small; null if it is not."""
    reduction = F.when(original > 0, 100 * (1 - compact / original)).otherwise(0.0)
    return F.when((original > 2000) & (compact < 400), "too small").when((original > 3000) & (reduction > 85), "too aggressive").when(least_columns < 3, "too thin")
