"""Checks of compact schemas against the full one and against the query that they must serve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JOIN = r"(?i)JOIN\s+[`\"]?\w+[`\"]?\s+.*?ON\s+[`\"]?\w+[`\"]?\.`?(\w+)`?\s*=\s*[`\"]?\w+[`\"]?\.`?(\w+)`?"


def words(sql: Column) -> Column:
    """Distinct identifiers of a query, lower-cased, without what stands in literals."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), r"'(?:[^']|'')*'", " ")), F.lit(r"[a-z_]\w*"), F.lit(0)))


def lowered(names: Column) -> Column:
    return F.transform(names, lambda x: F.lower(x))


def invented(full: Column, compact: Column) -> Column:
    """Names of the compact schema that the full one does not hold."""
    return F.array_sort(F.array_except(compact, full))


def missing(sql: Column, full_tables: Column, full_columns: Column, tables: Column, columns: Column) -> Column:
    """``table:x`` and ``column:x`` for all that the query takes from the full schema and the compact one lacks.

    A name that is a table's is none of a column.
    """
    used = words(sql)
    own = lambda names, kept: F.array_sort(F.array_except(F.array_intersect(used, lowered(names)), lowered(kept)))
    gone_tables = F.transform(own(full_tables, tables), lambda x: F.concat(F.lit("table:"), x))
    gone_columns = F.array_except(own(full_columns, columns), lowered(full_tables))
    return F.concat(gone_tables, F.transform(gone_columns, lambda x: F.concat(F.lit("column:"), x)))


def missing_join_column(sql: Column, columns: Column) -> Column:
    """The first column of a join condition that the compact schema lacks; null if joins hold."""
    sides = [F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(_JOIN), F.lit(k)) for k in (1, 2)]
    ends = F.flatten(F.zip_with(*sides, lambda a, b: F.array(F.lower(a), F.lower(b))))
    return F.try_element_at(F.filter(ends, lambda c: ~F.array_contains(lowered(columns), c)), F.lit(1))


def unquoted_special(sql: Column, columns: Column) -> Column:
    """Whether a column of several words with special characters is used without its quotes."""
    special = F.filter(columns, lambda c: c.rlike(r"[\s()\-%/]") & (F.size(F.split(F.trim(c), r"\s+")) > 1))
    first = lambda c: F.regexp_replace(F.element_at(F.split(F.trim(c), r"\s+"), 1), r"([\\\[\](){}.*+?^$|/-])", r"\\$1")
    return F.coalesce(F.exists(special, lambda c: F.rlike(sql, F.concat(F.lit(r"\b"), first(c), F.lit(r"\b(?!\s*`)"))) & ~sql.contains(F.concat(F.lit("`"), c, F.lit("`")))), F.lit(False))
