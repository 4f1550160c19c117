"""Corruptions of correct SQL, for repair examples; each returns the text unchanged where it does not apply."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sqltext import aliases


def _first(c: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match only: the lazy head keeps what stands before it."""
    return F.regexp_replace(c, rf"(?is)^(.*?){pattern}", rf"$1{replacement}")


def remove_distinct(c: Column) -> Column:
    return _first(c, r"\bDISTINCT\s+", "")


def count_distinct_to_count(c: Column) -> Column:
    return _first(c, r"\bCOUNT\s*\(\s*DISTINCT\s+", "COUNT(")


def count_to_star(c: Column) -> Column:
    return _first(c, r"\bCOUNT\s*\(\s*[A-Za-z_][\w.]*\s*\)", "COUNT(*)")


def remove_backticks(c: Column) -> Column:
    return F.replace(c, F.lit("`"), F.lit(""))


def flip_order(c: Column) -> Column:
    """The first direction is turned round."""
    desc = F.regexp_extract(c, r"(?i)\b(ASC|DESC)\b", 1)
    return F.when(F.upper(desc) == "ASC", _first(c, r"\bASC\b", "DESC")).when(F.upper(desc) == "DESC", _first(c, r"\bDESC\b", "ASC")).otherwise(c)


def change_limit(c: Column) -> Column:
    """LIMIT n becomes LIMIT n + 1."""
    n = F.regexp_extract(c, r"(?i)\bLIMIT\s+(\d+)", 1)
    head = F.regexp_extract(c, r"(?is)^(.*?\bLIMIT\s+)\d+", 1)
    tail = F.regexp_extract(c, r"(?is)^.*?\bLIMIT\s+\d+(.*)$", 1)
    return F.when(n != "", F.concat(head, (n.cast("long") + 1).cast("string"), tail)).otherwise(c)


def truncate(c: Column, seed: Column) -> Column:
    """Cut at 50 to 80 per cent of the length, by a hash of the seed."""
    part = F.lit(50) + F.pmod(F.conv(F.substring(F.md5(seed.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(31))
    return F.substring(c, F.lit(1), F.floor(F.length(c) * part / 100).cast("int"))


def _pick(seed, options: list):
    """A choice that follows from the seed alone."""
    import hashlib

    return options[int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) % len(options)] if options else None


def drop_condition(sql: str, seed) -> str:
    """Without one of the WHERE clause's AND conditions, or without WHERE if it has only one."""
    m = re.search(r"(?is)\bwhere\b(.*?)(?=\b(?:group\s+by|having|order\s+by|limit|union)\b|$)", sql or "")
    if not m:
        return sql or ""
    parts, depth, last, body = [], 0, 0, m[1]
    for t in re.finditer(r"'(?:[^']|'')*'|\(|\)|(?i:\bbetween\b)|(?i:\band\b)", body):
        depth += (t[0] == "(") - (t[0] == ")")
        if t[0].lower() == "between":
            depth += 1  # its own AND ends it
        elif t[0].lower() == "and" and depth:
            depth -= depth == 1 and "between" in body[last : t.start()].lower()
        elif t[0].lower() == "and":
            parts.append(body[last : t.start()].strip())
            last = t.end()
    parts.append(body[last:].strip())
    if len(parts) < 2:
        return (sql[: m.start()].rstrip() + " " + sql[m.end() :].lstrip()).strip()
    gone = _pick(seed, list(range(len(parts))))
    kept = " AND ".join(p for k, p in enumerate(parts) if k != gone)
    return f"{sql[: m.start()]}WHERE {kept} {sql[m.end() :]}".strip()


def swap_alias(sql: str, seed) -> str:
    """One qualified column moves to another alias."""
    names = sorted(aliases(sql))
    used = [m for m in re.finditer(r"\b([A-Za-z_]\w*)\.[A-Za-z_]\w*", sql or "") if m[1] in names]
    m = _pick(seed, used)
    other = _pick(f"{seed}/", [n for n in names if m and n != m[1]])
    return f"{sql[: m.start(1)]}{other}{sql[m.end(1) :]}" if m and other else sql or ""


def wrong_column(sql: str, seed, columns: list[str]) -> str:
    """One column name becomes another of the catalogue."""
    known = {c.lower() for c in columns}
    m = _pick(seed, [m for m in re.finditer(r"\b[A-Za-z_]\w*\b", sql or "") if m[0].lower() in known])
    other = _pick(f"{seed}/", sorted(c for c in columns if m and c.lower() != m[0].lower()))
    return f"{sql[: m.start()]}{other}{sql[m.end() :]}" if m and other else sql or ""


def by_row(function, *args):
    """One of the corruptions above as a column of (sql, seed), in Arrow batches."""
    return F.pandas_udf(lambda s, k: pd.Series([function(x or "", i, *args) for x, i in zip(s, k)], dtype=object), T.StringType())


def compatible(sql: Column) -> dict[str, tuple[Column, Column]]:
    """Transform -> whether a query has what it changes, and the changed text."""
    up = F.upper(sql)
    return {
        "count_distinct_to_count": (up.contains("COUNT(DISTINCT"), count_distinct_to_count(sql)),
        "count_to_count_star": (up.contains("COUNT("), count_to_star(sql)),
        "remove_distinct": (up.contains("DISTINCT"), remove_distinct(sql)),
        "wrong_order_direction": (up.contains(" ASC") | up.contains(" DESC"), flip_order(sql)),
        "change_limit": (up.contains("LIMIT"), change_limit(sql)),
        "remove_backticks": (sql.contains("`"), remove_backticks(sql)),
    }


def examples(sources: DataFrame, key: str, sql: str, quota: int, attempts: int = 3) -> DataFrame:
    """(key, transform, broken, corrected): up to ``quota`` examples of each transform.

    Compatible sources are tried in an order that follows from a hash of transform and key, ``attempts`` times the quota
    at most, and those count that the transform changes.  Both limits are the feature; they cut within tasks first.
    """
    made = F.array(*[F.when(fits, F.struct(F.lit(name).alias("transform"), broken.alias("broken"))) for name, (fits, broken) in compatible(F.col(sql)).items()])
    d = sources.select(F.col(key), F.col(sql).alias("corrected"), F.explode(F.array_compact(made)).alias("m")).select(key, "corrected", "m.*")
    w = Window.partitionBy("transform").orderBy(F.md5(F.concat_ws("/", "transform", F.col(key).cast("string")).cast("binary")), key)
    tried = d.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= quota * attempts)
    kept = tried.where(F.col("broken") != F.col("corrected")).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= quota)
    return kept.select(key, "transform", "broken", "corrected")
