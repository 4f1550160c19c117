"""Which names of a query its schema does not explain: tables, qualified columns, and bare names by scope."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sqltext


def references(sql: str) -> dict:
    """Tables of FROM and JOIN, columns with the table that their qualifier stands for, and bare names; all lower-cased."""
    low = {a.lower(): t.lower() for a, t in sqltext.aliases(sql).items()}
    tokens = sqltext.lex(sql)
    named = [t[1:-1] if t[0] in "`\"" and len(t) > 1 else t for t in tokens]
    ends = {(low.get(a.lower(), a.lower()), c.lower()) for a, dot, c in zip(named, tokens[1:], named[2:]) if dot == "." and (a[:1].isalpha() or a[:1] == "_") and (c[:1].isalpha() or c[:1] == "_")}
    return {
        "tables": sorted({t for t in low.values() if t != "(subquery)"}),
        "qualified": [{"tab": a, "col": c} for a, c in sorted(ends)],
        "bare": sorted({b.lower() for b in sqltext.bare_identifiers(sql)}),
    }


_NAMES = T.ArrayType(T.StringType())
_REFERENCES = T.StructType([T.StructField("tables", _NAMES), T.StructField("qualified", T.ArrayType(T.StructType([T.StructField("tab", T.StringType()), T.StructField("col", T.StringType())]))), T.StructField("bare", _NAMES)])
references_of = F.pandas_udf(lambda s: pd.DataFrame([references(x or "") for x in s], columns=["tables", "qualified", "bare"]), _REFERENCES)


def schema_usage(rows: DataFrame, catalogue: DataFrame, sql: str = "sql") -> DataFrame:
    """``rows`` (with ``db``) and ``issues``, an array: what is unknown or ambiguous against ``catalogue`` (db, tab, col).

    One row per database meets each query, so nothing is exploded; a bare name is looked up in the tables the query
    uses.  Null or blank text has the single issue ``empty``; a database without a catalogue knows no name.
    """
    known = catalogue.groupBy(F.col("db").alias("known_db")).agg(F.collect_set(F.struct(F.lower("tab").alias("tab"), F.lower("col").alias("col"))).alias("known_cols"))
    d = rows.select(F.struct(*rows.columns).alias("row"), F.col("db").alias("row_db"), F.col(sql).alias("row_sql"))  # the caller's columns go along as one, so no name can clash
    d = d.withColumn("refs", references_of("row_sql")).join(known, F.col("row_db") == F.col("known_db"), "left")
    known_cols = F.coalesce("known_cols", F.array().cast("array<struct<tab:string,col:string>>"))
    tabs = F.transform(known_cols, lambda k: k.tab)

    def owners(c: Column) -> Column:
        return F.size(F.filter(known_cols, lambda k: (k.col == c) & F.array_contains(F.col("refs.tables"), k.tab)))

    gone = F.transform(F.filter("refs.tables", lambda t: ~F.array_contains(tabs, t)), lambda t: F.concat(F.lit("table:"), t))
    wrong = F.filter("refs.qualified", lambda q: F.array_contains(tabs, q.tab) & ~F.array_contains(known_cols, q))
    wrong = F.transform(wrong, lambda q: F.concat(F.lit("column:"), q.tab, F.lit("."), q.col))
    unknown = F.transform(F.filter("refs.bare", lambda b: owners(b) == 0), lambda b: F.concat(F.lit("unresolved:"), b))
    many = F.transform(F.filter("refs.bare", lambda b: owners(b) > 1), lambda b: F.concat(F.lit("ambiguous:"), b))
    blank = F.coalesce(F.trim("row_sql") == "", F.lit(True))
    issues = F.when(blank, F.array(F.lit("empty"))).otherwise(F.concat(gone, wrong, unknown, many))
    return d.select(*[F.col("row")[c].alias(c) for c in rows.columns], issues.alias("issues"))
