"""Schema compaction: which tables and columns a question needs, with a margin, rendered as short DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqlfeat import over_compaction
from . import coverage, schema_graph


def matches(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """(question_id, db, tab, col, hit): a column is hit by its name or by a word of over three letters of it.

    Joined by database, so a question meets its own catalogue only.
    """
    q = questions.select("question_id", "db", F.lower("question").alias("q"))
    words = F.filter(F.split(F.lower("col"), "_"), lambda w: F.length(w) > 3)
    hit = F.col("q").contains(F.lower("col")) | F.exists(words, lambda w: F.col("q").contains(w))
    return q.join(columns, "db").select("question_id", "db", "tab", "col", "typ", "pos", "is_pk", "ref_table", "ref_col", F.col("q").contains(F.lower("tab")).alias("table_named"), hit.alias("hit"))


def selected(matched: DataFrame, fks: DataFrame) -> DataFrame:
    """(question_id, tab, mentions, why): tables that are hit, and tables that touch two of them."""
    own = matched.groupBy("question_id", "db", "tab").agg(F.count_if(F.col("hit")).alias("mentions"), F.max("table_named").alias("named")).where("mentions > 0 or named")
    edges = schema_graph.undirected(fks)
    met = own.join(edges, F.col("tab") == F.col("a")).groupBy("question_id", "db", F.col("b").alias("bridge")).agg(F.count_distinct("tab").alias("links")).where("links >= 2")
    bridges = met.join(own.select(F.col("question_id").alias("q2"), F.col("tab").alias("t2")), (F.col("question_id") == F.col("q2")) & (F.col("bridge") == F.col("t2")), "left_anti")
    return own.select("question_id", "db", "tab", "mentions", F.lit("hit").alias("why")).unionByName(bridges.select("question_id", "db", F.col("bridge").alias("tab"), F.lit(0).cast("long").alias("mentions"), F.lit("bridge").alias("why")))


def primary(tables: DataFrame) -> DataFrame:
    """The table with most mentions, then by name."""
    w = Window.partitionBy("question_id").orderBy(F.desc("mentions"), "tab")
    return tables.withColumn("rk", F.row_number().over(w)).where("rk = 1").select("question_id", F.col("tab").alias("primary_table"))


def kept_columns(matched: DataFrame, tables: DataFrame, extra: int = 3, near: int = 2, widened: int = 0) -> DataFrame:
    """Hit columns, keys, references, columns within ``near`` places of a hit, and up to ``extra`` more by position."""
    own = matched.join(tables.select(F.col("question_id").alias("q2"), F.col("tab").alias("t2"), "why"), (F.col("question_id") == F.col("q2")) & (F.col("tab") == F.col("t2")))
    w = Window.partitionBy("question_id", "tab").orderBy("pos")
    hit = F.col("hit").cast("int")
    near_hit = F.max(hit).over(w.rowsBetween(-near, near)) > 0
    must = F.col("hit") | F.col("is_pk") | F.col("ref_table").isNotNull() | (near_hit & (F.col("why") == "hit"))
    rest = F.sum(F.when(must, 0).otherwise(1)).over(w)
    return own.withColumn("must", must).withColumn("rest", rest).where(F.col("must") | (F.col("rest") <= extra + widened))


def _ddl(rows: DataFrame, group: list[str]) -> DataFrame:
    line = F.concat(F.lit("    "), "col", F.when(F.col("typ") != "", F.concat(F.lit(" "), "typ")).otherwise(""), F.when(F.col("is_pk"), " PRIMARY KEY").otherwise(""), F.when(F.col("ref_table").isNotNull(), F.concat(F.lit(" REFERENCES "), "ref_table", F.lit("("), "ref_col", F.lit(")"))).otherwise(""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x.line), ",\n")
    tables = rows.groupBy(*group, "tab").agg(F.concat(F.lit("CREATE TABLE "), F.first("tab"), F.lit(" (\n"), lines, F.lit("\n);")).alias("ddl"), F.count("*").alias("n_columns"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tab", "ddl"))), lambda x: x.ddl), "\n\n")
    return tables.groupBy(*group).agg(texts.alias("ddl"), F.min("n_columns").alias("least_columns"), F.count("*").alias("n_tables"))


def compact(questions: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(question_id, status, ddl, n_tables, reduction): a normal try, a widened one, else the full schema."""
    matched = matches(questions, columns)
    tables = selected(matched, fks)
    full = _ddl(columns, ["db"]).select("db", F.col("ddl").alias("full_ddl"), F.col("n_tables").alias("all_tables"))
    out = questions.select("question_id", "db").join(full, "db")
    for name, widened in (("normal", 0), ("widened", 6)):
        one = _ddl(kept_columns(matched, tables, widened=widened), ["question_id"])
        out = out.join(one.select("question_id", *[F.col(c).alias(f"{name}_{c}") for c in ("ddl", "least_columns", "n_tables")]), "question_id", "left")

    def fits(name: str) -> Column:
        d = F.col(f"{name}_ddl")
        return d.isNotNull() & over_compaction(F.length(d), F.length("full_ddl"), F.col(f"{name}_least_columns")).isNull()

    status = F.when(fits("normal"), "success").when(fits("widened"), "widened").otherwise("fallback")
    out = out.withColumn("status", status)
    ddl = F.when(F.col("status") == "success", F.col("normal_ddl")).when(F.col("status") == "widened", F.col("widened_ddl")).otherwise(F.col("full_ddl"))
    n = F.when(F.col("status") == "success", F.col("normal_n_tables")).when(F.col("status") == "widened", F.col("widened_n_tables")).otherwise(F.col("all_tables"))
    reduction = F.floor(1000 * (1 - F.length(ddl) / F.length("full_ddl")) + 0.5) / 10.0
    return out.select("question_id", "db", "status", ddl.alias("ddl"), n.alias("n_tables"), reduction.alias("reduction"))


def compact_for_gold(questions: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """As ``compact`` for training rows (question_id, db, question, gold_sql): what the gold query names is a hit too.

    A schema that still lacks a name or a join column of the gold query gives way to the full one.  Adds ``covered``.
    """
    found = matches(questions, columns)
    gold = questions.select("question_id", coverage.words(F.col("gold_sql")).alias("gold_words"), "gold_sql")
    named = lambda c: F.array_contains("gold_words", F.lower(c))
    matched = found.join(gold.select("question_id", "gold_words"), "question_id").withColumns({"table_named": F.col("table_named") | named(F.col("tab")), "hit": F.col("hit") | (named(F.col("col")))}).drop("gold_words")
    tables = selected(matched, fks)
    kept = kept_columns(matched, tables)
    own = kept.groupBy("question_id").agg(F.collect_set("tab").alias("own_tabs"), F.collect_set("col").alias("own_cols"))
    short = _ddl(kept, ["question_id"]).select("question_id", F.col("ddl").alias("short_ddl"), F.col("n_tables").alias("short_tables"))
    full = _ddl(columns, ["db"]).select("db", F.col("ddl").alias("full_ddl"), F.col("n_tables").alias("all_tables"))
    names = columns.groupBy("db").agg(F.collect_set("tab").alias("tabs"), F.collect_set("col").alias("cols"))
    d = questions.select("question_id", "db", "gold_sql").join(full, "db").join(names, "db").join(short, "question_id", "left").join(own, "question_id", "left")
    whole = lambda tabs, cols: (F.size(coverage.missing(F.col("gold_sql"), F.col("tabs"), F.col("cols"), tabs, cols)) == 0) & coverage.missing_join_column(F.col("gold_sql"), cols).isNull()
    fits = F.col("short_ddl").isNotNull() & F.coalesce(whole(F.col("own_tabs"), F.col("own_cols")), F.lit(False))
    d = d.withColumn("fits", fits)
    return d.select(
        "question_id",
        "db",
        F.when(F.col("fits"), "success").otherwise("fallback").alias("status"),
        F.when(F.col("fits"), F.col("short_ddl")).otherwise(F.col("full_ddl")).alias("ddl"),
        F.when(F.col("fits"), F.col("short_tables")).otherwise(F.col("all_tables")).alias("n_tables"),
        (F.col("fits") | whole(F.col("tabs"), F.col("cols"))).alias("covered"),
    )


def summary(compacted: DataFrame) -> DataFrame:
    """Counts and mean reduction by status."""
    return compacted.groupBy("status").agg(F.count("*").alias("n"), F.avg("reduction").alias("mean_reduction"))
