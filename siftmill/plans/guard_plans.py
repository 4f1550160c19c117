"""Queries over repairs, schema compaction, prompts by class, and further reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sqlfeat, text
from ..operators import compaction, corrupt, metrics, repair, sample, sqltext
from ..operators.evaluate import Verifier
from .fixtures import EVALS, SQLS, evals, fks, sqls, table

_N = "CAST(count(*) AS BIGINT)"

#: The star schema's DDL, as a literal.
DDL = """CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT);
CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER REFERENCES region(r_regionkey));
CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_nationkey INTEGER, c_acctbal DECIMAL(18,2), c_mktsegment TEXT, PRIMARY KEY (c_custkey), FOREIGN KEY (c_nationkey) REFERENCES nation(n_nationkey));
CREATE TABLE orders (o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER REFERENCES customer(c_custkey), o_orderstatus TEXT, o_totalprice REAL, o_orderdate DATE);"""
_WANT = [
    ("region", "r_regionkey", "INTEGER", 0, True, None), ("region", "r_name", "TEXT", 1, False, None), ("nation", "n_nationkey", "INTEGER", 0, True, None), ("nation", "n_name", "TEXT", 1, False, None), ("nation", "n_regionkey", "INTEGER", 2, False, "region.r_regionkey"),
    ("customer", "c_custkey", "INTEGER", 0, True, None), ("customer", "c_name", "TEXT", 1, False, None), ("customer", "c_nationkey", "INTEGER", 2, False, "nation.n_nationkey"), ("customer", "c_acctbal", "DECIMAL", 3, False, None), ("customer", "c_mktsegment", "TEXT", 4, False, None),
    ("orders", "o_orderkey", "INTEGER", 0, True, None), ("orders", "o_custkey", "INTEGER", 1, False, "customer.c_custkey"), ("orders", "o_orderstatus", "TEXT", 2, False, None), ("orders", "o_totalprice", "REAL", 3, False, None), ("orders", "o_orderdate", "DATE", 4, False, None),
]


def _catalogue(spark):
    return spark.createDataFrame([("star", DDL)], "db string, ddl string").select("db", F.explode(sqltext.columns_of("ddl")).alias("c")).select("db", "c.*")


def ddl_columns(spark, sf_dir):
    """G1."""
    ref = F.when(F.col("ref_table").isNotNull(), F.concat_ws(".", "ref_table", "ref_col"))
    return _catalogue(spark).select("tab", "col", "typ", F.col("pos").cast("long").alias("pos"), "is_pk", ref.alias("ref"))


_DDL_SQL = "SELECT tab, col, typ, CAST(pos AS BIGINT) AS pos, is_pk, ref FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, {str(e).lower()}, {'NULL' if f is None else repr(f)})" for a, b, c, d, e, f in _WANT) + ") AS t(tab, col, typ, pos, is_pk, ref)"


def select_items(spark, sf_dir):
    """P23, P25, P26 over the SQL corpus."""
    return sqls(spark, sf_dir).select("doc_id", F.array_join(sqltext.select_items_of("sql"), " | ").alias("items"), F.array_join(sqltext.aliases_of("sql"), ",").alias("aliases"), F.array_join(sqltext.bare_identifiers_of("sql"), ",").alias("bare"))


def hygiene(spark, sf_dir):
    """Cleaned output and its issues."""
    d = sqls(spark, sf_dir).withColumn("clean", text.normalize_output("sql")).withColumns({"repeats": sqltext.has_repeats_of("clean"), "cut": sqltext.cut_at_repeat_of("clean")})
    issues = F.array_compact(F.array(F.when(F.col("repeats"), "repeats"), F.when(text.count_clauses("clean") > 20, "clauses"), F.when(F.length("clean") < 10, "short"), F.when(sqlfeat.prose_reason("clean").isNotNull(), "prose")))
    return d.select("doc_id", "cut", F.array_join(issues, ",").alias("issues"))


def _repairs(spark, sf_dir):
    d = sqls(spark, sf_dir).withColumn("original", F.col("sql"))
    repaired = F.when(F.col("doc_id") % 4 == 0, corrupt.flip_order(F.col("sql"))).when(F.col("doc_id") % 4 == 1, F.concat("sql", F.lit(" JOIN extra ON 1 = 1"))).when(F.col("doc_id") % 4 == 2, F.replace("sql", F.lit("id"), F.lit("key"))).otherwise(F.col("sql"))
    kind = F.element_at(F.array(*map(F.lit, ("alias_error", "exact_identifier_error", "wrong_return_field", "degenerate_or_truncated_sql"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return repair.with_guards(d.withColumns({"repaired": repaired, "failure_type": kind}))


def repair_accept(spark, sf_dir):
    """The decision on each repair."""
    d = _repairs(spark, sf_dir)
    i = F.col("doc_id")
    same = F.lower(F.trim("original")) == F.lower(F.trim("repaired"))
    reason = repair.acceptance(i % 7 != 0, F.size("structure_issues") == 0, i % 5 != 0, i % 11 != 0, i % 2 == 0, same, F.col("diff_ratio"), F.col("failure_type"))
    return d.select("doc_id", "failure_type", reason.alias("reason"), F.array_join("structure_issues", ",").alias("issues"), F.round("diff_ratio", 4).alias("diff_ratio"), sqlfeat.rejection_category(reason).alias("category"))


def column_candidates(spark, sf_dir):
    """Catalogue columns for misspelt names."""
    cols = _catalogue(spark).select(F.col("tab").alias("table_name"), F.col("col").alias("column_name"))
    failed = cols.select(F.xxhash64("column_name").alias("row_id"), F.concat(F.replace("column_name", F.lit("_"), F.lit("")), F.lit("s")).alias("name"))
    return repair.candidates(failed, cols).select("row_id", F.col("rk").cast("long").alias("rk"), "table_name", "column_name", F.round("score", 6).alias("score"))


def _questions(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("total price of orders", "name of each nation", "customers by mktsegment", "region names and account balance", "nothing of the kind"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("star").alias("db"), F.concat(words, F.lit(" in "), "lang").alias("question"))


def compact_schema(spark, sf_dir):
    """G2, G4, G8, G11, G12."""
    return compaction.compact(_questions(spark, sf_dir), _catalogue(spark), fks(spark, sf_dir))


def compaction_summary(spark, sf_dir):
    """A16."""
    return compaction.summary(compact_schema(spark, sf_dir))


def primary_tables(spark, sf_dir):
    """G10."""
    m = compaction.matches(_questions(spark, sf_dir), _catalogue(spark))
    return compaction.primary(compaction.selected(m, fks(spark, sf_dir)))


def repair_prompts(spark, sf_dir):
    """A template by failure class, blanks filled with their defaults."""
    templates = spark.createDataFrame([("exact_identifier_error", "Fix the name {name} in: {sql}"), ("syntax_local_error", "Fix the syntax of: {sql}"), ("alias_error", "Fix the alias {name} in: {sql}")], "kind string, template string")
    e = evals(spark, sf_dir).where("exec_failed").join(sqls(spark, sf_dir).withColumnRenamed("doc_id", "question_id"), "question_id")
    e = e.withColumn("kind", sqlfeat.failure_type(F.col("exec_failed"), F.col("wrong_result"), sqlfeat.error_category("pred_error"), F.col("sql"), F.col("pred_error")))
    e = e.join(F.broadcast(templates), "kind", "left")  # three literal rows
    named = F.coalesce(F.nullif(F.concat(text.error_identifier("pred_error", "column"), text.error_identifier("pred_error", "table")), F.lit("")), F.lit("unknown"))
    made = F.replace(F.replace(F.coalesce("template", F.lit("Repair: {sql}")), F.lit("{name}"), named), F.lit("{sql}"), F.col("sql"))
    return e.select("question_id", "kind", made.alias("prompt"))


_KIND = "CASE WHEN contains(pred_error, 'no such column') OR contains(pred_error, 'no such table') THEN 'exact_identifier_error' WHEN contains(pred_error, 'syntax error') THEN 'syntax_local_error' WHEN contains(pred_error, 'ambiguous') THEN 'alias_error' WHEN length(trim(sql)) > 0 AND (length(trim(sql)) < 10 OR NOT starts_with(upper(trim(sql)), 'SELECT')) THEN 'degenerate_or_truncated_sql' ELSE 'syntax_local_error' END"
_REPAIR_SQL = f"""WITH {EVALS}, {SQLS}, j AS (SELECT question_id, sql, pred_error, {_KIND} AS kind, coalesce(nullif(regexp_extract(pred_error, '(?i)no such column: ([\\w.]+)', 1) || regexp_extract(pred_error, '(?i)no such table: ([\\w.]+)', 1), ''), 'unknown') AS name FROM evals JOIN sqls ON doc_id = question_id WHERE exec_failed)
SELECT question_id, kind, CASE kind WHEN 'exact_identifier_error' THEN 'Fix the name ' || name || ' in: ' || sql WHEN 'syntax_local_error' THEN 'Fix the syntax of: ' || sql WHEN 'alias_error' THEN 'Fix the alias ' || name || ' in: ' || sql ELSE 'Repair: ' || sql END AS prompt FROM j"""


def eval_prompts(spark, sf_dir):
    """Each question with its database's schema; how many have hints (A26-like shares)."""
    schemas = _catalogue(spark).groupBy("db").agg(F.count("*").alias("columns"))
    q = _questions(spark, sf_dir).withColumn("hint", F.when(F.col("question").contains("nothing"), F.lit("")).otherwise(F.lit("look")))
    q = q.join(F.broadcast(schemas), "db", "left")  # one row per database of a literal catalogue
    return q.groupBy("db").agg(F.count("*").alias("n"), F.count_if(F.col("hint") != "").alias("with_hint"), F.max("columns").alias("columns")).withColumn("hint_pct", metrics.share(F.col("with_hint"), F.col("n")))


def archetypes(spark, sf_dir):
    """Per family the number of rows, of accepted rows, levels, and the mean weight."""
    e = evals(spark, sf_dir)
    weight = F.when(F.col("correct"), 1.5).otherwise(1.0)
    return e.groupBy("db_id").agg(F.count("*").alias("raw"), F.count_if(F.col("correct")).alias("accepted"), F.count_distinct("difficulty").alias("levels"), (F.sum(weight * 2) / 2 / F.count("*")).alias("mean_weight"))


def repaired_breakdown(spark, sf_dir):
    """Outcomes of repaired and other rows."""
    e = evals(spark, sf_dir).withColumn("repaired", F.col("exec_failed") & (F.length("pred_error") % 2 == 0))
    return e.groupBy("repaired").agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("correct"), F.count_if(F.col("exec_failed")).alias("exec_failed"))


def target_preservation(spark, sf_dir):
    """rows whose target changed between two versions of a corpus."""
    a = sqls(spark, sf_dir).select("doc_id", text.strip_comments("sql").alias("old"))
    b = sqls(spark, sf_dir).select("doc_id", text.strip_comments(corrupt.remove_distinct(F.col("sql"))).alias("new"))
    return a.join(b, "doc_id").where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", "old", "new")


_BARE = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?m)--.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g'))"


def metadata_rules(spark, sf_dir):
    """what is wrong with an example's metadata, and whether it may go to the clean pool."""
    d = table(spark, sf_dir, "documents")
    checks = [(F.length("text") < 100, "text too short"), (F.col("lang") == "es", "unknown language"), (F.col("n_chars") != F.length("text"), "wrong length")]
    errors = F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in checks])), "; ")
    return d.select("doc_id", errors.alias("errors"), ((errors == "") & F.col("source").startswith("src1")).alias("eligible"))


def schema_lines_to_ddl(spark, sf_dir):
    """``t(a, b)`` as CREATE TABLE."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("(id, "), "lang", F.lit(", n)")).alias("s"))
    name, body = F.regexp_extract("s", r"^(\w+)\s*\(", 1), F.regexp_extract("s", r"\((.*)\)", 1)
    cols = F.array_join(F.transform(F.split(body, ","), lambda c: F.concat(F.lit("    "), F.trim(c), F.lit(" TEXT"))), ",\n")
    return d.select("doc_id", F.concat(F.lit("CREATE TABLE "), name, F.lit(" (\n"), cols, F.lit("\n);")).alias("ddl"))


def multi_upsample(spark, sf_dir):
    """Extra rows of each feature, against the original number of rows."""
    d = sqls(spark, sf_dir)
    goals = {"JOIN": 0.5, "CTE": 0.25, "WINDOW": 0.3}
    out = None
    for name, goal in goals.items():
        one = sample.upsample_plan(d, sqlfeat.strict_features("sql")[name], goal).withColumn("feature", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("feature", "total", "have", "extra")


_GOALS = (("JOIN", 0.5), ("CTE", 0.25), ("WINDOW", 0.3))
_MULTI_SQL = f"WITH {SQLS}, s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {g}::DOUBLE AS g, {_N} AS total, CAST(count(*) FILTER (regexp_matches(sql, '(?i){sqlfeat.STRICT[n]}')) AS BIGINT) AS have FROM sqls" for n, g in _GOALS) + ") SELECT feature, total, have, greatest(0, CAST(floor((g * total - have) / (1 - g)) AS BIGINT)) AS extra FROM s"


def weighted_copies(spark, sf_dir):
    """How often a row goes in, by its family's weight, twice at most."""
    d = table(spark, sf_dir, "documents")
    weight = F.when(F.col("lang") == "fr", 3.0).when(F.col("lang") == "de", 1.6).otherwise(1.0)
    times = F.least(F.lit(2), F.floor(weight + 0.5)).cast("int")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).groupBy("lang").agg(F.count("*").alias("n"))


def quartiles(spark, sf_dir):
    """Quartile of a text's length within its language."""
    w = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.ntile(4).over(w).cast("long").alias("quartile"), F.sum("n_chars").over(w.rowsBetween(-2, 0)).alias("last_three"))


def templates(spark, sf_dir):
    """Question and query templates for every table of the catalogue, as chat rows."""
    t = _catalogue(spark).groupBy("tab").agg(F.min_by("col", "pos").alias("key"))
    shapes = spark.createDataFrame([("count", "How many {t}?", "SELECT COUNT(*) FROM {t}"), ("list", "List {c} of {t}.", "SELECT {c} FROM {t} ORDER BY {c}")], "shape string, q string, s string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{t}"), F.col("tab")), F.lit("{c}"), F.col("key"))
    rows = t.join(F.broadcast(shapes))  # two literal rows
    return rows.select("tab", "shape", fill(F.col("q")).alias("question"), fill(F.col("s")).alias("sql"), F.size(text.chat(F.lit("s"), fill(F.col("q")), fill(F.col("s")))).cast("long").alias("messages"))


_TEMPLATES_SQL = "WITH t(tab, key) AS (VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('orders', 'o_orderkey')) SELECT tab, 'count' AS shape, 'How many ' || tab || '?' AS question, 'SELECT COUNT(*) FROM ' || tab AS sql, CAST(3 AS BIGINT) AS messages FROM t UNION ALL SELECT tab, 'list', 'List ' || key || ' of ' || tab || '.', 'SELECT ' || key || ' FROM ' || tab || ' ORDER BY ' || key, 3 FROM t"

def corrupted(spark, sf_dir):
    """Row-wise corruptions with choices that follow from doc_id."""
    d = sqls(spark, sf_dir)
    i = F.col("doc_id")
    return d.select(
        "doc_id", corrupt.by_row(corrupt.drop_condition)("sql", i).alias("dropped"), corrupt.by_row(corrupt.swap_alias)("sql", i).alias("swapped"),
        corrupt.by_row(corrupt.wrong_column, ["id", "name", "n_chars", "key"])("sql", i).alias("renamed"), corrupt.truncate(F.col("sql"), i).alias("cut"),
    )


_CHECKED = [
    (1, "SELECT count(*) FROM nation", "SELECT count(n_name) FROM nation", "SELECT cnt FROM nation", "ok", "ok"),
    (2, "SELECT count(*) FROM nation", "SELECT count(*) FROM region", "SELECT count(1) FROM nation", "results differ", "same result"),
    (3, "SELECT n_name FROM nation", "Sorry, I cannot", "SELECT n_name FROM nation", "prose", "same text"),
    (4, "SELECT nope FROM nation", "SELECT n_name FROM nation", "SELECT n_name FROM nations", "reference fails", "parent fails"),
    (5, "SELECT n_name FROM nation", "SELECT nope FROM nation", "SELECT n_nationkey FROM nation", "correction fails", "ok"),
]


def verified(spark, sf_dir):
    """Corrections and made errors, executed and judged."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    v = Verifier(spark)
    rows = [(k, v.correction(fixed, gold, broken), v.pair(gold, broken)) for k, gold, fixed, broken, _, _ in _CHECKED]
    return spark.createDataFrame(rows, "k long, correction string, pair string")


def parity(spark, sf_dir):
    """F16: where two versions of a prompt first differ; 0 where they do not."""
    d = sqls(spark, sf_dir).withColumn("other", corrupt.remove_backticks(F.col("sql")))
    same = F.expr("size(filter(sequence(1, least(length(sql), length(other))), i -> substring(sql, 1, i) = substring(other, 1, i)))")
    return d.select("doc_id", F.when(F.col("sql") != F.col("other"), same + 1).otherwise(0).cast("long").alias("at"))


QUERIES = {
    "corrupted": (corrupted, None),
    "verified": (verified, "SELECT CAST(k AS BIGINT) AS k, correction, pair FROM (VALUES " + ", ".join(f"({c[0]}, '{c[4]}', '{c[5]}')" for c in _CHECKED) + ") AS t(k, correction, pair)"),
    "prompt_parity": (parity, f"WITH {SQLS}, p AS (SELECT doc_id, sql, replace(sql, chr(96), '') AS other FROM sqls) SELECT doc_id, CASE WHEN sql <> other THEN CAST(instr(sql, chr(96)) AS BIGINT) ELSE 0 END AS at FROM p"),
    "ddl_columns": (ddl_columns, _DDL_SQL),
    "select_items": (select_items, None),
    "hygiene": (hygiene, None),
    "repair_accept": (repair_accept, None),
    "column_candidates": (column_candidates, None),
    "compact_schema": (compact_schema, None),
    "compaction_summary": (compaction_summary, None),
    "primary_tables": (primary_tables, None),
    "repair_prompts": (repair_prompts, _REPAIR_SQL),
    "eval_prompts": (eval_prompts, f"SELECT 'star' AS db, {_N} AS n, CAST(count(*) FILTER (doc_id % 5 <> 4) AS BIGINT) AS with_hint, CAST({len(_WANT)} AS BIGINT) AS columns, floor(CAST(count(*) FILTER (doc_id % 5 <> 4) AS BIGINT) * 100.0::DOUBLE * 100.0::DOUBLE / count(*) + 0.5::DOUBLE) / 100.0::DOUBLE AS hint_pct FROM documents"),
    "archetype_summary": (archetypes, f"WITH {EVALS} SELECT db_id, {_N} AS raw, CAST(count(*) FILTER (correct) AS BIGINT) AS accepted, CAST(count(DISTINCT difficulty) AS BIGINT) AS levels, sum(CASE WHEN correct THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END) / 2 / count(*) AS mean_weight FROM evals GROUP BY db_id"),
    "repaired_breakdown": (repaired_breakdown, f"WITH {EVALS} SELECT coalesce(exec_failed AND length(pred_error) % 2 = 0, false) AS repaired, {_N} AS n, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, CAST(count(*) FILTER (exec_failed) AS BIGINT) AS exec_failed FROM evals GROUP BY 1"),
    "target_preservation": (target_preservation, f"WITH {SQLS}, p AS (SELECT doc_id, {_BARE.replace('{x}', 'sql')} AS old, {_BARE.replace('{x}', "regexp_replace(sql, '(?is)^(.*?)\\bDISTINCT\\s+', '\\1')")} AS new FROM sqls) SELECT doc_id, old, new FROM p WHERE old IS DISTINCT FROM new"),
    "metadata_rules": (metadata_rules, "SELECT doc_id, e AS errors, e = '' AND starts_with(source, 'src1') AS eligible FROM (SELECT *, concat_ws('; ', CASE WHEN length(text) < 100 THEN 'text too short' END, CASE WHEN lang = 'es' THEN 'unknown language' END, CASE WHEN n_chars <> length(text) THEN 'wrong length' END) AS e FROM documents)"),
    "schema_lines_to_ddl": (schema_lines_to_ddl, "SELECT doc_id, 'CREATE TABLE ' || source || ' (' || chr(10) || '    id TEXT,' || chr(10) || '    ' || lang || ' TEXT,' || chr(10) || '    n TEXT' || chr(10) || ');' AS ddl FROM documents"),
    "multi_upsample": (multi_upsample, _MULTI_SQL),
    "weighted_copies": (weighted_copies, f"SELECT lang, CAST(count(*) * CASE WHEN lang IN ('fr', 'de') THEN 2 ELSE 1 END AS BIGINT) AS n FROM documents GROUP BY lang"),
    "quartiles": (quartiles, "SELECT doc_id, CAST(ntile(4) OVER w AS BIGINT) AS quartile, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id)"),
    "template_rows": (templates, _TEMPLATES_SQL),
}
