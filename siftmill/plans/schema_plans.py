"""Queries over schema checks, relevance scores, repair classes, anchors, relations and smaller rules."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from ..functions import sqlfeat, text
from ..operators import compaction, coverage, metrics, relevance, sample
from .fixtures import EVALS, FKS, SQLS, evals, fks, sqls, table
from .guard_plans import _WANT, _catalogue

_N = "CAST(count(*) AS BIGINT)"
#: The catalogue of the star schema as DuckDB text.
_CAT = "cat(tab, col, typ, pos, is_pk, is_fk) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, {str(e).lower()}, {str(f is not None).lower()})" for a, b, c, d, e, f in _WANT) + ")"

_GOLD = [
    "SELECT c_name, SUM(o_totalprice) FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY c_name",
    "SELECT n_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey WHERE r_name = 'o_orderdate'",
    "SELECT O_ORDERDATE FROM orders WHERE o_orderstatus = 'F'",
    "SELECT unknown_col FROM elsewhere",
]
_GOLD_EXPR = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{s.replace(chr(39), chr(39) * 2)}'" for k, s in enumerate(_GOLD)) + " END"


def _gold(spark, sf_dir):
    """Each document with a gold query and a compact schema that lacks a column or table here and there, and invents one at times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, _GOLD[0]).when(F.col("doc_id") % 4 == 1, _GOLD[1]).when(F.col("doc_id") % 4 == 2, _GOLD[2]).otherwise(_GOLD[3]).alias("sql"))
    cat = _catalogue(spark).agg(F.array_sort(F.collect_list(F.struct("tab", "col", "pos"))).alias("cat"))
    kept = F.filter("cat", lambda c: ((c.pos * 7 + F.length(c.col) + F.col("doc_id")) % 5 != 0) & ((F.length(c.tab) + F.col("doc_id")) % 11 != 0))
    d = docs.crossJoin(F.broadcast(cat)).withColumn("kept", kept)  # one row: the catalogue
    extra = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("made_up"))).otherwise(F.array().cast("array<string>"))
    names = lambda c, k: F.array_distinct(F.transform(c, lambda x: x[k]))
    return d.select("doc_id", "sql", names("cat", "tab").alias("tabs"), names("cat", "col").alias("cols"), names("kept", "tab").alias("own_tabs"), F.concat(names("kept", "col"), extra).alias("own_cols"))


def schema_coverage(spark, sf_dir):
    """invented names, names of the gold query that the compact schema lacks, and the first lost join column."""
    d = _gold(spark, sf_dir)
    gone = coverage.missing(F.col("sql"), *map(F.col, ("tabs", "cols", "own_tabs", "own_cols")))
    made = F.concat(coverage.invented(F.col("tabs"), F.col("own_tabs")), coverage.invented(F.col("cols"), F.col("own_cols")))
    return d.select("doc_id", F.array_join(made, ",").alias("invented"), F.array_join(gone, ",").alias("missing"), coverage.missing_join_column(F.col("sql"), F.col("own_cols")).alias("join_column"))


_COVERAGE_SQL = f"""WITH {_CAT}, d AS (SELECT doc_id, {_GOLD_EXPR} AS sql FROM documents),
k AS (SELECT doc_id, tab, col FROM d, cat WHERE (pos * 7 + length(col) + doc_id) % 5 <> 0 AND (length(tab) + doc_id) % 11 <> 0),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(regexp_replace(sql, '''[^'']*''', ' ', 'g')), '[a-z_]\\w*')) AS word FROM d),
gone AS (SELECT doc_id, 0 AS o, word, 'table:' || word AS what FROM w WHERE word IN (SELECT tab FROM cat) AND (doc_id, word) NOT IN (SELECT doc_id, tab FROM k)
  UNION ALL SELECT doc_id, 1, word, 'column:' || word FROM w WHERE word IN (SELECT col FROM cat) AND word NOT IN (SELECT tab FROM cat) AND (doc_id, word) NOT IN (SELECT doc_id, col FROM k)),
g AS (SELECT doc_id, string_agg(what, ',' ORDER BY o, word) AS missing FROM gone GROUP BY doc_id),
j(m, o, c) AS (VALUES (0, 1, 'c_custkey'), (0, 2, 'o_custkey'), (1, 1, 'n_regionkey'), (1, 2, 'r_regionkey')),
x AS (SELECT doc_id, min_by(c, o) AS join_column FROM d JOIN j ON doc_id % 4 = m WHERE (doc_id, c) NOT IN (SELECT doc_id, col FROM k) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN 'made_up' ELSE '' END AS invented, coalesce(missing, '') AS missing, join_column FROM d LEFT JOIN g USING (doc_id) LEFT JOIN x USING (doc_id)"""

_QUESTIONS = ["Total price of orders", "name of each nation", "customer by mktsegment", "region and balance", "nothing of the kind"]
_HINTS = ["", "orderdate of orders", "nation name"]
_PREDICTED = ["SELECT o.o_totalprice FROM orders AS o", "SELECT c.c_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey", "SELECT x.r_name FROM nation AS x", "SELECT 1"]
_FAILED = ["o_totalprices", "r_names", "zzz", "x.r_name"]


def _pick(values, modulus_of):
    return F.element_at(F.array(*map(F.lit, values)), (modulus_of % len(values) + 1).cast("int"))


def _pick_sql(values, of):
    return f"CASE ({of}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _contexts(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("question_id"), F.lit("star").alias("db"), _pick(_QUESTIONS, i).alias("question"), _pick(_HINTS, i).alias("hints"), _pick(_PREDICTED, i).alias("sql"), F.when(i % 7 < 4, F.concat(F.lit("no such column: "), _pick(_FAILED, i % 7))).alias("error"))
    return relevance.contexts(d)


def _scored_catalogue(spark):
    return _catalogue(spark).withColumn("is_fk", F.col("ref_table").isNotNull())


_CONTEXT = f"""q AS (SELECT doc_id AS question_id, {_pick_sql(_QUESTIONS, 'doc_id')} AS question, {_pick_sql(_HINTS, 'doc_id')} AS hints, doc_id % 4 AS p, CASE WHEN doc_id % 7 < 4 THEN {_pick_sql(_FAILED, 'doc_id % 7')} END AS named FROM documents),
c AS (SELECT *, coalesce(regexp_replace(named, '^.*\\.', ''), '') AS failed, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS qw, list_distinct(regexp_extract_all(lower(hints), '[a-z0-9]+')) AS hw FROM q)"""
#: Aliases and tables of the predicted texts, and the columns that they qualify.
_USED = "used(p, a, t) AS (VALUES (0, 'o', 'orders'), (1, 'c', 'customer'), (1, 'n', 'nation'), (2, 'x', 'nation')), ends(p, a, c) AS (VALUES (0, 'o', 'o_totalprice'), (1, 'c', 'c_name'), (1, 'c', 'c_nationkey'), (1, 'n', 'n_nationkey'), (2, 'x', 'r_name'))"
_RATIOS = "ratio(col, failed, r) AS (VALUES " + ", ".join(f"('{w[1]}', '{f.split('.')[-1]}', {difflib.SequenceMatcher(None, w[1], f.split('.')[-1]).ratio()!r}::DOUBLE)" for w in _WANT for f in _FAILED) + ")"


def _jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def table_relevance(spark, sf_dir):
    """C14."""
    return relevance.table_scores(_contexts(spark, sf_dir), _scored_catalogue(spark)).select("question_id", "tab", F.round("score", 6).alias("score"))


_TABLE_SQL = f"""WITH {_CAT}, {_CONTEXT}, {_USED}, {_RATIOS}, t AS (SELECT tab, list_distinct(flatten(list(regexp_extract_all(lower(col), '[a-z0-9]+')))) AS cw, regexp_extract_all(tab, '[a-z0-9]+') AS tw FROM cat GROUP BY tab),
n AS (SELECT DISTINCT tab, failed FROM cat JOIN ratio USING (col) WHERE r > 0.7)
SELECT question_id, tab, round((CASE WHEN contains(lower(question), tab) THEN 3 ELSE 0 END) + {_jaccard_sql('tw', 'qw')} * 2 + {_jaccard_sql('cw', 'qw')} * 1.5::DOUBLE + (CASE WHEN contains(hints, tab) THEN 4 ELSE 0 END) + {_jaccard_sql('tw', 'hw')} * 2.5::DOUBLE + {_jaccard_sql('cw', 'hw')} * 2
  + (CASE WHEN (p, tab) IN (SELECT p, t FROM used) THEN 11 ELSE 0 END) + (CASE WHEN contains(coalesce(named, ''), tab) THEN 4 ELSE 0 END) + (CASE WHEN (tab, failed) IN (SELECT tab, failed FROM n) THEN 5 ELSE 0 END), 6)::DOUBLE AS score FROM c, t"""


def column_relevance(spark, sf_dir):
    """C15, with orders as the primary table of every third question."""
    ctx = _contexts(spark, sf_dir)
    primary = ctx.where("question_id % 3 = 0").select("question_id", F.lit("orders").alias("primary_table"))
    return relevance.column_scores(ctx, _scored_catalogue(spark), primary).select("question_id", "tab", "col", F.round("score", 6).alias("score"))


_COLUMN_SQL = f"""WITH {_CAT}, {_CONTEXT}, {_USED}, {_RATIOS}, e AS (SELECT p, ends.c AS col, t FROM ends JOIN used USING (p, a)), k AS (SELECT *, regexp_extract_all(col, '[a-z0-9]+') AS w FROM cat)
SELECT question_id, tab, col, round(((CASE WHEN is_pk THEN 10 ELSE 0 END) + (CASE WHEN is_fk THEN 8 ELSE 0 END)
  + coalesce((SELECT sum(CASE WHEN e.t = k.tab THEN 10 ELSE 6 END) FROM e WHERE e.p = c.p AND e.col = k.col), 0)
  + (CASE WHEN failed = '' THEN 0 WHEN k.col = failed THEN 10 ELSE coalesce((SELECT CASE WHEN r > 0.7 THEN 8 WHEN r > 0.5 THEN 4 ELSE 0 END FROM ratio WHERE ratio.col = k.col AND ratio.failed = c.failed), 0) END)
  + (CASE WHEN contains(lower(question), k.col) THEN 4 ELSE 0 END) + (CASE WHEN contains(hints, k.col) THEN 5 ELSE 0 END) + {_jaccard_sql('w', 'qw')} * 2 + {_jaccard_sql('w', 'hw')} * 3)
  * (CASE WHEN question_id % 3 = 0 AND tab = 'orders' THEN 1.2::DOUBLE ELSE 1 END), 6)::DOUBLE AS score FROM c, k"""

_ERRORS = ["no such column: o_totalprices", "no such column: x.o_totalprice", "no such column: n.r_name", "no such column: r_name", "no such column: qqqq", "no such table: nations", "no such table: qqqq", "near \"FROM\": syntax error", "misuse of aggregate: SUM()", "datatype mismatch", "ambiguous column name: n_name", "interrupted"]
_CLASSES = {0: ("exact_identifier_error", 0.95, 0.9), 1: ("wrong_table_side_error", 0.85, 0.75), 2: ("alias_error", 0.9, 0.85), 3: ("wrong_table_side_error", 0.8, 0.7), 4: ("exact_identifier_error", 0.6, 0.3), 5: ("exact_identifier_error", 0.95, 0.85), 6: ("exact_identifier_error", 0.7, 0.4), 7: ("generic_exec_error", 0.6, 0.3), 8: ("derived_metric_error", 0.8, 0.5), 9: ("filter_value_mapping_error", 0.8, 0.5), 10: ("join_backbone_error", 0.8, 0.6), 11: ("generic_exec_error", 0.5, 0.2)}


def _classed(spark, sf_dir):
    i = F.col("question_id")
    rows = evals(spark, sf_dir).select(i, "db_id", "correct", "exec_failed", "wrong_result", F.lit("SELECT n.r_name FROM nation AS n").alias("sql"), F.when(F.col("exec_failed"), _pick(_ERRORS, i)).alias("error"))
    return relevance.repair_class(rows, _catalogue(spark))


def repair_classes(spark, sf_dir):
    """Class, confidence and repairability of every failure."""
    return _classed(spark, sf_dir).where("failure_type is not null").select("question_id", "failure_type", "confidence", "repairability")


_CLASS_ROWS = "cls(k, failure_type, confidence, repairability) AS (VALUES " + ", ".join(f"({k}, '{a}', {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in _CLASSES.items()) + ")"
_CLASSED_SQL = f"""SELECT question_id, CASE WHEN exec_failed THEN failure_type WHEN wrong_result THEN 'wrong_result_non_exec_failure' ELSE 'generic_exec_error' END AS failure_type,
  CASE WHEN exec_failed THEN confidence WHEN wrong_result THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence, CASE WHEN exec_failed THEN repairability WHEN wrong_result THEN 0::DOUBLE ELSE 0.1::DOUBLE END AS repairability FROM evals JOIN cls ON question_id % 12 = k WHERE NOT correct"""


def repairability(spark, sf_dir):
    """A21."""
    from ..operators import repair

    return repair.repairability(_classed(spark, sf_dir).where("failure_type is not null")).withColumn("mean", F.round("mean", 6))


_ANCHORS = [("customer", "region"), ("lineitem", "nation"), ("orders",), ("part", "supplier", "region"), ("nowhere", "orders")]
_REQUIRED = ["customer,nation,region", "lineitem,supplier,nation", "", "part,lineitem,supplier,nation,region", "nowhere,orders"]


def anchor_bridges(spark, sf_dir):
    """Anchor tables and what joins them, in order."""
    i = F.col("doc_id")
    anchors = F.element_at(F.array(*[F.array(*map(F.lit, a)) for a in _ANCHORS]), (i % len(_ANCHORS) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", anchors.alias("anchors"))
    return relevance.bridged(rows, fks(spark, sf_dir)).select("doc_id", F.array_join("required", ",").alias("required"))


_TABLES = ["region", "nation", "customer", "orders", "lineitem", "supplier"]


def schema_relations(spark, sf_dir):
    """Keys between selected tables."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.explode(F.filter(F.array(*map(F.lit, _TABLES)), lambda t: (F.length(t) * 3 + F.col("doc_id")) % 4 != 0)).alias("tab"))
    return relevance.relations(d, fks(spark, sf_dir))


_RELATIONS_SQL = f"WITH {FKS}, t(tab) AS (VALUES " + ", ".join(f"('{t}')" for t in _TABLES) + "), s AS (SELECT doc_id AS question_id, tab FROM documents, t WHERE (length(tab) * 3 + doc_id) % 4 <> 0) SELECT DISTINCT a.question_id, src_t || '.' || src_c || ' = ' || dst_t || '.' || dst_c AS relation FROM s a JOIN fks ON a.tab = src_t JOIN s b ON b.question_id = a.question_id AND b.tab = dst_t"


def gold_compaction(spark, sf_dir):
    """Schemas that hold what the gold query takes, and how many tables they keep."""
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("star").alias("db"), F.lit("nothing").alias("question"), F.expr(_GOLD_EXPR).alias("gold_sql"))
    return compaction.compact_for_gold(q, _catalogue(spark), fks(spark, sf_dir)).select("question_id", "status", "n_tables", "covered")


_GOLD_COMPACT = {0: ("success", 2), 1: ("success", 2), 2: ("success", 1), 3: ("fallback", 4)}


def target_modes(spark, sf_dir):
    """C10 over the classes of failed predictions."""
    e = evals(spark, sf_dir).where("exec_failed or wrong_result").join(sqls(spark, sf_dir).withColumnRenamed("doc_id", "question_id"), "question_id")
    kind = sqlfeat.failure_type(F.col("exec_failed"), F.col("wrong_result"), sqlfeat.error_category("pred_error"), F.col("sql"), F.col("pred_error"))
    return e.select(kind.alias("failure_type")).groupBy("failure_type").agg(F.count("*").alias("n")).withColumn("mode", sqlfeat.target_mode(F.col("failure_type")))


def special_columns(spark, sf_dir):
    """queries that use a column of several words without its quotes."""
    sql = F.concat(F.lit("SELECT "), _pick(["`Free Meal (%)`", "Free Meal (%)", "Meal", "`Free` Meal", "Enrolled-Now here"], F.col("doc_id")), F.lit(" FROM schools"))
    return table(spark, sf_dir, "documents").select("doc_id", coverage.unquoted_special(sql, F.array(F.lit("Free Meal (%)"), F.lit("plain"), F.lit("a-b"))).alias("unquoted"))


_NARROW5 = {"case": r"\bCASE\b", "cte": r"\bWITH\b", "window": r"\bOVER\s*\(", "join": r"\bJOIN\b", "subquery": "(?s)SELECT.*SELECT"}


def sql_features_small(spark, sf_dir):
    """C4: 5 and 8 features."""
    d = sqls(spark, sf_dir)
    return d.select("doc_id", *[c.alias(f"five_{k}") for k, c in sqlfeat.five_features("sql").items()], *[c.alias(f"eight_{k}") for k, c in sqlfeat.eight_features("sql").items()])


_EIGHT_SQL = {"cte": "contains(u, 'WITH ')", "window": "contains(u, ' OVER(') OR contains(u, ' OVER (')", "subquery": "len(regexp_extract_all(u, 'SELECT')) > 1", "case": "contains(u, 'CASE ')", "join": "contains(u, 'JOIN')", "agg": "regexp_matches(u, 'SUM\\(|COUNT\\(|AVG\\(|MAX\\(|MIN\\(')", "like": "contains(u, 'LIKE ')", "having": "contains(u, 'HAVING ')"}


def sql_features_narrow(spark, sf_dir):
    """11 features."""
    return sqls(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in sqlfeat.narrow_features("sql").items()])


def question_fingerprints(spark, sf_dir):
    """Fingerprint of the first line of a turn."""
    d = table(spark, sf_dir, "conversations")
    return d.select("conv_id", "turn", text.fingerprint(F.substring_index("text", "\n", 1)).alias("print"))


def systematic_sample(spark, sf_dir):
    """Every fifth document of a source, by doc_id."""
    ranked = sample.ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id")
    return ranked.where("(rk - 1) % 5 = 0").select("doc_id", "source")


def category_samples(spark, sf_dir):
    """The first three documents of each language."""
    ranked = sample.ranked(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id")
    return ranked.where("rk <= 3").select("doc_id", "lang")


def required_pairs(spark, sf_dir):
    """Only rows of required (source, language) pairs."""
    wanted = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("source", "lang").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(wanted, ["source", "lang"], "left_semi").select("doc_id")


def composite_dedup(spark, sf_dir):
    """First row of each (lang, source, hash of the folded query)."""
    d = sqls(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("print", text.fingerprint("sql"))
    return d.groupBy("lang", "source", "print").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def evaluated_shares(spark, sf_dir):
    """Share of prompts with a DDL schema, and with backticks."""
    d = sqls(spark, sf_dir).withColumn("prompt", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CREATE TABLE t (a TEXT);\n"), "sql")).otherwise(F.col("sql")))
    n = F.count("*")
    return d.agg(n.alias("n"), metrics.share(F.count_if(F.col("prompt").contains("CREATE TABLE")), n).alias("ddl_pct"), metrics.share(F.count_if(F.col("prompt").contains("`")), n).alias("backtick_pct"))


_TYPE_SQL = "CASE WHEN exec_failed AND (contains(pred_error, 'no such column') OR contains(pred_error, 'no such table')) THEN 'exact_identifier_error' WHEN exec_failed AND contains(pred_error, 'syntax error') THEN 'syntax_local_error' WHEN exec_failed AND contains(pred_error, 'ambiguous') THEN 'alias_error'"

QUERIES = {
    "schema_coverage": (schema_coverage, _COVERAGE_SQL),
    "table_relevance": (table_relevance, _TABLE_SQL),
    "column_relevance": (column_relevance, _COLUMN_SQL),
    "repair_classes": (repair_classes, f"WITH {EVALS}, {_CLASS_ROWS} {_CLASSED_SQL}"),
    "repairability": (repairability, f"WITH {EVALS}, {_CLASS_ROWS}, f AS ({_CLASSED_SQL}) SELECT failure_type, {_N} AS n, round(avg(repairability), 6) AS mean, CAST(count(*) FILTER (repairability >= 0.5) AS BIGINT) AS repairable FROM f GROUP BY failure_type"),
    "anchor_bridges": (anchor_bridges, f"SELECT doc_id, {_pick_sql(_REQUIRED, 'doc_id')} AS required FROM documents"),
    "schema_relations": (schema_relations, _RELATIONS_SQL),
    "gold_compaction": (gold_compaction, "SELECT doc_id AS question_id, " + _pick_sql([a for a, _ in _GOLD_COMPACT.values()], "doc_id") + " AS status, CAST(CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in _GOLD_COMPACT.items()) + " END AS BIGINT) AS n_tables, true AS covered FROM documents"),
    "target_modes": (target_modes, None),
    "special_columns": (special_columns, "SELECT doc_id, doc_id % 5 = 1 AS unquoted FROM documents"),
    "sql_features_small": (sql_features_small, f"WITH {SQLS}, s AS (SELECT doc_id, sql, upper(sql) AS u FROM sqls) SELECT doc_id, " + ", ".join([f"regexp_matches(u, '{p}') AS five_{k}" for k, p in _NARROW5.items()] + [f"{x} AS eight_{k}" for k, x in _EIGHT_SQL.items()]) + " FROM s"),
    "sql_features_narrow": (sql_features_narrow, f"WITH {SQLS} SELECT doc_id, " + ", ".join(f"regexp_matches(upper(sql), '{sqlfeat.WIDE[k]}') AS {k}" if k in sqlfeat.WIDE else (f"len(regexp_extract_all(upper(sql), 'SELECT')) > 1 AS {k}" if k == "subquery" else f"contains(sql, chr(96)) AS {k}") for k in sqlfeat.NARROW) + " FROM sqls"),
    "question_fingerprints": (question_fingerprints, None),
    "systematic_sample": (systematic_sample, "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE (rk - 1) % 5 = 0"),
    "category_samples": (category_samples, "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 3"),
    "required_pairs": (required_pairs, "SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT source, lang FROM documents WHERE doc_id % 50 = 0)"),
    "composite_dedup": (composite_dedup, f"WITH {SQLS}, d AS (SELECT s.doc_id, lang, source, md5(trim(regexp_replace(lower(sql), '\\s+', ' ', 'g'))) AS print FROM sqls s JOIN documents d ON s.doc_id = d.doc_id) SELECT min(doc_id) AS doc_id FROM d GROUP BY lang, source, print"),
    "prompt_shares": (evaluated_shares, None),
}
