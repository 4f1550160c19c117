"""Queries over schema usage, repair logs, made examples, example similarity, reports, sinks, paths and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfeat
from ..operators import corrupt, dedup, relevance, repair, report, sample, schema_graph, sqltext, usage
from ..sources import jsonl, paths
from .fixtures import EVALS, SQLS, evals, sqls, table
from .guard_plans import _WANT, _catalogue
from .metric_plans import _CATEGORY, _COUNTS, _if, _pct
from .schema_plans import _TABLE_SQL, _contexts, _scored_catalogue

_N = "CAST(count(*) AS BIGINT)"

_OLD = [("nation_old", "n_nationkey"), ("nation_old", "n_name")]
#: Queries, and the tables, qualified columns and bare names that each uses.
_USES = [
    ("SELECT c.c_name, SUM(o.o_totalprice) FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey", ["customer", "orders"], [("customer", "c_name"), ("orders", "o_totalprice"), ("customer", "c_custkey"), ("orders", "o_custkey")], []),
    ("SELECT n_name, r_nothing FROM nation WHERE r_name = 'n_name'", ["nation"], [], ["n_name", "r_nothing", "r_name"]),
    ("SELECT x.r_name FROM nation AS x JOIN elsewhere AS e ON x.n_regionkey = e.k", ["nation", "elsewhere"], [("nation", "r_name"), ("nation", "n_regionkey"), ("elsewhere", "k")], []),
    ("SELECT n_name FROM nation JOIN nation_old ON nation.n_nationkey = nation_old.n_nationkey", ["nation", "nation_old"], [("nation", "n_nationkey"), ("nation_old", "n_nationkey")], ["n_name"]),
    ("  ", [], [], []),
    ("SELECT O_ORDERDATE, `O_OrderStatus` FROM Orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", ["orders", "customer"], [], ["o_orderdate", "o_orderstatus", "o_custkey", "c_custkey"]),
]


def schema_usage(spark, sf_dir):
    """names of each query that its schema does not explain; every tenth row names a database without a schema."""
    old = spark.createDataFrame([("star", *r) for r in _OLD], "db string, tab string, col string")
    cat = _catalogue(spark).select("db", "tab", "col").unionByName(old)
    i = F.col("doc_id")
    sql = F.element_at(F.array(*[F.lit(u[0]) for u in _USES]), (i % len(_USES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 10 == 9, "none").otherwise("star").alias("db"), sql.alias("sql"))
    return usage.schema_usage(rows, cat).select("doc_id", F.array_join("issues", ",").alias("issues"))


_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_USAGE_SQL = f"""WITH cat(tab, col) AS (VALUES {_values([(w[0], w[1]) for w in _WANT] + _OLD)}),
t(m, tab) AS (VALUES {_values([(k, t) for k, u in enumerate(_USES) for t in u[1]])}), q(m, tab, col) AS (VALUES {_values([(k, *c) for k, u in enumerate(_USES) for c in u[2]])}), b(m, col) AS (VALUES {_values([(k, c) for k, u in enumerate(_USES) for c in u[3]])}),
known AS (SELECT 'star' AS db, * FROM cat), dbs(db) AS (VALUES ('star'), ('none')),
o AS (SELECT db, m, col, (SELECT count(*) FROM known k JOIN t ON t.tab = k.tab WHERE t.m = b.m AND k.col = b.col AND k.db = dbs.db) AS n FROM b, dbs),
i AS (SELECT db, m, 0 AS o, 'table:' || tab AS x FROM t, dbs WHERE (db, tab) NOT IN (SELECT db, tab FROM known)
  UNION ALL SELECT db, m, 1, 'column:' || tab || '.' || col FROM q, dbs WHERE (db, tab) IN (SELECT db, tab FROM known) AND (db, tab, col) NOT IN (SELECT db, tab, col FROM known)
  UNION ALL SELECT db, m, 2, 'unresolved:' || col FROM o WHERE n = 0 UNION ALL SELECT db, m, 3, 'ambiguous:' || col FROM o WHERE n > 1 UNION ALL SELECT db, 4, 0, 'empty' FROM dbs),
g AS (SELECT db, m, string_agg(x, ',' ORDER BY o, x) AS issues FROM i GROUP BY db, m)
SELECT doc_id, coalesce(issues, '') AS issues FROM documents LEFT JOIN g ON g.m = doc_id % {len(_USES)} AND g.db = CASE WHEN doc_id % 10 = 9 THEN 'none' ELSE 'star' END"""


def repair_log(spark, sf_dir):
    """Examples from a log of repairs, and why the other rows give none."""
    i = F.col("question_id")
    failures = evals(spark, sf_dir).where("exec_failed or wrong_result").select("question_id", "db_id", F.lit("generic_exec_error").alias("inferred_type"))
    log = sqls(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("db_id")), "doc_id")
    log = log.select(F.col("doc_id").alias("question_id"), "db_id", F.col("sql").alias("final_sql")).withColumns({"final_accepted": i % 4 != 0, "failure_type": F.when(i % 3 != 0, "alias_error")})
    out = repair.from_log(log, failures, i % 5 != 0)
    example = F.col("outcome") == "example"
    return out.select("question_id", "outcome", *[F.when(example, F.col(c)).alias(c) for c in ("failure_type", "example_id", "corrected_sql")], F.when(example, sqlfeat.target_mode(F.col("failure_type"))).alias("mode"))


_MODES = " ".join(f"WHEN '{k}' THEN '{sqlfeat.TARGET_MODES.get(k, 'return_field_mismatch')}'" for k in ("alias_error", "generic_exec_error"))
_LOG_SQL = f"""WITH {EVALS}, {SQLS}, f AS (SELECT question_id FROM evals WHERE exec_failed OR wrong_result),
l AS (SELECT s.doc_id AS question_id, source, trim(sql) AS sql, CASE WHEN s.doc_id % 4 = 0 THEN 'not accepted' WHEN s.doc_id NOT IN (SELECT question_id FROM f) THEN 'no failure' WHEN trim(sql) = '' THEN 'empty' WHEN s.doc_id % 5 = 0 THEN 'not verified' ELSE 'example' END AS outcome,
  CASE WHEN s.doc_id % 3 <> 0 THEN 'alias_error' ELSE 'generic_exec_error' END AS kind FROM sqls s JOIN documents d ON s.doc_id = d.doc_id)
SELECT question_id, outcome, CASE WHEN outcome = 'example' THEN kind END AS failure_type, CASE WHEN outcome = 'example' THEN 'repair_' || source || '_' || question_id END AS example_id, CASE WHEN outcome = 'example' THEN sql END AS corrected_sql, CASE WHEN outcome = 'example' THEN CASE kind {_MODES} END END AS mode FROM l"""

_QUOTA = 12


def made_examples(spark, sf_dir):
    """Examples made by transforms from compatible queries, up to a quota of each."""
    return corrupt.examples(sqls(spark, sf_dir), "doc_id", "sql", _QUOTA)


_FIRST = "regexp_replace(sql, '(?i){}', '{}')"
_MADE = {
    "count_distinct_to_count": ("contains(upper(sql), 'COUNT(DISTINCT')", _FIRST.format(r"\bCOUNT\s*\(\s*DISTINCT\s+", "COUNT(")),
    "count_to_count_star": ("contains(upper(sql), 'COUNT(')", _FIRST.format(r"\bCOUNT\s*\(\s*[A-Za-z_][\w.]*\s*\)", "COUNT(*)")),
    "remove_distinct": ("contains(upper(sql), 'DISTINCT')", _FIRST.format(r"\bDISTINCT\s+", "")),
    "wrong_order_direction": ("contains(upper(sql), ' ASC') OR contains(upper(sql), ' DESC')", "CASE upper(regexp_extract(sql, '(?i)\\b(ASC|DESC)\\b', 1)) WHEN 'ASC' THEN " + _FIRST.format(r"\bASC\b", "DESC") + " WHEN 'DESC' THEN " + _FIRST.format(r"\bDESC\b", "ASC") + " ELSE sql END"),
    "change_limit": ("contains(upper(sql), 'LIMIT')", "CASE WHEN regexp_matches(sql, '(?i)\\bLIMIT\\s+\\d') THEN regexp_replace(sql, '(?i)(\\bLIMIT\\s+)\\d+', '\\1' || (CAST(regexp_extract(sql, '(?i)\\bLIMIT\\s+(\\d+)', 1) AS BIGINT) + 1)) ELSE sql END"),
    "remove_backticks": ("contains(sql, chr(96))", "replace(sql, chr(96), '')"),
}
_MADE_SQL = f"WITH {SQLS}, m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS transform, {b} AS broken, sql AS corrected FROM sqls WHERE {p}" for k, (p, b) in _MADE.items()) + f"""),
t AS (SELECT *, row_number() OVER (PARTITION BY transform ORDER BY md5(transform || '/' || doc_id), doc_id) AS rk FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY transform ORDER BY rk) AS r2 FROM t WHERE rk <= {3 * _QUOTA} AND broken <> corrected)
SELECT doc_id, transform, broken, corrected FROM k WHERE r2 <= {_QUOTA}"""


def versions(spark, sf_dir):
    """Two versions of each document's example: question, broken query, corrected query."""
    d = sqls(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return d.select("doc_id", F.concat_ws(" of ", "source", "lang").alias("q1"), F.concat_ws(" in ", "lang", "source").alias("q2"), F.col("sql").alias("b1"), corrupt.flip_order(F.col("sql")).alias("b2"), F.col("sql").alias("c1"), F.upper(corrupt.remove_distinct(F.col("sql"))).alias("c2"))


def example_similarity(spark, sf_dir):
    """D6."""
    return versions(spark, sf_dir).select("doc_id", F.round(dedup.example_similarity(*[tuple(F.col(f"{c}{k}") for c in "qbc") for k in (1, 2)]), 6).alias("similarity"))


_LEVELS = ("simple", "moderate", "challenging")


def evaluation_report(spark, sf_dir):
    """The evaluation as lines of Markdown and of HTML."""
    cells = report.evaluation_cells(evals(spark, sf_dir), _LEVELS, sqlfeat.error_category("pred_error"))
    return report.markdown(cells).join(report.html(cells).withColumnRenamed("line", "html"), ["section", "pos"])


_pc = lambda c, whole: f"printf('%.2f%%', coalesce({_pct(c, whole)}, 0))"
_REPORT_SQL = f"""WITH {EVALS}, o AS (SELECT {_COUNTS}, {_if('exact_match')} AS exact_match FROM evals),
l AS (SELECT difficulty, {_COUNTS} FROM evals GROUP BY difficulty), v(difficulty, r) AS (VALUES ('simple', 1), ('moderate', 2), ('challenging', 3)), lv AS (SELECT v.difficulty, r, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(exec_failed, 0) AS exec_failed, coalesce(wrong_result, 0) AS wrong_result FROM v LEFT JOIN l USING (difficulty)),
d AS (SELECT db_id, {_COUNTS} FROM evals GROUP BY db_id), e AS (SELECT {_CATEGORY} AS category, {_N} AS n FROM evals WHERE exec_failed GROUP BY 1),
c AS (SELECT 0 AS section, 0 AS pos, ['Metric', 'Count', 'Rate'] AS cells UNION ALL SELECT 1, 0, ['Difficulty', 'Correct', 'Total', 'Accuracy', 'Exec fail', 'Wrong'] UNION ALL SELECT 2, 0, ['Database', 'Correct', 'Total', 'Accuracy'] UNION ALL SELECT 3, 0, ['Category', 'Count']
  UNION ALL SELECT 0, 1, ['Execution accuracy', correct || '/' || total, {_pc('correct', 'total')}] FROM o UNION ALL SELECT 0, 2, ['Exact match', exact_match || '/' || total, {_pc('exact_match', 'total')}] FROM o
  UNION ALL SELECT 0, 3, ['Exec failures', exec_failed || '/' || total, {_pc('exec_failed', 'total')}] FROM o UNION ALL SELECT 0, 4, ['Wrong results', wrong_result || '/' || total, {_pc('wrong_result', 'total')}] FROM o
  UNION ALL SELECT 1, r, [difficulty, correct::VARCHAR, total::VARCHAR, {_pc('correct', 'total')}, exec_failed::VARCHAR, wrong_result::VARCHAR] FROM lv
  UNION ALL SELECT 2, row_number() OVER (ORDER BY {_pct('correct', 'total')} DESC, db_id), [db_id, correct::VARCHAR, total::VARCHAR, {_pc('correct', 'total')}] FROM d
  UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, category), [category, n::VARCHAR] FROM e)
SELECT section, CAST(pos AS BIGINT) AS pos, '| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN pos = 0 THEN chr(10) || repeat('|-', len(cells)) || '|' ELSE '' END AS line,
  CASE WHEN pos = 0 THEN '<tr><th>' || array_to_string(cells, '</th><th>') || '</th></tr>' ELSE '<tr><td>' || array_to_string(cells, '</td><td>') || '</td></tr>' END AS html FROM c"""


def dataset_manifest(spark, sf_dir):
    """One JSON document with the rows of each file of a build."""
    counts = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("train_"), F.coalesce("lang", F.lit("none")), F.lit(".jsonl")).alias("file")).agg(F.count("*").alias("n"))
    return report.manifest(counts, "documents", "1", {"task": "repair", "seed": "42"})


_MANIFEST_SQL = """WITH c AS (SELECT 'train_' || coalesce(lang, 'none') || '.jsonl' AS file, count(*) AS n FROM documents GROUP BY 1)
SELECT '{"name":"documents","version":"1","statistics":{' || string_agg('"' || file || '":' || n, ',' ORDER BY file) || '},"config":{"seed":"42","task":"repair"}}' AS manifest FROM c"""


def table_paths(spark, sf_dir):
    """The file of a named table, looked up below the folder that holds ``sf_dir``."""
    root = sf_dir.rstrip("/").rpartition("/")[0]
    found = [(n, paths.find(spark, root, n, ("sqlite", "parquet"))) for n in ("documents", "nation", "absent")]
    return spark.createDataFrame([(n, p and p.rpartition("/")[2]) for n, p in found], "name string, file string")


_POOLS = "CASE WHEN doc_id % 7 = 0 THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'clean' ELSE 'internal' END"


def pool_sinks(spark, sf_dir):
    """Pools written and read again: a clean row is in two folders, a rejected one in its own."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_POOLS} AS pool", "CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split", "text AS _private")
    return jsonl.pools_round_trip(spark, d, "doc_id long, pool string, split string").select("folder", "split", "doc_id")


_POOLS_SQL = f"""WITH d AS (SELECT doc_id, {_POOLS} AS pool, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents)
SELECT 'internal' AS folder, split, doc_id FROM d WHERE pool <> 'rejected' UNION ALL SELECT 'clean', split, doc_id FROM d WHERE pool = 'clean' UNION ALL SELECT 'rejected', split, doc_id FROM d WHERE pool = 'rejected'"""


def last_by_key(spark, sf_dir):
    """Of rows with one key the last wins."""
    return jsonl.read_map(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


def selected_tables(spark, sf_dir):
    """The best tables of each question, four at most, of a score of 1 or more."""
    scored = relevance.table_scores(_contexts(spark, sf_dir), _scored_catalogue(spark)).where("score >= 1")
    return sample.ranked(scored, ["question_id"], F.desc("score"), "tab").where("rk <= 4").select("question_id", "tab", F.col("rk").cast("long").alias("rk"))


def ddl_layout(spark, sf_dir):
    """One column or constraint a line."""
    ddl = F.concat(F.lit("create table "), F.col("source"), F.lit(" (id INTEGER,  price DECIMAL(10, 2) , CHECK (id IN (1,2)), PRIMARY KEY (id)); CREATE TABLE b(x TEXT)"))
    return table(spark, sf_dir, "documents").select("doc_id", sqltext.format_of(ddl).alias("ddl"))


_LAYOUT_SQL = r"""SELECT doc_id, replace('create table ' || source || ' (@    id INTEGER,@    price DECIMAL(10, 2),@    CHECK (id IN (1,2)),@    PRIMARY KEY (id)@);@@CREATE TABLE b (@    x TEXT@);', '@', chr(10)) AS ddl FROM documents"""

_REQUIRED = [("shop", ("customer", "orders")), ("world", ("nation", "region")), ("parts", ("part",))]
_LINES = ["customer(a)", "orders(b)", "nation(c)", "region(d)", "part(e)"]


def schema_ids(spark, sf_dir):
    """Id by the whole signature where it is known, else by distinctive tables."""
    i = F.col("doc_id")
    lines = F.filter(F.array(*map(F.lit, _LINES)), lambda x: (F.ascii(x) * 5 + i) % 3 != 0)
    known = spark.createDataFrame([("customer,part", "known"), ("", "empty")], "signature string, known_id string")
    d = table(spark, sf_dir, "documents").select(i, F.transform(lines, lambda x: F.substring_index(x, "(", 1)).alias("tables"))
    d = d.withColumn("signature", F.array_join(F.array_sort("tables"), ",")).join(F.broadcast(known), "signature", "left")  # two literal rows
    return d.select("doc_id", schema_graph.schema_id(F.col("tables"), _REQUIRED, F.col("known_id")).alias("schema_id"))


_IDS_SQL = f"""WITH d AS (SELECT doc_id, list_filter([{', '.join(f"'{x[:-3]}'" for x in _LINES)}], lambda x: (ascii(x) * 5 + doc_id) % 3 <> 0) AS t FROM documents)
SELECT doc_id, CASE array_to_string(list_sort(t), ',') WHEN 'customer,part' THEN 'known' WHEN '' THEN 'empty' ELSE CASE """ + " ".join(f"WHEN list_has_all(t, {list(need)!r}) THEN '{name}'" for name, need in _REQUIRED) + " ELSE 'unknown' END END AS schema_id FROM d"


def capped_features(spark, sf_dir):
    """The first rows with a join and no CASE, and the first with a subquery, up to a cap of each; of equal texts the first counts."""
    d = dedup.first_of(sqls(spark, sf_dir), F.md5(F.lower(F.trim("sql")).cast("binary")), F.col("doc_id"))
    up = F.upper("sql")
    kind = F.when(up.contains("JOIN") & ~up.contains("CASE"), "join").when((F.length(up) - F.length(F.replace(up, F.lit("SELECT"), F.lit("")))) > 6, "subquery")
    return sample.ranked(d.withColumn("kind", kind).where("kind is not null"), ["kind"], "doc_id").where((F.col("kind") == "join") & (F.col("rk") <= 30) | (F.col("rk") <= 10)).select("doc_id", "kind")


_CAPPED_SQL = f"""WITH {SQLS}, d AS (SELECT min(doc_id) AS doc_id, arg_min(sql, doc_id) AS sql FROM sqls GROUP BY md5(lower(trim(sql)))),
k AS (SELECT doc_id, CASE WHEN contains(upper(sql), 'JOIN') AND NOT contains(upper(sql), 'CASE') THEN 'join' WHEN len(regexp_extract_all(upper(sql), 'SELECT')) > 1 THEN 'subquery' END AS kind FROM d)
SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS rk FROM k WHERE kind IS NOT NULL) WHERE rk <= CASE kind WHEN 'join' THEN 30 ELSE 10 END"""

QUERIES = {
    "schema_usage": (schema_usage, _USAGE_SQL),
    "repair_log": (repair_log, _LOG_SQL),
    "made_examples": (made_examples, _MADE_SQL),
    "example_similarity": (example_similarity, None),
    "evaluation_report": (evaluation_report, _REPORT_SQL),
    "dataset_manifest": (dataset_manifest, _MANIFEST_SQL),
    "table_paths": (table_paths, "SELECT * FROM (VALUES ('documents', 'documents.parquet'), ('nation', 'nation.parquet'), ('absent', NULL)) AS t(name, file)"),
    "pool_sinks": (pool_sinks, _POOLS_SQL),
    "last_by_key": (last_by_key, "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id"),
    "selected_tables": (selected_tables, f"SELECT question_id, tab, CAST(rk AS BIGINT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, tab) AS rk FROM ({_TABLE_SQL}) WHERE score >= 1) WHERE rk <= 4"),
    "ddl_layout": (ddl_layout, _LAYOUT_SQL),
    "schema_ids": (schema_ids, _IDS_SQL),
    "capped_features": (capped_features, _CAPPED_SQL),
}
