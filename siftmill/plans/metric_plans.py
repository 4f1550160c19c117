"""Queries over evaluation records and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sqlfeat
from ..operators import metrics, vote
from ..operators.evaluate import Evaluator, normalize
from .fixtures import CANDIDATES, EVALS, SQLS, candidates, evals, sqls, table

_N = "CAST(count(*) AS BIGINT)"


def _if(c: str) -> str:
    return f"CAST(count(*) FILTER ({c}) AS BIGINT)"


def _pct(part: str, whole: str) -> str:
    return f"floor({part} * 100.0::DOUBLE * 100.0::DOUBLE / nullif({whole}, 0) + 0.5::DOUBLE) / 100.0::DOUBLE"


_COUNTS = f"{_N} AS total, {_if('correct')} AS correct, {_if('exec_failed')} AS exec_failed, {_if('wrong_result')} AS wrong_result"


def eval_overall(spark, sf_dir):
    return metrics.overall(evals(spark, sf_dir))


def eval_by_difficulty(spark, sf_dir):
    return metrics.by_domain(evals(spark, sf_dir), "difficulty", ("simple", "moderate", "challenging", "extreme"))


def eval_by_db(spark, sf_dir):
    return metrics.by_group(evals(spark, sf_dir), "db_id")


def error_histogram(spark, sf_dir):
    e = evals(spark, sf_dir).where("exec_failed").withColumn("category", sqlfeat.error_category("pred_error"))
    return metrics.with_share(metrics.histogram(e, "category"))


def error_kinds(spark, sf_dir):
    e = evals(spark, sf_dir).where("exec_failed").withColumn("kind", sqlfeat.error_kind("pred_error"))
    return metrics.histogram(e, "kind")


def db_difficulty_matrix(spark, sf_dir):
    return metrics.by_group(evals(spark, sf_dir), "db_id", "difficulty")


def dataset_composition(spark, sf_dir):
    e = evals(spark, sf_dir)
    return e.rollup("db_id", "difficulty").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")).where("level <> 3").select("db_id", "difficulty", "n", "level")


def _runs(spark, sf_dir):
    e = evals(spark, sf_dir)
    return e.where("difficulty <> 'moderate'"), e.where("difficulty <> 'simple' or exec_failed").withColumn("correct", F.col("correct") & (F.col("question_id") % 5 != 0))


_RUNS = f"{EVALS}, a AS (SELECT * FROM evals WHERE difficulty <> 'moderate'), b AS (SELECT question_id, db_id, correct AND question_id % 5 <> 0 AS correct FROM evals WHERE difficulty <> 'simple' OR exec_failed), p AS (SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.db_id, b.db_id) AS db_id, a.correct AS a_correct, b.correct AS b_correct FROM a FULL JOIN b ON a.question_id = b.question_id AND a.db_id = b.db_id)"


def run_compare(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return metrics.compare(a, b, ["question_id", "db_id"])


def win_loss(spark, sf_dir):
    return metrics.win_loss(run_compare(spark, sf_dir))


def run_deltas(spark, sf_dir):
    """Accuracy by database in both runs, most improved first."""
    a, b = (metrics.by_group(x, "db_id").select("db_id", F.col("accuracy").alias(n)) for x, n in zip(_runs(spark, sf_dir), ("a", "b")))
    return a.join(b, "db_id", "full_outer").withColumn("delta", F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).orderBy(F.desc("delta"), "db_id")


def pattern_distribution(spark, sf_dir):
    return metrics.feature_shares(sqls(spark, sf_dir), sqlfeat.wide_features("sql"))


def target_bands(spark, sf_dir):
    return metrics.band_check(metrics.feature_shares(sqls(spark, sf_dir), sqlfeat.strict_features("sql")), sqlfeat.BANDS)


_STRICT = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in sqlfeat.BANDS.items())
_BANDS_SQL = f"""WITH {SQLS}, f AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, {_if(f"regexp_matches(sql, '(?i){p}')")} AS n, {_N} AS total FROM sqls" for k, p in sqlfeat.STRICT.items())}),
t(feature, low, high) AS (VALUES {_STRICT}), s AS (SELECT f.feature, {_pct('n', 'total')} AS pct, low, high FROM f JOIN t USING (feature))
SELECT feature, pct, CASE WHEN pct BETWEEN low AND high THEN 'in' WHEN pct BETWEEN low - 2 AND high + 2 THEN 'near' ELSE 'out' END AS state FROM s"""


def source_mix(spark, sf_dir):
    return metrics.with_share(metrics.histogram(table(spark, sf_dir, "documents"), "source"))


def family_summary(spark, sf_dir):
    e = evals(spark, sf_dir).withColumn("split", F.when(F.col("question_id") % 10 == 0, "dev").otherwise("train"))
    return e.groupBy("difficulty").pivot("split", ["train", "dev"]).agg(F.count(F.lit(1))).na.fill(0)


def status_counts(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "event_type")


def distinct_groups(spark, sf_dir):
    e = evals(spark, sf_dir)
    return e.groupBy("difficulty").agg(F.count_distinct("db_id").alias("dbs"), F.count_distinct(F.when(F.col("correct"), F.col("db_id"))).alias("dbs_right"))


def failure_types(spark, sf_dir):
    """C9 and C10-style summary: failure class of each failing prediction with attempts and acceptance."""
    e = evals(spark, sf_dir).where("exec_failed or wrong_result").join(sqls(spark, sf_dir).withColumnRenamed("doc_id", "question_id"), "question_id")
    kind = sqlfeat.failure_type(F.col("exec_failed"), F.col("wrong_result"), sqlfeat.error_category("pred_error"), F.col("sql"), F.col("pred_error"))
    return e.groupBy(kind.alias("failure_type")).agg(F.count("*").alias("attempted"), F.count_if(F.col("question_id") % 4 == 0).alias("accepted"))


_CATEGORY = "CASE WHEN coalesce(pred_error, '') = '' THEN 'unknown' WHEN contains(lower(pred_error), 'no such column') THEN 'column_error' WHEN contains(lower(pred_error), 'no such table') THEN 'table_error' WHEN contains(lower(pred_error), 'syntax error') THEN 'syntax_error' WHEN contains(lower(pred_error), 'aggregate') THEN 'aggregate_error' WHEN contains(lower(pred_error), 'ambiguous column') THEN 'ambiguous_column' WHEN contains(lower(pred_error), 'near') THEN 'syntax_error' ELSE 'other_error' END"
_KIND = "CASE WHEN contains(lower(pred_error), 'no such column') THEN 'column_not_found' WHEN contains(lower(pred_error), 'no such table') THEN 'table_not_found' WHEN contains(lower(pred_error), 'syntax error') THEN 'syntax_error' WHEN contains(lower(pred_error), 'ambiguous column') THEN 'ambiguous_column' WHEN contains(lower(pred_error), 'unrecognized token') THEN 'unrecognized_token' WHEN contains(lower(pred_error), 'misuse of aggregate') THEN 'aggregate_misuse' WHEN contains(lower(pred_error), 'near') THEN 'syntax_near' ELSE 'other' END"
_TYPES_SQL = f"""WITH {EVALS}, {SQLS}, j AS (SELECT e.*, s.sql, {_CATEGORY} AS cat FROM evals e JOIN sqls s ON s.doc_id = e.question_id WHERE exec_failed OR wrong_result),
k AS (SELECT question_id, coalesce(CASE WHEN exec_failed THEN CASE cat {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in sqlfeat.CATEGORY_TO_TYPE.items())} END END, CASE WHEN exec_failed AND contains(lower(pred_error), 'ambiguous') THEN 'alias_error' END,
  CASE WHEN length(trim(sql)) > 0 AND (length(trim(sql)) < 10 OR NOT starts_with(upper(trim(sql)), 'SELECT')) THEN 'degenerate_or_truncated_sql' WHEN wrong_result THEN 'wrong_return_field' WHEN exec_failed THEN 'syntax_local_error' ELSE 'wrong_return_field' END) AS failure_type FROM j)
SELECT failure_type, {_N} AS attempted, {_if('question_id % 4 = 0')} AS accepted FROM k GROUP BY failure_type"""


def error_buckets(spark, sf_dir):
    """The first eight of each outcome bucket."""
    e = evals(spark, sf_dir)
    bucket = sqlfeat.error_bucket(F.col("correct"), F.col("exec_failed"), F.col("wrong_result"), F.when(F.col("exec_failed"), sqlfeat.error_category("pred_error")))
    w = Window.partitionBy("bucket").orderBy("question_id")
    return e.withColumn("bucket", bucket).withColumn("rk", F.row_number().over(w).cast("long")).where("rk <= 8").select("bucket", "rk", "question_id")


def top_bottom_groups(spark, sf_dir):
    """The five best and the five worst databases by accuracy, then size."""
    g = metrics.by_group(evals(spark, sf_dir), "db_id")
    top = g.orderBy(F.desc("accuracy"), F.desc("total"), "db_id").limit(5).withColumn("side", F.lit("top"))
    bottom = g.orderBy("accuracy", F.desc("total"), "db_id").limit(5).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "db_id", "total", "accuracy")


def repair_attempts(spark, sf_dir):
    """How many questions are first fixed at attempt k, of at most three."""
    t = evals(spark, sf_dir).where("exec_failed").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3)))).where((F.col("question_id") + F.col("attempt")) % 4 == 0)
    return t.groupBy("question_id").agg(F.min("attempt").alias("fixed_at")).groupBy("fixed_at").agg(F.count("*").alias("n")).select(F.col("fixed_at").cast("long").alias("fixed_at"), "n")


def rewards(spark, sf_dir):
    e = evals(spark, sf_dir)
    r = sqlfeat.reward(~F.col("gold_error"), ~F.col("exec_failed"), F.col("correct"))
    return e.groupBy("db_id").agg(F.count("*").alias("n"), F.count_if(r == 1.0).alias("full"), F.count_if(r == 0.3).alias("part"), F.count_if(r == 0.0).alias("none"))


def vote_query(spark, sf_dir):
    return vote.vote(candidates(spark, sf_dir))


_VOTE_SQL = f"""WITH {CANDIDATES}, t AS (SELECT *, count(*) OVER q AS nc, count(*) FILTER (ok) OVER q AS ne FROM candidates WINDOW q AS (PARTITION BY question_id)),
u AS (SELECT *, CASE WHEN ok THEN sig ELSE '' END AS grp FROM t WHERE ok OR ne = 0),
x AS (SELECT question_id, grp, sql, count(*) AS nt, min(pos) AS ft, any_value(nc) AS nc, any_value(ne) AS ne FROM u GROUP BY question_id, grp, sql),
y AS (SELECT *, sum(nt) OVER g AS ng, min(ft) OVER g AS fg FROM x WINDOW g AS (PARTITION BY question_id, grp)),
z AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ng DESC, fg, nt DESC, length(sql), sql) AS rk FROM y),
c AS (SELECT question_id, count(DISTINCT grp) AS k FROM x GROUP BY question_id)
SELECT question_id, sql AS chosen_sql, CASE WHEN ne > 0 THEN 'vote' ELSE 'fallback' END AS method, CAST(nc AS BIGINT) AS num_candidates, CAST(ne AS BIGINT) AS num_executable,
  CAST(CASE WHEN ne > 0 THEN k ELSE 0 END AS BIGINT) AS num_result_groups, CAST(CASE WHEN ne > 0 THEN ng ELSE 0 END AS BIGINT) AS winning_group_size,
  CASE WHEN ne > 0 THEN CAST(ng AS DOUBLE) / nc ELSE 0.0::DOUBLE END AS confidence FROM z JOIN c USING (question_id) WHERE rk = 1"""


def vote_stats(spark, sf_dir):
    """How often the vote decided, and how clear it was."""
    v = vote_query(spark, sf_dir)
    return v.groupBy("method").agg(F.count("*").alias("n"), F.sum("winning_group_size").alias("in_groups"), F.sum("num_result_groups").alias("groups"))


#: Gold and predicted queries over the star schema, with a tied alternative.
PAIRS = [
    (1, "retail", "simple", "SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(1) AS n FROM lineitem GROUP BY 1 ORDER BY 2", None),
    (2, "retail", "simple", "SELECT count(*) FROM orders", "<think>hm</think>```sql\nSELECT COUNT(*) FROM orders;\n```", None),
    (3, "retail", "moderate", "SELECT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey", "SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey", None),
    (4, "retail", "moderate", "SELECT max(o_totalprice) FROM orders", "SELECT min(o_totalprice) FROM orders", None),
    (5, "geo", "simple", "SELECT n_name FROM nation", "SELECT n_title FROM nation", None),
    (6, "geo", "simple", "SELECT r_name FROM region", "SELECT r_name FROM regions", None),
    (7, "geo", "moderate", "SELECT count(*) FROM nation", "SELEC count(*) FROM nation", None),
    (8, "geo", "challenging", "SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey", "SELECT n_name, n_regionkey, count(*) FROM nation GROUP BY n_regionkey", None),
    (9, "geo", "challenging", "SELECT nope FROM nation", "SELECT n_name FROM nation", None),
    (10, "geo", "challenging", "SELECT n_nationkey FROM nation", "SELECT n_name FROM nation", "SELECT n_name FROM nation"),
    (11, "geo", "simple", "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey < 0", None),
    (12, "retail", "challenging", "SELECT p_partkey FROM part JOIN lineitem ON p_partkey = l_partkey", "SELECT p_partkey FROM part a JOIN part b ON a.p_partkey = b.p_partkey", None),
]


def _records(spark, sf_dir):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    keys = ("question_id", "db_id", "difficulty", "gold_sql", "predicted_sql", "tied_sql")
    return Evaluator(spark).evaluate([dict(zip(keys, p)) for p in PAIRS])


def exec_match(spark, sf_dir):
    """One record per prediction."""
    return _records(spark, sf_dir).select("question_id", "correct", "exact_match", "exec_failed", "wrong_result", F.col("gold_error").isNotNull().alias("gold_failed"), "error_category", "matched_via")


_WANT = {1: "correct", 2: "exact", 3: "correct", 4: "wrong", 5: "column_error", 6: "table_error", 7: "syntax_error", 8: "aggregate_error", 9: "gold", 10: "tied", 11: "correct", 12: "ambiguous_column"}


def _outcome_sql(p) -> str:
    """The outcome of a pair as DuckDB finds it by running both; what must fail to run is stated."""
    if _WANT[p[0]] not in ("correct", "exact", "wrong", "tied"):
        return f"'{_WANT[p[0]]}'"
    gold, pred, tied = (normalize(x) if x else None for x in (p[3], p[4], p[5]))
    rows = lambda q: f"(SELECT list_sort(list_distinct(list(CAST(json_extract(to_json(t), '$.*') AS VARCHAR)))) FROM ({q}) AS t)"
    same = lambda q: f"coalesce({rows(q)}, []) = coalesce({rows(pred)}, [])"
    tie = f"WHEN {same(tied)} THEN 'tied' " if tied else ""
    return f"CASE WHEN {str(gold.lower() == pred.lower()).lower()} THEN 'exact' WHEN {same(gold)} THEN 'correct' {tie}ELSE 'wrong' END"


_RECORDS = "records AS (" + " UNION ALL ".join(f"SELECT {p[0]} AS question_id, '{p[1]}' AS db_id, {_outcome_sql(p)} AS outcome" for p in PAIRS) + ")"
_MATCH_SQL = f"""WITH {_RECORDS} SELECT CAST(question_id AS BIGINT) AS question_id, outcome IN ('correct', 'exact', 'tied') AS correct, outcome = 'exact' AS exact_match, outcome LIKE '%\\_error' ESCAPE '\\' OR outcome = 'ambiguous_column' AS exec_failed, outcome = 'wrong' AS wrong_result,
  outcome = 'gold' AS gold_failed, CASE WHEN outcome LIKE '%\\_error' ESCAPE '\\' OR outcome = 'ambiguous_column' THEN outcome END AS error_category, CASE WHEN outcome = 'tied' THEN 'tied_append' END AS matched_via FROM records"""


def exec_match_report(spark, sf_dir):
    """The flagship: accuracy by database from executed queries."""
    return metrics.by_group(_records(spark, sf_dir), "db_id")


_REPORT_SQL = f"""WITH {_RECORDS}, e AS (SELECT db_id, outcome IN ('correct', 'exact', 'tied') AS correct, outcome LIKE '%\\_error' ESCAPE '\\' OR outcome = 'ambiguous_column' AS exec_failed, outcome = 'wrong' AS wrong_result FROM records)
SELECT db_id, {_COUNTS}, {_pct(_if('correct'), _N)} AS accuracy FROM e GROUP BY db_id"""


def result_signature(spark, sf_dir):
    """The same result in another order and under other names has one signature; a duplicate row changes it."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a = vote.result_signature(n).withColumnRenamed("signature", "a")
    b = vote.result_signature(n.orderBy(F.desc("n_nationkey")).toDF("x", "y")).withColumnRenamed("signature", "b")
    c = vote.result_signature(n.unionByName(n.limit(1))).withColumnRenamed("signature", "c")
    one = a.crossJoin(b).crossJoin(c)  # three one-row results
    return one.select((F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_with_duplicate"), F.length("a").cast("long").alias("digits"))


_WIDE = {k: f"regexp_matches(upper(sql), '{p}')" for k, p in sqlfeat.WIDE.items()} | {"subquery": "len(regexp_extract_all(upper(sql), 'SELECT')) > 1", "backtick": "contains(sql, chr(96))"}

QUERIES = {
    "exec_match_report": (exec_match_report, _REPORT_SQL),
    "exec_match": (exec_match, _MATCH_SQL),
    "eval_overall": (eval_overall, f"WITH {EVALS}, o AS (SELECT {_COUNTS}, {_if('exact_match')} AS exact_match, {_if('gold_error')} AS gold_errors, {_if('tied')} AS tied_matches FROM evals) SELECT *, " + ", ".join(f"{_pct(c, 'total')} AS {c}_pct" for c in ("correct", "exact_match", "exec_failed", "wrong_result")) + " FROM o"),
    "eval_by_difficulty": (eval_by_difficulty, f"WITH {EVALS}, g AS (SELECT difficulty, {_COUNTS} FROM evals GROUP BY difficulty), d(difficulty) AS (VALUES ('simple'), ('moderate'), ('challenging'), ('extreme')) SELECT d.difficulty, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(exec_failed, 0) AS exec_failed, coalesce(wrong_result, 0) AS wrong_result, coalesce({_pct('correct', 'total')}, 0.0::DOUBLE) AS accuracy FROM d LEFT JOIN g USING (difficulty)"),
    "eval_by_db": (eval_by_db, f"WITH {EVALS}, g AS (SELECT db_id, {_COUNTS} FROM evals GROUP BY db_id) SELECT *, {_pct('correct', 'total')} AS accuracy FROM g"),
    "error_histogram": (error_histogram, f"WITH {EVALS}, g AS (SELECT {_CATEGORY} AS category, {_N} AS n FROM evals WHERE exec_failed GROUP BY 1) SELECT *, {_pct('n', '(sum(n) OVER ())')} AS pct FROM g"),
    "error_kinds": (error_kinds, f"WITH {EVALS} SELECT {_KIND} AS kind, {_N} AS n FROM evals WHERE exec_failed GROUP BY 1"),
    "db_difficulty_matrix": (db_difficulty_matrix, f"WITH {EVALS}, g AS (SELECT db_id, difficulty, {_COUNTS} FROM evals GROUP BY db_id, difficulty) SELECT *, {_pct('correct', 'total')} AS accuracy FROM g"),
    "dataset_composition": (dataset_composition, f"WITH {EVALS} SELECT db_id, difficulty, {_N} AS n, CAST(0 AS BIGINT) AS level FROM evals GROUP BY db_id, difficulty UNION ALL SELECT db_id, NULL, {_N}, 1 FROM evals GROUP BY db_id"),
    "run_compare": (run_compare, f"WITH {_RUNS} SELECT question_id, db_id, a_correct, b_correct FROM p"),
    "win_loss": (win_loss, f"WITH {_RUNS}, c AS (SELECT coalesce(a_correct, false) AS a, coalesce(b_correct, false) AS b FROM p), s AS (SELECT {_if('a AND b')} AS both_right, {_if('NOT a AND NOT b')} AS both_wrong, {_if('a AND NOT b')} AS a_only, {_if('b AND NOT a')} AS b_only FROM c) SELECT *, b_only - a_only AS net FROM s"),
    "run_deltas": (run_deltas, f"WITH {_RUNS}, x AS (SELECT db_id, {_pct(_if('correct'), _N)} AS a FROM a GROUP BY db_id), y AS (SELECT db_id, {_pct(_if('correct'), _N)} AS b FROM b GROUP BY db_id) SELECT db_id, a, b, coalesce(b, 0) - coalesce(a, 0) AS delta FROM x FULL JOIN y USING (db_id)"),
    "pattern_distribution": (pattern_distribution, f"WITH {SQLS}, f AS ({' UNION ALL '.join(f'''SELECT '{k}' AS feature, {_if(x)} AS n, {_N} AS total FROM sqls''' for k, x in _WIDE.items())}) SELECT feature, n, {_pct('n', 'total')} AS pct FROM f"),
    "target_bands": (target_bands, _BANDS_SQL),
    "source_mix_pct": (source_mix, f"WITH g AS (SELECT source, {_N} AS n FROM documents GROUP BY source) SELECT *, {_pct('n', '(sum(n) OVER ())')} AS pct FROM g"),
    "family_summary": (family_summary, f"WITH {EVALS} SELECT difficulty, {_if('question_id % 10 <> 0')} AS train, {_if('question_id % 10 = 0')} AS dev FROM evals GROUP BY difficulty"),
    "status_counts": (status_counts, f"SELECT event_type, {_N} AS n FROM events GROUP BY event_type"),
    "distinct_groups": (distinct_groups, f"WITH {EVALS} SELECT difficulty, CAST(count(DISTINCT db_id) AS BIGINT) AS dbs, CAST(count(DISTINCT CASE WHEN correct THEN db_id END) AS BIGINT) AS dbs_right FROM evals GROUP BY difficulty"),
    "failure_types": (failure_types, _TYPES_SQL),
    "topk_errors_per_class": (error_buckets, f"WITH {EVALS}, b AS (SELECT question_id, CASE WHEN correct THEN 'correct' WHEN exec_failed THEN {_CATEGORY} WHEN wrong_result THEN 'wrong_result' ELSE 'other_error' END AS bucket FROM evals), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY question_id) AS rk FROM b) SELECT bucket, CAST(rk AS BIGINT) AS rk, question_id FROM r WHERE rk <= 8"),
    "top_bottom_groups": (top_bottom_groups, f"WITH {EVALS}, g AS (SELECT db_id, {_N} AS total, {_pct(_if('correct'), _N)} AS accuracy FROM evals GROUP BY db_id) (SELECT 'top' AS side, * FROM g ORDER BY accuracy DESC, total DESC, db_id LIMIT 5) UNION ALL (SELECT 'bottom' AS side, * FROM g ORDER BY accuracy, total DESC, db_id LIMIT 5)"),
    "repair_attempts": (repair_attempts, f"WITH {EVALS}, t AS (SELECT question_id, min(a) AS fixed_at FROM evals, (VALUES (1), (2), (3)) AS k(a) WHERE exec_failed AND (question_id + a) % 4 = 0 GROUP BY question_id) SELECT CAST(fixed_at AS BIGINT) AS fixed_at, {_N} AS n FROM t GROUP BY fixed_at"),
    "rewards": (rewards, f"WITH {EVALS} SELECT db_id, {_N} AS n, {_if('correct')} AS \"full\", {_if('NOT gold_error AND NOT exec_failed AND NOT correct')} AS part, {_if('gold_error OR exec_failed')} AS \"none\" FROM evals GROUP BY db_id"),
    "vote": (vote_query, _VOTE_SQL),
    "vote_stats": (vote_stats, f"WITH v AS ({_VOTE_SQL}) SELECT method, {_N} AS n, CAST(sum(winning_group_size) AS BIGINT) AS in_groups, CAST(sum(num_result_groups) AS BIGINT) AS groups FROM v GROUP BY method"),
    "result_signature": (result_signature, "SELECT true AS same, false AS same_with_duplicate, CAST(64 AS BIGINT) AS digits"),
}
