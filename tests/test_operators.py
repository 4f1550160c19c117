"""Operators on small inputs: the traps of their semantics."""

import difflib

import pytest
from pyspark.sql import functions as F

from siftmill.functions import sqlfeat, text
from siftmill.operators import dedup, pack, sample, schema_graph, vote
from siftmill.operators.dialect import to_spark
from siftmill.operators.evaluate import Evaluator, set_equal
from siftmill.sources import jsonl
from siftmill.streaming.progress import windowed_counts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column("s").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<think>a; b</think>SELECT 1; SELECT 2", "SELECT 1"),
        ("```sql\nSELECT\n 1\n```", "SELECT 1"),
        ("```\nSELECT ';'\n```", "SELECT '"),
        ("<think>open SELECT 1", "<think>open SELECT 1"),
        (None, ""),
        ("  ", ""),
    ],
)
def test_normalize_output(spark, raw, want):
    assert one(spark, text.normalize_output, raw) == want


def test_recover_and_strip(spark):
    assert one(spark, text.recover_sql, "<think>so I say WITH q AS (SELECT 1) SELECT * FROM q; done") == "WITH q AS (SELECT 1) SELECT * FROM q"
    assert one(spark, text.strip_think, "SELECT 1 <think>never closed") == "SELECT 1"
    assert one(spark, text.strip_comments, "SELECT 1 -- a\n/* b\nc */ FROM t") == "SELECT 1 FROM t"


def test_set_equality(spark):
    q = spark.sql
    assert set_equal(q("SELECT 1 AS a UNION ALL SELECT 1"), q("SELECT 1.0D AS b"))
    assert not set_equal(q("SELECT 1, 2"), q("SELECT 2, 1"))
    assert set_equal(q("SELECT 1 WHERE false"), q("SELECT 1, 2 WHERE false"))
    assert set_equal(q("SELECT CAST(NULL AS INT)"), q("SELECT CAST(NULL AS INT)"))
    assert not set_equal(q("SELECT 1"), q("SELECT 1, 2"))


def test_signature_is_a_multiset(spark):
    a, b, c = (vote.result_signature(spark.sql(f"SELECT * FROM VALUES {v} AS t(x, y)")).first()[0] for v in ("(1, null), (2, 3)", "(2, 3), (1, null)", "(1, null), (2, 3), (2, 3)"))
    assert a == b != c


def test_vote(spark):
    rows = [(1, 0, "B", True, "x"), (1, 1, "A", True, "y"), (1, 2, "AA", True, "y"), (1, 3, "C", False, None), (2, 0, "Q", False, None), (2, 1, "P", False, None), (3, 0, "Z", True, "u"), (3, 1, "Y", True, "v")]
    got = {r.question_id: (r.chosen_sql, r.method, r.confidence) for r in vote.vote(spark.createDataFrame(rows, "question_id long, pos int, sql string, ok boolean, sig string")).collect()}
    assert got == {1: ("A", "vote", 0.5), 2: ("P", "fallback", 0.0), 3: ("Z", "vote", 0.5)}


def test_evaluator_reads_only(spark):
    e = Evaluator(spark)
    assert e.run("DROP TABLE nothing")[1] is not None
    r = e.one({"question_id": 1, "db_id": "d", "difficulty": "simple", "gold_sql": "SELECT 1", "predicted_sql": "SELECT CAST('x' AS INT)"})
    assert r.exec_failed and not r.correct and r.error_category == "other_error"


@pytest.mark.parametrize("n, dev", [(1, 0), (2, 1), (9, 1), (10, 1), (11, 1), (25, 2)])
def test_split_sizes(spark, n, dev):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("s").alias("g"))
    assert sample.stratified_split(rows, ["g"], "k").where("split = 'dev'").count() == dev


def test_largest_remainder_sums(spark):
    rows = spark.createDataFrame([("a", 7), ("b", 0), ("c", 101)], "g string, total long")
    got = sample.largest_remainder(rows, "g", "total", {"x": 1, "y": 1, "z": 1}).groupBy("g").agg(F.sum("n").alias("n"))
    assert {r.g: r.n for r in got.collect()} == {"a": 7, "b": 0, "c": 101}


def test_partitions_do_not_matter(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("g"))
    found = {tuple(r.k for r in sample.round_robin(rows.repartition(n), "g", "k", 2, 40).collect()) for n in (1, 4, 16)}
    assert len(found) == 1


def test_paths(spark):
    edges = schema_graph.undirected(spark.createDataFrame([("a", "x", "b", "y"), ("b", "x", "c", "y"), ("a", "x", "d", "y"), ("d", "x", "c", "y"), ("e", "x", "e", "y"), ("f", "x", "g", "y")], "src_t string, src_c string, dst_t string, dst_c string"))
    got = {(r.src, r.dst): r.path for r in schema_graph.paths(edges).collect()}
    assert got["a", "c"] == "a>b>c" and ("a", "f") not in got and ("e", "e") not in got


def test_greedy_near_dedup(spark):
    rows = [(k, "p", t) for k, t in enumerate(["select a from t where x = 1", "select a from t where x = 2", "something else at all", "SELECT A FROM t WHERE x = 1"])]
    got = {r.ord: (r.kept, r.similar_to) for r in dedup.greedy_near_dedup(spark.createDataFrame(rows, "k long, p string, t string"), "p", "k", "t").collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 0)}


def test_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(dedup.sequence_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_pack(spark):
    rows = spark.createDataFrame([(k, 0, [k] * n) for k, n in enumerate([3, 3, 9, 1])], "k long, s long, ids array<int>")
    got = [(r.members, r.input_ids, r.labels) for r in pack.pack(rows, "s", "k", "ids", 8, 99).orderBy("pack").collect()]
    assert got == [([0, 1], [0, 0, 0, 99, 1, 1, 1], [0, 0, 0, -100, 1, 1, 1]), ([2], [2] * 8, [2] * 8), ([3], [3], [3])]


def test_dialect():
    assert to_spark("SELECT IIF(a LIKE 'x LIKE y', 1, 2) FROM t LIMIT 5, 10") == "SELECT if(a ILIKE 'x LIKE y', 1, 2) FROM t LIMIT 10 OFFSET 5"
    assert to_spark("SELECT STRFTIME('%Y', d), CAST(a AS REAL), \"b c\" FROM t") == "SELECT date_format(d, 'yyyy'), CAST(a AS DOUBLE), `b c` FROM t"


def test_error_rules(spark):
    assert [one(spark, sqlfeat.error_category, m) for m in (None, "no such column: a", "misuse of aggregate near x", "near y")] == ["unknown", "column_error", "aggregate_error", "syntax_error"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    got = jsonl.read(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    assert [(r.a, r._corrupt_record) for r in got] == [(1, None), (None, "not json"), (2, None)]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = next(n for n, t in rows.dtypes if t.startswith("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), time, "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, windowed_counts(rows, time, "event_type").collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want


def test_cross_pool_leak_against_brute_force(spark, tmp_path):
    import difflib
    import random

    from siftmill.plans.corpus_plans import cross_pool_leak

    rng = random.Random(4)
    texts = ["ok", "ok", "no", "no", "thanks", "thank", "", "", None, "да", "да нет", "да, нет", "你好", "你好吗", "好", "a b c d e", "a b c d f", "!?", "!?!"]
    for _ in range(30):
        base = [rng.choice("abcd ef日") for _ in range(rng.randrange(1, 40))]
        for _ in range(2):
            texts.append("".join(c for c in base if rng.random() > 0.1))
    rows = [(k, 0, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)] + [(900, 0, "assistant", "ok"), (901, 0, "user", "thank")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    fold = lambda t: " ".join((t or "").lower().split())
    want = set()
    for i, _, p, x in rows:
        for j, _, q, y in rows:
            if (p, q) == ("user", "assistant") and (r := difflib.SequenceMatcher(None, fold(x), fold(y)).ratio()) >= 0.8:
                want.add((f"{i}/0", f"{j}/0", round(r, 3)))
    got = [(r.user_id, r.assistant_id, r.ratio) for r in cross_pool_leak(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
