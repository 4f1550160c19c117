"""Parsing, repair guards and compaction on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import compaction, corrupt, repair, sqltext
from siftmill.operators.evaluate import Verifier


def test_aliases():
    q = "SELECT a.x FROM orders AS a JOIN `big part` b ON a.id = b.id LEFT JOIN (SELECT id FROM t) s ON s.id = a.id JOIN region"
    assert sqltext.aliases(q) == {"a": "orders", "b": "big part", "s": "(subquery)", "t": "t", "region": "region"}


@pytest.mark.parametrize("sql, items", [("SELECT DISTINCT f(a, b), c AS d FROM t", ["f ( a , b )", "c AS d"]), ("SELECT (SELECT max(x) FROM u), 'a, b' FROM t", ["( SELECT max ( x ) FROM u )", "'a, b'"]), ("", []), ("no query", [])])
def test_select_items(sql, items):
    assert sqltext.select_items(sql) == items


def test_bare_identifiers():
    assert sqltext.bare_identifiers("SELECT name, t.id, COUNT(total) AS n FROM t WHERE 'x' = city -- note") == ["city", "name", "total"]


def test_ddl():
    ddl = 'CREATE TABLE IF NOT EXISTS "a b" (id INT PRIMARY KEY, v DECIMAL(10, 2) CHECK (v > 0), r INT REFERENCES c(id)); create table d (x TEXT, y INT, PRIMARY KEY (x, y), FOREIGN KEY (y) REFERENCES `a b` (id))'
    got = [(c["tab"], c["col"], c["typ"], c["pos"], c["is_pk"], c["ref_table"], c["ref_col"]) for c in sqltext.parse_ddl(ddl)]
    assert got == [("a b", "id", "INT", 0, True, None, None), ("a b", "v", "DECIMAL", 1, False, None, None), ("a b", "r", "INT", 2, False, "c", "id"), ("d", "x", "TEXT", 0, True, None, None), ("d", "y", "INT", 1, True, "a b", "id")]
    assert sqltext.format_ddl("CREATE TABLE t (a DECIMAL(1,2), b INT)") == "CREATE TABLE t (\n    a DECIMAL(1,2),\n    b INT\n);"


def brute_repeats(s):
    return len(s) >= 50 and any(s[k + w :].count(s[k : k + w]) >= 2 for w in (20, 30, 40) for k in range(len(s) - 2 * w))


def test_repeats():
    rng = random.Random(1)
    for _ in range(150):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randrange(5, 30)))
        s = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 40))) + unit * rng.randrange(1, 6) + "x" * rng.randrange(0, 50)
        assert sqltext.has_repeats(s) == brute_repeats(s), s
    assert sqltext.cut_at_repeat("SELECT a FROM t WHERE x = 1 " * 4).startswith("SELECT a FROM t WHER")


def test_guards(spark):
    rows = [(1, "SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 2", "alias_error"), (2, "SELECT a FROM t", "SELECT b, c, d FROM u JOIN v ON 1 = 1", "alias_error"), (3, "SELECT a FROM t", "SELECT b, c, d FROM u JOIN v ON 1 = 1", "wrong_return_field")]
    d = repair.with_guards(spark.createDataFrame(rows, "k int, original string, repaired string, failure_type string"))
    got = {r.k: (r.structure_issues, r.diff_ratio) for r in d.collect()}
    assert got[1][0] == [] and got[1][1] < 0.1
    assert got[2][0] == ["new tables", "join count", "select targets"] and got[3][0] == []


def test_acceptance_order(spark):
    t, f = F.lit(True), F.lit(False)
    cases = [((f, f, f, f, f, t, 0.9), "schema invalid"), ((t, t, t, t, f, t, 0.9), "result mismatch"), ((t, t, t, t, t, f, 0.6), "diff >50%"), ((t, t, t, t, t, f, 0.18), "diff over class limit"), ((t, t, t, t, t, f, 0.1), "accepted")]
    for args, want in cases:
        args = [F.lit(a) if isinstance(a, float) else a for a in args]
        assert spark.range(1).select(repair.acceptance(*args, F.lit("alias_error"))).first()[0] == want


def test_candidates(spark):
    cols = spark.createDataFrame([("t", "customer_id"), ("t", "name"), ("u", "customerid"), ("u", "custom_id")], "table_name string, column_name string")
    got = repair.candidates(spark.createDataFrame([(1, "customerid")], "row_id int, name string"), cols).orderBy("rk").collect()
    assert [r.column_name for r in got] == ["customerid", "customer_id", "custom_id"]


def test_compaction(spark):
    ddl = "CREATE TABLE a (id INT PRIMARY KEY, price REAL, w1 INT, w2 INT, w3 INT, w4 INT, w5 INT, w6 INT); CREATE TABLE b (id INT PRIMARY KEY, a_id INT REFERENCES a(id), n INT); CREATE TABLE c (id INT PRIMARY KEY, b_id INT REFERENCES b(id), colour TEXT)"
    cols = spark.createDataFrame([("d", ddl)], "db string, ddl string").select("db", F.explode(sqltext.columns_of("ddl")).alias("c")).select("db", "c.*")
    keys = spark.createDataFrame([("b", "a_id", "a", "id"), ("c", "b_id", "b", "id")], "src_t string, src_c string, dst_t string, dst_c string")
    q = spark.createDataFrame([(1, "d", "price by colour"), (2, "d", "zzz")], "question_id int, db string, question string")
    got = {r.question_id: r for r in compaction.compact(q, cols, keys).collect()}
    assert got[1].status == "success" and got[1].n_tables == 3 and "colour TEXT" in got[1].ddl and "w6" not in got[1].ddl
    assert got[2].status == "fallback" and got[2].reduction == 0.0


def test_corruptions():
    q = "SELECT a.x FROM t a JOIN u b ON a.id = b.id WHERE a.x BETWEEN 1 AND 2 AND (b.y = 1 AND b.z = 2) AND a.w = 'p AND q' ORDER BY 1"
    got = {corrupt.drop_condition(q, k) for k in range(40)}
    assert len(got) == 3 and all(x.endswith("ORDER BY 1") and x.count("WHERE") == 1 for x in got)
    assert corrupt.drop_condition("SELECT 1 FROM t WHERE x = 1", 0) == "SELECT 1 FROM t" and corrupt.drop_condition("SELECT 1", 0) == "SELECT 1"
    assert {corrupt.swap_alias("SELECT a.x FROM t a, u b", k) for k in range(9)} == {"SELECT b.x FROM t a, u b"} or corrupt.swap_alias("SELECT a.x FROM t a JOIN u b", 1) == "SELECT b.x FROM t a JOIN u b"
    assert corrupt.wrong_column("SELECT id FROM t", 3, ["id", "name"]) == "SELECT name FROM t"


def test_repair_loop(spark):
    tries = {(1, 1): "SELECT nope", (1, 2): "SELECT 1", (2, 1): "SELECT 2", (3, 1): "", (3, 2): "SELEC"}
    log = Verifier(spark).repair_loop([{"question_id": k} for k in (1, 2, 3)], lambda r, a: tries[r["question_id"], a])
    assert [(x["question_id"], x["attempt"], x["accepted"]) for x in log] == [(1, 1, False), (2, 1, True), (3, 1, False), (1, 2, True), (3, 2, False)]
