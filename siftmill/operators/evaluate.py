"""Evaluation of predicted SQL: run gold and prediction over views, compare result sets, categorise failures.

SQL texts are planned on the driver, so each distinct text runs once; the comparison itself is a DataFrame
job.  Results are compared as sets of positional tuples: order, duplicates and names do not matter.
"""

from __future__ import annotations

import re
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's error conditions by category.
CONDITIONS = {"UNRESOLVED_COLUMN": "column_error", "TABLE_OR_VIEW_NOT_FOUND": "table_error", "PARSE_SYNTAX_ERROR": "syntax_error", "INVALID_WHERE_CONDITION": "aggregate_error", "MISSING_AGGREGATION": "aggregate_error", "MISSING_GROUP_BY": "aggregate_error", "AMBIGUOUS_REFERENCE": "ambiguous_column"}


@dataclass
class Record:
    question_id: int
    db_id: str
    difficulty: str
    gold_sql: str
    predicted_sql: str
    correct: bool = False
    exact_match: bool = False
    exec_failed: bool = False
    wrong_result: bool = False
    gold_error: str | None = None
    pred_error: str | None = None
    error_category: str | None = None
    matched_via: str | None = None


RECORD_SCHEMA = "question_id long, db_id string, difficulty string, gold_sql string, predicted_sql string, correct boolean, exact_match boolean, exec_failed boolean, wrong_result boolean, gold_error string, pred_error string, error_category string, matched_via string"


def normalize(sql: str | None) -> str:
    s = re.sub(r"(?is)<think>.*?</think>", "", sql or "")
    if m := re.search(r"(?is)```(?:sql)?\s*(.*?)```", s):
        s = m[1]
    return " ".join(s.split(";")[0].split())


def positional(df: DataFrame, other: DataFrame) -> DataFrame:
    """Columns by position; numbers as doubles where either side has fractions, so that 1 and 1.0 are equal, else exact."""

    def number(k: int, f: T.StructField):
        c, kinds = F.col(f"c{k}"), [f.dataType, other.schema[k].dataType]
        if not all(isinstance(t, T.NumericType) for t in kinds):
            return c.cast("double").alias(f"c{k}") if isinstance(f.dataType, T.NumericType) else c
        if all(isinstance(t, T.IntegralType) for t in kinds):
            return c.cast("long").alias(f"c{k}")
        exact = all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in kinds)
        return c.cast("decimal(38,10)" if exact else "double").alias(f"c{k}")

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[number(k, f) for k, f in enumerate(df.schema)])


def set_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same set of rows; two empty ones always do."""
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    x, y = positional(a, b), positional(b, a)
    if [f.dataType for f in x.schema] != [f.dataType for f in y.schema]:
        x, y = (d.select(*[F.col(c).cast("string") for c in d.columns]) for d in (x, y))
    return x.subtract(y).isEmpty() and y.subtract(x).isEmpty()


def category(error: Exception) -> str:
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    if "ParseException" in f"{type(error).__name__} {error}"[:400]:
        return "syntax_error"
    return CONDITIONS.get(condition.split(".")[0], "other_error")


class Evaluator:
    """Evaluates predictions over the views of a session; ``timeout`` seconds for each text."""

    def __init__(self, spark: SparkSession, timeout: float = 30.0):
        self.spark, self.timeout = spark, timeout

    def run(self, sql: str) -> tuple[DataFrame | None, Exception | None]:
        if not re.match(r"(?is)^\s*(select|with)\b", sql):
            try:  # parsed, never run: for its error
                self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
            except Exception as e:
                return None, e
            return None, ValueError("only SELECT and WITH are run")
        tag = f"siftmill-{id(sql)}-{threading.get_ident()}"
        timer = threading.Timer(self.timeout, self.spark.sparkContext.cancelJobsWithTag, [tag])
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            df = self.spark.sql(sql)
            df.write.format("noop").mode("overwrite").save()  # every column of every row, so that all errors show here
            return df, None
        except Exception as e:  # whatever a predicted text brings about is its result
            return None, e
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def equal(self, a: DataFrame, b: DataFrame) -> bool | Exception:
        """``set_equal`` under the timer; an error or the end of time is returned."""
        tag = f"siftmill-equal-{id(a)}-{threading.get_ident()}"
        timer = threading.Timer(2 * self.timeout, self.spark.sparkContext.cancelJobsWithTag, [tag])
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            return set_equal(a, b)
        except Exception as e:
            return e
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def one(self, row: dict) -> Record:
        gold, pred = normalize(row["gold_sql"]), normalize(row["predicted_sql"])
        out = Record(row["question_id"], row["db_id"], row["difficulty"], gold, pred)
        out.exact_match = gold.lower() == pred.lower()
        want, error = self.run(gold)
        if error is not None:
            out.gold_error = str(error)[:200]
            return out
        got, error = self.run(pred)
        same = False if error is not None else self.equal(want, got)
        error = same if isinstance(same, Exception) else error
        if error is not None:
            out.exec_failed, out.pred_error, out.error_category = True, str(error)[:200], category(error)
        elif same:
            out.correct = True
        elif row.get("tied_sql") and (tied := self.run(normalize(row["tied_sql"])))[1] is None and self.equal(tied[0], got) is True:
            out.correct, out.matched_via = True, "tied_append"
        else:
            out.wrong_result = True
        return out

    def evaluate(self, rows: list[dict], workers: int = 4) -> DataFrame:
        with ThreadPoolExecutor(workers) as threads:
            found = list(threads.map(self.one, rows))
        return self.spark.createDataFrame([tuple(asdict(r).values()) for r in found], RECORD_SCHEMA)


class Verifier(Evaluator):
    """Checks of corrections and of made pairs, and loops that ask for new tries."""

    def correction(self, corrected: str, reference: str, broken: str, schema_ok: bool = True) -> str:
        """ok, or the first reason why a correction does not count."""
        from .sqltext import lex

        words = [t.lower() for t in lex(corrected)]
        if not words or words[0] not in ("select", "with"):
            return "prose"
        if not schema_ok:
            return "schema"
        want, error = self.run(normalize(reference))
        if error is not None:
            return "reference fails"
        got, error = self.run(normalize(corrected))
        if error is not None:
            return "correction fails"
        if self.equal(want, got) is not True:
            return "results differ"
        return "unchanged" if normalize(corrected).lower() == normalize(broken).lower() else "ok"

    def pair(self, parent: str, broken: str) -> str:
        """ok if a made error is one: the parent runs, the texts differ, and the broken text fails or answers otherwise."""
        if normalize(parent).lower() == normalize(broken).lower():
            return "same text"
        want, error = self.run(normalize(parent))
        if error is not None:
            return "parent fails"
        got, error = self.run(normalize(broken))
        return "ok" if error is not None or self.equal(want, got) is not True else "same result"

    def repair_loop(self, rows: list[dict], propose, attempts: int = 2, accept=None) -> list[dict]:
        """Asks ``propose(row, attempt)`` for each pending row until ``accept`` takes it; one log entry a try.

        ``accept(row, sql)`` is by default: it runs.
        """
        accept = accept or (lambda row, sql: self.run(normalize(sql))[1] is None)
        log, pending = [], list(rows)
        for attempt in range(1, attempts + 1):
            left = []
            for row in pending:
                sql = propose(row, attempt)
                done = bool(sql) and accept(row, sql)
                log.append({"question_id": row["question_id"], "attempt": attempt, "sql": sql, "accepted": done})
                if not done:
                    left.append(row)
            pending = left
        return log
