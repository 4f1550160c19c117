"""Report and manifest sinks: small aggregates rendered as Markdown, HTML or one JSON document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def _percent(c: str) -> Column:
    return F.format_string("%.2f%%", F.coalesce(F.col(c), F.lit(0.0)))


def _body(rows: DataFrame, section: int, order: list[Column], *cells: Column) -> DataFrame:
    """Numbered lines of one table; ``rows`` is an aggregate, one row per group."""
    w = Window.partitionBy(F.lit(section)).orderBy(*order)
    return rows.select(F.lit(section).alias("section"), F.row_number().over(w).cast("long").alias("pos"), F.array(*[c.cast("string") for c in cells]).alias("cells"))


def evaluation_cells(evals: DataFrame, levels: tuple[str, ...], category: Column) -> DataFrame:
    """(section, pos, cells) of an evaluation: totals, then by difficulty, by database (best first), and errors (most first); ``pos`` 0 holds a table's heads."""
    total = metrics.overall(evals).select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("metric"), F.col(c).alias("n"), F.col(f"{c}_pct").alias("pct")) for k, (name, c) in enumerate((("Execution accuracy", "correct"), ("Exact match", "exact_match"), ("Exec failures", "exec_failed"), ("Wrong results", "wrong_result")))])).alias("m")).select("total", "m.*")
    by_level = metrics.by_domain(evals, "difficulty", levels)
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("difficulty"))
    errors = metrics.histogram(evals.where("exec_failed").withColumn("category", category), "category")
    heads = [["Metric", "Count", "Rate"], ["Difficulty", "Correct", "Total", "Accuracy", "Exec fail", "Wrong"], ["Database", "Correct", "Total", "Accuracy"], ["Category", "Count"]]
    head = evals.sparkSession.createDataFrame([(k, 0, h) for k, h in enumerate(heads)], "section int, pos long, cells array<string>")
    parts = [
        head,
        _body(total, 0, [F.col("rank")], F.col("metric"), F.concat("n", F.lit("/"), "total"), _percent("pct")),
        _body(by_level, 1, [rank], F.col("difficulty"), F.col("correct"), F.col("total"), _percent("accuracy"), F.col("exec_failed"), F.col("wrong_result")),
        _body(metrics.by_group(evals, "db_id"), 2, [F.desc("accuracy"), F.col("db_id")], F.col("db_id"), F.col("correct"), F.col("total"), _percent("accuracy")),
        _body(errors, 3, [F.desc("n"), F.col("category")], F.col("category"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def markdown(cells: DataFrame) -> DataFrame:
    """``line``: a table row; heads carry their rule."""
    row = F.concat(F.lit("| "), F.array_join("cells", " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("\n"), F.repeat(F.lit("|-"), F.size("cells")), F.lit("|"))
    return cells.select("section", "pos", F.when(F.col("pos") == 0, F.concat(row, rule)).otherwise(row).alias("line"))


def html(cells: DataFrame) -> DataFrame:
    """``line``: a table row, its text escaped."""
    safe = F.transform("cells", lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    made = lambda tag: F.concat(F.lit(f"<tr><{tag}>"), F.array_join(safe, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))
    return cells.select("section", "pos", F.when(F.col("pos") == 0, made("th")).otherwise(made("td")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The report as one text file; its size is that of the groups."""
    lines.coalesce(1).sortWithinPartitions("section", "pos").select("line").write.mode("overwrite").text(path)


def manifest(counts: DataFrame, name: str, version: str, config: dict[str, str], created_at: str | None = None) -> DataFrame:
    """One JSON document over ``counts`` (file, n); the time is the caller's, so that reruns agree."""
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "n"))))
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]) if config else F.lit(None).cast("map<string,string>")
    row = counts.agg(files.alias("statistics")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(created_at).alias("created_at"), "statistics", settings.alias("config"))
    return row.select(F.to_json(F.struct(*row.columns)).alias("manifest"))
