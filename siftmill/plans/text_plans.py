"""Queries over SQL texts, prompts and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfeat, text
from ..operators import corrupt
from .fixtures import SQLS, chats, sqls, table

_THINK = "(?is)<think>.*?</think>"
_FENCE = "(?is)```(?:sql)?\\s*(.*?)```"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _unfenced(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_FENCE}') THEN regexp_extract({x}, '{_FENCE}', 1) ELSE {x} END"


def _of(name, column, sql_text):
    """A query of one computed text column over the SQL corpus."""

    def query(spark, sf_dir):
        return sqls(spark, sf_dir).select("doc_id", column("sql").alias(name))

    return query, f"WITH {SQLS} SELECT doc_id, {sql_text} AS {name} FROM sqls"


_FOLDED = "regexp_replace(trim(lower(sql)), '\\s+', ' ', 'g')"
_NO_THINK = f"regexp_replace(sql, '{_THINK}', '', 'g')"
_NO_COMMENT = _squeezed("regexp_replace(regexp_replace(sql, '(?m)--.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')")


def _list(x: str) -> str:
    """A sorted list of distinct strings as one text."""
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


def _joined(column):
    return lambda c: F.array_join(column(c), ",")


_WIDE_SQL = {k: f"regexp_matches(upper(sql), '{p}')" for k, p in sqlfeat.WIDE.items()} | {"subquery": "len(regexp_extract_all(upper(sql), 'SELECT')) > 1", "backtick": "contains(sql, chr(96))"}


def sql_features(spark, sf_dir):
    return sqls(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in sqlfeat.wide_features("sql").items()])


def strict_features(spark, sf_dir):
    return sqls(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in sqlfeat.strict_features("sql").items()])


def substring_features(spark, sf_dir):
    return sqls(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in sqlfeat.substring_features("sql").items()])


def difficulty(spark, sf_dir):
    score = sqlfeat.difficulty_score("sql")
    level = sqlfeat.difficulty(score)
    stated = F.when(F.col("doc_id") % 3 == 0, "simple").when(F.col("doc_id") % 3 == 1, "moderate").otherwise("challenging")
    return sqls(spark, sf_dir).select("doc_id", score.cast("long").alias("score"), level.alias("level"), sqlfeat.corrected_difficulty(stated, level).alias("corrected"))


_DIFFICULTY_SQL = f"""WITH {SQLS}, s AS (
  SELECT doc_id, lower(sql) AS q FROM sqls
), k AS (
  SELECT doc_id, CAST(2 * len(regexp_extract_all(q, '\\bjoin\\b')) + 3 * (len(regexp_extract_all(q, 'select')) - 1)
    + CASE WHEN regexp_matches(q, '\\b(count|sum|avg|max|min)\\s*\\(') THEN 1 ELSE 0 END + CASE WHEN contains(q, 'group by') THEN 1 ELSE 0 END
    + CASE WHEN contains(q, 'having') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(q, '\\bover\\s*\\(') THEN 3 ELSE 0 END
    + CASE WHEN contains(q, 'distinct') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '\\b(union|intersect|except)\\b') THEN 2 ELSE 0 END
    + CASE WHEN starts_with(ltrim(q), 'with') THEN 2 ELSE 0 END AS BIGINT) AS score FROM s
), l AS (
  SELECT doc_id, score, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 6 THEN 'moderate' ELSE 'challenging' END AS level,
         CASE doc_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS stated FROM k
)
SELECT doc_id, score, level, CASE WHEN stated || level IN ('simplechallenging', 'challengingsimple') THEN level ELSE stated END AS corrected FROM l"""


def validators(spark, sf_dir):
    """F1, F2, F7, F8 and F11 side by side."""
    return sqls(spark, sf_dir).select(
        "doc_id", sqlfeat.junk_hint("sql").alias("junk"), sqlfeat.sql_validity("sql").alias("validity"), sqlfeat.prose_reason("sql").alias("prose"), sqlfeat.response_reason("sql").alias("response"), sqlfeat.truncated("sql").alias("truncated")
    )


_BALANCED = "length(b) - length(replace(b, '(', '')) = length(b) - length(replace(b, ')', ''))"
_VALIDATORS_SQL = f"""WITH {SQLS}, t AS (SELECT doc_id, sql, trim(sql) AS b, lower(trim(sql)) AS l, trim(upper(sql)) AS u FROM sqls)
SELECT doc_id,
  b = '' OR regexp_matches(b, '(?i){"|".join(f"(?:{p})" for p in sqlfeat.JUNK_HINTS)}') OR (length(b) < 5 AND NOT regexp_matches(b, '[a-zA-Z0-9]')) AS junk,
  CASE WHEN b = '' THEN 'Empty SQL' WHEN NOT regexp_matches(b, '(?i)\\bSELECT\\b') THEN 'No SELECT' WHEN NOT ({_BALANCED}) THEN 'Unbalanced parentheses'
       WHEN regexp_matches(b, '(?i)\\bSELECT\\s*,') THEN 'SELECT followed by comma' ELSE 'OK' END AS validity,
  CASE WHEN sql = '' THEN 'Empty SQL' WHEN starts_with(l, 'the ') THEN 'Starts with ''the ''' WHEN starts_with(l, 'here ') THEN 'Starts with ''here '''
       WHEN starts_with(l, 'this ') THEN 'Starts with ''this ''' WHEN starts_with(l, 'to ') THEN 'Starts with ''to ''' WHEN starts_with(l, 'i ') THEN 'Starts with ''I '''
       WHEN contains(sql, '```') THEN 'Contains code fences' WHEN starts_with(sql, '#') THEN 'Starts with markdown header'
       WHEN regexp_matches(l, '\\bexplanation\\b') THEN 'Contains ''explanation''' WHEN regexp_matches(l, '\\bnote:\\b') THEN 'Contains ''Note:'''
       WHEN length(b) < 8 THEN 'SQL too short' WHEN NOT regexp_matches(b, '(?i)^\\s*(SELECT|WITH|INSERT|UPDATE|DELETE)') THEN 'Does not start with SQL keyword' END AS prose,
  CASE WHEN sql = '' THEN 'Empty response' WHEN NOT regexp_matches(u, '^(SELECT|WITH|INSERT|UPDATE|DELETE)') THEN 'Does not start with SQL keyword' WHEN length(sql) < 10 THEN 'SQL too short' END AS response,
  sql = '' OR regexp_matches(b, '(?i)\\b(SELECT|FROM|WHERE|AND|OR|JOIN|ON|ORDER BY|GROUP BY|HAVING|LIMIT|SET|VALUES)\\s*$') OR NOT ({_BALANCED})
    OR (length(b) - length(replace(b, chr(39), ''))) % 2 <> 0 OR (starts_with(upper(b), 'SELECT') AND length(b) < 20) AS truncated
FROM t"""


def corruptions(spark, sf_dir):
    c = F.col("sql")
    out = {"no_distinct": corrupt.remove_distinct(c), "plain_count": corrupt.count_distinct_to_count(c), "count_star": corrupt.count_to_star(c), "no_backticks": corrupt.remove_backticks(c), "flipped": corrupt.flip_order(c), "other_limit": corrupt.change_limit(c)}
    return sqls(spark, sf_dir).select("doc_id", *[x.alias(k) for k, x in out.items()])


_CORRUPT_SQL = f"""WITH {SQLS}, t AS (SELECT doc_id, sql, upper(regexp_extract(sql, '(?i)\\b(ASC|DESC)\\b', 1)) AS d, regexp_extract(sql, '(?i)\\bLIMIT\\s+(\\d+)', 1) AS n FROM sqls)
SELECT doc_id,
  regexp_replace(sql, '(?is)^(.*?)\\bDISTINCT\\s+', '\\1') AS no_distinct,
  regexp_replace(sql, '(?is)^(.*?)\\bCOUNT\\s*\\(\\s*DISTINCT\\s+', '\\1COUNT(') AS plain_count,
  regexp_replace(sql, '(?is)^(.*?)\\bCOUNT\\s*\\(\\s*[A-Za-z_][\\w.]*\\s*\\)', '\\1COUNT(*)') AS count_star,
  replace(sql, chr(96), '') AS no_backticks,
  CASE d WHEN 'ASC' THEN regexp_replace(sql, '(?is)^(.*?)\\bASC\\b', '\\1DESC') WHEN 'DESC' THEN regexp_replace(sql, '(?is)^(.*?)\\bDESC\\b', '\\1ASC') ELSE sql END AS flipped,
  CASE WHEN n <> '' THEN regexp_extract(sql, '(?is)^(.*?\\bLIMIT\\s+)\\d+', 1) || CAST(CAST(n AS BIGINT) + 1 AS VARCHAR) || regexp_extract(sql, '(?is)^.*?\\bLIMIT\\s+\\d+(.*)$', 1) ELSE sql END AS other_limit
FROM t"""


def prompts(spark, sf_dir):
    """Canonical prompts built, then taken apart again."""
    docs = table(spark, sf_dir, "documents")
    hints = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("lang is "), "lang"))
    built = text.prompt(F.concat(F.lit("CREATE TABLE "), "source", F.lit("(a, b)")), F.concat(F.lit("How many "), "lang", F.lit("?")), hints)
    out = docs.select("doc_id", built.alias("prompt"))
    names = ("Schema", "Hints", "Question")
    return out.select("doc_id", "prompt", *[text.section("prompt", n, names[k + 1 :]).alias(n.lower()) for k, n in enumerate(names)])


_PROMPTS_SQL = """SELECT doc_id, 'Schema:' || chr(10) || 'CREATE TABLE ' || source || '(a, b)' || chr(10) || chr(10) || 'Hints:' || chr(10) || h || chr(10) || chr(10) || 'Question:' || chr(10) || 'How many ' || lang || '?' AS prompt,
  'CREATE TABLE ' || source || '(a, b)' AS schema, h AS hints, 'How many ' || lang || '?' AS question
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE 'lang is ' || lang END AS h FROM documents)"""


def role_messages(spark, sf_dir):
    c = chats(spark, sf_dir)
    return c.select("conv_id", text.message("messages", "user").alias("first_user"), text.message("messages", "assistant").alias("first_assistant"), F.size("messages").cast("long").alias("turns"))


_ROLES_SQL = """SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS first_user, coalesce(min_by(text, turn) FILTER (role = 'assistant'), '') AS first_assistant, CAST(count(*) AS BIGINT) AS turns
FROM conversations GROUP BY conv_id"""


def contract_errors(spark, sf_dir):
    """what is wrong with each chat row."""
    c = chats(spark, sf_dir)
    roles = F.transform("messages", lambda m: m.role)
    checks = {"too few messages": F.size("messages") < 2, "no user": ~F.array_contains(roles, "user"), "no assistant": ~F.array_contains(roles, "assistant"), "blank message": F.exists("messages", lambda m: F.trim(F.coalesce(m.content, F.lit(""))) == "")}
    return c.select("conv_id", F.array_join(F.array_compact(F.array(*[F.when(x, k) for k, x in checks.items()])), "; ").alias("errors"))


_CONTRACT_SQL = """SELECT conv_id, concat_ws('; ', CASE WHEN count(*) < 2 THEN 'too few messages' END, CASE WHEN NOT bool_or(role = 'user') THEN 'no user' END,
  CASE WHEN NOT bool_or(role = 'assistant') THEN 'no assistant' END, CASE WHEN bool_or(trim(coalesce(text, '')) = '') THEN 'blank message' END) AS errors
FROM conversations GROUP BY conv_id"""


def schema_lines(spark, sf_dir):
    """P18, P19, P21 over DDL and short schema lines."""
    docs = table(spark, sf_dir, "documents")
    lines = F.concat(F.col("source"), F.lit(" (a, b)\n\n  "), "lang", F.lit("_t(c)\nCREATE TABLE `"), "lang", F.lit("_x` (id)"))
    d = docs.select("doc_id", lines.alias("s"))
    return d.select("doc_id", text.schema_signature("s").alias("signature"), F.array_join(text.table_names("s"), ",").alias("names"), F.array_join(text.created_tables("s"), ",").alias("created"))


_SCHEMA_SQL = """WITH d AS (SELECT doc_id, source || ' (a, b)' || chr(10) || chr(10) || '  ' || lang || '_t(c)' || chr(10) || 'CREATE TABLE `' || lang || '_x` (id)' AS s FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '')), chr(10)) AS signature,
  array_to_string(list_sort(list_distinct(regexp_extract_all(s, '(?m)^([A-Za-z_]\\w*)\\s*\\(', 1))), ',') AS names,
  array_to_string(regexp_extract_all(s, '(?i)CREATE\\s+TABLE\\s+`?(\\w+)`?', 1), ',') AS created FROM d"""


def clause_bodies(spark, sf_dir):
    stops = ("ORDER BY", "GROUP BY", "HAVING", "LIMIT", "UNION")
    return sqls(spark, sf_dir).select("doc_id", text.clause("sql", "FROM", ("WHERE", *stops)).alias("from_body"), text.clause("sql", "WHERE", stops).alias("where_body"), text.count_clauses("sql").cast("long").alias("clauses"))


_STOPS = "ORDER BY|GROUP BY|HAVING|LIMIT|UNION"
_CLAUSES_SQL = f"""WITH {SQLS} SELECT doc_id, trim(regexp_extract(sql, '(?is)\\bFROM\\b(.*?)(?:\\b(?:WHERE|{_STOPS})\\b|$)', 1)) AS from_body,
  trim(regexp_extract(sql, '(?is)\\bWHERE\\b(.*?)(?:\\b(?:{_STOPS})\\b|$)', 1)) AS where_body,
  CAST({" + ".join(f"len(regexp_extract_all(upper(sql), '{chr(92)}b{w}{chr(92)}b'))" for w in text.CLAUSES)} AS BIGINT) AS clauses FROM sqls"""


def key_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", F.array_join(text.key_tokens("text"), " ").alias("keys"), F.size(text.tokenize("text")).cast("long").alias("tokens"))


_KEYS_SQL = """SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2))), ' ') AS keys,
  CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS BIGINT) AS tokens FROM benchmark"""

QUERIES = {
    "normalize_output": _of("norm", text.normalize_output, _squeezed(f"split_part({_unfenced(_NO_THINK)}, ';', 1)")),
    "recover_output": _of(
        "norm",
        text.recover_sql,
        _squeezed("split_part(" + _unfenced(f"(CASE WHEN regexp_matches({_NO_THINK}, '(?i)<think>') THEN regexp_extract({_NO_THINK}, '(?is)<think>.*?\\b((?:select|with)\\b.*)$', 1) ELSE {_NO_THINK} END)") + ", ';', 1)"),
    ),
    "after_think": _of("tail", text.after_think, "trim(array_to_string(list_filter(string_split(regexp_split_to_array(sql, '(?i)</think(?:ing)?>')[-1], chr(10)), lambda x: NOT starts_with(trim(x), '```')), chr(10)))"),
    "strip_comments": _of("bare", text.strip_comments, _NO_COMMENT),
    "strip_think": _of("bare", text.strip_think, f"trim(regexp_replace({_NO_THINK}, '(?is)<think>.*$', '', 'g'))"),
    "clean_proposal": _of("bare", text.clean_proposal, f"trim(split_part(regexp_replace(trim({_unfenced('sql')}), '(?i)^(?:here is|here''s|the corrected|corrected|sql|answer|output)[^\\n:]*:\\s*', ''), ';', 1))"),
    "fingerprint": _of("fp", text.fingerprint, f"md5({_FOLDED})"),
    "short_hash": _of("fp", text.short_hash, f"substr(md5({_NO_COMMENT}), 1, 16)"),
    "extract_tables": _of("tables", _joined(text.source_tables), _list("list_transform(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+`?(\\w+)`?', 1), lambda x: lower(x))")),
    "qualified_columns": _of("cols", _joined(text.qualified_columns), _list("regexp_extract_all(sql, '\\b([A-Za-z_]\\w*\\.[A-Za-z_]\\w*)\\b', 1)")),
    "prose_identifiers": _of("ids", _joined(text.prose_identifiers), _list("""list_concat(regexp_extract_all(sql, '[''"`](\\w+)[''"`]', 1), regexp_extract_all(sql, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1))""")),
    "sql_features": (sql_features, f"WITH {SQLS} SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _WIDE_SQL.items())} FROM sqls"),
    "sql_features_strict": (strict_features, f"WITH {SQLS} SELECT doc_id, " + ", ".join(f"regexp_matches(sql, '(?i){p}') AS \"{k}\"" for k, p in sqlfeat.STRICT.items()) + " FROM sqls"),
    "sql_features_substring": (
        substring_features,
        f"""WITH {SQLS}, u AS (SELECT doc_id, upper(sql) AS q FROM sqls) SELECT doc_id, contains(q, 'WITH ') AND contains(q, 'AS (') AS cte, contains(q, 'OVER (') OR contains(q, 'OVER(') AS "window",
        contains(q, 'CASE ') OR contains(q, 'CASE' || chr(10)) AS "case", len(regexp_extract_all(q, 'SELECT')) > 1 AS subquery, contains(q, ' JOIN ') AS "join", contains(q, 'GROUP BY') AS group_by, contains(q, 'HAVING') AS "having",
        contains(q, 'UNION') AS "union", contains(q, 'DISTINCT') AS "distinct", contains(q, 'LIMIT') AS "limit", contains(q, 'ORDER BY') AS "order", contains(q, 'BETWEEN') AS "between" FROM u""",
    ),
    "difficulty": (difficulty, _DIFFICULTY_SQL),
    "validators": (validators, _VALIDATORS_SQL),
    "corrupt_regex": (corruptions, _CORRUPT_SQL),
    "prompt_sections": (prompts, _PROMPTS_SQL),
    "role_messages": (role_messages, _ROLES_SQL),
    "contract_errors": (contract_errors, _CONTRACT_SQL),
    "schema_lines": (schema_lines, _SCHEMA_SQL),
    "clause_bodies": (clause_bodies, _CLAUSES_SQL),
    "key_tokens": (key_tokens, _KEYS_SQL),
}
