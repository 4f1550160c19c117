"""Text normalisation and parsing as Column builders; patterns stay in the subset that Java and RE2 share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = r"(?is)<think>.*?</think>"
FENCE = r"(?is)```(?:sql)?\s*(.*?)```"


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unfenced(c: Column) -> Column:
    """The inside of the first code fence, or the text itself."""
    return F.when(c.rlike(FENCE), F.regexp_extract(c, FENCE, 1)).otherwise(c)


def first_statement(c: Column) -> Column:
    return F.split_part(c, F.lit(";"), F.lit(1))


def normalize_output(c) -> Column:
    """Model output to SQL: no closed think block, first fence unwrapped, first statement, squeezed."""
    return squeeze(first_statement(unfenced(F.regexp_replace(text(c), THINK, ""))))


def recover_sql(c) -> Column:
    """As :func:`normalize_output`; after an unclosed think tag, the text from the first SELECT or WITH on."""
    closed = F.regexp_replace(text(c), THINK, "")
    after = F.regexp_extract(closed, r"(?is)<think>.*?\b((?:select|with)\b.*)$", 1)
    return squeeze(first_statement(unfenced(F.when(closed.rlike("(?i)<think>"), after).otherwise(closed))))


def after_think(c) -> Column:
    """Text after the last closing think tag, without fence lines; statements stay whole."""
    tail = F.element_at(F.split(text(c), "(?i)</think(?:ing)?>"), -1)
    lines = F.filter(F.split(tail, "\n"), lambda x: ~F.trim(x).startswith("```"))
    return F.trim(F.array_join(lines, "\n"))


def strip_comments(c) -> Column:
    """SQL without comments, squeezed; case stays."""
    return squeeze(F.regexp_replace(F.regexp_replace(text(c), r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", ""))


def strip_think(c) -> Column:
    """No think blocks; an unclosed tag goes with all that follows."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), THINK, ""), r"(?is)<think>.*$", ""))


def clean_proposal(c) -> Column:
    """A proposal's SQL: unfenced, without a lead-in phrase, first statement only."""
    return F.trim(first_statement(F.regexp_replace(F.trim(unfenced(text(c))), r"(?i)^(?:here is|here's|the corrected|corrected|sql|answer|output)[^\n:]*:\s*", "")))


def folded(c) -> Column:
    """Lower case, one space between words: what fingerprints are made of."""
    return F.array_join(F.split(F.trim(F.lower(text(c))), r"\s+"), " ")


def fingerprint(c) -> Column:
    return F.md5(folded(c).cast("binary"))


def short_hash(c) -> Column:
    return F.substring(F.md5(strip_comments(c).cast("binary")), 1, 16)


def section(c, name: str, following: tuple[str, ...] = ()) -> Column:
    """The body of a prompt section: what follows ``name:`` up to the next section's name or the end."""
    stop = "|".join(f"\\n{x}:" for x in following) + ("|" if following else "") + "$"
    return F.regexp_replace(F.regexp_extract(text(c), rf"(?s)(?:^|\n){name}:\s*\n(.*?)(?:{stop})", 1), r"^\s+|\s+$", "")


def prompt(schema: Column, question: Column, hints: Column) -> Column:
    """The canonical prompt; blank hints read None."""
    shown = F.coalesce(F.nullif(F.trim(F.coalesce(hints, F.lit(""))), F.lit("")), F.lit("None"))
    return F.concat(F.lit("Schema:\n"), F.trim(schema), F.lit("\n\nHints:\n"), shown, F.lit("\n\nQuestion:\n"), F.trim(question))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    def said(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    return F.array(said("system", system), said("user", user), said("assistant", assistant))


def message(messages, role: str) -> Column:
    """Content of the first message of a role; empty if there is none."""
    found = F.filter(F.col(messages) if isinstance(messages, str) else messages, lambda m: m.role == role)
    return F.coalesce(F.try_element_at(found, F.lit(1)).getField("content"), F.lit(""))


def schema_signature(c) -> Column:
    """Trimmed non-empty lines, sorted."""
    lines = F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(lines), "\n")


def table_names(c) -> Column:
    """Names that begin a schema line before a parenthesis, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?m)^([A-Za-z_]\w*)\s*\("), F.lit(1))))


def created_tables(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?i)CREATE\s+TABLE\s+`?(\w+)`?"), F.lit(1))


def source_tables(c) -> Column:
    """Tables after FROM and JOIN, lower-cased, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"(?i)\b(?:FROM|JOIN)\s+`?(\w+)`?"), F.lit(1)), F.lower)))


def qualified_columns(c) -> Column:
    """alias.column mentions, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\b"), F.lit(1))))


def clause(c, name: str, stops: tuple[str, ...]) -> Column:
    """The body of a clause up to the first stop word."""
    return F.trim(F.regexp_extract(text(c), rf"(?is)\b{name}\b(.*?)(?:\b(?:{'|'.join(stops)})\b|$)", 1))


def error_identifier(c, kind: str) -> Column:
    """The column or table that an error message names."""
    return F.regexp_extract(text(c), rf"(?i)no such {kind}: ([\w.]+)", 1)


def prose_identifiers(c) -> Column:
    """Quoted words and snake_case words of a text, sorted."""
    quoted = F.regexp_extract_all(text(c), F.lit(r"['\"`](\w+)['\"`]"), F.lit(1))
    snake = F.regexp_extract_all(text(c), F.lit(r"\b([a-z]+(?:_[a-z0-9]+)+)\b"), F.lit(1))
    return F.array_sort(F.array_union(quoted, snake))


def tokenize(c) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def key_tokens(c) -> Column:
    """Distinct words of more than two characters, without punctuation, sorted."""
    bare = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9_\s]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda x: F.length(x) > 2)))


CLAUSES = ("SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "UNION")


def count_clauses(c) -> Column:
    total = F.lit(0)
    for word in CLAUSES:
        total = total + F.regexp_count(F.upper(text(c)), F.lit(rf"\b{word}\b"))
    return total


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either side is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / any_)
