"""A small text rewriter from the SQLite dialect of the query corpus to Spark SQL."""

from __future__ import annotations

import re

#: What is a whole number for sure.
_WHOLE = r"\bcount\s*\([^()]*\)|(?<![\w.)])\d+"
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def _outside_strings(sql: str, rewrite) -> str:
    """Applies ``rewrite`` to what is not inside a quoted literal or name."""
    parts = re.split(r"('(?:[^']|'')*'|`[^`]*`)", sql)
    return "".join(x if k % 2 else rewrite(x) for k, x in enumerate(parts))


def to_spark(sql: str) -> str:
    """ILIKE for LIKE, IIF, LIMIT offset, STRFTIME, REAL and TEXT casts, quoted identifiers, and functions by other names.

    ``/`` between whole numbers cuts the fraction there; texts alone do not tell, so a quotient of two COUNTs or
    whole literals is rewritten and any other keeps its fraction.
    """

    def strftime(m: re.Match) -> str:
        form = m[1]
        if form == "%w":
            return f"cast(dayofweek({m[2]}) - 1 as string)"
        if form == "%j":
            return f"date_format({m[2]}, 'DDD')"
        for a, b in _FORMATS.items():
            form = form.replace(a, b)
        return f"date_format({m[2]}, '{form}')"

    sql = re.sub(r"(?i)\bstrftime\s*\(\s*'([^']*)'\s*,\s*([\w.`]+)\s*\)", strftime, sql)
    sql = re.sub(r"(?i)\bdate\s*\(\s*'now'\s*\)", "current_date()", sql)
    sql = re.sub(r"(?i)\bdate\s*\(\s*([\w.]+)\s*,\s*'([+-]\d+) days?'\s*\)", r"date_add(\1, \2)", sql)

    def plain(x: str) -> str:
        x = re.sub(r"(?i)\blike\b", "ILIKE", x)
        x = re.sub(r"(?i)\biif\s*\(", "if(", x)
        x = re.sub(r"(?i)\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", x)
        x = re.sub(r"(?i)\bas\s+real\s*\)", "AS DOUBLE)", x)
        x = re.sub(r"(?i)\bas\s+text\s*\)", "AS STRING)", x)
        x = re.sub(r"(?i)\bprintf\s*\(", "format_string(", x)
        x = re.sub(r"(?i)\bgroup_concat\s*\(\s*((?:distinct\s+)?[\w.]+)\s*\)", r"listagg(\1, ',')", x)
        x = re.sub(r"(?i)\bgroup_concat\s*\(", "listagg(", x)
        x = re.sub(r"(?i)\bjulianday\s*\(\s*([\w.]+)\s*\)", r"(unix_timestamp(cast(\1 as timestamp)) / 86400.0D + 2440587.5D)", x)
        x = re.sub(r"(?i)\btotal\s*\(\s*([\w.]+)\s*\)", r"coalesce(sum(cast(\1 as double)), 0.0D)", x)
        x = re.sub(rf"(?i)({_WHOLE})\s*/\s*({_WHOLE})(?![\w.])", r"(\1 div nullif(\2, 0))", x)
        return re.sub(r'"([^"]*)"', r"`\1`", x)

    return _outside_strings(sql, plain)
