"""Regular expressions with the reference semantics: ASCII classes, line feed as the only line break.

Java needs rewriting where the semantics differ; DuckDB's engine has them
natively, so every helper also gives the SQL text used as oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a Java and as an RE2 class body.
WS = r"\t-\r \x85\xa0  -     　"
WS_SQL = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: ASCII white space of the pattern class \s.
S = r"[\t\n\f\r ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


def java(pattern: str) -> str:
    r"""An RE2 pattern for Java: \s, \d, \w and \b are ASCII, case folding is Unicode, $ and . know the line feed only."""
    out = pattern.replace("\\s", S).replace("[[\\t\\n\\f\\r ]", "[\\t\\n\\f\\r ").replace("\\b", "\x00")
    parts = out.split("\x00")
    # A boundary before a word character looks behind, after one looks ahead.
    text = parts[0]
    for nxt in parts[1:]:
        text += r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))" + nxt
    return "(?d)" + text.replace("(?i)", "(?iu)").replace("(?is)", "(?isu)").replace("(?im)", "(?imu)")


def matches(c: Column, patterns: list[str]) -> Column:
    return c.rlike(java("|".join(f"(?:{p})" for p in patterns)))


def matches_sql(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def replace(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, java(pattern), to)


def replace_sql(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(java(pattern))).cast("bigint")


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def words(c: Column) -> Column:
    """Fields between Unicode white space."""
    return F.filter(F.split(c, f"[{WS}]+", -1), lambda w: w != "")


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS_SQL}]+'), lambda w: w <> '')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def list_sql(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
