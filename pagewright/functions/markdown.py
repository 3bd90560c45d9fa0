"""Markdown text functions: cleanup, counts, titles, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import rx

# Patterns.
CLEANUP = [
    (r"<!--[^>]*-->", ""), (r"(?m)^[\-\*\+]\s*\[\]\([^)]+\)\s*$", ""), (r"\[\]\([^)]+\)", ""),
    (r"(?im)^.*(?:scan the qr code|download the.*app|get the app|available on.*app store|available on.*google play).*$\n?", ""), (r"\n{3,}", "\n\n"),
]
HEADING, LINK, IMAGE, ANY_LINK = r"(?m)^#{1,6}\s", r"\[[^\]]+\]\([^)]+\)", r"!\[[^\]]*\]\([^)]+\)", r"\[[^\]]+\]\([^\)]+\)"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}]"


def cleanup(md: Column) -> Column:
    for p, to in CLEANUP:
        md = rx.replace(md, p, to)
    return rx.trim(md)


def cleanup_sql(x: str) -> str:
    for p, to in CLEANUP:
        x = rx.replace_sql(x, p, "\\n\\n" if to else "").replace("'\\n\\n'", "chr(10) || chr(10)")
    return rx.trim_sql(x)


def headings(md: Column) -> Column:
    return rx.count(md, HEADING)


def links(md: Column) -> Column:
    return rx.count(md, LINK) - rx.count(md, IMAGE)


def _lines(md: Column) -> Column:
    return F.transform(F.split(md, "\n", -1), rx.trim)


def _lines_sql(x: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda l: {rx.trim_sql('l')})"


def long_lines(md: Column) -> Column:
    """Lines of more than 40 bytes that open no heading, list, quote or fence."""
    return F.size(F.filter(_lines(md), lambda l: (F.octet_length(l) > 40) & ~l.rlike("^(?:[#*>-]|```)"))).cast("bigint")


def long_lines_sql(x: str) -> str:
    return f"len(list_filter({_lines_sql(x)}, lambda l: strlen(l) > 40 AND NOT regexp_matches(l, '^(?:[#*>-]|```)')))"


def front_matter(md: Column) -> Column:
    """Text between the opening and the closing --- line; null if either is missing."""
    rows = F.split(F.regexp_replace(md, r"^---\r?\n", ""), "\n", -1)
    end = F.array_position(F.transform(rows, lambda l: F.regexp_replace(l, r"\r+\z", "")), "---")
    # A last, empty piece after the final line feed is no line.
    return F.when(md.rlike(r"^---\r?\n") & (end > 0), F.array_join(F.slice(rows, 1, F.greatest(end - 1, F.lit(0)).cast("int")), "\n"))


def front_matter_sql(x: str) -> str:
    rows = f"string_split(regexp_replace({x}, '^---\\r?\\n', ''), chr(10))"
    end = f"list_position(list_transform({rows}, lambda l: rtrim(l, chr(13))), '---')"
    return f"CASE WHEN regexp_matches({x}, '^---\\r?\\n') AND {end} > 0 THEN array_to_string({rows}[1:{end} - 1], chr(10)) END"


def title(md: Column) -> Column:
    """Title of the front matter, else the first heading, else empty."""
    rows = F.filter(F.transform(F.split(front_matter(md), "\n", -1), rx.trim), lambda l: l.startswith("title:"))
    named = F.filter(F.transform(rows, lambda l: F.regexp_replace(rx.trim(F.substring(l, 7, 1_000_000)), "^[\"']+|[\"']+$", "")), lambda t: t != "")
    first = rx.trim(F.regexp_extract(md, rx.java(r"(?m)^#{1,6}\s+(.+)$"), 1))
    return F.coalesce(F.get(named, 0), first, F.lit(""))


def title_sql(x: str) -> str:
    rows = f"list_filter(list_transform(string_split({front_matter_sql(x)}, chr(10)), lambda l: {rx.trim_sql('l')}), lambda l: starts_with(l, 'title:'))"
    bare = rx.trim_sql("substr(l, 7)")
    quotes = rx.q('^["' + "']+|[\"" + "']+$")
    named = f"list_filter(list_transform({rows}, lambda l: regexp_replace({bare}, {quotes}, '', 'g')), lambda t: t <> '')"
    first = rx.trim_sql(f"regexp_extract({x}, {rx.q('(?m)^#{1,6}' + chr(92) + 's+(.+)$')}, 1)")
    return f"coalesce({named}[1], {first}, '')"


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def quality(md: Column) -> dict[str, Column]:
    """The quality counters of a text, by name."""
    lines = _lines(md)
    blocks = F.transform(F.split(md, "\n\n", -1), rx.trim)
    text = F.octet_length(md)
    letters = F.length(F.regexp_replace(md, r"[^\p{L}\p{N}" + rx.WS + "]", ""))
    return {
        "content_length": text.cast("bigint"),
        "heading_count": F.size(F.filter(lines, lambda l: l.rlike("^#+ "))).cast("bigint"),
        "paragraph_count": F.size(F.filter(blocks, lambda b: (b != "") & ~b.rlike("^(?:[#*>-]|```)"))).cast("bigint"),
        "list_count": F.size(F.filter(lines, lambda l: l.rlike(r"^(?:[-*] |[0-9]\. )"))).cast("bigint"),
        "code_block_count": F.floor(rx.count(md, "```") / 2).cast("bigint"),
        "link_count": rx.count(md, ANY_LINK),
        "text_density": F.when(~md.rlike(r"[\p{L}\p{N}]"), 0.0).otherwise(F.least(F.lit(1.0), letters / text)),
    }


def quality_sql(x: str) -> dict[str, str]:
    lines = _lines_sql(x)
    blocks = f"list_transform(string_split({x}, chr(10) || chr(10)), lambda l: {rx.trim_sql('l')})"
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}{rx.WS_SQL}]', '', 'g'))"
    return {
        "content_length": f"strlen({x})",
        "heading_count": f"len(list_filter({lines}, lambda l: regexp_matches(l, '^#+ ')))",
        "paragraph_count": f"len(list_filter({blocks}, lambda b: b <> '' AND NOT regexp_matches(b, '^(?:[#*>-]|```)')))",
        "list_count": f"len(list_filter({lines}, lambda l: regexp_matches(l, '^(?:[-*] |[0-9]\\. )')))",
        "code_block_count": f"{rx.count_sql(x, '```')} // 2",
        "link_count": rx.count_sql(x, ANY_LINK),
        "text_density": f"CASE WHEN NOT regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') THEN 0.0 ELSE least(1.0, {letters} / strlen({x})) END",
    }


def score(m) -> Column:
    """Quality score of the counters in columns named as in quality()."""
    n, c = m["content_length"], m
    size = F.when(n < 1000, n / 1000.0 * 30.0).when(n <= 5000, 30.0).otherwise(30.0 * F.least(F.lit(1.0), 1.0 - (n - 5000) / 10000.0))
    parts = sum((F.when(c[k] > least, 10.0).otherwise(0.0) for k, least in (("heading_count", 0), ("paragraph_count", 3), ("list_count", 0), ("code_block_count", 0))), F.lit(0.0))
    dense = F.when(c["text_density"] > 0.6, 20.0).otherwise(c["text_density"] * 40.0)
    total = size + F.least(F.lit(40.0), parts) + F.least(F.lit(10.0), c["link_count"] * 2.0) + dense
    return F.when(n < 100, 5.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))


SCORE_SQL = (
    "CASE WHEN content_length < 100 THEN 5.0 ELSE least(100.0, greatest(0.0, "
    "CASE WHEN content_length < 1000 THEN content_length / 1000.0 * 30.0 WHEN content_length <= 5000 THEN 30.0 ELSE 30.0 * least(1.0, 1.0 - (content_length - 5000) / 10000.0) END "
    "+ least(40.0, (CASE WHEN heading_count > 0 THEN 10 ELSE 0 END) + (CASE WHEN paragraph_count > 3 THEN 10 ELSE 0 END) + (CASE WHEN list_count > 0 THEN 10 ELSE 0 END) + (CASE WHEN code_block_count > 0 THEN 10 ELSE 0 END)) "
    "+ least(10.0, link_count * 2.0) + CASE WHEN text_density > 0.6 THEN 20.0 ELSE text_density * 40.0 END)) END"
)
