"""Fingerprints that ignore ids, times, counters and versions; change between versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import rx

# The noise patterns, in the order they are removed.
IDS = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32,}"
TIMES = (
    r"(?i)\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?|\d{1,2}/\d{1,2}/\d{2,4}"
    r"|\d{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{2,4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}"
    r"|\d{1,2}:\d{2}(:\d{2})?\s*(am|pm)?|(today|yesterday|tomorrow)"
)
COUNTERS = r"\b\d{3,}\b"
AGO = r"(?i)\d+\s*(second|minute|hour|day|week|month|year)s?\s+ago|just\s+now|moments?\s+ago|a\s+(few|couple)\s+(seconds?|minutes?|hours?|days?)\s+ago"
VERSIONS = r"\bv?\d+\.\d+(\.\d+)*\b"
NOISE = [IDS, TIMES, COUNTERS, AGO, VERSIONS]


def normal(c: Column) -> Column:
    for p in NOISE:
        c = rx.replace(c, p, " ")
    return rx.trim(F.lower(F.regexp_replace(c, rx.S + "+", " ")))


def normal_sql(x: str) -> str:
    for p in NOISE:
        x = rx.replace_sql(x, p, " ")
    return rx.trim_sql(f"lower({rx.replace_sql(x, chr(92) + 's+', ' ')})")


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(normal(c), 256), 1, 32)


def fingerprint_sql(x: str) -> str:
    return f"substr(sha256({normal_sql(x)}), 1, 32)"


def long_words(norm: Column) -> Column:
    """Hashes of the distinct longer words of a normalised text."""
    return F.array_distinct(F.transform(F.filter(rx.words(norm), lambda w: F.octet_length(w) >= 3), lambda w: F.xxhash64(w)))


def significance_of(same: Column, a: Column, b: Column) -> Column:
    """0 to 100 from two sets of word hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(same | (union == 0), 0).otherwise(F.floor((F.lit(1.0) - both / union) * 100).cast("int")).cast("bigint")


def significance(old: Column, new: Column) -> Column:
    """0 to 100: share of the distinct longer words that only one version has.  old, new: normalised texts."""
    return significance_of(old == new, long_words(old), long_words(new))


def significance_sql(old: str, new: str) -> str:
    a, b = (f"list_distinct(list_filter({rx.words_sql(x)}, lambda w: strlen(w) >= 3))" for x in (old, new))
    both = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {old} = {new} OR {union} = 0 THEN 0 ELSE trunc((1.0::DOUBLE - {both} / {union}) * 100)::BIGINT END"
