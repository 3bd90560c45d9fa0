"""Outputs: JSON lines, Markdown with front matter, files by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def front_matter(fields: dict[str, Column], content: Column) -> Column:
    """Markdown headed by the fields; nulls are empty."""
    head = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), content)


def file_stem(url: Column) -> Column:
    """What follows // in the URL, slashes and colons as underscores."""
    return F.translate(F.get(F.split(url, "//", -1), 1), "/:", "__")


def file_path(url: Column, at: Column, kind: str, root: str = "renders") -> Column:
    """One file for each page and time."""
    return F.concat(F.lit(root + "/"), file_stem(url), F.date_format(at, "_yyyyMMdd_HHmmss"), F.lit("." + kind))


def summary_line(profile: Column, title: Column, length: Column) -> Column:
    return F.format_string("%s | %s | %d bytes", F.concat_ws(" ", profile["class"], F.lit("→"), profile["outcome"]), F.coalesce(title, F.lit("")), length)


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON text per row, with angle brackets and ampersands escaped."""
    text = F.to_json(F.struct("*"), {"pretty": "true"} if pretty else {})
    for mark, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return df.select(text.alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("append").text(path)


def write_by_domain(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Files in one folder per domain."""
    domain = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("unknown"))
    df.withColumn("domain", domain).write.mode("append").partitionBy("domain").format(fmt).save(path)
