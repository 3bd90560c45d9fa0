"""Inputs: page tables, folders of HTML files, compressed bodies."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Parquet pages: page_id, url, html and, where present, status, headers, redirect_chain."""
    return spark.read.parquet(path)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of HTML files, one page each: page_id (hash of the path), url (the path), html."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("url"))
    return rows.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


@F.pandas_udf(T.StringType())
def _decompressed(body: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(b, e) -> str | None:
        if b is None:
            return None
        e = (e or "").strip().lower()
        try:
            raw = gzip.decompress(b) if e == "gzip" else zlib.decompressobj(-15).decompress(b) if e == "deflate" else None if e == "br" else b
        except (OSError, EOFError, zlib.error):
            raw = None
        if raw is None:  # an undecodable body that is plainly text is kept
            raw = b if b.strip()[:1] in (b"<", b"{") else None
        return None if raw is None else raw.decode("utf-8", "replace")

    return pd.Series([one(b, e) for b, e in zip(body, encoding)], dtype=object)


def decoded_body(body: Column, encoding: Column) -> Column:
    """Text of a response body: gzip, raw deflate or identity; others and broken ones are null unless they begin like text."""
    return _decompressed(body, encoding)


def negotiated(markdown_body: Column, markdown_status: Column, html_body: Column) -> Column:
    """The Markdown answer, or the HTML one where the first was 404 or 406."""
    return F.when(markdown_status.isin(404, 406), html_body).otherwise(F.coalesce(markdown_body, html_body))
