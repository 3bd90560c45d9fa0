"""The text functions under SQL names.

They are temporary SQL functions, that is, expressions which the optimizer
inlines; none of them calls Python.  Functions with lambdas over arrays have no
SQL text and are left to the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pagewright.functions import detect, fingerprint, markdown, rx
from pagewright.session import site_of, table

FUNCTIONS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "is_blocked_page": (detect.is_blocked, "BOOLEAN"), "is_binary_type": (detect.is_binary, "BOOLEAN"),
    "has_llm_text": (detect.has_llm_text, "BOOLEAN"), "md_cleanup": (markdown.cleanup, "STRING"), "md_headings": (markdown.headings, "BIGINT"), "md_links": (markdown.links, "BIGINT"),
    "semantic_fingerprint": (fingerprint.fingerprint, "STRING"), "strip_invisible": (markdown.strip_invisible, "STRING"), "normal_text": (fingerprint.normal, "STRING"),
    "is_retryable_error": (detect.is_retryable, "BOOLEAN"), "site_of_url": (site_of, "STRING"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Makes the functions callable from SQL in this session; gives their names."""
    probe = spark.createDataFrame([], "x string")
    for name, (fn, kind) in FUNCTIONS.items():
        body = _sql_of(probe, fn)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def _sql_of(probe, fn: Callable[[Column], Column]) -> str:
    """SQL text of the analysed expression over the column x."""
    from pyspark.sql import functions as F

    plan = probe.select(fn(F.col("x")).alias("out"))._jdf.queryExecution().analyzed()
    text = plan.expressions().apply(0).child().sql()
    return text.replace("x.`x`", "x").replace("`x`", "x")


# Arguments that meet both answers of each function.
_PAGE = "'<html><body>' || CASE WHEN result_id % 2 = 0 THEN 'captcha' ELSE 'all is well' END || '</body>'"
_TYPE = "CASE WHEN result_id % 2 = 0 THEN 'image/png' ELSE 'text/html' END"
_TOLD = "CASE WHEN result_id % 2 = 0 THEN ' LLM instructions' ELSE '' END"
_FAILED = "CASE WHEN result_id % 2 = 0 THEN 'unexpected EOF' ELSE 'bad certificate' END"


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function called from SQL, over the records."""
    register_all(spark)
    table(spark, sf_dir, "extractions").select("result_id", "content", "url").createOrReplaceTempView("pagewright_sql_demo")
    return spark.sql(f"""SELECT result_id, is_blocked_page({_PAGE}) AS is_blocked, is_binary_type({_TYPE}) AS is_binary, has_llm_text(content || {_TOLD}) AS llm, md5(md_cleanup(content)) AS clean, md_headings(content) AS headings, md_links(content) AS links,
      semantic_fingerprint(content) AS fingerprint, md5(strip_invisible(content)) AS visible, md5(normal_text(content)) AS normal, is_retryable_error({_FAILED}) AS retry, site_of_url(url) AS site FROM pagewright_sql_demo""").dropDuplicates(["result_id"])


def demo_sql() -> str:
    return rf"""SELECT result_id, {detect.is_blocked_sql('(' + _PAGE + ')')} AS is_blocked, {detect.is_binary_sql('(' + _TYPE + ')')} AS is_binary, {detect.has_llm_text_sql('(content || ' + _TOLD + ')')} AS llm, md5({markdown.cleanup_sql('content')}) AS clean,
      {rx.count_sql('content', markdown.HEADING)} AS headings, {rx.count_sql('content', markdown.LINK)} - {rx.count_sql('content', markdown.IMAGE)} AS links, {fingerprint.fingerprint_sql('content')} AS fingerprint, md5(regexp_replace(content, '{markdown.INVISIBLE}', '', 'g')) AS visible,
      md5({fingerprint.normal_sql('content')}) AS normal, {detect.is_retryable_sql('(' + _FAILED + ')')} AS retry, regexp_replace(lower(regexp_extract(url, '//([^/:?#]*)', 1)), '^(www\.|m\.)', '') AS site
      FROM (SELECT DISTINCT result_id, content, url FROM extractions)"""
