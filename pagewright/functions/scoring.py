"""Confidence, validation and page classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import rx

# Phrase banks.
SKELETON = ["view more", "load more", "loading...", "please wait", "enable javascript", "javascript is required", "javascript must be enabled", "browser doesn't support", "upgrade your browser", "click here to", "sign in to", "log in to continue", "subscribe to", "create an account"]
BOT_WALL = ["checking your browser", "please wait while we verify", "access denied", "cloudflare", "ddos protection", "captcha", "are you a robot", "verify you are human"]
PAYWALL = ["subscribe to read", "subscribers only", "premium content", "unlock this article", "free articles remaining", "sign in to read", "membership required"]
STATUS_REASONS = {401: "http-401-unauthorized", 403: "http-403-forbidden", 429: "http-429-rate-limited", 502: "http-502-bad-gateway", 503: "http-503-service-unavailable", 504: "http-504-gateway-timeout"}


def confidence(length: Column, headings: Column, paragraphs: Column, signals: Column, blocked: Column) -> Column:
    lost = F.when(length < 100, 50).when(length < 500, 20).otherwise(0) + F.when(headings == 0, 10).otherwise(0) + F.when(paragraphs == 0, 15).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - lost - signals * 20 - F.when(blocked, 30).otherwise(0)).cast("bigint")


def confidence_sql(length: str, headings: str, paragraphs: str, signals: str, blocked: str) -> str:
    return (
        f"greatest(0, 100 - CASE WHEN {length} < 100 THEN 50 WHEN {length} < 500 THEN 20 ELSE 0 END - CASE WHEN {headings} = 0 THEN 10 ELSE 0 END"
        f" - CASE WHEN {paragraphs} = 0 THEN 15 ELSE 0 END - {signals} * 20 - CASE WHEN {blocked} THEN 30 ELSE 0 END)::BIGINT"
    )


def validation(content: Column, headings: Column, paragraphs: Column, links: Column) -> Column:
    """The validation struct of an extracted text."""
    low = F.lower(content)
    n = F.size(rx.words(content))
    lines = F.transform(F.split(content, "\n", -1), lambda l: F.octet_length(rx.trim(l)))
    short = F.size(F.filter(lines, lambda k: (k > 0) & (k < 30))) / F.size(lines)
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in SKELETON), F.lit(0)) / len(SKELETON)
    density = F.when(paragraphs > 0, links / paragraphs).otherwise(0.0)
    bot = low.rlike("|".join(BOT_WALL))
    pay = low.rlike("|".join(PAYWALL))
    heavy = (headings > 0) & (paragraphs > 0) & (headings / F.when(paragraphs > 0, paragraphs) > 0.8)
    heavy = F.coalesce(heavy, F.lit(False))
    first = 1.0 - F.when(n < 50, 0.3).otherwise(0.0) - F.when(density > 3.0, 0.2).otherwise(0.0) - F.when(hits > 0.2, 0.3).otherwise(0.0)
    conf = F.when(bot, 0.1).otherwise(first) - F.when(pay, 0.2).otherwise(0.0) - F.when(heavy, 0.15).otherwise(0.0) - F.when(short > 0.7, 0.2).otherwise(0.0)
    conf = F.greatest(F.lit(0.0), F.round(conf, 6))
    total = headings + paragraphs + links
    issues = rx.compact(
        F.when(n < 50, F.lit("minimal-content")), F.when(density > 3.0, F.lit("nav-heavy")), F.when(hits > 0.2, F.lit("skeleton-content")), F.when(bot, F.lit("bot-protection")),
        F.when(pay, F.lit("paywall-detected")), F.when(heavy, F.lit("heading-heavy")), F.when(short > 0.7, F.lit("menu-like")),
    )
    return F.struct(
        ((n >= 10) & ~bot & (conf >= 0.5)).alias("is_valid"), ((n < 10) | (density > 5.0) | (hits > 0.2) | bot).alias("needs_browser"), conf.alias("confidence"), issues.alias("issues"),
        F.round(density, 6).alias("link_density"), F.round(hits, 6).alias("skeleton_score"), F.round(F.when(total > 0, paragraphs / total).otherwise(0.0), 6).alias("content_ratio"),
    )


def validation_sql(table: str, key: str, content: str, headings: str, paragraphs: str, links: str) -> str:
    hits = " + ".join(f"contains(low, {rx.q(p)})::INT" for p in SKELETON)
    return f"""
WITH base AS (SELECT {key}, lower({content}) AS low, {headings}::DOUBLE AS h, {paragraphs}::DOUBLE AS p, {links}::DOUBLE AS l, len({rx.words_sql(content)}) AS n,
    list_transform(string_split({content}, chr(10)), lambda x: strlen({rx.trim_sql('x')})) AS sizes FROM {table}),
more AS (SELECT *, ({hits}) / {len(SKELETON)} AS hits, CASE WHEN p > 0 THEN l / p ELSE 0 END AS density, regexp_matches(low, {rx.q('|'.join(BOT_WALL))}) AS bot, regexp_matches(low, {rx.q('|'.join(PAYWALL))}) AS pay,
    coalesce(h > 0 AND p > 0 AND h / p > 0.8, false) AS heavy, len(list_filter(sizes, lambda k: k > 0 AND k < 30)) / len(sizes) AS short FROM base),
conf AS (SELECT *, greatest(0.0::DOUBLE, round(CASE WHEN bot THEN 0.1::DOUBLE ELSE 1.0::DOUBLE - CASE WHEN n < 50 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN density > 3 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN hits > 0.2 THEN 0.3::DOUBLE ELSE 0 END END
    - CASE WHEN pay THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN heavy THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN short > 0.7 THEN 0.2::DOUBLE ELSE 0 END, 6)) AS confidence FROM more)
SELECT {key}, n >= 10 AND NOT bot AND confidence >= 0.5 AS is_valid, n < 10 OR density > 5 OR hits > 0.2 OR bot AS needs_browser, confidence,
  {rx.list_sql("CASE WHEN n < 50 THEN 'minimal-content' END", "CASE WHEN density > 3 THEN 'nav-heavy' END", "CASE WHEN hits > 0.2 THEN 'skeleton-content' END", "CASE WHEN bot THEN 'bot-protection' END", "CASE WHEN pay THEN 'paywall-detected' END", "CASE WHEN heavy THEN 'heading-heavy' END", "CASE WHEN short > 0.7 THEN 'menu-like' END")} AS issues,
  round(density, 6) AS link_density, round(hits, 6) AS skeleton_score, round(CASE WHEN h + p + l > 0 THEN p / (h + p + l) ELSE 0 END, 6) AS content_ratio FROM conf
"""


def profile(conf: Column, length: Column, headings: Column, paragraphs: Column, signals: Column, is_spa: Column, blocked: Column) -> Column:
    """struct(class, outcome, reasons, confidence, trustworthy)."""
    root = F.array_contains(signals, "spa-root-element")
    hydrated = root & (((conf >= 50) & (length > 500)) | ((headings >= 1) & (paragraphs >= 2)))
    ssr = (headings >= 2) & (paragraphs >= 3) & (length > 1000)
    minimal = (conf >= 40) & (conf < 80) & (length >= 100) & (F.size(signals) == 1) & (F.coalesce(F.get(signals, 0), F.lit("")) == "minimal-body-content")

    def made(cls: str, outcome, reasons, trust) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
        why = F.array(*[F.lit(r) for r in reasons]) if isinstance(reasons, tuple) else reasons
        return F.struct(F.lit(cls).alias("class"), lit(outcome).alias("outcome"), why.alias("reasons"), conf.cast("bigint").alias("confidence"), lit(trust).alias("trustworthy"))

    spa_reasons = F.concat(F.transform(signals, lambda s: F.concat(F.lit("spa-signal:"), s)), rx.compact(F.when(conf < 30, F.lit("low-confidence-extraction"))))
    low_reasons = F.concat(F.array(F.lit("low-confidence"), F.lit("content-may-be-incomplete")), rx.compact(F.when(conf < 30, F.lit("very-low-extraction-quality"))))
    return (
        F.when(blocked, made("blocked", "needs-browser", ("bot-detection-triggered",), False))
        .when(is_spa, made("spa", "needs-browser", spa_reasons, False))
        .when((conf >= 80) & hydrated, made("hydrated", "extract", ("high-confidence", "hydration-markers-present"), True))
        .when((conf >= 80) & ssr, made("ssr", "extract", ("high-confidence", "ssr-markers-present"), True))
        .when(conf >= 80, made("static", "extract", ("high-confidence", "plain-html"), True))
        .when(minimal, made("static", "extract", ("minimal-content", "clean-extraction", "no-spa-signals"), True))
        .when((conf >= 50) & hydrated, made("hydrated", "extract", ("medium-confidence", "hydration-markers"), conf >= 60))
        .when(conf >= 50, made("dynamic", "extract-with-warning", ("medium-confidence", "possible-personalization"), conf >= 60))
        .otherwise(made("dynamic", F.when(conf < 30, "fail-fast").otherwise("extract-with-warning"), low_reasons, False))
    )


PROFILE_SQL = """
CASE WHEN blocked THEN {'class': 'blocked', 'outcome': 'needs-browser', 'reasons': ['bot-detection-triggered'], 'trustworthy': false}
WHEN is_spa THEN {'class': 'spa', 'outcome': 'needs-browser', 'reasons': list_concat(list_transform(signals, lambda s: 'spa-signal:' || s), CASE WHEN conf < 30 THEN ['low-confidence-extraction'] ELSE [] END), 'trustworthy': false}
WHEN conf >= 80 AND hydrated THEN {'class': 'hydrated', 'outcome': 'extract', 'reasons': ['high-confidence', 'hydration-markers-present'], 'trustworthy': true}
WHEN conf >= 80 AND ssr THEN {'class': 'ssr', 'outcome': 'extract', 'reasons': ['high-confidence', 'ssr-markers-present'], 'trustworthy': true}
WHEN conf >= 80 THEN {'class': 'static', 'outcome': 'extract', 'reasons': ['high-confidence', 'plain-html'], 'trustworthy': true}
WHEN conf >= 40 AND conf < 80 AND length >= 100 AND signals = ['minimal-body-content'] THEN {'class': 'static', 'outcome': 'extract', 'reasons': ['minimal-content', 'clean-extraction', 'no-spa-signals'], 'trustworthy': true}
WHEN conf >= 50 AND hydrated THEN {'class': 'hydrated', 'outcome': 'extract', 'reasons': ['medium-confidence', 'hydration-markers'], 'trustworthy': conf >= 60}
WHEN conf >= 50 THEN {'class': 'dynamic', 'outcome': 'extract-with-warning', 'reasons': ['medium-confidence', 'possible-personalization'], 'trustworthy': conf >= 60}
ELSE {'class': 'dynamic', 'outcome': CASE WHEN conf < 30 THEN 'fail-fast' ELSE 'extract-with-warning' END, 'reasons': list_concat(['low-confidence', 'content-may-be-incomplete'], CASE WHEN conf < 30 THEN ['very-low-extraction-quality'] ELSE [] END), 'trustworthy': false} END
"""


def display(profile_col: Column) -> Column:
    return F.concat_ws(" ", profile_col["class"], F.when(profile_col["trustworthy"], "✓").otherwise("⚠"), F.lit("→"), profile_col["outcome"])


def status_reason(status: Column) -> Column:
    """Reason of a blocking status; null for the others."""
    out = F.lit(None).cast("string")
    for code, why in STATUS_REASONS.items():
        out = F.when(status == code, F.lit(why)).otherwise(out)
    return out
