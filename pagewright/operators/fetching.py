"""Crawl delays, cached rules and retries over tables of robots texts and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import detect, headers, rx

OK_HOURS, FAILED_HOURS = 24, 1


def crawl_delays(robots: DataFrame, user_agent: str, own_name: str = "pagewright") -> DataFrame:
    """domain, delay_s: the last readable delay of the agent's own section if above zero, else that of *.

    robots: domain, body (the first 64 KiB count).  Lines of a section apply
    to the agent line last seen; an agent matches if the user agent contains
    it or it contains our own name.  Null bodies give no row.
    """
    body = F.decode(F.substring(F.encode("body", "UTF-8"), 1, 65536), "UTF-8")
    lines = robots.filter(F.col("body").isNotNull()).select("domain", F.posexplode(F.transform(F.split(body, "\n", -1), rx.trim)).alias("pos", "line"))
    low = F.lower("line")
    agent = F.when(low.startswith("user-agent:"), F.lower(rx.trim(F.substring("line", 12, 1_000_000))))
    lines = lines.filter(~F.col("line").startswith("#")).withColumn("agent", agent)
    current = F.last("agent", ignorenulls=True).over(Window.partitionBy("domain").orderBy("pos"))
    lines = lines.withColumns({"current": current, "delay": F.when(low.startswith("crawl-delay:"), headers.duration_seconds(rx.trim(F.substring("line", 13, 1_000_000))))})
    ours = F.contains(F.lit(user_agent.lower()), F.col("current")) | F.contains(F.col("current"), F.lit(own_name))
    lines = lines.withColumn("kind", F.when(F.col("current") == "*", "any").when(ours, "own"))
    per = lines.groupBy("domain").agg(
        F.max_by("delay", F.when((F.col("kind") == "own") & F.col("delay").isNotNull(), F.col("pos"))).alias("own"),
        F.max_by("delay", F.when((F.col("kind") == "any") & F.col("delay").isNotNull(), F.col("pos"))).alias("any"),
    )
    return per.select("domain", F.when(F.col("own") > 0, F.col("own")).otherwise(F.coalesce("any", F.lit(0.0))).alias("delay_s"))


def fresh_rules(snapshots: DataFrame, now: Column) -> DataFrame:
    """Of each domain the latest snapshot (domain, fetched_at, ok, ...) that has not run out: 24 hours, 1 hour after a failure."""
    hours = F.when(F.col("ok"), OK_HOURS).otherwise(FAILED_HOURS)
    alive = snapshots.filter((F.col("fetched_at") <= now) & (F.unix_micros("fetched_at") + hours * 3_600_000_000 > F.unix_micros(now)))
    nth = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("fetched_at").desc()))
    return alive.withColumn("nth", nth).filter("nth = 1").drop("nth")


def preflight_error(status: Column, content_type: Column) -> Column:
    """Why a page is not fetched after its HEAD answer; null: it is (other answers, 405 and none at all say nothing)."""
    gone = F.when(status.isin(404, 410), F.concat(F.lit("HEAD preflight returned "), status.cast("string")))
    return F.when((status == 200) & detect.is_binary(content_type), F.concat(F.lit("skipped binary content: "), content_type)).otherwise(gone)


def backoff_seconds(attempt: Column, most: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), most)


def jittered(seconds: Column, seed: int) -> Column:
    """Plus or minus a quarter, at least a millisecond."""
    return F.when(seconds <= 0, seconds).otherwise(F.greatest(F.lit(0.001), seconds * (0.75 + F.rand(seed) * 0.5)))


def retry_log(attempts: DataFrame, max_retries: int, max_wait_s: float, budget_s: float) -> DataFrame:
    """attempts: req_id, attempt, status, error, retry_after_s -> req_id, attempt, wait_s, event.

    Errors and 502/504 wait 2^attempt seconds at most max_wait_s; 429 waits
    what it says if that is not above max_wait_s.  events: success, retrying,
    exhausted (no retry left or none allowed), timeout (the waits exceed the
    budget).  Attempts after the first final event are left out.
    """
    c = F.col
    bad = c("error").isNotNull() | c("status").isin(502, 504)
    wait = F.when(bad, backoff_seconds(c("attempt"), F.lit(max_wait_s))).when((c("status") == 429) & (c("retry_after_s") <= max_wait_s), c("retry_after_s"))
    rows = attempts.withColumn("wait_s", wait)
    before = Window.partitionBy("req_id").orderBy("attempt")
    rows = rows.withColumn("waited", F.sum(F.coalesce("wait_s", F.lit(0.0))).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    failed = bad | (c("status") == 429)
    event = F.when(~failed, "success").when(c("wait_s").isNull() | (c("attempt") >= max_retries), "exhausted").when(c("waited") > budget_s, "timeout").otherwise("retrying")
    rows = rows.withColumn("event", event)
    ended = F.sum(F.when(c("event") != "retrying", 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", F.coalesce(ended, F.lit(0))).filter("ended = 0")
    return rows.select("req_id", "attempt", F.when(c("event") == "retrying", c("wait_s")).alias("wait_s"), "event")
