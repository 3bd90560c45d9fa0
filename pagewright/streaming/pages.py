"""Structured Streaming forms: change detection with state, deduplication in a watermark, cached crawl rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.functions import fingerprint
from pagewright.operators import fetching


def changes(pages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """url, fetched_at, fingerprint, state (new, same, changed) of a stream of url, fetched_at, content.

    The fingerprint is made natively before the shuffle, so only hashes move;
    the state of a URL is its last fingerprint, forgotten after ttl_ms without
    a version.  Versions of one batch are taken in the order of fetched_at.
    Null URLs and contents are left out.
    """
    prints = pages.filter(F.col("url").isNotNull() & F.col("content").isNotNull()).select("url", "fetched_at", fingerprint.fingerprint(F.col("content")).alias("fingerprint"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["fetched_at", "fingerprint"], kind="stable")  # one URL's versions of one batch
        last = state.get[0] if state.exists else None
        out = []
        for fp in rows["fingerprint"]:
            out.append("new" if last is None else "same" if fp == last else "changed")
            last = fp
        state.update((last,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"url": key[0], "fetched_at": rows["fetched_at"], "fingerprint": rows["fingerprint"], "state": out})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return prints.groupBy("url").applyInPandasWithState(step, "url string, fetched_at timestamp, fingerprint string, state string", "fingerprint string", "append", timeout)


def without_repeats(rows: DataFrame, keys: list[str], time_col: str, lateness: str) -> DataFrame:
    """The first row of each key within the watermark; state is dropped once the watermark has passed."""
    return rows.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and sums by time window and event type; rows later than the watermark are dropped."""
    got = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def cached_rules(answers: DataFrame, ok_ms: int = fetching.OK_HOURS * 3_600_000, failed_ms: int = fetching.FAILED_HOURS * 3_600_000) -> DataFrame:
    """domain, asked_at, delay_s, hit of a stream of domain, asked_at, ok, delay_s.

    A question finds the cached rule if it has not run out; otherwise its own
    answer is cached, for less time if it failed (delay 0).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("asked_at", kind="stable")
        delay, until = state.get if state.exists else (None, None)
        out = []
        for at, ok, own in zip(rows["asked_at"].astype("int64") // 1_000_000 if str(rows["asked_at"].dtype).endswith("ns]") else rows["asked_at"].astype("int64") // 1000, rows["ok"], rows["delay_s"]):
            hit = until is not None and at < until
            if not hit:
                delay, until = (float(own) if ok else 0.0), int(at) + (ok_ms if ok else failed_ms)
            out.append((delay, hit))
        state.update((delay, until))
        yield pd.DataFrame({"domain": key[0], "asked_at": rows["asked_at"], "delay_s": [d for d, _ in out], "hit": [h for _, h in out]})

    return answers.groupBy("domain").applyInPandasWithState(step, "domain string, asked_at timestamp, delay_s double, hit boolean", "delay_s double, until_ms bigint", "append", GroupStateTimeout.NoTimeout)
