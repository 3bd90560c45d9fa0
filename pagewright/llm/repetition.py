"""Repetition inside a document: hashed n-gram likelihood ratio, then the exact repeated share.

Every run of four words is an n-gram, hashed into one of CELLS buckets; each
bucket has two outcomes, begun anew and begun before in the same record.  Over
all records these outcomes form the raw multinomial, over the trusted ones the
target.  The fetcher's notes miss half of the repetitive records, so a record
is trusted if it was noted as clean and nearly all its runs begin anew.  A
record's score is the mean log-likelihood ratio of
its runs, so it is normalised by length.  Single buckets may lower a score
without bound; what they may add is clipped, so that a cut follows from the
wanted share alone that no record with this share can exceed.  Every record is
scored and held against the cut; only those not above it are read exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 4
#: Buckets of n-grams; each has the outcomes new and again.
CELLS = 1 << 16
MIN_WORDS = 8
#: How much more than all new runs together a single bucket's new runs may speak for a record.
SLACK = 0.02
#: Most runs of a trusted record that began before.
TRUSTED_AGAIN = 0.02
#: Words of a reader's memory are forgotten between batches beyond this.
KNOWN_WORDS = 500_000
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, each run of digits as 0."""
    return _WORD.findall(_DIGITS.sub("0", text.lower()))


def exact_share(words: list[str]) -> tuple[int, int]:
    """Words and repeated words: those in a run of four that already began earlier."""
    n = len(words)
    if n < RUN:
        return n, 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) < 1 << 15:  # four ids fit one number exactly
        gram = (a[:-3] << 45) | (a[1:-2] << 30) | (a[2:-1] << 15) | a[3:]
    else:
        gram = np.unique(np.stack([a[:-3], a[1:-2], a[2:-1], a[3:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(gram, kind="stable")
    again = order[1:][gram[order][1:] == gram[order][:-1]]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + RUN, -1)
    return n, int((np.cumsum(mark)[:n] > 0).sum())


class Hashes:
    """Word hashes that a reader has met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def outcomes(words: list[str], hashes: Hashes) -> np.ndarray:
    """The outcome of each run of four: its bucket if it begins anew, CELLS + its bucket if it began before."""
    if len(words) < RUN:
        return np.zeros(0, np.int64)
    h = hashes.of(words)
    with np.errstate(over="ignore"):
        gram = ((h[:-3] * _MULT + h[1:-2]) * _MULT + h[2:-1]) * _MULT + h[3:]
        bucket = ((gram * _MULT) >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    again = order[1:][gram[order][1:] == gram[order][:-1]]
    bucket[again] += CELLS
    return bucket


def _noted_clean() -> Column:
    """Records whose fetcher noted no duplicates and no failure; nulls there count as not trusted."""
    return F.coalesce((F.col("dedupe.duplicatesFound") == 0) & F.col("validation.isValid"), F.lit(False))


def outcome_counts(extractions: DataFrame) -> DataFrame:
    """cell, trusted, raw: runs with each outcome in trusted and in all delivered rows; at most 2 * CELLS rows.

    Each task sums its own rows first.
    """
    src = extractions.select("content", _noted_clean().alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 * CELLS), np.int64)
        hashes = Hashes()
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    cells = outcomes(words_of(text), hashes)
                    np.add.at(sums[1], cells, 1)
                    if good and len(cells) and (cells >= CELLS).mean() <= TRUSTED_AGAIN:
                        np.add.at(sums[0], cells, 1)
        met = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[0][met]), pa.array(sums[1][met])], names=["cell", "trusted", "raw"])

    return src.mapInArrow(run, "cell bigint, trusted bigint, raw bigint").groupBy("cell").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


@dataclass
class Ratios:
    """Log-likelihood ratio of every outcome, and the most that one of either kind may give."""

    llr: np.ndarray
    most_new: float
    most_again: float

    def cut(self, share: float) -> float:
        """A score that no record with at least this repeated share exceeds.

        A repeated word needs a run that began before, and a run covers four
        words, so at least share / 4 of the runs are repeats.  If new runs are
        not likelier in trusted records, no cut is safe: infinity.
        """
        if self.most_new <= self.most_again:
            return math.inf
        return self.most_new * (1 - share / RUN) + self.most_again * share / RUN + 1e-9


def fit_ratios(trusted: np.ndarray, raw: np.ndarray, slack: float = SLACK) -> Ratios:
    """Counts by outcome -> ratios.  A bucket is smoothed by one run in the proportion of its kind."""
    t, r = trusted.astype(float), raw.astype(float)
    kinds = np.repeat([0, 1], CELLS)
    kt, kr = np.bincount(kinds, t) + 1.0, np.bincount(kinds, r) + 1.0
    pooled = np.log(kt / kt.sum()) - np.log(kr / kr.sum())
    llr = np.log((t + kt[kinds] / kr[kinds]) / (r + 1.0)) - math.log(kt.sum() / kr.sum())
    most = pooled + np.array([slack, 0.0])
    return Ratios(np.minimum(llr, most[kinds]), float(most[0]), float(most[1]))


def ratios_of(extractions: DataFrame) -> Ratios:
    """Fits on all rows; what comes to the driver is bounded by CELLS."""
    t, r = np.zeros(2 * CELLS, np.int64), np.zeros(2 * CELLS, np.int64)
    for row in outcome_counts(extractions).collect():
        t[row.cell], r[row.cell] = row.trusted, row.raw
    return fit_ratios(t, r)


def score_repetition(extractions: DataFrame, share: float = 0.3, exact_for_all: bool = False) -> DataFrame:
    """One row per record: words, repeated, repeated_share, score (higher: more like trusted records), below_cut.

    repeated and repeated_share are read where the score is not above the cut
    and null elsewhere, unless ``exact_for_all``.  Records under eight words
    have share 0 and are never below the cut; null contents count as empty.
    A null result_id is one record; repeated deliveries count once.
    """
    ratios = ratios_of(extractions)
    cut = ratios.cut(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text) if text else []
                cells = outcomes(words, hashes)
                score = float(ratios.llr[cells].mean()) if len(cells) else ratios.most_new
                below = len(words) >= MIN_WORDS and score <= cut
                rows.append((len(words), exact_share(words)[1] if below or exact_for_all else None, score, below))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["result_id", "words", "repeated", "score", "below_cut"])

    scored = extractions.select("result_id", "content").mapInArrow(run, "result_id bigint, words bigint, repeated bigint, score double, below_cut boolean").dropDuplicates(["result_id"])
    part = F.when(F.col("words") >= MIN_WORDS, F.col("repeated") / F.col("words")).otherwise(0.0)
    return scored.select("result_id", "words", "repeated", part.alias("repeated_share"), "score", "below_cut")


def repetitive_records(extractions: DataFrame, share: float = 0.3) -> DataFrame:
    """result_id of the records whose repeated share is at least ``share``: the cut first, then the exact share."""
    return score_repetition(extractions, share).filter(F.col("below_cut") & (F.col("repeated") >= share * F.col("words"))).select("result_id")


def pruning(extractions: DataFrame, share: float = 0.3) -> DataFrame:
    """One row: records, read (not above the cut), found (with the share), read_share and lost (with the share, but above the cut: 0)."""
    s = score_repetition(extractions, share, exact_for_all=True)
    has = (F.col("words") >= MIN_WORDS) & (F.col("repeated") >= share * F.col("words"))
    return s.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("below_cut").alias("read"), F.count_if(has).alias("found"),
        F.round(F.count_if("below_cut") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("read_share"), F.count_if(has & ~F.col("below_cut")).alias("lost"),
    )
