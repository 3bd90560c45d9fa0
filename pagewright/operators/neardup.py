"""Near-duplicate texts of a whole corpus: copies collapsed, pairs by five-word shingles, classes.

An id has one text, however often it is delivered.  Equal normalised texts are
one copy, represented by the smallest id.  The
representatives' shingle sets are compared by prefix filtering: with any total
order of the shingles, two sets of Jaccard similarity 0.8 share one of their
first n - ceil(0.8 n) + 1, so no pair is missed.  The order puts shingles that
are frequent in a sample last, so that what many pages share makes few pairs.
Whole sets are read and moved only for pairs that neither the places of the
shared prefixes nor 1,024 parities of the shingles rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.blocks import normal_block
from pagewright.session import bounded_broadcast, checkpoint, checkpoint_round

SHINGLE = 5
#: One of so many texts is sampled for the order, of which so many shingles are known to be frequent.
SAMPLE, FREQUENT = 16, 100_000
#: Buckets of the parities that are compared before whole sets are.
BITS = 1024


def word_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, w of every text.  Null ids and texts without a word have no row."""
    # Exploding a single value keeps the planner from working it out again at each use.
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(normal_block(F.col(text_col)))).alias("norm"))
    rows = rows.select("id", F.sha2("norm", 256).alias("text_key"), F.explode(F.array(F.regexp_extract_all("norm", F.lit(r"[\p{L}\p{Nd}]+"), 0))).alias("words")).filter("size(words) > 0")
    return rows.select("id", "text_key", F.transform("words", lambda w: F.xxhash64(w)).alias("w"))


def shingles(w: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, from those of its words; one of fewer words is one shingle."""
    w = w.view(np.uint64)
    n = max(len(w) - SHINGLE + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def parities(h: np.ndarray) -> np.ndarray:
    """One bit for each of BITS buckets: whether an odd number of the hashes fall into it."""
    return np.packbits(np.bincount(h & (BITS - 1), minlength=BITS) & 1).view(np.int64)


def _hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each row of w."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (shingles(flat[i:k]) for i, k in zip(at[:-1], at[1:]))


def shingle_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, s of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_hashes(b.column(1))), pa.list_(pa.int64()))], names=["id", "s"])

    return word_hashes(df, id_col, text_col).select("id", "w").mapInArrow(run, "id bigint, s array<bigint>")


def frequent_shingles(df: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts: as many whole counts, from the highest down, as FREQUENT allows.

    The cut is found on how many shingles have each count, so that no task
    sends more than its share of the result.
    """
    counted = checkpoint(shingle_sets(df, id_col, text_col).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("times")).filter("times > 1"))
    least, total = None, 0
    for r in counted.groupBy("times").agg(F.count("*").alias("rows")).orderBy(F.desc("times")).collect():
        total += r.rows
        if total > FREQUENT:
            break
        least = r.times
    top = counted.filter(F.col("times") >= F.lit(least)).toArrow().sort_by("h")
    return top["h"].to_numpy(), top["times"].to_numpy()


def prefixes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n, prefix, bits of every text; any order of the shingles is complete, a good one is quick."""
    frequent, counts = frequent_shingles(df.filter(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, firsts, bits = [], [], []
            for h in _hashes(b.column(2)):
                rank = np.zeros(len(h), np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    rank = np.where(frequent[place] == h, counts[place], 0)
                sizes.append(len(h))
                firsts.append(h[np.lexsort((h, rank))][: len(h) - (4 * len(h) + 4) // 5 + 1])
                bits.append(parities(h))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(firsts, lists), pa.array(bits, lists)], names=["id", "text_key", "n", "prefix", "bits"])

    return checkpoint(word_hashes(df, id_col, text_col).mapInArrow(run, "id bigint, text_key string, n int, prefix array<bigint>, bits array<bigint>"))


def candidate_pairs(one: DataFrame) -> DataFrame:
    """a, b: pairs of the texts that may be similar; none that is similar is left out.

    Up to the last shingle that two prefixes share, all that both texts share
    is known; no more can follow than either has left.  Shingles of one text
    only leave an odd count, so the buckets whose parities differ are no more
    than the shingles that the texts do not share.
    """
    keys = one.select("id", "n", F.posexplode("prefix").alias("at", "h"))
    left, right = (keys.select("h", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4)
    met = left.join(right, "h").filter(near).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    # Similar: 5 shared >= 4 (na + nb - shared), that is 9 shared >= 4 (na + nb).
    met = met.filter("9 * (met + least(na - ata, nb - atb) - 1) >= 4 * (na + nb)")
    of = lambda side: one.select(F.col("id").alias(side), F.col("bits").alias(f"bits{side}"))
    both = met.select("a", "b", "na", "nb").join(of("a"), "a").join(of("b"), "b")
    unlike = F.expr("aggregate(zip_with(bitsa, bitsb, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    return both.filter(9 * unlike <= F.col("na") + F.col("nb")).select("a", "b")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, made: DataFrame) -> DataFrame:
    """a, b, shared, total of the representatives whose shared shingles are at least 0.8 of all of both; a < b.

    Only texts with a candidate are read again for their whole sets.
    """
    one = made.groupBy("text_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    pairs = checkpoint(candidate_pairs(one))
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct())
    texts = df.select(id_col, text_col).join(bounded_broadcast(ids, ids.count(), 64), id_col, "left_semi")
    sets = shingle_sets(texts, id_col, text_col).dropDuplicates(["id"])
    of = lambda side: sets.select(F.col("id").alias(side), F.col("s").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    both = both.withColumn("total", F.size("sa") + F.size("sb") - F.col("shared"))
    return both.filter("5 * shared >= 4 * total").select("a", "b", "shared", "total")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """a, b, shared, total: all near-duplicate pairs of representatives, whatever page they are of."""
    return similar_pairs(df, id_col, text_col, prefixes(df, id_col, text_col))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, copy_of, class_id: each text's representative, and the smallest id that a chain of pairs leads to."""
    made = prefixes(df, id_col, text_col)
    pairs = checkpoint_round(similar_pairs(df, id_col, text_col, made).select("a", "b"))
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpoint_round(edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    while True:
        heard = edges.join(labels, edges["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        lower = heard.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
        jumped = lower.join(labels.select(F.col("id").alias("label"), F.col("label").alias("further")), "label")
        grown = checkpoint_round(jumped.select("id", F.least("label", "further").alias("label")))
        changed = not grown.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").isEmpty()
        labels = grown
        if not changed:
            break
    members = made.select("id", "text_key").distinct()
    first = members.groupBy("text_key").agg(F.min("id").alias("copy_of"))
    out = members.join(first, "text_key").join(labels.withColumnsRenamed({"id": "copy_of"}), "copy_of", "left")
    return out.select("id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))
