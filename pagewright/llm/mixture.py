"""Mixing sources to target shares of tokens by min-cost flow over membership patterns.

A mail archived by several sources belongs to all of them.  Mails are
aggregated by their set of sources; a flow sends the tokens of each set to its
sources' quotas, where the k-th use of the same tokens costs k - 1, so that
repetition is spread as thinly as possible.  A mail that one source holds
several times is as many records there.  Unless a total is given it is the
largest for which every source with mails can be given its share within its
repetitions; beyond it the shares would drift apart.  Each set's mails are
then laid on a seeded circle and every source takes its flow as an arc of it,
so that the uses of any two records of a set differ by one at most and what a
source gets differs from its quota by about half a mail.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import checkpoint

#: Where the public tokenizer's ranks lie; parameter of every function below.
TOKENIZER = os.environ.get("PAGEWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Mails of a set and bucket are ordered in one task: about this many.
BUCKET_ROWS = 20_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (trimmed, lower-cased), mail (128-bit key of the text), tokens.  Null texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            sizes = [len(enc.encode_ordinary(t)) for t in texts]
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "source", "mail", "tokens"])

    source = F.lower(F.trim("source"))
    return documents.select("doc_id", F.when(F.length(source) > 0, source).alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, mail binary, tokens bigint")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost) of a cheapest maximal flow; successive shortest paths with potentials."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        far = [float("inf")] * n
        via = [-1] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e]:
                    nd = d + cost[e] + potential[u] - potential[to[e]]
                    if nd < far[to[e]]:
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if far[sink] == float("inf"):
            break
        for v in range(n):
            if far[v] < float("inf"):
                potential[v] += far[v]
        push, v = None, sink
        while v != source:
            e = via[v]
            push = cap[e] if push is None else min(push, cap[e])
            v = to[e ^ 1]
        v = sink
        while v != source:
            e = via[v]
            cap[e] -= push
            cap[e ^ 1] += push
            v = to[e ^ 1]
    return [cap[2 * i + 1] for i in range(len(arcs))]


def route(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[int, str], int]:
    """Tokens that each source takes from each set of mails.

    patterns: (sources, tokens of the set's records once); targets: source ->
    (share, most uses).  A source takes at most share * total.  Sets without a
    target source give nothing.
    """
    names = sorted(targets)
    n = 2 + len(patterns) + len(names)
    arcs: list[tuple[int, int, int, int]] = []
    flows: list[tuple[int, str] | None] = []
    for p, (members, tokens) in enumerate(patterns):
        mine = [s for s in members if s in targets]
        for k in range(sum(targets[s][1] for s in mine)):  # the k-th further use costs k
            arcs.append((0, 2 + p, tokens, k))
            flows.append(None)
        for s in mine:
            arcs.append((2 + p, 2 + len(patterns) + names.index(s), tokens * targets[s][1], 0))
            flows.append((p, s))
    for i, s in enumerate(names):
        arcs.append((2 + len(patterns) + i, 1, round(targets[s][0] * total), 0))
        flows.append(None)
    got = min_cost_flow(n, arcs, 0, 1)
    return {key: f for key, f in zip(flows, got) if key and f}


def best_total(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total at which every source that has mails can reach its share.

    A source takes what it needs from its own sets, each at most its uses
    times over, and no other source takes that away; so the source with the
    fewest tokens for its share decides.
    """
    room: dict[str, int] = {}
    for members, tokens in patterns:
        for s in members:
            if s in targets:
                room[s] = room.get(s, 0) + tokens * targets[s][1]
    return min((int(r / targets[s][0]) for s, r in room.items() if r and targets[s][0] > 0), default=0)


def plan_mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER):
    """(records, sets, flows, total): the mails with their sets of sources, and the tokens each source takes from each set.

    records: mail, doc_id, members, copies, tokens (of one copy).  The n-th
    copies of a mail in its sources belong together.  What reaches the driver
    is one row per set of sources that occurs; a source without mails takes no
    part and the others' shares are of what they have together.
    """
    docs = checkpoint(token_sizes(documents, tokenizer))
    wanted = {r.source.strip().lower(): (r.target_share, max(1, r.max_repeats or 1)) for r in targets.filter(F.col("source").isNotNull() & F.col("target_share").isNotNull()).collect()}
    known = docs.filter(F.col("source").isin(sorted(wanted)) & (F.col("tokens") > 0))
    held = known.groupBy("mail", "source").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("tokens"))
    mails = held.groupBy("mail").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"))
    # Copies 1..n_1 are in all sources, n_1+1..n_2 in those that hold more, and so on.
    steps = F.array_sort(F.array_distinct("held.n"))
    level = F.explode(F.transform(steps, lambda n, i: F.struct((n - F.when(i > 0, F.get(steps, i - 1)).otherwise(0)).alias("copies"), F.transform(F.filter("held", lambda h: h["n"] >= n), lambda h: h["source"]).alias("members"))))
    records = checkpoint(mails.select("mail", "doc_id", "tokens", level.alias("level")).select("mail", "doc_id", "tokens", "level.copies", "level.members"))
    sets = [(tuple(r.members), r.t) for r in records.groupBy("members").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()]
    sets.sort()
    total = total_tokens if total_tokens is not None else best_total(sets, wanted)
    return records, sets, route(sets, wanted, total), total


def select_mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, copies, uses, tokens: the mixture; a mail counts ``uses`` times for the source.

    A mail in several archives of a set, or several times in one, stands for
    all its copies (smallest doc_id); uses / copies is at most max_repeats.
    Every target source with mails and a share is used at least once.
    Mails of unknown or null source and empty ones take no part.  An empty
    table or no targets give no rows.
    """
    records, sets, flows, _ = plan_mixture(documents, targets, total_tokens, tokenizer)
    spark = documents.sparkSession
    arcs = []
    start: dict[int, int] = {}
    for (p, s), f in sorted(flows.items()):
        a = start.get(p, 0)
        arcs.append((list(sets[p][0]), s, a, a + f, sets[p][1]))
        start[p] = a + f
    arc = spark.createDataFrame(arcs, "members array<string>, source string, a bigint, b bigint, circle bigint")  # a row per set and source
    placed = _on_circle(records, seed).join(arc, "members")

    def until(x: str) -> Column:
        """Uses on the circle up to place x: a copy counts once its middle is passed."""
        turn = F.expr(f"floor({x} / circle)")
        rest = F.ceil((F.expr(f"{x} % circle") - F.col("at")) / F.col("tokens") - 0.5)
        return turn * F.col("copies") + F.greatest(F.lit(0), F.least(rest, F.col("copies")))

    columns = ("doc_id", "source", "copies", "uses", "tokens")
    chosen = checkpoint(placed.withColumn("uses", (until("b") - until("a")).cast("bigint")).filter("uses > 0").select(*columns))
    # A source whose quota is less than half of the mail it met takes its shortest one.
    left = arc.select("members", "source").join(chosen.select("source").distinct(), "source", "left_anti")
    short = records.join(left, "members").groupBy("source").agg(F.min_by(F.struct("doc_id", "copies", "tokens"), F.struct("tokens", "doc_id")).alias("r"))
    return chosen.unionByName(short.select("r.doc_id", "source", "r.copies", F.lit(1).cast("bigint").alias("uses"), "r.tokens"))


def _on_circle(records: DataFrame, seed: int) -> DataFrame:
    """Adds ``at``: the tokens before each mail's copies in the seeded order of its set.

    The order is by a hash; buckets of the hash keep every task's share of a
    set small, and the buckets' totals are summed in a small table.
    """
    buckets = max(1, records.count() // BUCKET_ROWS)
    weight = F.col("tokens") * F.col("copies")
    placed = records.withColumn("h", F.xxhash64("mail", F.lit(seed))).withColumn("bucket", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    sums = placed.groupBy("members", "bucket").agg(F.sum(weight).alias("t"))
    before = F.sum("t").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("members", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum(weight).over(Window.partitionBy("members", "bucket").orderBy("h", "mail", "copies").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, ["members", "bucket"])
    return placed.select("doc_id", "members", "copies", "tokens", (F.col("base") + F.col("inside")).alias("at"))


def mixture_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """source, target_share, max_repeats, actual_share, deviation, tokens, mails, most_uses of every target source.

    most_uses: the most times that any record is used.
    """
    chosen = select_mixture(documents, targets, total_tokens, seed, tokenizer)
    per = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("mails"), F.max(F.ceil(F.col("uses") / F.col("copies"))).alias("most_uses"))
    want = targets.filter(F.col("source").isNotNull() & F.col("target_share").isNotNull()).select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    out = want.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = Window.partitionBy(F.lit(1))  # one row per target source
    actual = F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1)), 6)
    return out.select(
        "source", "target_share", "max_repeats", actual.alias("actual_share"), F.round(actual - F.col("target_share"), 6).alias("deviation"),
        "tokens", F.coalesce("mails", F.lit(0)).alias("mails"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
