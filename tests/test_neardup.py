"""Near-duplicates on different pages, against comparing all pairs."""

import random

from pagewright.operators import neardup


def brute(texts):
    rep = {}
    for i, t in sorted(texts):
        rep.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} for t, i in rep.items() if t}
    pairs = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    label = {i: i for i in sets}
    for _ in label:
        for a, b, _, _ in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return pairs, {(i, rep[t], label[rep[t]]) for i, t in texts if t}


def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = []
    for k in range(12):
        words = [f"w{rng.randint(0, 60)}x" for _ in range(rng.randint(3, 90))]
        for v in range(6):
            texts.append((100 * v + k, " ".join(words)))
            words[rng.randrange(len(words))] = f"new{v}x"
    texts += [(900, texts[0][1]), (901, ""), (902, "one"), (903, "one")]
    pairs, classes = brute(texts)
    df = spark.createDataFrame(texts + [(904, None), (None, "one")] + texts[:5], "result_id bigint, content string")
    got = sorted((r.a, r.b, r.shared, r.total) for r in neardup.near_duplicate_pairs(df, "result_id", "content").collect())
    assert got == sorted(pairs) and len(pairs) > 10
    assert sorted((r.id, r.copy_of, r.class_id) for r in neardup.near_duplicate_classes(df, "result_id", "content").collect()) == sorted(classes)
    assert neardup.near_duplicate_classes(df.limit(0), "result_id", "content").count() == 0


def test_keyed_join_of_either_kind(spark):
    """A hot key, keys on one side only and null keys give the same rows broadcast and salted."""
    from pagewright.session import keyed_join

    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i % 2 else None) for i in range(200)], "result_id bigint, k string")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for how in ("inner", "left"):
        a, b = (sorted(map(str, keyed_join(large, small, "k", size, how).select("result_id", "k", "v").collect())) for size in (1, 1 << 40))
        assert a == b and len(a) == (200 if how == "left" else 134)


def estimate(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_rounds_of_components_leave_no_growing_estimate(spark):
    """A shuffled chain takes many rounds; the planner's estimate of the result stays a small number."""
    from pagewright.llm import residue

    chain = random.Random(5).sample(range(24), 24)
    nodes = spark.createDataFrame([(x,) for x in chain], "signature bigint")
    found = residue.components(nodes, spark.createDataFrame(list(zip(chain, chain[1:])), "a bigint, b bigint"))
    assert estimate(found).bit_length() < 1000
    assert sorted(map(tuple, found.collect())) == [(x, 0) for x in range(24)]


def test_classes_of_a_chain_leave_no_growing_estimate(spark):
    """Each text is near its neighbours in the chain only; ids in any order make many rounds."""
    ids = random.Random(5).sample(range(24), 24)
    df = spark.createDataFrame([(x, " ".join(f"w{k}x" for k in range(4 * i, 4 * i + 60))) for i, x in enumerate(ids)], "result_id bigint, content string")
    found = neardup.near_duplicate_classes(df, "result_id", "content")
    assert estimate(found).bit_length() < 2000
    assert sorted(map(tuple, found.collect())) == [(x, x, 0) for x in range(24)]


def test_texts_that_share_a_rare_beginning_are_no_candidates(spark):
    """Half a text in common meets in the prefixes; whole sets are compared only of what may reach 0.8."""
    shared = [f"s{k}x" for k in range(60)]
    texts = [(i, " ".join(shared + [f"w{i}y{k}x" for k in range(60)])) for i in range(12)]
    texts.append((12, texts[0][1] + " more"))
    df = spark.createDataFrame(texts, "result_id bigint, content string")
    made = neardup.prefixes(df, "result_id", "content").withColumnRenamed("text_key", "k")
    assert [tuple(r) for r in neardup.candidate_pairs(made).collect()] == [(0, 12)]
    assert [tuple(r) for r in neardup.near_duplicate_pairs(df, "result_id", "content").collect()] == [(0, 12, 116, 117)]


def test_frequent_shingles_are_whole_counts(spark, monkeypatch):
    """Five texts have one shingle each, of counts 4, 3, 2, 2 and 1; counts that would pass the bound stay out."""
    texts = ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + ["d"] * 2 + ["e"]
    df = spark.createDataFrame(list(enumerate(texts)), "result_id bigint, content string")
    for bound, want in ((4, [2, 2, 3, 4]), (3, [3, 4]), (2, [3, 4]), (1, [4]), (0, [])):
        monkeypatch.setattr(neardup, "FREQUENT", bound)
        h, times = neardup.frequent_shingles(df, "result_id", "content")
        assert sorted(times.tolist()) == want and h.tolist() == sorted(h.tolist())
