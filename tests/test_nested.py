import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.operators import nested

EDGES = [
    '{"children":[{"children":{"a":1}},null,[{"x":1}],"{}",{"children":[]}],"children":[{"b":"}]"}]}', '{"\\u0063hildren":{"children":[{}]}}', "[{}]", "{}", '"{"', '{"a":"\\\\"}', "3", '""',
    '{"meta":{"children":[{}]},"children":[{"a":{"children":[{}]}}]}', '{"a":NaN}', '{"a":1,}', "", "  {}  ", '{"children":null}', '{"children":[{}],"children":null}', '{"children":"x","a\\"":{}}', '{"a":"\t"}', "{}{}",
]


def brute(text):
    def refuse(_):
        raise ValueError

    try:
        o = json.loads(text, parse_constant=refuse)
    except ValueError:
        return None
    rows = []

    def go(n, up, depth):
        me = len(rows)
        rows.append((me, up, depth))
        kids = n.get("children")
        for k in [kids] if isinstance(kids, dict) else kids if isinstance(kids, list) else []:
            if isinstance(k, dict):
                go(k, me, depth + 1)

    if isinstance(o, dict):
        go(o, -1, 0)
    return rows


def linked(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    starts = np.concatenate([[0], ends[:-1]])
    docs, order, up, depth, _, _ = nested.index_batch(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
    out = {i: [] for i in range(len(texts))}
    for d, *row in zip(docs.tolist(), order.tolist(), up.tolist(), depth.tolist()):
        out[d].append(tuple(row))
    return out


def test_edges_alone_and_together():
    good = [t for t in EDGES if nested.is_valid_json(t)]
    assert [t for t in EDGES if brute(t) is not None] == good
    for t in good:
        assert linked([t])[0] == brute(t), t
    together = linked(good)
    assert [together[i] for i in range(len(good))] == [brute(t) for t in good]


_json = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["children", "role", 'a"b', "\\", "x"]), c, max_size=3), max_leaves=25
)


@settings(max_examples=150, deadline=None)
@given(st.lists(_json, min_size=1, max_size=5), st.booleans())
def test_random_trees(values, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
    got = linked(texts)
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_very_deep():
    deep = '{"children":' * 60_000 + "null" + "}" * 60_000
    assert nested.is_valid_json(deep) and not nested.is_valid_json(deep[:-1])
    assert linked([deep])[0][-1] == (59_999, 59_998, 59_999)


def test_frames(spark):
    rows = [(1, EDGES[0], "c"), (1, EDGES[0], "c"), (2, None, None), (3, "not json", ""), (None, '{"ref":7,"depth":"2","checked":"true","children":{"ref":"e","name":"\\u00e9"}}', "")]
    df = spark.createDataFrame(rows, "snapshot_id bigint, tree string, preorder string")
    got = sorted(map(tuple, nested.tree_links(df).collect()), key=str)
    assert got == sorted([(1, *r) for r in brute(EDGES[0])] + [(None, 0, -1, 0), (None, 1, 0, 1)], key=str)
    nodes = {r.preorder: r for r in nested.tree_nodes(df.filter("snapshot_id is null")).collect()}
    assert (nodes[0].ref, nodes[0].stored_depth, nodes[0].checked) == ("7", 2, True)
    assert (nodes[1].parent_ref, nodes[1].name) == ("7", "é")
    assert nested.tree_nodes(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 200])
def test_one_partition_or_many(spark, n):
    df = spark.createDataFrame([(i, EDGES[8]) for i in range(50)], "snapshot_id bigint, tree string").repartition(n)
    assert nested.tree_links(df).count() == 100
