"""Nested JSON trees to linked flat rows by vectorised structural indexing.

Each Arrow batch of JSON texts is handled as one byte buffer.  Bitmaps of the
unescaped quotes, the brackets and the delimiters outside strings are built
with numpy; nesting depth is a prefix sum over the bracket bitmap; the parent
of every token is the last opening bracket one level up, found by one sort and
a running maximum.  Objects reached from the root through ``children`` become
rows.  There is no per-node Python loop in the linking.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, BACKSLASH, LBRACE, RBRACE, LBRACKET, RBRACKET, COLON, COMMA = b'"\\{}[]:,'
_KIND = np.zeros(256, np.uint8)
for _k, _c in enumerate((LBRACE, RBRACE, LBRACKET, RBRACKET, COLON, COMMA), 1):
    _KIND[_c] = _k
_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COLON, _COMMA = range(1, 7)

TEXT_FIELDS = ("role", "name", "tag", "ref", "selector", "value", "href")
FIELDS = (*TEXT_FIELDS, "depth", "level", "interactive", "checked", "disabled")


class _NotJson(ValueError):
    pass


def _refuse(word: str):
    raise _NotJson(word)


_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)


def _valid_without_recursion(text: str) -> bool:
    """A stack machine for texts nested deeper than the C parser goes."""
    stack: list[str] = []
    want = "value"  # value, value_or_end, key, key_or_end, colon, comma_or_end
    pos = 0
    while stack or want != "done":
        m = _TOKEN.match(text, pos)
        if not m:
            return False
        pos = m.end()
        mark, string, scalar = m.groups()
        closes = mark and stack and ((mark == "}" and stack[-1] == "{") or (mark == "]" and stack[-1] == "["))
        if closes and want in ("comma_or_end", "key_or_end" if mark == "}" else "value_or_end"):
            stack.pop()
            want = "comma_or_end" if stack else "done"
        elif want in ("value", "value_or_end") and (mark in ("{", "[") or string or scalar):
            if mark:
                stack.append(mark)
                want = "key_or_end" if mark == "{" else "value_or_end"
            else:
                want = "comma_or_end" if stack else "done"
        elif want in ("key", "key_or_end") and string:
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "comma_or_end" and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return False
    return not text[pos:].strip(" \t\n\r")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=len, parse_float=len)


def is_valid_json(text: str | None) -> bool:
    """Strict JSON: no NaN or Infinity, no raw control characters in strings, nothing after the value."""
    if text is None:
        return False
    try:
        _DECODER.decode(text)
        return True
    except RecursionError:
        return _valid_without_recursion(text)
    except ValueError:
        return False


def _last_before(level: np.ndarray, opens: np.ndarray, items: np.ndarray, opens_at: np.ndarray, items_at: np.ndarray) -> np.ndarray:
    """For each item: the index of the last open bracket of the level above before it (-1: none).

    level: levels of the opens followed by the wanted levels of the items.
    """
    at = np.concatenate([opens_at, items_at])
    order = np.lexsort((at, level))
    who = np.where(order < len(opens), order, -1)
    same = level[order]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    last = np.maximum.accumulate(np.where(who >= 0, np.arange(len(order)), -1))
    found = np.where(last >= start, who[np.maximum(last, 0)], -1)
    out = np.empty(len(order), np.int64)
    out[order] = found
    return out[len(opens):]


def index_batch(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Link the nodes of a batch of valid JSON texts that lie in one byte buffer.

    Returns (doc, preorder, parent_preorder, depth, position of the node's brace, state for fields).
    """
    n_docs = len(starts)
    none = np.zeros(0, np.int64)
    if n_docs == 0 or len(data) == 0:
        return none, none, none, none, none, None
    # Backslashes: in a run, every second one is escaped, and what follows an odd run is.
    slash = np.flatnonzero(data == BACKSLASH)
    quote = data == QUOTE
    if len(slash):
        new = np.concatenate([[True], (slash[1:] != slash[:-1] + 1) | np.isin(slash[1:], starts)])
        run = np.maximum.accumulate(np.where(new, slash, 0))
        odd_end = slash[((slash - run) % 2 == 0)] + 1
        odd_end = odd_end[(odd_end < len(data))]
        quote[odd_end[~np.isin(odd_end, starts)]] = False
    quotes = np.flatnonzero(quote)
    kind_all = _KIND[data]
    marks = np.flatnonzero(kind_all)
    # In a string, if an odd number of quotes precede in the same text.
    before = np.searchsorted(quotes, marks)
    doc_of = np.searchsorted(starts, marks, side="right") - 1
    base = np.searchsorted(quotes, starts)
    keep = (before - base[doc_of]) % 2 == 0
    marks, before, doc_of = marks[keep], before[keep], doc_of[keep]
    if not len(marks):
        return none, none, none, none, none, None
    kind = kind_all[marks]
    is_open = (kind == _OPEN_OBJ) | (kind == _OPEN_ARR)
    is_close = (kind == _CLOSE_OBJ) | (kind == _CLOSE_ARR)
    step = is_open.astype(np.int64) - is_close
    level = np.cumsum(step)
    first_mark = np.searchsorted(doc_of, np.arange(n_docs))
    level_base = np.where(first_mark > 0, level[np.maximum(first_mark - 1, 0)], 0)
    level = level - level_base[doc_of]  # an opening bracket has the level inside it
    opens = np.flatnonzero(is_open)
    if not len(opens):
        return none, none, none, none, none, None
    wide = int(level.max()) + 2
    key_of = lambda doc, lev: doc * wide + lev
    open_key = key_of(doc_of[opens], level[opens])
    parent = _last_before(np.concatenate([open_key, open_key - 1]), opens, opens, marks[opens], marks[opens])
    # Colons whose key is "children": the eight bytes before the closing quote.
    colons = np.flatnonzero(kind == _COLON)
    close_q, open_q = quotes[before[colons] - 1], quotes[before[colons] - 2]
    length = close_q - open_q - 1
    child_key = np.zeros(len(colons), bool)
    eight = np.flatnonzero(length == 8)
    if len(eight):
        got = data[(open_q[eight] + 1)[:, None] + np.arange(8)]
        child_key[eight] = (got == np.frombuffer(b"children", np.uint8)).all(1)
    if len(slash):  # keys written with escapes
        has = np.searchsorted(slash, close_q) > np.searchsorted(slash, open_q)
        for i in np.flatnonzero(has & (length > 8)):
            child_key[i] = json.loads(bytes(data[open_q[i] : close_q[i] + 1])) == "children"
    colons = colons[child_key]
    owner = _last_before(np.concatenate([open_key, key_of(doc_of[colons], level[colons])]), opens, colons, marks[opens], marks[colons])
    # Of a repeated key the last one counts, as in common parsers.
    last_colon = np.full(len(opens), -1, np.int64)
    last_colon[owner] = colons  # colons ascend, the last write stays
    before_open = opens - 1
    keyed = np.zeros(len(opens), bool)
    has_before = (before_open >= 0) & (parent >= 0)
    keyed[has_before] = last_colon[parent[has_before]] == before_open[has_before]
    obj = kind[opens] == _OPEN_OBJ
    # A node: the root object, a lone object under children, or an object in the array under children.
    grand = np.where(parent >= 0, parent[np.maximum(parent, 0)], -1)
    under_obj = (parent >= 0) & obj[np.maximum(parent, 0)]
    lone = obj & under_obj & keyed
    in_list = obj & (parent >= 0) & ~under_obj & keyed[np.maximum(parent, 0)] & (grand >= 0) & obj[np.maximum(grand, 0)]
    link = np.where(lone, parent, np.where(in_list, grand, -1))
    root = obj & (parent < 0) & (level[opens] == 1) & (opens == first_mark[doc_of[opens]])
    alive = root | (link >= 0)
    depth = np.where(link >= 0, 1, 0)
    jump = np.where(link >= 0, link, np.arange(len(opens)))
    while True:  # pointer jumping: log2(depth) rounds
        depth = depth + np.where(jump != np.arange(len(opens)), depth[jump], 0)
        alive = alive & alive[jump]
        nxt = jump[jump]
        if (nxt == jump).all():
            break
        jump = nxt
    node = np.flatnonzero(alive & root[jump])
    docs = doc_of[opens[node]]
    order = np.arange(len(node)) - np.searchsorted(docs, docs)
    number = np.full(len(opens), -1, np.int64)
    number[node] = order
    up = np.where(link[node] >= 0, number[np.maximum(link[node], 0)], -1)
    state = (data, marks, kind, before, doc_of, quotes, opens, open_key, wide, level, number, slash)
    return docs, order, up, depth[node], node, state


def _field_values(node: np.ndarray, docs: np.ndarray, order: np.ndarray, state) -> list[dict]:
    """Scalar values of the known keys directly inside each node, by span."""
    data, marks, kind, before, doc_of, quotes, opens, open_key, wide, level, number, _ = state
    rows: list[dict] = [{} for _ in node]
    where = np.full(len(opens), -1, np.int64)
    where[node] = np.arange(len(node))
    colons = np.flatnonzero(kind == _COLON)
    owner = _last_before(np.concatenate([open_key, doc_of[colons] * wide + level[colons]]), opens, colons, marks[opens], marks[colons])
    mine = (owner >= 0) & (where[np.maximum(owner, 0)] >= 0)
    mine &= np.isin(kind[np.minimum(colons + 1, len(kind) - 1)], (_COMMA, _CLOSE_OBJ))  # a scalar follows
    raw = data.tobytes()
    names = set(FIELDS)
    for c, row in zip(colons[mine], where[owner[mine]]):
        close_q, open_q = quotes[before[c] - 1], quotes[before[c] - 2]
        key = raw[open_q + 1 : close_q]
        key = json.loads(raw[open_q : close_q + 1]) if b"\\" in key else key.decode("utf-8", "replace")
        if key in names:
            rows[row][key] = json.loads(raw[marks[c] + 1 : marks[c + 1]])
    return rows


def _integer(v) -> int | None:
    """Whole numbers, also written as text; everything else is null."""
    if isinstance(v, bool) or v is None:
        return None
    try:
        f = float(v)
        return int(f) if f == int(f) and abs(f) < 2**53 else None
    except (TypeError, ValueError, OverflowError):
        return None


def _flag(v) -> bool | None:
    return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None


def _text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v)


NODE_SCHEMA = (
    "preorder bigint, parent_preorder bigint, depth bigint, role string, name string, tag string, ref string, parent_ref string, "
    "selector string, value string, href string, stored_depth bigint, level bigint, interactive boolean, checked boolean, disabled boolean"
)
LINK_SCHEMA = "preorder bigint, parent_preorder bigint, depth bigint"


def flatten_trees(df: DataFrame, id_col: str = "snapshot_id", tree_col: str = "tree", fields: bool = True) -> DataFrame:
    """One row per node of every valid JSON tree: id, place, parent's place, depth and (fields=True) its attributes.

    Invalid JSON, null texts and roots that are no object give no rows; a null
    ``children`` gives no child; nested arrays and scalars in it are no nodes.
    Fields of another type than expected become null, or their text for text
    fields.  A null id is kept.  Other columns of ``df`` are not carried and
    may have any name.  Repeated rows give repeated results; the caller
    removes them.  Needs no shuffle.
    """
    kind = dict(df.dtypes)[id_col]
    out = f"{id_col} {kind}, {NODE_SCHEMA if fields else LINK_SCHEMA}"
    arrow_fields = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            texts = col.to_pylist()
            ok = np.flatnonzero([is_valid_json(t) for t in texts])
            if not len(ok):
                continue
            parts = [texts[i].encode("utf-8", "surrogatepass") for i in ok]
            lengths = np.array([len(p) for p in parts], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            data = np.frombuffer(b"".join(parts), np.uint8)
            docs, order, up, depth, node, state = index_batch(data, starts, starts + lengths)
            cols = [ids.take(pa.array(ok[docs])), pa.array(order), pa.array(up), pa.array(depth)]
            names = [id_col, "preorder", "parent_preorder", "depth"]
            if fields:
                rows = _field_values(node, docs, order, state) if len(node) else []
                first = np.searchsorted(docs, docs)
                above = [_text(rows[first[i] + up[i]].get("ref")) if up[i] >= 0 else None for i in range(len(rows))]
                for f in ("role", "name", "tag", "ref"):
                    cols.append(pa.array([_text(r.get(f)) for r in rows], pa.string()))
                cols.append(pa.array(above, pa.string()))
                for f in ("selector", "value", "href"):
                    cols.append(pa.array([_text(r.get(f)) for r in rows], pa.string()))
                for f in ("depth", "level"):
                    cols.append(pa.array([_integer(r.get(f)) for r in rows], pa.int64()))
                for f in ("interactive", "checked", "disabled"):
                    cols.append(pa.array([_flag(r.get(f)) for r in rows], pa.bool_()))
                names += ["role", "name", "tag", "ref", "parent_ref", "selector", "value", "href", "stored_depth", "level", "interactive", "checked", "disabled"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(F.col(id_col), F.col(tree_col)).mapInArrow(run, out)


def tree_links(snapshots: DataFrame) -> DataFrame:
    """Distinct (snapshot_id, preorder, parent_preorder, depth) of all nodes of all trees."""
    return flatten_trees(snapshots, fields=False).distinct()


def tree_nodes(snapshots: DataFrame) -> DataFrame:
    """The wide node table, one row per snapshot and place."""
    return flatten_trees(snapshots).dropDuplicates(["snapshot_id", "preorder"])
