"""JSON-LD blocks of pages."""

from __future__ import annotations

import json
import re

FIELDS = ("type", "headline", "description", "author", "datePublished", "publisher", "url", "keywords")
_SCRIPT = re.compile(r"""(?is)<script\s+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""")
MOST_BLOCKS = 10


def _string(v) -> str:
    """Strings as they are, lists as their strings joined, everything else empty."""
    if isinstance(v, str):
        return v
    return ", ".join(x for x in v if isinstance(x, str)) if isinstance(v, list) else ""


def _author(v) -> str:
    if isinstance(v, dict):
        return _string(v.get("name"))
    if isinstance(v, list):
        names = [x if isinstance(x, str) else _string(x.get("name")) if isinstance(x, dict) else "" for x in v]
        return ", ".join(n for n, x in zip(names, v) if n or isinstance(x, str))
    return v if isinstance(v, str) else ""


def _block(o: dict) -> dict:
    pub = o.get("publisher")
    out = {k: _string(o.get(k)) for k in ("headline", "description", "datePublished", "url", "keywords")}
    return out | {"type": _string(o.get("@type")), "author": _author(o.get("author")), "publisher": _string(pub.get("name") if isinstance(pub, dict) else pub), "headline": out["headline"] or _string(o.get("name"))}


def parse_block(raw: str) -> dict:
    """The block of one script: an object, the telling object of its @graph, or the telling object of a list."""
    empty = dict.fromkeys(FIELDS, "")
    try:
        v = json.loads(raw)
    except (ValueError, RecursionError):
        return empty
    telling = lambda items: next((b for b in (_block(x) for x in items if isinstance(x, dict)) if b["headline"] or b["description"]), None)
    if isinstance(v, list):
        return telling(v) or (_block(v[0]) if v and isinstance(v[0], dict) else empty)
    if not isinstance(v, dict):
        return empty
    graph = v.get("@graph")
    return (telling(graph) if isinstance(graph, list) else None) or _block(v)


def blocks_of(markup: str | None) -> list[dict]:
    """Up to ten blocks with a type, headline or description."""
    found = [m.strip() for m in _SCRIPT.findall(markup or "")[:MOST_BLOCKS]]
    return [b for b in map(parse_block, filter(None, found)) if b["type"] or b["headline"] or b["description"]]
