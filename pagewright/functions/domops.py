"""What is read off a flat HTML tree: main article, Markdown, cards, fallback text, accessibility nodes."""

from __future__ import annotations

import json
import re

from pagewright.functions.htmltree import Dom

# Class parts, limits and roles.
CARD_CLASSES = ("card", "post", "story", "item", "entry", "teaser", "cardwrapper", "summaryitem", "headline", "hed")
TEASER_CLASSES = ("excerpt", "teaser", "summary", "description", "deck", "dek")
SIDE_TEASERS = (*TEASER_CLASSES, "blurb", "lead")
FALLBACK_SKIP_TAGS = frozenset("script style noscript nav footer header svg iframe form".split())
FALLBACK_SKIP_WORDS = ("nav", "menu", "sidebar", "footer", "header", "cookie", "banner", "modal", "popup", "overlay", "breadcrumb", "pagination")
NOISE_START = ("©", "copyright", "all rights reserved", "cookie", "privacy", "terms")
ROLES = {
    "header": "banner", "nav": "navigation", "main": "main", "footer": "contentinfo", "aside": "complementary", "article": "article", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading", "button": "button", "textarea": "textbox", "select": "combobox", "option": "option", "ul": "list", "ol": "list", "li": "listitem", "dl": "list",
    "dt": "term", "dd": "definition", "table": "table", "tr": "row", "th": "columnheader", "td": "cell", "thead": "rowgroup", "tbody": "rowgroup", "figure": "figure", "figcaption": "caption",
    "p": "paragraph", "blockquote": "blockquote", "pre": "code", "code": "code", "details": "group", "summary": "button", "dialog": "dialog",
}
INPUT_ROLES = {"search": "searchbox", "number": "spinbutton", "range": "slider", "checkbox": "checkbox", "radio": "radio", "button": "button", "submit": "button", "reset": "button", "image": "button"}
ACTIVE_ROLES = frozenset("button link checkbox radio tab menuitem option".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


# Cards.


def _teaser(dom: Dom, nodes, parts: tuple[str, ...], paragraph_first: bool, stop: frozenset) -> str | None:
    for k in nodes:
        tag = dom.tag[k]
        if tag is None:
            continue
        if tag in stop:
            return None
        low = dom.attr(k, "class").lower()
        tests = [(tag == "p", 30), (any(p in low for p in parts), 20)]
        for holds, least in tests if paragraph_first else tests[::-1]:
            if holds:
                text = dom.clean(k)
                if least < size(text) < 500:
                    return text
    return None


def _siblings_after(dom: Dom, i: int):
    k, end = dom.last[i] + 1, dom.last[dom.parent[i]]
    while k <= end:
        yield k
        k = dom.last[k] + 1


def cards(dom: Dom, most: int = 50) -> list[dict]:
    """Title, url and teaser of articles and linked headings; the first of each url, longest titles first, ties in document order."""
    out: list[dict] = []
    seen: set[str] = set()

    def take(title: str, url: str, teaser: str) -> None:
        if title and url and url not in seen:
            seen.add(url)
            out.append({"title": title, "url": url, "teaser": teaser})

    for i in dom.find_all("article"):
        title = url = ""
        h = next((k for t in HEADINGS[:4] if (k := dom.first(t, i)) is not None), None)
        if h is not None:
            title = dom.clean(h)
            a = dom.first("a", h)
            url = dom.attr(a, "href") if a is not None else ""
        if not url and (a := dom.first("a", i)) is not None:
            url, title = dom.attr(a, "href"), title or dom.clean(a)
        marked = next((k for c in TEASER_CLASSES if (k := dom.first_with_class(c, i)) is not None), None)
        teaser = dom.clean(marked) if marked is not None else ""
        if not teaser and (p := dom.first("p", i)) is not None:
            text = dom.clean(p)
            teaser = text if 20 < size(text) < 500 else ""
        take(title, url, teaser)
    for tag in HEADINGS[1:4]:
        for h in dom.find_all(tag):
            a = dom.first("a", h)
            if a is not None:
                title, url = dom.clean(a), dom.attr(a, "href")
            else:
                a = dom.first("a", dom.parent[h])
                title, url = dom.clean(h), dom.attr(a, "href") if a is not None else ""
            teaser = _teaser(dom, _siblings_after(dom, h), SIDE_TEASERS, True, frozenset(HEADINGS[:4]))
            if teaser is None:
                teaser = _teaser(dom, (k for k in dom.children(dom.parent[h]) if k != h), SIDE_TEASERS, False, frozenset())
            take(title, url, teaser or "")
    return sorted(out, key=lambda c: -size(c["title"]))[:most]


def index_page(dom: Dom) -> dict:
    """Whether a page is a list of articles, how sure that is, and its cards as Markdown."""
    n = len(dom.find_all("article")) + sum(1 for k in dom.find_all("div") if any(c in dom.attr(k, "class").lower() for c in CARD_CLASSES))
    found = cards(dom)
    k = len(found)
    base = 50 if n >= 5 and k >= 5 else 40 if k >= 8 else 35 if k >= 6 and n >= 3 else 0
    text = "".join(f"## [{c['title']}]({c['url']})\n" + (f"\n{c['teaser']}\n" if c["teaser"] else "") + "\n" for c in found) if base else ""
    return {"is_index": base > 0, "articles": n, "headlines": k, "confidence": min(100, base + 2 * k) if base else 0, "markdown": text}


def fallback_text(dom: Dom) -> dict:
    """Headings, links and longer text of the body outside navigation, each once."""
    parts: list[str] = []
    counts = {"h": 0, "a": 0}
    body = dom.first("body")
    i, end = (body, dom.last[body]) if body is not None else (0, -1)
    while i <= end:
        tag = dom.tag[i]
        if tag is None:
            i += 1
            continue
        marks = " ".join(dom.attr(i, k).lower() for k in ("class", "role", "aria-label"))
        if tag in FALLBACK_SKIP_TAGS or any(w in marks for w in FALLBACK_SKIP_WORDS):
            i = dom.last[i] + 1
            continue
        if tag in HEADINGS or tag in ("a", "p", "li", "td", "dd"):
            text = dom.clean(i)
            if tag in HEADINGS and 3 < size(text) < 200:
                parts.append(f"{'#' * int(tag[1])} {text}")
                counts["h"] += 1
            elif tag == "a" and 3 < size(text) < 200 and dom.attr(i, "href") not in ("", "#"):
                parts.append(f"[{text}]({dom.attr(i, 'href')})")
                counts["a"] += 1
            elif tag in ("p", "li", "td", "dd") and size(text) > 20:
                parts.append(text)
            i = dom.last[i] + 1
            continue
        i += 1
    kept = [p for p in dict.fromkeys(p.strip() for p in parts) if p and not p.lower().startswith(NOISE_START)]
    text = "\n\n".join(kept)
    return {"content": text, "length": size(text), "headings": counts["h"], "links": counts["a"]}


# Accessibility nodes.


def role_of(dom: Dom, i: int) -> str:
    tag = dom.tag[i]
    if dom.attr(i, "role"):
        return dom.attr(i, "role")
    if tag == "section":
        return "region" if dom.attr(i, "aria-label") or dom.attr(i, "aria-labelledby") else ""
    if tag == "a":
        return "link" if dom.attr(i, "href") else ""
    if tag == "img":
        return "image" if dom.attr(i, "alt") else ""
    if tag == "input":
        return INPUT_ROLES.get(dom.attr(i, "type").lower(), "textbox")
    return ROLES.get(tag, "")


def short_name(text: str) -> str:
    """White space collapsed; beyond 80 bytes the first 77 and three dots."""
    text = " ".join(text.split())
    raw = text.encode("utf-8", "surrogatepass")
    return raw[:77].decode("utf-8", "ignore") + "..." if len(raw) > 80 else text


def name_of(dom: Dom, i: int) -> str:
    tag = dom.tag[i]
    for k in ("aria-label", "title"):
        if dom.attr(i, k):
            return short_name(dom.attr(i, k))
    if tag == "img":
        return short_name(dom.attr(i, "alt"))
    if tag in ("input", "textarea") and dom.attr(i, "placeholder"):
        return short_name(dom.attr(i, "placeholder"))
    return short_name(dom.content(i))


def is_interactive(dom: Dom, i: int) -> bool:
    tag = dom.tag[i]
    if tag == "a":
        return dom.attr(i, "href") != ""
    if tag == "input":
        return dom.attr(i, "type").lower() != "hidden"
    if tag in ("button", "select", "textarea", "summary", "details"):
        return True
    return any(k.startswith("on") for k in dom.attrs[i]) or dom.attr(i, "tabindex") not in ("", "-1") or dom.attr(i, "role") in ACTIVE_ROLES


def snapshot_nodes(dom: Dom, interactive_only: bool = False) -> list[dict]:
    """Role-bearing nodes in document order with refs, parents and depths counted among role-bearing nodes.

    With interactive_only, nodes that neither are nor hold an interactive node
    go; refs are not renumbered.
    """
    out: list[dict] = []
    place: dict[int, int] = {}
    per_tag: dict[str, int] = {}
    for i, tag in enumerate(dom.tag):
        if tag is None or not (role := role_of(dom, i)):
            continue
        up = dom.parent[i]
        while up >= 0 and up not in place:
            up = dom.parent[up]
        parent = place.get(up, -1)
        classes = dom.attr(i, "class").split()
        if dom.attr(i, "id"):
            selector = "#" + dom.attr(i, "id")
        elif classes:
            selector = f"{tag}.{next((c for c in classes if not c.startswith('js-') and len(c) > 1), classes[0])}"
        else:
            per_tag[tag] = per_tag.get(tag, 0) + 1
            selector = f"{tag}:nth-of-type({per_tag[tag]})"
        place[i] = len(out)
        out.append({
            "preorder": len(out), "parent": parent, "ref": f"e{len(out) + 1}", "depth": out[parent]["depth"] + 1 if parent >= 0 else 0, "role": role, "tag": tag, "name": name_of(dom, i), "selector": selector,
            "interactive": is_interactive(dom, i), "level": int(tag[1]) if role == "heading" and tag in HEADINGS else 0, "href": dom.attr(i, "href") if role == "link" else "",
            "value": dom.attr(i, "value") if role in ("textbox", "searchbox") else "", "checked": ("checked" in dom.attrs[i]) if role in ("checkbox", "radio") else None, "disabled": "disabled" in dom.attrs[i],
        })
    if interactive_only:
        keep = [n["interactive"] for n in out]
        for n in reversed(out):
            if keep[n["preorder"]] and n["parent"] >= 0:
                keep[n["parent"]] = True
        out = [n for n, k in zip(out, keep) if k]
    return out


def compact_text(nodes: list[dict]) -> str:
    """One line per node under the line of the document."""
    lines = ["document"]
    for n in nodes:
        parts = [n["ref"], n["role"]]
        if n["name"]:
            parts.append(json.dumps(n["name"], ensure_ascii=False))
        parts.append(f"<{n['tag']}>")
        if n["interactive"]:
            parts.append("[interactive]")
        if n["href"]:
            parts.append(f"href={n['href']}")
        if n["level"]:
            parts.append(f"level={n['level']}")
        lines.append("  " * (n["depth"] + 1) + " ".join(parts))
    return "\n".join(lines)


_ORDER = ("role", "name", "tag", "ref", "selector", "depth", "interactive", "level", "value", "href", "checked", "disabled")


def _encoded(node) -> str:
    """JSON as the sink writes it: no spaces, angle brackets and ampersands escaped."""
    return json.dumps(node, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def snapshot_tree(nodes: list[dict], max_tokens: int = 0) -> str:
    """The nested JSON of the nodes, later children dropped to fit four bytes a token."""
    root: dict = {"role": "document", "children": []}
    made: dict[int, dict] = {-1: root}
    for n in nodes:
        x = {k: n[k] for k in _ORDER if n[k] or (k == "checked" and n[k] is not None) or k == "role"}
        made[n["preorder"]] = x
        up = n["parent"]
        made.get(up, root).setdefault("children", []).append(x)

    def cut(children: list[dict], limit: int, current: int) -> list[dict]:
        if current <= limit or not children:
            return children
        kept = []
        for i, child in enumerate(children):
            own = size(_encoded(child))
            if current - own > limit and i > len(children) // 2:
                current -= own
                continue
            slim = dict(child)
            if "children" in child:
                slim["children"] = cut(child["children"], limit // 2, own)
            kept.append(slim)
        return kept

    if max_tokens:
        total = size(_encoded(root))
        root = dict(root, children=cut(root["children"], max_tokens * 4, total))
    if not root["children"]:
        root = {"role": "document"}
    return _encoded(root)


# Main article and Markdown.
_UNLIKELY = re.compile(r"(?i)nav|menu|sidebar|footer|header|comment|share|promo|related|cookie|banner|breadcrumb|\bads?\b|advert|sponsor|newsletter|popup")
_LIKELY = re.compile(r"(?i)article|body|content|entry|main|page|post|text|story|blog")


def article(dom: Dom) -> dict:
    """Title, byline, excerpt, site name and the node of the main text.

    Paragraph-like nodes give points for length and commas to their parent and
    half to the grandparent; containers are weighted by tag and class and
    damped by link density.  An article or main element wins ties.
    """
    points: dict[int, float] = {}
    link_text = [0] * (len(dom.tag) + 1)
    all_text = [0] * (len(dom.tag) + 1)
    linked_until = -1
    for i, tag in enumerate(dom.tag):
        if tag == "a":
            linked_until = max(linked_until, dom.last[i])
        n = len(dom.text[i].strip()) if tag is None else 0
        all_text[i + 1] = all_text[i] + n
        link_text[i + 1] = link_text[i] + (n if i <= linked_until else 0)
    skip = -1
    for i, tag in enumerate(dom.tag):
        if i <= skip or tag is None:
            continue
        mark = dom.attr(i, "class") + " " + dom.attr(i, "id")
        if tag in ("nav", "aside", "footer", "header", "form", "script", "style") or (tag in ("div", "section", "ul") and _UNLIKELY.search(mark) and not _LIKELY.search(mark)):
            skip = dom.last[i]
            continue
        if tag in ("p", "pre", "td", "blockquote") and len(text := dom.clean(i)) >= 25:
            gain = 1 + text.count(",") + min(len(text) // 100, 3)
            up = dom.parent[i]
            for share in (1.0, 0.5):
                if up >= 0:
                    if up not in points:
                        m = dom.attr(up, "class") + " " + dom.attr(up, "id")
                        points[up] = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "form": -3.0, "body": 0.0}.get(dom.tag[up], 0.0) + (25 if _LIKELY.search(m) else 0) - (25 if _UNLIKELY.search(m) else 0)
                    points[up] += gain * share
                    up = dom.parent[up]
    best, most = None, 0.0
    for i, p in points.items():
        n = all_text[dom.last[i] + 1] - all_text[i]
        linked = link_text[dom.last[i] + 1] - link_text[i]
        value = p * (1 - min(1.0, linked / n if n else 0))
        if value > most:
            best, most = i, value
    if best is None:
        best = next((k for t in ("article", "main", "body") if (k := dom.first(t)) is not None), 0)
    meta: dict[str, str] = {}
    for i in dom.find_all("meta"):
        meta.setdefault((dom.attr(i, "property") or dom.attr(i, "name")).lower(), dom.attr(i, "content").strip())
    t = dom.first("title")
    title = meta.get("og:title") or (dom.clean(t) if t is not None else "")
    if not title and (h := dom.first("h1")) is not None:
        title = dom.clean(h)
    by = next((dom.clean(i) for i, tag in enumerate(dom.tag) if tag and (dom.attr(i, "rel") == "author" or "byline" in dom.attr(i, "class").lower() or dom.attr(i, "itemprop") == "author")), "")
    excerpt = meta.get("og:description") or meta.get("description") or ""
    if not excerpt and (p := dom.first("p", best)) is not None:
        excerpt = dom.clean(p)
    return {"node": best, "title": title, "byline": meta.get("author") or by, "excerpt": excerpt, "sitename": meta.get("og:site_name", "")}


_ESCAPE = re.compile(r"([\\`*_\[\]])")


def markdown(dom: Dom, root: int) -> str:
    """CommonMark of a subtree.  Frames are kept on a list, not on the call stack."""
    frames: list[tuple[int, int, list[str]]] = [(-1, dom.last[root], [])]

    def close() -> None:
        i, _, parts = frames.pop()
        out = frames[-1][2]
        tag, text = dom.tag[i], "".join(parts)
        flat = text.strip()
        if tag in HEADINGS:
            out.append(f"\n\n{'#' * int(tag[1])} {' '.join(flat.split())}\n\n" if flat else "")
        elif tag == "pre":
            out.append(f"\n\n```\n{dom.content(i).strip(chr(10))}\n```\n\n")
        elif tag == "code":
            out.append(f"`{dom.content(i)}`" if flat else "")
        elif tag in ("b", "strong"):
            out.append(f"**{flat}**" if flat else text)
        elif tag in ("i", "em"):
            out.append(f"*{flat}*" if flat else text)
        elif tag == "a":
            out.append(f"[{' '.join(flat.split())}]({dom.attr(i, 'href')})" if dom.attr(i, "href") and flat else text)
        elif tag == "li":
            up = dom.parent[i]
            mark = "- "
            if up >= 0 and dom.tag[up] == "ol":
                mark = f"{sum(1 for k in dom.children(up) if dom.tag[k] == 'li' and k <= i)}. "
            body = re.sub(r"\n{2,}", "\n", flat).replace("\n", "\n" + " " * len(mark))
            out.append(f"\n{mark}{body}")
        elif tag in ("ul", "ol"):
            out.append("\n\n" + text.strip("\n") + "\n\n")
        elif tag == "blockquote":
            quoted = re.sub(r"\n{3,}", "\n\n", flat)
            out.append("\n\n" + "\n".join("> " + x if x else ">" for x in quoted.split("\n")) + "\n\n")
        elif tag in ("td", "th"):
            out.append(f" {' '.join(flat.split())} |")
        elif tag == "tr":
            out.append("\n|" + text if flat else "")
        elif tag in ("p", "div", "section", "article", "main", "table", "figure", "header", "footer", "aside", "nav", "dl", "dt", "dd", "form", "body", "figcaption", "details", "summary"):
            out.append(f"\n\n{text.strip(' ')}\n\n")
        else:
            out.append(text)

    for i in dom.within(root):
        while frames[-1][1] < i:
            close()
        tag = dom.tag[i]
        if tag is None:
            up = dom.parent[i]
            frames[-1][2].append(_ESCAPE.sub(r"\\\1", re.sub(r"\s+", " ", dom.text[i])) if dom.tag[up] not in ("script", "style", "noscript", "template") else "")
        elif tag == "br":
            frames[-1][2].append("  \n")
        elif tag == "hr":
            frames[-1][2].append("\n\n---\n\n")
        elif tag == "img":
            frames[-1][2].append(f"![{dom.attr(i, 'alt')}]({dom.attr(i, 'src')})" if dom.attr(i, "src") else "")
        else:
            frames.append((i, dom.last[i], []))
    while len(frames) > 1:
        close()
    pieces = re.split(r"(?s)(```\n.*?\n```)", "".join(frames[0][2]))
    for k in range(0, len(pieces), 2):  # code stays as it is
        pieces[k] = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?m)^[ \t]+(?=\S)(?![ ]*(?:-|\d+\.) )", "", pieces[k]))
        pieces[k] = re.sub(r"\n{3,}", "\n\n", pieces[k])
    return "".join(pieces).strip()
