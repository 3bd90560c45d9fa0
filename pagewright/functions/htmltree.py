"""HTML as flat columns in document order: tag, attributes, text, parent, end of subtree.

Element i spans the nodes i .. last[i]; text nodes have the tag None.  The
tree builder closes what HTML lets be omitted (p, li, dt, dd, td, tr, option
and the like); misnested formatting is closed where its container ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag closes these open elements, up to the barrier.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
}


@dataclass
class Dom:
    tag: list[str | None] = field(default_factory=list)
    attrs: list[dict] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def add(self, tag: str | None, attrs: dict, text: str, parent: int) -> int:
        i = len(self.tag)
        self.tag.append(tag), self.attrs.append(attrs), self.text.append(text), self.parent.append(parent), self.last.append(i)
        return i

    def within(self, i: int) -> range:
        return range(i, self.last[i] + 1)

    def find_all(self, tag: str, i: int = 0) -> list[int]:
        return [k for k in self.within(i) if self.tag[k] == tag] if self.tag else []

    def first(self, tag: str, i: int = 0) -> int | None:
        return next((k for k in self.within(i) if self.tag[k] == tag), None) if self.tag else None

    def first_with_class(self, part: str, i: int) -> int | None:
        return next((k for k in self.within(i) if self.tag[k] and part in (self.attrs[k].get("class") or "").lower()), None)

    def children(self, i: int):
        k = i + 1
        while k <= self.last[i]:
            yield k
            k = self.last[k] + 1

    def content(self, i: int) -> str:
        """All text below a node, scripts included."""
        return "".join(self.text[i : self.last[i] + 1])

    def clean(self, i: int) -> str:
        return " ".join(self.content(i).split())

    def attr(self, i: int, name: str) -> str:
        return self.attrs[i].get(name) or ""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.dom = Dom()
        self.open: list[int] = [self.dom.add("html", {}, "", -1)]
        self.body = -1

    def _end(self, depth: int) -> None:
        end = len(self.dom.tag) - 1
        for i in self.open[depth:]:
            self.dom.last[i] = end
        del self.open[depth:]

    def _body(self, tag: str | None) -> None:
        """Content outside head and body belongs to an implied body."""
        if self.body < 0 and tag not in ("head", "title", "meta", "link", "base", "style", "script", "noscript", "template"):
            if len(self.open) > 1 and self.dom.tag[self.open[1]] == "head":
                self._end(1)
            self.body = self.dom.add("body", {}, "", 0)
            self.open = [0, self.body]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag == "html":
            self.dom.attrs[0].update({k: v for k, v in found.items() if k not in self.dom.attrs[0]})
            return
        if tag == "body":
            if self.body < 0:
                self._body(None)
            self.dom.attrs[self.body].update({k: v for k, v in found.items() if k not in self.dom.attrs[self.body]})
            return
        self._body(tag)
        closes, barrier = _CLOSES.get(tag, ((), ()))
        if tag in _BLOCK:
            closes, barrier = {"p"}, {"button", "td", "th", "body", "table", "object"}
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.dom.tag[self.open[depth]]
            if name in barrier:
                break
            if name in closes:
                self._end(depth)
                if tag in _BLOCK or tag in ("li", "option", "td", "th"):
                    break
        i = self.dom.add(tag, found, "", self.open[-1])
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.dom.tag[self.open[depth]] == tag:
                self._end(depth)
                return

    def handle_data(self, data: str) -> None:
        if self.body < 0 and self.dom.tag[self.open[-1]] in ("html", "head"):
            if not data.strip():
                return
            self._body(None)
        self.dom.add(None, {}, data, self.open[-1])


def parse(markup: str | None) -> Dom:
    """The tree of any text; null and empty texts give an html element only."""
    b = _Builder()
    try:
        b.feed(markup or "")
        b.close()
    except (AssertionError, ValueError):  # broken declarations end the tree early
        pass
    b._end(0)
    return b.dom


# Sanitising works on the text, as what is left is parsed by others too.
# Tags removed with their content, and the signs of hidden elements.
REMOVED = "canvas embed iframe link meta noscript object style svg template".split()
_REMOVED = [re.compile(rf"(?is)<{t}\b[^>]*(?:/>|>.*?</{t}\s*>)", re.A) for t in REMOVED]
_COMMENT = re.compile(r"(?s)<!--.*?-->")
_HIDDEN_INPUT = re.compile(r"""(?i)<input\b[^>]*\btype\s*=\s*["']hidden["'][^>]*/?>""", re.A)
_HIDDEN_ATTRS = [re.compile(p, re.A) for p in (
    r"""(?i)\baria-hidden\s*=\s*["']true["']""", r"""(?i)\bclass\s*=\s*["'][^"']*\b(?:screen-reader-only|sr-only|visually-hidden)\b[^"']*["']""",
    r"""(?i)\bstyle\s*=\s*["'][^"']*display\s*:\s*none[^"']*["']""", r"""(?i)\bstyle\s*=\s*["'][^"']*visibility\s*:\s*hidden[^"']*["']""",
    r"""(?i)\bstyle\s*=\s*["'][^"']*opacity\s*:\s*0\s*[;"][^"']*["']""", r"""(?i)\bstyle\s*=\s*["'][^"']*font-size\s*:\s*0[^"']*["']""",
)]
_TAGS = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_BARE_HIDDEN = re.compile(r"""(?i)(?:^|[\s/])hidden(?=[\s/=]|$)""")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤⁪-⁯﻿]")


def sanitize(markup: str) -> str:
    """Removes comments, ten kinds of elements, hidden inputs, hidden elements with their content and invisible characters.

    Matching tags are found in one pass with a stack per tag name; a hidden
    element that is never closed loses its opening tag only.
    """
    text = _COMMENT.sub("", markup)
    for p in _REMOVED:
        text = p.sub("", text)
    text = _HIDDEN_INPUT.sub("", text)
    stacks: dict[str, list[tuple[int, int, bool]]] = {}
    gone: list[tuple[int, int]] = []
    for m in _TAGS.finditer(text):
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            if stacks.get(name):
                a, _, hidden = stacks[name].pop()
                if hidden:
                    gone.append((a, m.end()))
            continue
        hidden = bool(attrs) and (any(p.search(m[0]) for p in _HIDDEN_ATTRS) or bool(_BARE_HIDDEN.search(_QUOTED.sub("=", attrs))))
        if name in VOID or attrs.endswith("/"):
            if hidden:
                gone.append(m.span())
        else:
            stacks.setdefault(name, []).append((m.start(), m.end(), hidden))
    gone += [(a, b) for s in stacks.values() for a, b, hidden in s if hidden]
    out, at = [], 0
    for a, b in sorted(gone):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return _INVISIBLE.sub("", "".join(out))


_TWOSLASH = re.compile(r"""<button\s+[^>]*class=["'][^"']*twoslash[^"']*["'][^>]*>(.*?)</button>""")
_DOCS_APP = re.compile(r"""class=["'][^"']*\bVPApp\b|id=["']VPContent["']""", re.A)
_SITEMAP = re.compile(r"""(?is)<section[^>]*id=["']sitemap["'][^>]*>.*?</section>""")
_DOCS_FOOTER = re.compile(r"""(?is)<div[^>]*class=["'][^"']*VPFooter[^"']*["'][^>]*>.*?</div>""")
_CONTAINER = re.compile(r"""<([a-zA-Z][\w-]*)\b[^<>]*\bid=["']VPContent["'][^>]*>""")


def preprocess(markup: str) -> str:
    """Code-hint buttons become spans; documentation apps are cut to their content container."""
    text = _TWOSLASH.sub(r"<span>\1</span>", markup)
    m = _CONTAINER.search(text) if _DOCS_APP.search(text) else None
    if not m:
        return text
    depth = 1
    for t in re.compile(rf"(?i)<(/?){re.escape(m[1])}(?=[\s/>])").finditer(text, m.end()):
        depth += -1 if t[1] else 1
        if depth == 0:
            inner = _DOCS_FOOTER.sub("", _SITEMAP.sub("", text[m.end() : t.start()]))
            head, end, _ = text.partition("</head>")
            return f'{head}{end}<body><main id="VPContent">{inner}</main></body></html>' if end else f"<html><body><main>{inner}</main></body></html>"
    return text
