"""Main content of web pages by a tree-structured graphical model.

A page is a tree: page, zones (before, within and after the running text),
blocks, lines.  Every node is content or boilerplate; parent-child potentials
tie them, lines also have evidence of their own: words, shape, and the links
of their block against what was noted of the page's links.  One pass of
sum-product messages upward and one downward gives each line its marginal.
Evidence weights and potentials are trained by EM on a bounded number of
pages.  The labels come from the pages' HTML alone: lines of the article are
content, lines of its navigation and footer boilerplate, and so are forms of
lines that recur on the training pages but stand in none of their articles.
No phrase is given beforehand; lines without a label take part with their
marginals.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import site_of

#: Bound of the labelled pages that the model is fitted on.
TRAINING_PAGES = 1500
#: A form of a line recurs if so many training pages have it.
RECURS = 3
HEAD, BODY, TAIL, FLAT = range(4)
_ZONES = [f"~zone {z}" for z in range(4)]
_ZEROS = repeat(0.0)

# Words that begin a byline.
BYLINE = re.compile(r"(?i:(?:(?:written|edited|reported)\s+)?by|von|par|por)\s+(?:the\s|[A-ZÀ-Þ])")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_FORM_TOKEN = re.compile(r"\x02\S*|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]*)\)")
_MARKUP = re.compile(r"```.*|</?[A-Za-z][^<>]*>|\\(?:begin|end)\{[^{}]*\}|\\[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_LINK_TEXT = re.compile(r"\[([^\]]*)\]\(")
_LINK_LINE = re.compile(r"(?:[-*] |\d+\. )?\[[^\]]*\]\(([^)\s]*)\)[.,;]?$")
_ITEM = re.compile(r"([-*+]|\d+[.)]) ")
_END = ".!?…:;\"'”»)"
_SPACE = re.compile(r"[^\S\n]+")


def site_words(sitename: str | None, host: str | None) -> frozenset[str]:
    """Words of the site's own name."""
    words = re.findall(r"[^\W\d_]{3,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", sitename or "").lower()) + re.findall(r"[a-z]{3,}", (host or "").rpartition(".")[0])
    return frozenset(words) - {"the", "www", "com", "news"}


def line_features(line: str, names: frozenset[str]) -> list[str]:
    """Evidence of one line: its words, short runs of words and its shape."""
    tokens = ["0" if t[0].isdigit() else "\x01" if t in names else t for t in _TOKEN.findall(line.lower())]
    out = tokens + [a + " " + b for a, b in zip(tokens, tokens[1:])]
    out.append("^" + tokens[0] if tokens else "^")
    out.append("~upper" if line.isupper() else "~title" if line.istitle() else "~mixed")
    out.append(f"~length {len(tokens).bit_length()}")
    first = line[0]
    if "](" in line:
        m = _LINK_LINE.match(line)
        if m:
            to = m[1]
            out.append("~link http" if to.startswith("http") else "~link number" if to[-1:].isdigit() else "~link page")
        else:
            out.append("~some link")
    if first in "-*+" or first.isdigit():
        item = _ITEM.match(line)
        if item:
            out.append("~item number" if first.isdigit() else "~item " + first)
            out.append("~item end" if line[-1] in _END else "~item open")
        elif first in "-*+":
            out.append("~start " + first)
    elif first in "#>|<\\`=&":
        out.append("~start " + first)
    out.append("~end " + line[-1] if line[-1] in _END else "~end")
    return out


def form_of(line: str, names: frozenset[str]) -> str:
    """A line without what varies: numbers, names inside it, the site's own name, what its links say and where exactly they lead.

    Empty if nothing but markup is left.
    """
    line = _LINK.sub(lambda m: f" \x02{'http' if m[1].startswith('http') else m[1][:1] + _DIGITS.sub('0', m[1][1:].partition('/')[0])} ", line)
    bare = _MARKUP.sub(" ", line)
    if "\x02" not in line and not any(c.isalpha() for c in bare):
        return ""
    shown = not (line.istitle() or line.isupper())
    out: list[str] = []
    for k, t in enumerate(_FORM_TOKEN.findall(line)):
        low = t.lower()
        x = "0" if t[0].isdigit() else "\x01" if low in names else "*" if shown and k and t[0].isupper() else low
        if not (out and x == out[-1] and x in "\x01*"):
            out.append(x)
    return " ".join(out)


def shape_of(line: str) -> str:
    """The shape of a list item: its mark, links, end and length.  Empty for other lines."""
    item = _ITEM.match(line)
    if not item:
        return ""
    return f"\x03{'0' if line[0].isdigit() else line[0]} {'link' if '](' in line else 'text'} {'end' if line[-1] in _END else 'open'} {line.count(' ').bit_length()}"


@dataclass
class Page:
    """Lines (their numbers), the block of each line, the zone of each block, which lines are code, and the links of each block."""

    numbers: list[int]
    lines: list[str]
    block: list[int]
    zone: list[int]
    code: list[bool]
    links: list[str]


def outline(content: str) -> Page:
    """The tree of a page.  Lines inside a code fence are code; a code fence is one block."""
    numbers, lines, block, code = [], [], [], []
    b, fresh, fenced = -1, True, False
    prose: list[bool] = []
    for i, raw in enumerate(content.split("\n")):
        line = " ".join(raw.split())
        if not line:
            fresh = fresh or not fenced
            continue
        fence = line.startswith("```")
        if fresh:
            b += 1
            prose.append(False)
            fresh = False
        numbers.append(i)
        lines.append(line)
        block.append(b)
        code.append(fenced or fence)
        if fence:
            fenced = not fenced
        if not fenced and line.count(" ") >= 11 and (line[-1] in ".!?…\"”" or line.count(". ") >= 2) and line[0] not in "[|":
            prose[b] = True
    zone = [FLAT] * (b + 1)
    running = [k for k, p in enumerate(prose) if p]
    if running:
        zone = [HEAD if k < running[0] else TAIL if k > running[-1] else BODY for k in range(b + 1)]
    linked, words = [0] * (b + 1), [0] * (b + 1)
    for line, k in zip(lines, block):
        linked[k] += sum(m.count(" ") + 1 for m in _LINK_TEXT.findall(line)) if "](" in line else 0
        words[k] += line.count(" ") + 1
    links = [f"~links {0 if not n else 1 + min(2, 3 * n // max(1, w))}" for n, w in zip(linked, words)]
    return Page(numbers, lines, block, zone, code, links)


def page_links(count: int | None, density: float | None) -> str:
    """What was noted of a page's links, in steps; nulls are a step of their own."""
    return f"/{'?' if count is None else min(4, int(count).bit_length())}/{'?' if density is None else min(3, int(4 * density))}"


@dataclass
class Model:
    """Evidence weights by feature, the bias, and log potentials [zone kind][parent state][child state]."""

    weights: dict[str, float]
    bias: float
    zone_block: np.ndarray
    block_line: np.ndarray
    root_zone: np.ndarray


def context(page: Page, k: int, title: str, byline: str, noted: str) -> list[str]:
    """Evidence from the place of a line: its zone, its block's links against the page's, and whether it is code, the title or the byline."""
    b = page.block[k]
    out = [_ZONES[page.zone[b]], page.links[b], page.links[b] + noted]
    if page.code[k]:
        out.append("~code")
    if title and page.lines[k].lstrip("# ").lower() == title:
        out.append("~the title")
    if byline and byline in page.lines[k].lower():
        out.append("~the byline")
    return out


def evidence(page: Page, names: frozenset[str], title: str, byline: str, noted: str, model: Model, known: dict) -> list[float]:
    get = model.weights.get
    out = []
    for k, line in enumerate(page.lines):
        key = (line, names) if len(line) < 160 else None
        x = known.get(key) if key else None
        if x is None:
            x = model.bias + sum(map(get, line_features(line, names), _ZEROS))
            if key and len(known) < 200_000:
                known[key] = x
        out.append(x + sum(map(get, context(page, k, title, byline, noted), _ZEROS)))
    return out


def _up(x: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Message to the parent, as log odds, from a child with log odds x; psi[..., parent, child] are logs."""
    return np.logaddexp(psi[..., 1, 0], psi[..., 1, 1] + x) - np.logaddexp(psi[..., 0, 0], psi[..., 0, 1] + x)


def _down(y: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Message to the child from a parent whose log odds without that child are y."""
    return np.logaddexp(psi[..., 0, 1], psi[..., 1, 1] + y) - np.logaddexp(psi[..., 0, 0], psi[..., 1, 0] + y)


def sum_product(line_odds: np.ndarray, line_block: np.ndarray, block_zone: np.ndarray, zone_kind: np.ndarray, zone_page: np.ndarray, pages: int, model: Model):
    """Exact marginals of a forest of pages: log odds of lines, and the cavity odds used to re-estimate the potentials."""
    pb = model.block_line[zone_kind[block_zone[line_block]]]
    pz = model.zone_block[zone_kind[block_zone]]
    pr = model.root_zone[zone_kind]
    up_l = _up(line_odds, pb)
    block = np.bincount(line_block, up_l, len(block_zone))
    up_b = _up(block, pz)
    zone = np.bincount(block_zone, up_b, len(zone_kind))
    up_z = _up(zone, pr)
    root = np.bincount(zone_page, up_z, pages)
    zone_above = _down(root[zone_page] - up_z, pr)
    block_above = _down(zone_above[block_zone] + zone[block_zone] - up_b, pz)
    line_above = _down(block_above[line_block] + block[line_block] - up_l, pb)
    cavities = {
        "block_line": (block_above[line_block] + block[line_block] - up_l, line_odds, zone_kind[block_zone[line_block]]),
        "zone_block": (zone_above[block_zone] + zone[block_zone] - up_b, block, zone_kind[block_zone]),
        "root_zone": (root[zone_page] - up_z, zone, zone_kind),
    }
    return line_odds + line_above, cavities


def _forest(pages: list[Page]):
    line_block, block_zone, zone_kind, zone_page = [], [], [], []
    blocks = 0
    for p, page in enumerate(pages):
        at: dict[int, int] = {}
        for z in page.zone:
            if z not in at:
                at[z] = len(zone_kind)
                zone_kind.append(z)
                zone_page.append(p)
            block_zone.append(at[z])
        line_block.extend(blocks + b for b in page.block)
        blocks += len(page.zone)
    as_ints = lambda x: np.array(x, np.int64)
    return as_ints(line_block), as_ints(block_zone), as_ints(zone_kind), as_ints(zone_page)


_ARTICLE = re.compile(r"(?is)<article\b[^>]*>(.*?)(?:</article>|$)")
_PART = re.compile(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>")
_NAV = re.compile(r"(?is)<(?:nav|footer)\b[^>]*>(.*?)</(?:nav|footer)>")
_TAG = re.compile(r"<[^>]*>")


def _plain(x: str) -> str:
    return _SPACE.sub(" ", html.unescape(_TAG.sub("", x))).strip().lower()


def _shown(x: str | None) -> str:
    return _SPACE.sub(" ", x or "").strip().lower()


def labels(page: Page, forms: list[str], own: set[str], title: str, byline: str, foreign: frozenset[str], content: frozenset[str], nav_words: frozenset[str]) -> list[int]:
    """1 boilerplate, 0 content, -1 unknown for each line of a training page.

    own: texts of the page's article; foreign, content: forms that recur
    outside all articles, and that stand in some article.  What a foreign line
    heads in its block is foreign too.
    """
    out = []
    headed = -1
    for k, (line, form) in enumerate(zip(page.lines, forms)):
        low = line.lower()
        words = re.findall(r"[^\W\d_]+", re.sub(r"\]\([^)]*\)", "]", low))
        if low in own or low.lstrip("# ") in own or form in content or low.lstrip("# ") == title or (byline and byline in low) or (BYLINE.match(line) and line[-1] not in ".!?"):
            y = 0
        elif page.code[k] or (_MARKUP.match(line) if form else _MARKUP.search(line)):  # navigation and notices hold no code and no other markup
            y = 0
        elif headed == page.block[k]:
            y = 1
        elif form in foreign or shape_of(line) in foreign or (words and all(w in nav_words for w in words) and (len(words) > 1 or line[0] in "-*[")):
            y = 1
            if line[0] in "#*" and (k == 0 or page.block[k - 1] != page.block[k]):
                headed = page.block[k]
        else:
            y = -1
        out.append(y)
    return out


def fit(rows: list[tuple], rounds: int = 2, steps: int = 40) -> Model:
    """rows: (content, title, byline, sitename, host, link count, link density, html of the page or None).

    Logistic weights first on the labelled lines, then EM: marginals of all
    lines by sum-product, new potentials from the expected pairs, new weights
    from the marginals.
    """
    pages, names, titles, bylines, noted, owns, forms = [], [], [], [], [], [], []
    nav: Counter = Counter()
    seen: Counter = Counter()
    inside: Counter = Counter()
    for content, title, byline, sitename, host, count, density, markup in rows:
        for part in _NAV.findall(markup or ""):
            nav.update(set(re.findall(r"[^\W\d_]{2,}", _plain(part.replace("<", " <")))))
        page = outline(content or "")
        if not page.lines:
            continue
        own = {_plain(b) for part in _ARTICLE.findall(markup or "") for _, b in _PART.findall(part)}
        pages.append(page)
        names.append(site_words(sitename, host))
        titles.append(_shown(title))
        bylines.append(_shown(byline))
        noted.append(page_links(count, density))
        owns.append(own)
        forms.append([form_of(x, names[-1]) for x in page.lines])
        if own:  # without an article nothing is known to stand outside it
            seen.update({*forms[-1], *map(shape_of, page.lines)})
        inside.update({f for x in own if x for f in (form_of(x, names[-1]), shape_of(x))})
    nav_words = frozenset(w for w, n in nav.items() if n >= max(3, len(rows) // 500))
    foreign = frozenset(f for f, n in seen.items() if f and n >= RECURS and not inside[f])
    content = frozenset(f for f in inside if f and f[0] != "\x03")
    marks = [y for x in zip(pages, forms, owns, titles, bylines) for y in labels(*x, foreign, content, nav_words)]
    even = np.log(np.full((4, 2, 2), 0.5))
    start = np.log(np.array([[[0.9, 0.1], [0.1, 0.9]]] * 4))
    if not pages:
        return Model({}, -2.0, start, start, even)
    count: Counter = Counter()
    feats: list[list[str]] = []
    for page, own, title, byline, links in zip(pages, names, titles, bylines, noted):
        for k, line in enumerate(page.lines):
            f = [*line_features(line, own), *context(page, k, title, byline, links)]
            feats.append(f)
            count.update(set(f))
    ids = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 4))}
    kept = [[ids[f] for f in fs if f in ids] for fs in feats]
    index = np.array([i for x in kept for i in x], np.int64)
    row = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    y0 = np.array(marks)
    target, sure = np.maximum(y0, 0).astype(float), (y0 >= 0).astype(float)
    w, bias = np.zeros(len(ids)), 0.0
    forest = _forest(pages)
    model = Model({}, bias, start.copy(), start.copy(), even.copy())
    odds = np.zeros(len(kept))
    for turn in range(rounds + 1):
        m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):  # Adam on all lines
            odds = np.bincount(row, w[index], len(kept)) + bias
            miss = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target) * sure / max(1.0, sure.sum())
            g = np.bincount(index, miss[row], len(w)) + 1e-6 * w
            gb = miss.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.12 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-9)
            bias -= 0.12 * (mb1 / c1) / (np.sqrt(mb2 / c2) + 1e-9)
        odds = np.bincount(row, w[index], len(kept)) + bias
        if turn == rounds:
            break
        clamped = np.where(y0 == 1, 12.0, np.where(y0 == 0, -12.0, odds))
        belief, cavities = sum_product(clamped, *forest, len(pages), model)
        for name, (above, below, kind) in cavities.items():
            psi = getattr(model, name)
            new = np.full((4, 2, 2), 2.0)
            pair = psi[kind] + np.stack([np.zeros_like(above), above], 1)[:, :, None] + np.stack([np.zeros_like(below), below], 1)[:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            np.add.at(new, kind, pair / pair.sum((1, 2), keepdims=True))
            setattr(model, name, np.log(new / new.sum(2, keepdims=True)))
        share = 1 / (1 + np.exp(-np.clip(belief, -30, 30)))
        target = np.where(y0 >= 0, np.maximum(y0, 0), share)
        sure = np.where(y0 >= 0, 1.0, 0.5)
    model.weights = {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}
    model.bias = float(bias)
    return model


def boilerplate_lines(batch: list[tuple], model: Model, known: dict) -> list[list[int]]:
    """batch: (content, title, byline, sitename, host, link count, link density) -> numbers of the boilerplate lines of each."""
    pages, odds, where = [], [], []
    out: list[list[int]] = [[] for _ in batch]
    for k, (content, title, byline, sitename, host, count, density) in enumerate(batch):
        page = outline(content) if content else None
        if page and page.lines:
            names = known.get((sitename, host))
            if names is None:
                names = known[(sitename, host)] = site_words(sitename, host)
            pages.append(page)
            odds.extend(evidence(page, names, _shown(title), _shown(byline), page_links(count, density), model, known))
            where.append(k)
    if pages:
        belief, _ = sum_product(np.array(odds), *_forest(pages), len(pages), model)
        at = 0
        for page, k in zip(pages, where):
            end = at + len(page.lines)
            out[k] = [n for n, x in zip(page.numbers, belief[at:end]) if x > 0]
            at = end
    return out


def read_columns() -> tuple:
    """What the model reads of a record."""
    return "result_id", "content", "title", "byline", "sitename", site_of(F.coalesce("final_url", "url")).alias("host"), "link_count", F.col("validation.linkDensity").alias("density")


def train(extractions: DataFrame, pages: DataFrame, limit: int = TRAINING_PAGES) -> Model:
    """Fits on at most ``limit`` records, those with the lowest hash of their id.

    Ids are picked first, below a hash that about 1.5 times as many have, so
    that what reaches the driver does not grow with the table or its
    partitions; then the texts of these records only.
    """
    ids = extractions.select("result_id", F.xxhash64("result_id").alias("h")).filter(F.col("result_id").isNotNull())
    share = min(1.0, 1.5 * limit / max(1, extractions.count()))
    below = ids.filter(F.col("h") <= int((share - 0.5) * (2**64 - 1))) if share < 1 else ids
    chosen = [r.result_id for r in below.distinct().orderBy("h", "result_id").limit(limit).collect()]
    picked = extractions.select("page_id", *read_columns())
    picked = picked.filter(F.col("content").isNotNull() & F.col("result_id").isin(chosen)).dropDuplicates(["result_id"]).orderBy("result_id").collect() if chosen else []
    wanted = sorted({r.page_id for r in picked if r.page_id is not None})
    markup = {r.page_id: r.html for r in pages.select("page_id", "html").filter(F.col("page_id").isin(wanted)).collect()} if wanted else {}
    return fit([(r.content, r.title, r.byline, r.sitename, r.host, r.link_count, r.density, markup.get(r.page_id)) for r in picked])


def marked_lines(extractions: DataFrame, pages: DataFrame, limit: int = TRAINING_PAGES) -> DataFrame:
    """result_id, boilerplate (numbers of the lines): one row per record, repeated deliveries once.

    Null and empty contents have no lines.  Only ids and numbers are shuffled.
    """
    model = train(extractions, pages, limit)
    src = extractions.select(*read_columns())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows = list(zip(*[b.column(i).to_pylist() for i in range(1, 8)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(boilerplate_lines(rows, model, known), pa.list_(pa.int64()))], names=["result_id", "boilerplate"])

    return src.mapInArrow(run, "result_id bigint, boilerplate array<bigint>").dropDuplicates(["result_id"])


def found_lines(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """result_id, line_no of every line that is not the page's own."""
    return marked_lines(extractions, pages).select("result_id", F.explode("boilerplate").alias("line_no"))


def main_content(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """result_id, content, removed: each record once with its own lines only; null contents stay null.

    The texts stay where they are read: the marking runs beside them and the
    repeated deliveries are removed by id afterwards.
    """
    model = train(extractions, pages)
    src = extractions.select(*read_columns())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            rows = list(zip(*[b.column(i).to_pylist() for i in range(1, 8)]))
            marked = boilerplate_lines(rows, model, known)
            kept = []
            for (content, *_), drop in zip(rows, marked):
                gone = set(drop)
                kept.append(None if content is None else re.sub(r"\n{3,}", "\n\n", "\n".join(x for i, x in enumerate(content.split("\n")) if i not in gone)).strip("\n"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array([len(m) for m in marked], pa.int64())], names=["result_id", "content", "removed"])

    return src.mapInArrow(run, "result_id bigint, content string, removed bigint").dropDuplicates(["result_id"])
