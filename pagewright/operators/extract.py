"""Pages to extraction records: native detectors, one Arrow stage, native scoring.

Everything that needs the HTML tree happens in one pass over the text in one
Arrow function, so each page crosses to Python once.  The fallbacks, scores
and classes are columns over its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import detect, domops, fingerprint, headers, htmltree, ldjson, markdown, rx, scoring
from pagewright.operators import blocks


@dataclass(frozen=True)
class ExtractOptions:
    """dedupe: remove repeated blocks; fail_fast: note an error for hopeless single-page shells; fast_mode: leave pages that need a browser unextracted."""

    dedupe: bool = False
    fail_fast: bool = False
    fast_mode: bool = False


def map_text(df: DataFrame, key: str, text: str, fn: Callable[[str | None], list[dict] | dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of fn(text) (one dict or a list of dicts) beside the key, in one Arrow pass."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                got = fn(t)
                got = [got] if isinstance(got, dict) else got
                ids += [i] * len(got)
                rows += got
            cols = [b.column(0).take(pa.array(ids, pa.int64()))] + [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *arrow.names])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


_S, _L, _B = pa.string(), pa.int64(), pa.bool_()


def _tree(t: str | None) -> htmltree.Dom:
    return htmltree.parse(htmltree.sanitize(htmltree.preprocess(t or "")))


def sanitized(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    return map_text(df, key, text, lambda t: {"html": htmltree.sanitize(htmltree.preprocess(t or ""))}, "html string", pa.schema([("html", _S)]))


def index_pages(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    arrow = pa.schema([("is_index", _B), ("articles", _L), ("headlines", _L), ("confidence", _L), ("markdown", _S)])
    return map_text(df, key, text, lambda t: domops.index_page(_tree(t)), "is_index boolean, articles bigint, headlines bigint, confidence bigint, markdown string", arrow)


def card_items(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    arrow = pa.schema([("pos", _L), ("title", _S), ("url", _S), ("teaser", _S)])
    return map_text(df, key, text, lambda t: [c | {"pos": i} for i, c in enumerate(domops.cards(_tree(t)))], "pos bigint, title string, url string, teaser string", arrow)


def fallback_texts(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    arrow = pa.schema([("content", _S), ("length", _L), ("headings", _L), ("links", _L)])
    return map_text(df, key, text, lambda t: domops.fallback_text(_tree(t)), "content string, length bigint, headings bigint, links bigint", arrow)


def dom_nodes(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """The flat DOM: key, pre, last, parent, tag, attrs, text; subtree of a node = pre between its pre and last."""

    def rows(t: str | None) -> list[dict]:
        d = htmltree.parse(t)
        return [{"pre": i, "last": d.last[i], "parent": d.parent[i], "tag": d.tag[i], "attrs": list(d.attrs[i].items()), "text": d.text[i]} for i in range(len(d.tag))]

    arrow = pa.schema([("pre", _L), ("last", _L), ("parent", _L), ("tag", _S), ("attrs", pa.map_(_S, _S)), ("text", _S)])
    return map_text(df, key, text, rows, "pre bigint, last bigint, parent bigint, tag string, attrs map<string,string>, text string", arrow)


_NODE = "preorder bigint, parent bigint, ref string, depth bigint, role string, tag string, name string, selector string, interactive boolean, level bigint, href string, value string, checked boolean, disabled boolean"
_NODE_ARROW = pa.schema([("preorder", _L), ("parent", _L), ("ref", _S), ("depth", _L), ("role", _S), ("tag", _S), ("name", _S), ("selector", _S), ("interactive", _B), ("level", _L), ("href", _S), ("value", _S), ("checked", _B), ("disabled", _B)])


def snapshot_rows(df: DataFrame, key: str = "page_id", text: str = "html", interactive_only: bool = False) -> DataFrame:
    return map_text(df, key, text, lambda t: domops.snapshot_nodes(htmltree.parse(t), interactive_only), _NODE, _NODE_ARROW)


def snapshot_texts(df: DataFrame, key: str = "page_id", text: str = "html", max_tokens: int = 0) -> DataFrame:
    """Compact text and nested JSON of the accessibility tree."""

    def row(t: str | None) -> dict:
        nodes = domops.snapshot_nodes(htmltree.parse(t))
        return {"compact": domops.compact_text(nodes), "tree": domops.snapshot_tree(nodes, max_tokens)}

    return map_text(df, key, text, row, "compact string, tree string", pa.schema([("compact", _S), ("tree", _S)]))


def ldjson_blocks(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    arrow = pa.schema([("pos", _L)] + [(f, _S) for f in ldjson.FIELDS])
    return map_text(df, key, text, lambda t: [b | {"pos": i} for i, b in enumerate(ldjson.blocks_of(t))], "pos bigint, " + ", ".join(f"{f} string" for f in ldjson.FIELDS), arrow)


def ldjson_markdown(blocks_col: Column) -> Column:
    """Markdown of an array of block structs, with nulls as empty."""
    f = lambda b, k: F.coalesce(b[k], F.lit(""))

    def one(b: Column) -> Column:
        meta = F.concat_ws(" · ", F.when(f(b, "author") != "", F.concat(F.lit("By "), b["author"])), F.nullif(f(b, "datePublished"), F.lit("")), F.nullif(f(b, "publisher"), F.lit("")))
        parts = F.concat_ws("\n\n", F.when(f(b, "headline") != "", F.concat(F.lit("## "), b["headline"])), F.nullif(meta, F.lit("")), F.nullif(f(b, "description"), F.lit("")))
        return F.when((f(b, "headline") != "") | (f(b, "description") != ""), parts)

    return rx.trim(F.array_join(F.transform(blocks_col, one), "\n\n"))


def _main(t: str | None) -> dict:
    """The Arrow stage: everything read off one page's tree."""
    text = htmltree.preprocess(t or "")
    ld = ldjson.blocks_of(text)
    text = htmltree.sanitize(text)
    dom = htmltree.parse(text)
    a = domops.article(dom)
    node = a["node"]
    inside = [dom.tag[k] for k in dom.within(node)]
    return {
        "title": a["title"], "byline": a["byline"], "excerpt": a["excerpt"], "sitename": a["sitename"], "markdown": domops.markdown(dom, node),
        "headings": sum(t in domops.HEADINGS for t in inside), "links": inside.count("a"), "paragraphs": inside.count("p"), "bytes": domops.size(text),
        "index": domops.index_page(dom), "fallback": domops.fallback_text(dom), "ldjson": ld,
    }


_MAIN = (
    "title string, byline string, excerpt string, sitename string, markdown string, headings bigint, links bigint, paragraphs bigint, bytes bigint, "
    "index struct<is_index boolean, articles bigint, headlines bigint, confidence bigint, markdown string>, fallback struct<content string, length bigint, headings bigint, links bigint>, "
    "ldjson array<struct<" + ", ".join(f"{f} string" for f in ldjson.FIELDS) + ">>"
)
_MAIN_ARROW = pa.schema([
    ("title", _S), ("byline", _S), ("excerpt", _S), ("sitename", _S), ("markdown", _S), ("headings", _L), ("links", _L), ("paragraphs", _L), ("bytes", _L),
    ("index", pa.struct([("is_index", _B), ("articles", _L), ("headlines", _L), ("confidence", _L), ("markdown", _S)])), ("fallback", pa.struct([("content", _S), ("length", _L), ("headings", _L), ("links", _L)])),
    ("ldjson", pa.list_(pa.struct([(f, _S) for f in ldjson.FIELDS]))),
])


def articles(df: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """title, byline, excerpt, sitename and Markdown of the main article, with its raw counts."""
    return map_text(df, key, text, _main, _MAIN, _MAIN_ARROW).select(key, "title", "byline", "excerpt", "sitename", "markdown", "headings", "links", "paragraphs")


def minimal_markdown(df: DataFrame, key: str = "page_id", text: str = "html", preprocess: bool = True) -> DataFrame:
    """key, title, byline, markdown: the main article only, neither sanitised nor cleaned up; its plain text where the conversion fails."""

    def row(t: str | None) -> dict:
        dom = htmltree.parse(htmltree.preprocess(t or "") if preprocess else t)
        a = domops.article(dom)
        try:
            shown = domops.markdown(dom, a["node"])
        except (RecursionError, ValueError):
            shown = dom.content(a["node"])
        return {"title": a["title"], "byline": a["byline"], "markdown": shown}

    return map_text(df, key, text, row, "title string, byline string, markdown string", pa.schema([("title", _S), ("byline", _S), ("markdown", _S)]))


def is_markdown(headers_col: Column) -> Column:
    """Whether the answer is Markdown by its Content-Type; null maps are not."""
    return F.coalesce(F.contains(headers.header(headers.lower_keys(headers_col), "Content-Type"), F.lit("text/markdown")), F.lit(False))


def markdown_records(pages: DataFrame, dedupe: bool = False) -> DataFrame:
    """Answers that are Markdown (page_id, url, body, status, headers) as extraction records; all of it native.

    Only a 200 is trusted; other answers have their computed confidence, and
    those of a blocking status its profile.  Null bodies count as empty.
    """
    c = F.col
    link = lambda h: headers.header(headers.lower_keys(c("headers")), h)
    out = pages.select("page_id", "url", c("status").cast("int").alias("status"), markdown.cleanup(F.coalesce("body", F.lit(""))).alias("content"), headers.llms_txt(link("Link"), link("X-LLMs-Txt")).alias("llms_txt_url"))
    if dedupe:
        out = blocks.mark_blocks(out, "content", to="marked")
        out = out.withColumns(blocks.dedupe_columns(c("marked"))).drop("marked")
    out = out.withColumns({"n": F.octet_length("content").cast("bigint"), "h": markdown.headings(c("content")), "l": markdown.links(c("content")), "p": markdown.long_lines(c("content"))})
    fine = c("status") == 200
    conf = F.when(fine, F.lit(100).cast("bigint")).otherwise(scoring.confidence(c("n"), c("h"), c("p"), F.lit(0), F.lit(False)))
    reason = scoring.status_reason(c("status"))
    profile = lambda kind, outcome, why, sure, trusted: F.struct(F.lit(kind).alias("class"), F.lit(outcome).alias("outcome"), F.array(why).alias("reasons"), sure.alias("confidence"), F.lit(trusted).alias("trustworthy"))
    out = out.withColumn("confidence", conf).withColumn("quality_info", F.struct(*[v.alias(k) for k, v in markdown.quality(c("content")).items()]))
    return out.select(
        "page_id", "url", markdown.title(c("content")).alias("title"), "content", c("n").alias("length"), "status", "confidence", reason.isNotNull().alias("is_blocked"), c("h").alias("heading_count"), c("l").alias("link_count"), c("p").alias("paragraph_count"),
        F.round(markdown.score(c("quality_info")), 4).alias("quality"), "quality_info",
        F.when(reason.isNotNull(), profile("blocked", "needs-browser", reason, c("confidence"), False)).when(fine, profile("ssr", "extract", F.lit("content-negotiation-markdown"), c("confidence"), True)).alias("profile"),
        fingerprint.fingerprint(c("content")).alias("fingerprint"), scoring.validation(c("content"), c("h"), c("p"), c("l")).alias("validation"), detect.has_llm_text(c("content")).alias("has_llm_content"), "llms_txt_url",
        *([c("original_blocks"), c("unique_blocks"), c("duplicates_found"), c("duplicate_signals")] if dedupe else []),
    )


def extract_negotiated(pages: DataFrame, options: "ExtractOptions" = None) -> DataFrame:
    """Pages of both kinds (page_id, url, html, status, headers): Markdown answers as they are, the others through ``extract``."""
    options = options or ExtractOptions()
    kind = is_markdown(F.col("headers"))
    plain = markdown_records(pages.filter(kind).withColumn("body", F.col("html")), options.dedupe)
    return extract(pages.filter(~kind), options).unionByName(plain, allowMissingColumns=True)


def extract(pages: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """One extraction record per distinct page_id of ``pages`` (page_id, url, html, status).

    Null HTML counts as empty; extra columns are left out.  Pages are read and
    parsed once: with fast_mode those that need a browser are told apart
    natively and go through the Arrow stage without their text.  Repeated
    pages are removed at the end, so that no HTML is shuffled.
    """
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.col("status").cast("int").alias("status"))
    hurried = detect.browser_reason(F.col("html")) if options.fast_mode else F.lit("")
    carried = F.struct(
        "page_id", "url", "status", detect.spa_signals(F.col("html")).alias("signals"), detect.is_blocked(F.col("html")).alias("blocked"),
        F.when(F.col("status") == 200, detect.soft404_hints(F.col("html"), F.octet_length("html"))).alias("soft404"), hurried.alias("browser_reason"),
    )
    # The tree stage keeps the row's own columns, so nothing is joined back.
    kept = "struct<page_id bigint, url string, status int, signals array<string>, blocked boolean, soft404 array<string>, browser_reason string>"
    carried = src.select(carried.alias("row"), "html").select("row", F.when(F.col("row.browser_reason") == "", F.col("html")).alias("html"))
    rows = _with_tree(carried, kept)
    conf = lambda n, h, p, s: scoring.confidence(n, h, p, s, F.col("blocked"))
    c = F.col
    out = rows.select("row.*", "tree.*")
    out = out.withColumns({"content": markdown.cleanup(c("markdown")), "ld_markdown": ldjson_markdown(c("ldjson"))})
    out = out.withColumns({"n": F.octet_length("content").cast("bigint"), "h": c("headings"), "l": F.greatest(c("links"), markdown.links(c("content")))})
    out = out.withColumn("conf", conf(c("n"), c("h"), c("paragraphs"), F.size("signals")))
    out = out.withColumn("validation", scoring.validation(c("content"), c("h"), c("paragraphs"), c("l")))
    use = c("index.is_index") & (((c("n") < 4000) | (c("h") < 5)) & (c("index.headlines") >= 5) | ((c("h") < 4) & (c("index.headlines") >= 10)))
    out = out.withColumn("use_index", use)
    pick = lambda yes, no: F.when(c("use_index"), yes).otherwise(no)
    out = out.withColumns({
        "content": pick(c("index.markdown"), c("content")), "n": pick(F.octet_length("index.markdown").cast("bigint"), c("n")), "h": pick(c("index.headlines"), c("h")), "l": pick(markdown.links(c("index.markdown")), c("l")),
        "conf": pick(c("index.confidence"), c("conf")), "signals2": F.concat("signals", pick(F.array(F.lit("index-page-fallback")), F.array().cast("array<string>"))),
    })
    out = out.withColumn("use_text", (c("n") < 500) & ~c("blocked") & (c("bytes") > 10000) & (c("fallback.length") > c("n")) & (c("fallback.length") >= 200))
    pick = lambda yes, no: F.when(c("use_text"), yes).otherwise(no)
    out = out.withColumns({"content": pick(c("fallback.content"), c("content")), "n": pick(c("fallback.length"), c("n")), "h": pick(c("fallback.headings"), c("h")), "l": pick(c("fallback.links"), c("l")), "signals2": F.concat("signals2", pick(F.array(F.lit("text-fallback")), F.array().cast("array<string>")))})
    out = out.withColumn("conf", F.when(c("use_text"), conf(c("n"), c("h"), c("paragraphs"), F.size("signals2"))).otherwise(c("conf")))
    out = out.withColumn("use_ld", (c("ld_markdown") != "") & (c("n") < 5000))
    out = out.withColumns({"content": F.when(c("use_ld"), F.when(c("content") != "", F.concat("content", F.lit("\n\n---\n\n"), "ld_markdown")).otherwise(c("ld_markdown"))).otherwise(c("content")), "signals2": F.concat("signals2", F.when(c("use_ld"), F.array(F.lit("ldjson-supplemented"))).otherwise(F.array().cast("array<string>")))})
    out = out.withColumn("n", F.octet_length("content").cast("bigint"))
    out = out.withColumn("conf", F.when(c("use_ld"), conf(c("n"), c("h"), c("paragraphs"), F.size("signals2"))).otherwise(c("conf")))
    out = out.withColumn("is_spa", (F.size("signals") >= 2) | (c("conf") < 30))
    if options.dedupe:
        out = blocks.mark_blocks(out, "content", to="marked")  # inside the row: the tree stage runs once
        out = out.withColumns(blocks.dedupe_columns(c("marked"))).drop("marked")
        out = out.withColumn("n", F.octet_length("content").cast("bigint"))
    quality = {k: v.alias(k) for k, v in markdown.quality(c("content")).items()}
    out = out.withColumn("quality_info", F.struct(*quality.values()))
    out = out.withColumn("profile", scoring.profile(c("conf"), c("n"), c("h"), c("paragraphs"), c("signals2"), c("is_spa"), c("blocked")))
    reason = scoring.status_reason(c("status"))
    blocked_profile = F.struct(F.lit("blocked").alias("class"), F.lit("needs-browser").alias("outcome"), F.concat(c("profile.reasons"), F.array(reason)).alias("reasons"), c("profile.confidence").alias("confidence"), F.lit(False).alias("trustworthy"))
    error = F.when(c("is_spa") & (c("conf") < 30), F.concat(F.lit("SPA detected with low confidence ("), c("conf").cast("string"), F.lit("%)"))) if options.fail_fast else F.lit(None).cast("string")
    # A page left to a browser has its reason as its only issue.
    hurried = c("browser_reason") != ""
    v = c("validation")
    issue = F.when(hurried, F.array("browser_reason")).otherwise(v["issues"])
    out = out.withColumn("validation", v.withField("issues", issue).withField("is_valid", v["is_valid"] & ~hurried).withField("needs_browser", v["needs_browser"] | hurried).withField("confidence", F.when(hurried, 0.1).otherwise(v["confidence"])))
    if options.fast_mode:
        out = out.withColumns({x: F.when(~hurried, c(x)) for x in ("title", "content", "byline", "excerpt", "sitename", "n", "conf", "h", "l", "paragraphs", "is_spa", "profile", "quality_info", "signals2")})
    final = out.select(
        "page_id", "url", "title", "content", "byline", "excerpt", "sitename", c("n").alias("length"), "status", c("conf").alias("confidence"), "is_spa", (c("blocked") | reason.isNotNull()).alias("is_blocked"), c("signals2").alias("spa_signals"),
        c("h").alias("heading_count"), c("l").alias("link_count"), c("paragraphs").alias("paragraph_count"), F.round(markdown.score(c("quality_info")), 4).alias("quality"), "quality_info",
        F.when(reason.isNotNull(), blocked_profile).otherwise(c("profile")).alias("profile"), fingerprint.fingerprint(c("content")).alias("fingerprint"), "validation",
        (F.size(F.coalesce("soft404", F.array())) >= 2).alias("is_soft404"), F.coalesce("soft404", F.array().cast("array<string>")).alias("soft404_hints"), c("ldjson").alias("ldjson_blocks"), detect.has_llm_text(c("content")).alias("has_llm_content"),
        F.when(hurried, F.concat(F.lit("needs-browser: "), "browser_reason")).otherwise(error).alias("error"),
        *([c("original_blocks"), c("unique_blocks"), c("duplicates_found"), c("duplicate_signals")] if options.dedupe else []),
    )
    return final.dropDuplicates(["page_id"])


def _with_tree(df: DataFrame, kept: str) -> DataFrame:
    """row (carried as it is), tree (what the Arrow stage reads off html; null where html is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(list(_MAIN_ARROW))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else _main(t) for t in b.column(1).to_pylist()], kind)], names=["row", "tree"])

    return df.mapInArrow(run, f"row {kept}, tree struct<{_MAIN}>")
