"""Queries of the tree, extraction, JSON-LD and fetching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import detect, fingerprint, headers, htmltree, markdown, rx, scoring
from pagewright.functions import sql as sql_functions
from pagewright.operators import extract, fetching
from pagewright.plans.queries import SQL, register
from pagewright.session import table
from pagewright.sources import sinks

C = F.col


def _pages(s: SparkSession, d: str) -> DataFrame:
    """The pages as they came; _once follows where the texts have been read."""
    return table(s, d, "page_in").select("page_id", "url", "html", "status")


def _once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key: a page delivered twice has the same text."""
    return df.dropDuplicates(list(key or ("page_id",)))


PAGES = "(SELECT DISTINCT page_id, url, html, status FROM page_in)"
#: What sanitising removes: every kind of element, hidden inputs, hidden elements in every notation and nested, comments, invisible characters.
_GONE_SEEN = [
    "", *[f"<{x} a='b'>gone</{x}>" for x in htmltree.REMOVED if x not in ("embed", "link", "meta")], "<embed src=x/>", "<link rel=y/>", "<meta name=z/>", "<!-- c\n<b> -->", '<input TYPE="hidden" value="1">', "<input name=q type='hidden'/>",
    '<div aria-hidden="true"><div>x</div> h</div>', "<p hidden>y</p>", '<p hidden="">y</p>', '<span class="a sr-only">z</span>', "<span class='visually-hidden b'>z</span>", '<i class="screen-reader-only">z</i>',
    '<b style="display: none">w</b>', '<b style="color:red;visibility:hidden">w</b>', '<b style="opacity:0;">w</b>', '<b style="font-size:0">w</b>', "<br hidden>", "\u200b\u2060\ufeff", '<div hidden><p hidden>a</p>b</div>',
]
#: What looks like it and stays.
_KEPT_SEEN = ["", '<input type="text" value="hidden">', '<div aria-hidden="false">x</div>', '<p data-hidden="1">y</p>', '<b style="opacity:0.5">w</b>', '<i title="hidden">z</i>']


def _with_extra(s: SparkSession, d: str) -> DataFrame:
    gone = F.element_at(F.array(*map(F.lit, _GONE_SEEN)), (F.pmod("page_id", F.lit(len(_GONE_SEEN))) + 1).cast("int"))
    kept = F.element_at(F.array(*map(F.lit, _KEPT_SEEN)), (F.pmod("page_id", F.lit(len(_KEPT_SEEN))) + 1).cast("int"))
    return _pages(s, d).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), gone, kept)))


_KEPT_SQL = f"([{', '.join(map(rx.q, _KEPT_SEEN))}])[page_id % {len(_KEPT_SEEN)} + 1]"
register("sanitize_full", lambda s, d: _once(extract.sanitized(_with_extra(s, d)).select("page_id", F.md5("html").alias("digest"))), f"SELECT page_id, md5(replace(html, '<article>', '<article>' || {_KEPT_SQL})) AS digest FROM {PAGES}")
_TAGS_SEEN = ["a", "li", "article", "p", "h1", "nav", "ul", "footer", "div", "title"]
register("dom_counts", lambda s, d: _once(extract.dom_nodes(_pages(s, d)).filter(C("tag").isin(_TAGS_SEEN)).select("page_id", "pre", "tag"), "page_id", "pre").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")), f"""
SELECT page_id, tag, n FROM (SELECT page_id, unnest([{', '.join(map(rx.q, _TAGS_SEEN))}]) AS tag, unnest([{', '.join(f"len(regexp_extract_all(html, '<{x}[{chr(92)}s>]'))" for x in _TAGS_SEEN)}]) AS n FROM {PAGES}) WHERE n > 0""")  # fmt: skip


def _links_in_nav(s: SparkSession, d: str) -> DataFrame:
    """Descendants by the interval of the ancestor: links inside navigation."""
    n = _once(extract.dom_nodes(_pages(s, d)).filter("tag in ('a', 'nav')").select("page_id", "pre", "last", "tag", F.element_at("attrs", "href").alias("href")), "page_id", "pre")
    nav = n.filter("tag = 'nav'").select("page_id", C("pre").alias("a"), C("last").alias("b"))
    inside = n.filter("tag = 'a'").join(nav, "page_id").filter("pre between a + 1 and b")
    return inside.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("href").alias("first_href"))


register("dom_descendants", _links_in_nav, f"""
SELECT page_id, len(h) AS links, list_min(h) AS first_href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS h FROM {PAGES}) WHERE len(h) > 0""")
register("snapshot_nodes", lambda s, d: _once(extract.snapshot_rows(_pages(s, d)), "page_id", "preorder"))
#: A page with every kind of role and state, whose tree SQL can write down; titles and links are the page's own.
_STATES = (
    '<body><header>H</header><nav aria-label="Main"><a href="{u}">{t}</a><a>no link</a></nav><main><h2 id="top">{t}</h2><section aria-label="S"><p>x</p></section><section>plain</section><img alt="Pic" src=i><img src=j>'
    '<form class="js-f ff"><input type="checkbox" checked><input type="hidden"><input type="search" value="q" placeholder="find"><button disabled>Go</button><textarea>w</textarea><select><option>o</option></select></form>'
    '<div role="tab" tabindex="0">Tab</div><div onclick="x()">no role</div></main></body>'
)
_STATE_ROWS = [  # parent, depth, role, tag, name, selector, interactive, level, href, value, checked, disabled
    (-1, 0, "banner", "header", "'H'", "header:nth-of-type(1)", False, 0, "''", "", None, False),
    (-1, 0, "navigation", "nav", "'Main'", "nav:nth-of-type(1)", False, 0, "''", "", None, False),
    (1, 1, "link", "a", "t", "a:nth-of-type(1)", True, 0, "u", "", None, False),
    (-1, 0, "main", "main", "nm", "main:nth-of-type(1)", False, 0, "''", "", None, False),
    (3, 1, "heading", "h2", "t", "#top", False, 2, "''", "", None, False),
    (3, 1, "region", "section", "'S'", "section:nth-of-type(1)", False, 0, "''", "", None, False),
    (5, 2, "paragraph", "p", "'x'", "p:nth-of-type(1)", False, 0, "''", "", None, False),
    (3, 1, "image", "img", "'Pic'", "img:nth-of-type(1)", False, 0, "''", "", None, False),
    (3, 1, "form", "form", "'Gowo'", "form.ff", False, 0, "''", "", None, False),
    (8, 2, "checkbox", "input", "''", "input:nth-of-type(1)", True, 0, "''", "", True, False),
    (8, 2, "textbox", "input", "''", "input:nth-of-type(2)", False, 0, "''", "", None, False),
    (8, 2, "searchbox", "input", "'find'", "input:nth-of-type(3)", True, 0, "''", "q", None, False),
    (8, 2, "button", "button", "'Go'", "button:nth-of-type(1)", True, 0, "''", "", None, True),
    (8, 2, "textbox", "textarea", "'w'", "textarea:nth-of-type(1)", True, 0, "''", "", None, False),
    (8, 2, "combobox", "select", "'o'", "select:nth-of-type(1)", True, 0, "''", "", None, False),
    (14, 3, "option", "option", "'o'", "option:nth-of-type(1)", False, 0, "''", "", None, False),
    (3, 1, "tab", "div", "'Tab'", "div:nth-of-type(1)", True, 0, "''", "", None, False),
]


def _states(s: SparkSession, d: str) -> DataFrame:
    """t: the page's title without what HTML would read, cut to 60; u: its URL."""
    first, *rest = _STATES.replace("{t}", "\x00t\x00").replace("{u}", "\x00u\x00").split("\x00")
    title = F.trim(F.substring(F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), "[^A-Za-z ]+", ""), 1, 60))
    parts = [F.lit(first), *[{"t": C("t"), "u": C("url")}.get(x, F.lit(x)) for x in rest]]
    return _pages(s, d).withColumn("t", F.regexp_replace(title, " +", " ")).select("page_id", F.concat(*parts).alias("html"))


def _state_sql(interactive: bool = False) -> str:
    keep = {i for i, r in enumerate(_STATE_ROWS) if r[6]}
    for i in sorted(keep, reverse=True):
        while (i := _STATE_ROWS[i][0]) >= 0:
            keep.add(i)
    shown = lambda x: "NULL::BOOLEAN" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else rx.q(x)
    rows = " UNION ALL ".join(
        f"SELECT page_id, {i} AS preorder, {p} AS parent, 'e{i + 1}' AS ref, {depth} AS depth, {rx.q(role)} AS role, {rx.q(tag)} AS tag, {name} AS name, {rx.q(sel)} AS selector, {shown(act)} AS interactive, {level} AS level, {href} AS href, {rx.q(value)} AS value, {shown(ch)} AS checked, {shown(dis)} AS disabled FROM p"
        for i, (p, depth, role, tag, name, sel, act, level, href, value, ch, dis) in enumerate(_STATE_ROWS) if not interactive or i in keep
    )
    return f"""WITH q AS (SELECT page_id, url AS u, trim(regexp_replace(trim(substr(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[^A-Za-z ]+', '', 'g'), 1, 60)), ' +', ' ', 'g')) AS t FROM {PAGES}),
l AS (SELECT *, trim(t || 'xplainGowoTabno role') AS w FROM q), p AS (SELECT *, CASE WHEN strlen(w) > 80 THEN substr(w, 1, 77) || '...' ELSE w END AS nm FROM l)
{rows}"""


register("snapshot_states", lambda s, d: _once(extract.snapshot_rows(_states(s, d)), "page_id", "preorder"), _state_sql())
register("snapshot_states_interactive", lambda s, d: _once(extract.snapshot_rows(_states(s, d), interactive_only=True), "page_id", "preorder"), _state_sql(True))
register("snapshot_roles", lambda s, d: _once(extract.snapshot_rows(_pages(s, d)).select("page_id", "preorder", "role"), "page_id", "preorder").filter("role in ('listitem', 'link', 'article', 'navigation', 'contentinfo')").groupBy("page_id", "role").agg(F.count(F.lit(1)).alias("n")), f"""
SELECT page_id, role, n FROM (SELECT page_id, unnest(['listitem', 'link', 'article', 'navigation', 'contentinfo']) AS role, unnest([len(regexp_extract_all(html, '<li>')), len(regexp_extract_all(html, '<a href="[^"]')), len(regexp_extract_all(html, '<article>')),
  len(regexp_extract_all(html, '<nav>')), len(regexp_extract_all(html, '<footer>'))]) AS n FROM {PAGES}) WHERE n > 0""")  # fmt: skip
register("snapshot_interactive", lambda s, d: _once(extract.snapshot_rows(_pages(s, d), interactive_only=True), "page_id", "preorder"))
register("snapshot_compact", lambda s, d: _once(extract.snapshot_texts(_pages(s, d)).select("page_id", "compact")))
register("snapshot_truncated", lambda s, d: _once(extract.snapshot_texts(_pages(s, d), max_tokens=200).select("page_id", "tree")))
register("text_fallback", lambda s, d: _once(extract.fallback_texts(_pages(s, d))))


def _index(s: SparkSession, d: str) -> DataFrame:
    """The pages without articles of their own, with page_id % 60 cards at their end: articles in every other page, linked headings in the rest."""
    i = lambda k: k.cast("string")
    text = lambda k: F.concat(F.repeat(F.lit("T"), k.cast("int")), F.lit("</a></h2><p>"), F.repeat(F.lit("word "), k.cast("int") + 3), F.lit("</p>"))
    card = lambda k: F.concat(F.when(C("page_id") % 2 == 0, "<article>").otherwise("<div>"), F.lit('<h2><a href="/c/'), i(k), F.lit('">'), text(k), F.when(C("page_id") % 2 == 0, "</article>").otherwise("</div>"))
    cards = F.array_join(F.transform(F.when(C("page_id") % 60 > 0, F.sequence(F.lit(1).cast("bigint"), C("page_id") % 60)).otherwise(F.array().cast("array<bigint>")), card), "")
    bare = F.replace(F.replace(F.replace("html", F.lit("article>"), F.lit("section>")), F.lit("</body>")), F.lit("</html>"))
    return _pages(s, d).withColumn("html", F.concat(bare, F.lit("</nav></section></div>"), cards, F.lit("</body>")))


_N, _A = "page_id % 60", "CASE WHEN page_id % 2 = 0 THEN page_id % 60 ELSE 0 END"
_BASE = f"CASE WHEN {_A} >= 5 THEN 50 WHEN {_N} >= 8 THEN 40 ELSE 0 END"
register("index_pages", lambda s, d: _once(extract.index_pages(_index(s, d)).withColumn("markdown", F.md5("markdown"))), f"""
SELECT page_id, b > 0 AS is_index, {_A} AS articles, least({_N}, 50) AS headlines, CASE WHEN b > 0 THEN least(100, b + 2 * least({_N}, 50)) ELSE 0 END AS confidence, md5(CASE WHEN b > 0 THEN coalesce(m, '') ELSE '' END) AS markdown
FROM (SELECT page_id, {_BASE} AS b FROM {PAGES}) LEFT JOIN (SELECT page_id, string_agg('## [' || title || '](' || url || ')' || chr(10) || CASE WHEN teaser <> '' THEN chr(10) || teaser || chr(10) ELSE '' END || chr(10), '' ORDER BY pos) AS m FROM (CARDS) GROUP BY page_id) USING (page_id)""".replace("(CARDS)", "CARDS"))
_CARDS = f"""(SELECT page_id, {_N} - i AS pos, repeat('T', i::INT) AS title, '/c/' || i AS url, CASE WHEN (i + 3) * 5 - 1 > CASE WHEN page_id % 2 = 0 THEN 20 ELSE 30 END AND (i + 3) * 5 - 1 < 500 THEN trim(repeat('word ', (i + 3)::INT)) ELSE '' END AS teaser FROM {PAGES}, (SELECT unnest(range(1, 60)) AS i) WHERE i <= {_N} AND {_N} - i < 50)"""
SQL["index_pages"] = SQL["index_pages"].replace("FROM CARDS", f"FROM {_CARDS}")
register("index_cards", lambda s, d: _once(extract.card_items(_index(s, d)), "page_id", "pos"), f"SELECT * FROM {_CARDS}")
register("readability", lambda s, d: _once(extract.articles(_pages(s, d))))
register("extract_minimal", lambda s, d: _once(extract.minimal_markdown(_pages(s, d))))
_CODES = "([200, 200, 404, 503, 429])[result_id % 5 + 1]"
_LINKED = """CASE result_id % 3 WHEN 0 THEN '</llms.txt>; rel="llms-txt"' WHEN 1 THEN '<https://x.test/s.css>; rel=preload' END"""


def _answers(s: SparkSession, d: str) -> DataFrame:
    """The records' texts as Markdown answers of several statuses, with and without links."""
    code = F.element_at(F.array(*map(F.lit, (200, 200, 404, 503, 429))), (C("result_id") % 5 + 1).cast("int"))
    link = F.when(C("result_id") % 3 == 0, '</llms.txt>; rel="llms-txt"').when(C("result_id") % 3 == 1, "<https://x.test/s.css>; rel=preload")
    made = F.create_map(F.lit("content-type"), F.lit("text/markdown"), F.lit("Link"), F.coalesce(link, F.lit("")), F.lit("X-LLMs-Txt"), F.when(C("result_id") % 3 == 1, "/fallback.txt").otherwise(""))
    return table(s, d, "extractions").select(C("result_id").alias("page_id"), "url", F.concat("content", F.when(C("result_id") % 4 == 0, " LLM instructions").otherwise("")).alias("body"), code.alias("status"), made.alias("headers"))


_ANSWER = f"""(SELECT *, {markdown.cleanup_sql('content')} AS body, {_CODES} AS code FROM (SELECT result_id, any_value(content) || CASE WHEN result_id % 4 = 0 THEN ' LLM instructions' ELSE '' END AS content FROM extractions GROUP BY 1))"""
_HLP = f"{rx.count_sql('body', markdown.HEADING)} AS h, {rx.count_sql('body', markdown.LINK)} - {rx.count_sql('body', markdown.IMAGE)} AS l, {markdown.long_lines_sql('body')} AS p"
register("extract_markdown", lambda s, d: _once(extract.markdown_records(_answers(s, d)).select("page_id", "title", F.md5("content").alias("digest"), "length", "status", "confidence", "is_blocked", "heading_count", "link_count", "paragraph_count", "profile.class", "profile.outcome", "profile.trustworthy", "fingerprint", "has_llm_content", "llms_txt_url")), f"""
SELECT result_id AS page_id, {markdown.title_sql('body')} AS title, md5(body) AS digest, strlen(body) AS length, code AS status, CASE WHEN code = 200 THEN 100 ELSE {scoring.confidence_sql('strlen(body)', 'h', 'p', '0', 'false')} END AS confidence, code IN (503, 429) AS is_blocked,
  h AS heading_count, l AS link_count, p AS paragraph_count, CASE code WHEN 200 THEN 'ssr' WHEN 404 THEN NULL ELSE 'blocked' END AS class, CASE code WHEN 200 THEN 'extract' WHEN 404 THEN NULL ELSE 'needs-browser' END AS outcome, CASE WHEN code <> 404 THEN code = 200 END AS trustworthy,
  {fingerprint.fingerprint_sql('body')} AS fingerprint, {detect.has_llm_text_sql('body')} AS has_llm_content, CASE result_id % 3 WHEN 0 THEN '/llms.txt' WHEN 1 THEN '/fallback.txt' ELSE '' END AS llms_txt_url FROM (SELECT *, {_HLP} FROM {_ANSWER})""")  # fmt: skip
_CT = headers.header_sql("headers", "Content-Type")
_HEAD_CODES = "([200, 404, 410, 405, status])[page_id % 5 + 1]"
_head_code = lambda: F.element_at(F.array(*map(F.lit, (200, 404, 410, 405)), C("status")), (C("page_id") % 5 + 1).cast("int"))
_head_type = lambda: F.when(C("page_id") % 3 == 0, "Image/PNG; q=1").otherwise(headers.header(headers.lower_keys(C("headers")), "Content-Type"))
register("head_preflight", lambda s, d: _once(table(s, d, "page_in").select("page_id", fetching.preflight_error(_head_code(), _head_type()).alias("error"))), f"""
SELECT DISTINCT page_id, CASE WHEN code = 200 AND {detect.is_binary_sql('ct')} THEN 'skipped binary content: ' || ct WHEN code IN (404, 410) THEN 'HEAD preflight returned ' || code END AS error
FROM (SELECT page_id, {_HEAD_CODES} AS code, CASE WHEN page_id % 3 = 0 THEN 'Image/PNG; q=1' ELSE {_CT} END AS ct FROM page_in)""")
register("extract_full", lambda s, d: extract.extract(_pages(s, d)))
#: What SQL can read of the records: the title, and every native signal.
register("extract_signals", lambda s, d: extract.extract(_pages(s, d)).select("page_id", "title", "status", "is_blocked", "is_soft404", "soft404_hints", F.array_except("spa_signals", F.array(F.lit("index-page-fallback"), F.lit("text-fallback"), F.lit("ldjson-supplemented"))).alias("spa_signals")), f"""
SELECT page_id, {rx.trim_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, status, {detect.is_blocked_sql('html')} OR status IN ({', '.join(map(str, scoring.STATUS_REASONS))}) AS is_blocked, len(h) >= 2 AS is_soft404, h AS soft404_hints, {detect.spa_signals_sql('html')} AS spa_signals
FROM (SELECT *, CASE WHEN status = 200 THEN {detect.soft404_hints_sql('html', 'strlen(html)')} ELSE [] END AS h FROM {PAGES})""")  # fmt: skip
_ART = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
register("readability_counts", lambda s, d: _once(extract.articles(_pages(s, d))).filter("headings > 0").select("page_id", "headings", "paragraphs", "links"), f"""
SELECT page_id, len(regexp_extract_all(a, '<h[1-6][>\\s]')) AS headings, len(regexp_extract_all(a, '<p[>\\s]')) AS paragraphs, len(regexp_extract_all(a, '<a[>\\s]')) AS links FROM (SELECT page_id, {_ART} AS a FROM {PAGES}) WHERE headings > 0""")  # fmt: skip
register("extract_dedupe", lambda s, d: extract.extract(_pages(s, d), extract.ExtractOptions(dedupe=True)).select("page_id", "length", "original_blocks", "unique_blocks", "duplicates_found"))
register("extract_fast_mode", lambda s, d: extract.extract(_pages(s, d), extract.ExtractOptions(fast_mode=True)).groupBy("profile.class", "error").agg(F.count(F.lit(1)).alias("n")))

# JSON-LD: scripts made of the blocks' own values, read back.
_KEYS = "type headline description author datePublished publisher url keywords".split()


def _scripts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "ldjson_blocks").distinct()
    obj = lambda x: F.to_json(F.struct(x["type"].alias("@type"), x["headline"].alias("headline"), x["description"].alias("description"), F.struct(x["author"].alias("name")).alias("author"), x["datePublished"].alias("datePublished"), F.struct(x["publisher"].alias("name")).alias("publisher"), x["url"].alias("url"), x["keywords"].alias("keywords")))
    return b.select("page_id", F.array_join(F.transform("blocks", lambda x: F.concat(F.lit('<script type="application/ld+json">'), obj(x), F.lit("</script>"))), "").alias("html"))


register("ldjson_blocks", lambda s, d: extract.ldjson_blocks(_scripts(s, d)), f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id, k ORDER BY i) - 1 AS pos, {', '.join(f"coalesce(b.{k}, '') AS {k}" for k in _KEYS)}
FROM (SELECT page_id, k, unnest(blocks) AS b, unnest(range(len(blocks))) AS i FROM (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT page_id, blocks FROM ldjson_blocks))) WHERE coalesce(b.type, '') <> '' OR coalesce(b.headline, '') <> '' OR coalesce(b.description, '') <> ''""")  # fmt: skip
_META = "concat_ws(' · ', 'By ' || nullif(b.author, ''), nullif(b.datePublished, ''), nullif(b.publisher, ''))"
_LD_MD = f"CASE WHEN coalesce(b.headline, '') <> '' OR coalesce(b.description, '') <> '' THEN concat_ws(chr(10) || chr(10), '## ' || nullif(b.headline, ''), nullif({_META}, ''), nullif(b.description, '')) END"
register("ldjson_markdown", lambda s, d: table(s, d, "ldjson_blocks").distinct().filter("blocks is not null").select("page_id", extract.ldjson_markdown(C("blocks")).alias("markdown")),
         f"SELECT page_id, {rx.trim_sql(f'coalesce(array_to_string(list_filter(list_transform(blocks, lambda b: {_LD_MD}), lambda x: x IS NOT NULL), chr(10) || chr(10)), {rx.q(str())})')} AS markdown FROM (SELECT DISTINCT page_id, blocks FROM ldjson_blocks) WHERE blocks IS NOT NULL")

# Fetching rules.
register("retry_after", lambda s, d: _once(_pages(s, d).select("page_id")).select("page_id", F.explode(F.array(F.col("page_id").cast("string"), F.concat(F.lit("1m"), F.pmod("page_id", F.lit(60)).cast("string")), F.lit("-2.5"), F.lit("soon"), F.lit("Mon, 01 Jan 2024 00:01:30 GMT"))).alias("value"))
         .select("page_id", "value", headers.retry_after_seconds(C("value"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds")),
         f"""SELECT page_id, v.value AS value, v.s AS seconds FROM (SELECT page_id, unnest([{{'value': page_id::VARCHAR, 's': page_id::DOUBLE}}, {{'value': '1m' || (page_id % 60), 's': 60.0 + page_id % 60}}, {{'value': '-2.5', 's': -2.5}}, {{'value': 'soon', 's': NULL}}, {{'value': 'Mon, 01 Jan 2024 00:01:30 GMT', 's': 90.0}}]) AS v FROM {PAGES})""")


def _attempts(s: SparkSession, d: str) -> DataFrame:
    p = _once(_pages(s, d).select("page_id")).select(C("page_id").alias("req_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    k = F.pmod(C("req_id") + C("attempt") * 7, F.lit(5))
    return p.select("req_id", C("attempt").cast("bigint"), F.when(k == 0, 200).when(k == 1, 429).when(k == 2, 502).when(k == 3, 504).otherwise(0).alias("status"), F.when(k == 4, F.lit("i/o timeout")).alias("error"), F.pmod("req_id", F.lit(9)).cast("double").alias("retry_after_s"))


register("retry_simulation", lambda s, d: fetching.retry_log(_attempts(s, d), 3, 6.0, 7.0), f"""
WITH a AS (SELECT page_id AS req_id, t AS attempt, (page_id + t * 7) % 5 AS k, (page_id % 9)::DOUBLE AS ra FROM {PAGES}, (SELECT unnest(range(4)) AS t)),
w AS (SELECT *, CASE WHEN k >= 2 THEN least(power(2, attempt), 6.0) WHEN k = 1 AND ra <= 6 THEN ra END AS wait FROM a),
s AS (SELECT *, sum(coalesce(wait, 0)) OVER (PARTITION BY req_id ORDER BY attempt) AS waited FROM w),
e AS (SELECT *, CASE WHEN k = 0 THEN 'success' WHEN wait IS NULL OR attempt >= 3 THEN 'exhausted' WHEN waited > 7 THEN 'timeout' ELSE 'retrying' END AS event FROM s),
f AS (SELECT *, sum(CASE WHEN event <> 'retrying' THEN 1 ELSE 0 END) OVER (PARTITION BY req_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e)
SELECT req_id, attempt, CASE WHEN event = 'retrying' THEN wait END AS wait_s, event FROM f WHERE coalesce(ended, 0) = 0""")  # fmt: skip


def _robots(s: SparkSession, d: str) -> DataFrame:
    n = C("max_retries").cast("string")
    body = F.concat(F.lit("# x\nUser-agent: *\nCrawl-delay: 1\nCrawl-Delay: "), n, F.lit(".5\n\nUser-Agent: fetcher\nDisallow: /\ncrawl-delay: "), F.when(C("timeout_ms") > 10000, n).otherwise("x"), F.lit("\nUser-agent: other\nCrawl-delay: 99"))
    return table(s, d, "domain_cfg").filter("max_retries is not null").select("domain", body.alias("body")).dropDuplicates(["domain"])


register("robots_crawl_delay", lambda s, d: fetching.crawl_delays(_robots(s, d), "Fetcher/2.0"),
         "SELECT domain, min(CASE WHEN timeout_ms > 10000 AND max_retries > 0 THEN max_retries::DOUBLE ELSE max_retries + 0.5 END) AS delay_s FROM domain_cfg WHERE max_retries IS NOT NULL GROUP BY domain")
register("robots_cache_ttl", lambda s, d: fetching.fresh_rules(table(s, d, "extractions").select(C("sitename").alias("domain"), "fetched_at", (C("status_code") == 200).alias("ok")).filter("domain is not null").distinct(), F.lit("2024-06-01").cast("timestamp")).select("domain", F.unix_micros("fetched_at").alias("fetched_us")),
         """SELECT domain, epoch_us(max(fetched_at)) AS fetched_us FROM (SELECT DISTINCT sitename AS domain, fetched_at, status_code = 200 AS ok FROM extractions WHERE sitename IS NOT NULL) WHERE fetched_at <= TIMESTAMP '2024-06-01' AND fetched_at + CASE WHEN ok THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END > TIMESTAMP '2024-06-01' GROUP BY domain""")  # fmt: skip

# Sinks as columns.
register("sink_front_matter", lambda s, d: table(s, d, "extractions").dropDuplicates(["result_id"]).select("result_id", sinks.front_matter({"title": C("title"), "url": C("url"), "length": C("length").cast("string")}, C("content")).alias("doc")),
         """SELECT result_id, any_value('---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'url: ' || coalesce(url, '') || chr(10) || 'length: ' || coalesce(length::VARCHAR, '') || chr(10) || '---' || chr(10) || chr(10) || content) AS doc FROM extractions GROUP BY result_id""")  # fmt: skip
register("sink_file_name", lambda s, d: _once(table(s, d, "extractions").select("result_id", sinks.file_stem(C("url")).alias("stem"), sinks.file_path(C("url"), C("fetched_at"), "md").alias("path")), "result_id"),
         "SELECT DISTINCT result_id, replace(replace(split_part(url, '//', 2), '/', '_'), ':', '_') AS stem, 'renders/' || replace(replace(split_part(url, '//', 2), '/', '_'), ':', '_') || strftime(fetched_at, '_%Y%m%d_%H%M%S.md') AS path FROM extractions")
register("sql_functions", sql_functions.demo, sql_functions.demo_sql())
