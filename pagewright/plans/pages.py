"""Queries of the native page, text, header and change operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import detect, fingerprint, headers, markdown, rx, scoring
from pagewright.operators import blocks, neardup
from pagewright.plans.queries import register
from pagewright.session import site_of, table

C = F.col


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_in")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Records once each, with non-null text and counts."""
    return table(s, d, "extractions").dropDuplicates(["result_id"])


RECORDS = "(SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at) = 1)"
TEXTS = "(SELECT DISTINCT result_id, page_id, fetched_at, content, heading_count, link_count, paragraph_count FROM extractions)"


def _texts(s: SparkSession, d: str) -> DataFrame:
    """The deliveries as they came: functions run where the texts are read, and _once follows on their results."""
    return table(s, d, "extractions").select("result_id", "page_id", "fetched_at", "content", "heading_count", "link_count", "paragraph_count")


def _once(df: DataFrame, key: str = "result_id") -> DataFrame:
    """One row per id: repeated deliveries have the same text."""
    return df.dropDuplicates([key])


def _each(s: SparkSession, d: str, *columns) -> DataFrame:
    """Columns of every record, once each."""
    return _once(_texts(s, d).select("result_id", *columns))


def _plant(key: str, values: list) -> Column:
    """One of the values by the row's key, so that every branch of a rule is met on the whole table."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(C(key), F.lit(len(values))) + 1).cast("int"))


def _plant_sql(key: str, values: list) -> str:
    shown = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else rx.q(v) for v in values)
    return f"([{shown}])[{key} % {len(values)} + 1]"


# Detectors.
register("detect_spa", lambda s, d: _pages(s, d).select("page_id", detect.spa_signals(C("html")).alias("signals")).withColumn("is_spa", F.size("signals") >= 2),
         f"SELECT page_id, s AS signals, len(s) >= 2 AS is_spa FROM (SELECT page_id, {detect.spa_signals_sql('html')} AS s FROM page_in)")
#: Openings put before the pages: challenge pages of every kind, a long body that only mentions one, single-page shells, bot walls.
_BLOCKS_SEEN = [
    "", "<title>Just  a moment", "<TITLE>x cloudflare", "<title>a CAPTCHA", "<title>Access  Denied", "<title> client challenge", "<title>Rate limit", "window._cf_chl_opt", "/_pxCapt", "px-captcha", "_Incapsula_Resource",
    "<title>pardon our interruption", 'action="/x/validateCaptcha', "opfcaptcha.amazon", "csm-captcha-instrumentation", "AwsWafIntegration", '<div id="challenge-container"> </div>',
    *[f"<html><body><script>x</script>{x}</body>" for x in ("A captcha", "are you a  robot", "Verify you're human", "access blocked", "bot protection", "Please complete the security check", "Cloudflare", "DDoS-protection", "Checking your browser", "too many  requests", "rate limit", "all is well")],
    f"<html><body>captcha {'long text ' * 120}</body>", "no body: captcha",
]
_SHELLS_SEEN = ["", *[x for m, _ in detect.SHELL_MARKERS for x in (f"<html><body>{m}", f"<html><body>{m}{' word' * 120}")], *[f"<html><body>{m.upper()}" for m, _ in detect.BOT_MARKERS]]
_opened = lambda s, d, values: _pages(s, d).withColumn("html", F.concat(_plant("page_id", values), C("html")))
_opened_sql = lambda values: f"(SELECT page_id, {_plant_sql('page_id', values)} || html AS html FROM page_in)"
register("detect_blocked", lambda s, d: _opened(s, d, _BLOCKS_SEEN).select("page_id", detect.is_blocked(C("html")).alias("is_blocked")), f"SELECT page_id, {detect.is_blocked_sql('html')} AS is_blocked FROM {_opened_sql(_BLOCKS_SEEN)}")
_bare = lambda s, d: _pages(s, d).withColumn("html", F.concat(_plant("page_id", _SHELLS_SEEN), F.when(C("page_id") % 2 == 0, C("html")).otherwise("")))
_BARE_SQL = f"(SELECT page_id, {_plant_sql('page_id', _SHELLS_SEEN)} || CASE WHEN page_id % 2 = 0 THEN html ELSE '' END AS html FROM page_in)"
register("quick_needs_browser", lambda s, d: _bare(s, d).select("page_id", detect.browser_reason(C("html")).alias("reason")).withColumn("needs_browser", C("reason") != ""),
         f"SELECT page_id, r AS reason, r <> '' AS needs_browser FROM (SELECT page_id, {detect.browser_reason_sql('html')} AS r FROM {_BARE_SQL})")
register("soft404", lambda s, d: _pages(s, d).filter("status = 200").select("page_id", detect.soft404_hints(C("html"), C("content_length")).alias("hints")).withColumn("is_soft404", F.size("hints") >= 2),
         f"SELECT page_id, h AS hints, len(h) >= 2 AS is_soft404 FROM (SELECT page_id, {detect.soft404_hints_sql('html', 'content_length')} AS h FROM page_in WHERE status = 200)")
_LLM_SEEN = ["", " Instructions for LLMs", " instruction for a language model", " Instruction  for language models", "\nLLM instructions", " ai agent instructions", " instructions for AI"]
register("llm_content", lambda s, d: _each(s, d, detect.has_llm_text(F.concat("content", _plant("result_id", _LLM_SEEN))).alias("has_llm")),
         f"SELECT result_id, {detect.has_llm_text_sql('c')} AS has_llm FROM (SELECT result_id, content || {_plant_sql('result_id', _LLM_SEEN)} AS c FROM {TEXTS})")
_TYPES_SEEN = [None, "", " text/html ; charset=x", *[f" {x.title()}x; q=1" for x in detect.BINARY_TYPES], "x-image/png"]
register("binary_content_type", lambda s, d: _pages(s, d).select("page_id", detect.is_binary(F.coalesce(_plant("page_id", _TYPES_SEEN), headers.header(headers.lower_keys(C("headers")), "Content-Type"))).alias("is_binary")),
         f"SELECT page_id, {detect.is_binary_sql('coalesce(' + _plant_sql('page_id', _TYPES_SEEN) + ', ' + headers.header_sql('headers', 'Content-Type') + ')')} AS is_binary FROM page_in")
_ERRORS_SEEN = ["read tcp: Connection RESET by peer", "dial: connection refused", "lookup x: No such host", "read: i/o timeout", "unexpected EOF", "tls: bad certificate", "", None]
_KINDS_SEEN = [None, "ECONNRESET", "ETIMEDOUT", "timeout", "dns-temporary", "EACCES", "dns-not-found"]
register("retryable_errors", lambda s, d: _once(table(s, d, "extractions").select("result_id", detect.is_retryable(_plant("result_id", _ERRORS_SEEN), _plant("result_id", _KINDS_SEEN)).alias("retry"))),
         f"SELECT DISTINCT result_id, {detect.is_retryable_sql(_plant_sql('result_id', _ERRORS_SEEN), _plant_sql('result_id', _KINDS_SEEN))} AS retry FROM extractions")

# Markdown text.
register("md_cleanup", lambda s, d: _each(s, d, markdown.cleanup(C("content")).alias("content")), f"SELECT result_id, {markdown.cleanup_sql('content')} AS content FROM {TEXTS}")
register("md_counts", lambda s, d: _each(s, d, markdown.headings(C("content")).alias("headings"), markdown.links(C("content")).alias("links"), markdown.long_lines(C("content")).alias("paragraphs")),
         f"SELECT result_id, {rx.count_sql('content', markdown.HEADING)} AS headings, {rx.count_sql('content', markdown.LINK)} - {rx.count_sql('content', markdown.IMAGE)} AS links, {markdown.long_lines_sql('content')} AS paragraphs FROM {TEXTS}")
_FM = "'---' || chr(10) || 'site: x' || chr(10) || 'title: \"' || coalesce(sitename, '') || '\"' || chr(10) || '---' || chr(10) || content"
register("md_title", lambda s, d: _once(table(s, d, "extractions").select("result_id", "sitename", "content")).select("result_id", markdown.title(C("content")).alias("title"),
         markdown.title(F.concat(F.lit('---\nsite: x\ntitle: "'), F.coalesce("sitename", F.lit("")), F.lit('"\n---\n'), C("content"))).alias("front_title")),
         f"SELECT result_id, {markdown.title_sql('content')} AS title, {markdown.title_sql('fm')} AS front_title FROM (SELECT *, {_FM} AS fm FROM (SELECT DISTINCT result_id, sitename, content FROM extractions))")
_FRONTS_SEEN = ["---\r\na: 1\n---\r\n", "---\nb: 2\nc: 3\n---\n", "---\nopen: 1\n", "", " ---\nd: 4\n---\n", "---\n---\n"]
register("front_matter", lambda s, d: _each(s, d, markdown.front_matter(F.concat(_plant("result_id", _FRONTS_SEEN), C("content"))).alias("front")),
         f"SELECT result_id, {markdown.front_matter_sql('x')} AS front FROM (SELECT result_id, {_plant_sql('result_id', _FRONTS_SEEN)} || content AS x FROM {TEXTS})")
register("strip_invisible", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(markdown.strip_invisible(C("text"))).alias("digest")),
         f"SELECT doc_id, md5(regexp_replace(text, '{markdown.INVISIBLE}', '', 'g')) AS digest FROM documents")


def _quality(s: SparkSession, d: str) -> DataFrame:
    q = _each(s, d, *[c.alias(n) for n, c in markdown.quality(C("content")).items()])
    return q.withColumn("score", F.round(markdown.score({c: C(c) for c in q.columns}), 4)).withColumn("text_density", F.round("text_density", 6))


_QUALITY_SQL = f"SELECT result_id, {', '.join(f'{x} AS {n}' for n, x in markdown.quality_sql('content').items())} FROM {TEXTS}"
register("quality_metrics", _quality, f"SELECT * REPLACE (round(text_density, 6) AS text_density), round({markdown.SCORE_SQL}, 4) AS score FROM ({_QUALITY_SQL})")

# Confidence, validation, classes.
_SIGNALS = "coalesce(len(h), 0)"


def _classed(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "extractions").select("result_id", "page_id", F.octet_length("content").alias("length"), "heading_count", "paragraph_count", "status_code").dropDuplicates(["result_id"])
    p = _pages(s, d).select("page_id", detect.spa_signals(C("html")).alias("signals"), detect.is_blocked(C("html")).alias("blocked")).dropDuplicates(["page_id"])
    j = e.join(p, "page_id").withColumn("is_spa", F.size("signals") >= 2)
    return j.withColumn("conf", scoring.confidence(C("length"), C("heading_count"), C("paragraph_count"), F.size("signals"), C("blocked")))


_CLASSED = f"""
(SELECT *, len(signals) >= 2 AS is_spa, {scoring.confidence_sql('length', 'heading_count', 'paragraph_count', 'len(signals)', 'blocked')} AS conf,
  list_contains(signals, 'spa-root-element') AND (({scoring.confidence_sql('length', 'heading_count', 'paragraph_count', 'len(signals)', 'blocked')} >= 50 AND length > 500) OR (heading_count >= 1 AND paragraph_count >= 2)) AS hydrated,
  heading_count >= 2 AND paragraph_count >= 3 AND length > 1000 AS ssr
FROM (SELECT DISTINCT result_id, page_id, strlen(content) AS length, heading_count, paragraph_count, status_code FROM extractions)
JOIN (SELECT DISTINCT page_id, {detect.spa_signals_sql('html')} AS signals, {detect.is_blocked_sql('html')} AS blocked FROM page_in) USING (page_id))
"""
register("confidence", lambda s, d: _classed(s, d).select("result_id", C("conf").alias("confidence")), f"SELECT result_id, conf AS confidence FROM {_CLASSED}")
register("validation", lambda s, d: _each(s, d, scoring.validation(C("content"), C("heading_count"), C("paragraph_count"), C("link_count")).alias("v")).select("result_id", "v.*"),
         scoring.validation_sql(TEXTS, "result_id", "content", "heading_count", "paragraph_count", "link_count"))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    c = _classed(s, d)
    return c.withColumn("p", scoring.profile(C("conf"), C("length"), C("heading_count"), C("paragraph_count"), C("signals"), C("is_spa"), C("blocked")))


register("classify_page", lambda s, d: _profiles(s, d).select("result_id", "p.class", "p.outcome", "p.reasons", "p.confidence", "p.trustworthy", scoring.display(C("p")).alias("display")),
         f"SELECT result_id, p.class AS class, p.outcome AS outcome, p.reasons AS reasons, conf AS confidence, p.trustworthy AS trustworthy, concat_ws(' ', p.class, CASE WHEN p.trustworthy THEN '✓' ELSE '⚠' END, '→', p.outcome) AS display FROM (SELECT *, {scoring.PROFILE_SQL} AS p FROM {_CLASSED})")
register("class_rollup", lambda s, d: _profiles(s, d).select("p.class", "p.outcome").rollup("class", "outcome").agg(F.count(F.lit(1)).alias("n")),
         f"SELECT p.class AS class, p.outcome AS outcome, count(*) AS n FROM (SELECT {scoring.PROFILE_SQL} AS p FROM {_CLASSED}) GROUP BY ROLLUP (p.class, p.outcome)")
_STATUS_SEEN = [200, *scoring.STATUS_REASONS, 404, 500]
_REASONS = f"CASE status {' '.join(f'WHEN {k} THEN {rx.q(v)}' for k, v in scoring.STATUS_REASONS.items())} END"
register("status_profile", lambda s, d: _pages(s, d).select("page_id", F.coalesce(F.nullif(_plant("page_id", _STATUS_SEEN), F.lit(200)), C("status")).alias("status")).select("page_id", "status", scoring.status_reason(C("status")).alias("reason")).withColumn("is_blocked", C("reason").isNotNull()),
         f"SELECT page_id, status, {_REASONS} AS reason, {_REASONS} IS NOT NULL AS is_blocked FROM (SELECT page_id, coalesce(nullif({_plant_sql('page_id', _STATUS_SEEN)}, 200), status)::INT AS status FROM page_in)")

# Fingerprints and change.
register("fingerprint", lambda s, d: _each(s, d, fingerprint.fingerprint(C("content")).alias("fingerprint")), f"SELECT result_id, {fingerprint.fingerprint_sql('content')} AS fingerprint FROM {TEXTS}")
register("fingerprint_mail", lambda s, d: table(s, d, "documents").select("doc_id", fingerprint.fingerprint(C("text")).alias("fingerprint")), f"SELECT doc_id, {fingerprint.fingerprint_sql('text')} AS fingerprint FROM documents")


#: What the versions of a page add: nothing, noise that a fingerprint passes over, some words, a rewritten text.
_CHANGES_SEEN = ["", " 2024-01-02", " v1.2.3", " Something else was added by the desk of another town, twice", "\n\n# Moved\n\nThe page now says other things entirely."]
_changed_text = lambda: F.concat(F.when(F.pmod(F.col("result_id"), F.lit(7)) == 3, "").otherwise(F.col("content")), _plant("result_id", _CHANGES_SEEN))
_CHANGED_SQL = f"(CASE WHEN result_id % 7 = 3 THEN '' ELSE content END || {_plant_sql('result_id', _CHANGES_SEEN)})"


def _versions(s: SparkSession, d: str, *columns) -> DataFrame:
    """Each version of a page beside the one before.  Columns (of ``content``) are taken first, so that the window carries ids and hashes only."""
    v = _once(_texts(s, d).withColumn("content", _changed_text()).select("result_id", "page_id", "fetched_at", *columns))
    w = Window.partitionBy("page_id").orderBy("fetched_at", "result_id")
    names = [x for x in v.columns if x not in ("result_id", "page_id", "fetched_at")]
    return v.withColumns({"old_id": F.lag("result_id").over(w)} | {f"old_{x}": F.lag(x).over(w) for x in names}).filter("old_id is not null")


_VERSIONS = f"""(SELECT page_id, result_id, content, norm, lag(result_id) OVER w AS old_id, lag(norm) OVER w AS old, lag(content) OVER w AS old_content
FROM (SELECT *, {fingerprint.normal_sql('content')} AS norm FROM (SELECT * REPLACE ({_CHANGED_SQL} AS content) FROM {TEXTS})) WINDOW w AS (PARTITION BY page_id ORDER BY fetched_at, result_id))"""
_norm = lambda: fingerprint.normal(C("content"))
register("change_lag", lambda s, d: _versions(s, d, fingerprint.fingerprint(C("content")).alias("fp")).select("page_id", "old_id", C("result_id").alias("new_id"), (C("old_fp") != C("fp")).alias("changed")),
         f"SELECT page_id, old_id, result_id AS new_id, old <> norm AS changed FROM {_VERSIONS} WHERE old_id IS NOT NULL")
register("change_significance", lambda s, d: _versions(s, d, F.md5(_norm()).alias("fp"), fingerprint.long_words(_norm()).alias("words")).select("old_id", C("result_id").alias("new_id"), fingerprint.significance_of(C("old_fp") == C("fp"), C("old_words"), C("words")).alias("significance")),
         f"SELECT old_id, result_id AS new_id, {fingerprint.significance_sql('old', 'norm')} AS significance FROM {_VERSIONS} WHERE old_id IS NOT NULL")
register("near_duplicate_score", lambda s, d: _versions(s, d, F.md5(blocks.normal_block(C("content"))).alias("fp"), blocks.hashed_words(C("content")).alias("words")).select("old_id", C("result_id").alias("new_id"), blocks.shared_word_score(C("old_fp") == C("fp"), C("old_words"), C("words")).alias("score")),
         f"SELECT old_id, result_id AS new_id, {blocks.near_duplicate_score_sql('old_content', 'content')} AS score FROM {_VERSIONS} WHERE old_id IS NOT NULL")
_SETS = f"""(SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT id, regexp_extract_all(norm, '[\\p{{L}}\\p{{Nd}}]+') AS w FROM (SELECT norm, min(result_id) AS id FROM (SELECT result_id, {blocks.normal_block_sql('content')} AS norm FROM extractions) GROUP BY norm)) WHERE len(w) > 0)"""
register("near_dup_pairs", lambda s, d: neardup.near_duplicate_pairs(table(s, d, "extractions"), "result_id", "content"),
         f"""SELECT a, b, shared, na + nb - shared AS total FROM (SELECT x.id AS a, y.id AS b, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.s, y.s)) AS shared FROM {_SETS} x JOIN {_SETS} y ON x.id < y.id) WHERE 5 * shared >= 4 * (na + nb - shared)""")
register("near_dup_classes", lambda s, d: neardup.near_duplicate_classes(table(s, d, "extractions"), "result_id", "content"))


def _changed(s: SparkSession, d: str) -> DataFrame:
    """First against latest version of every page."""
    t = _each(s, d, "page_id", "fetched_at", fingerprint.fingerprint(C("content")).alias("fp"))
    at = F.struct("fetched_at", "result_id")
    old = t.filter("fetched_at < timestamp'2024-07-01'").groupBy("page_id").agg(F.max_by("fp", at).alias("old_fp"))
    new = t.filter("fetched_at >= timestamp'2024-07-01'").groupBy("page_id").agg(F.max_by("fp", at).alias("new_fp"))
    state = F.when(C("old_fp").isNull(), "added").when(C("new_fp").isNull(), "removed").when(C("old_fp") == C("new_fp"), "same").otherwise("changed")
    return old.join(new, "page_id", "full_outer").select("page_id", state.alias("state"))


register("content_changed_join", _changed, f"""
WITH t AS (SELECT page_id, fetched_at, result_id, {fingerprint.fingerprint_sql('content')} AS fp FROM {TEXTS}),
o AS (SELECT page_id, max_by(fp, (fetched_at, result_id)) AS old_fp FROM t WHERE fetched_at < TIMESTAMP '2024-07-01' GROUP BY page_id),
n AS (SELECT page_id, max_by(fp, (fetched_at, result_id)) AS new_fp FROM t WHERE fetched_at >= TIMESTAMP '2024-07-01' GROUP BY page_id)
SELECT page_id, CASE WHEN old_fp IS NULL THEN 'added' WHEN new_fp IS NULL THEN 'removed' WHEN old_fp = new_fp THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n USING (page_id)""")  # fmt: skip

# Block and line dedupe.
_BLOCKS = rf"""
WITH t AS (SELECT result_id, content FROM {TEXTS}),
lines AS (SELECT result_id, b.i AS bi, l.i AS li, l.x AS line, len(b.parts) AS n FROM (SELECT result_id, unnest(range(len(bs))) AS i, string_split(unnest(bs), chr(10)) AS parts FROM (SELECT result_id, string_split(content, chr(10) || chr(10)) AS bs FROM t)) b,
  LATERAL (SELECT unnest(range(len(b.parts))) AS i, unnest(b.parts) AS x) l),
marked AS (SELECT *, n > 1 AND regexp_matches(line, '^#{{1,6}}[\t\n\f\r ]+.+') AS head FROM lines),
grouped AS (SELECT *, sum(CASE WHEN head OR prev THEN 1 ELSE 0 END) OVER (PARTITION BY result_id, bi ORDER BY li) AS g FROM (SELECT *, coalesce(lag(head) OVER (PARTITION BY result_id, bi ORDER BY li), false) AS prev FROM marked)),
pieces AS (SELECT result_id, bi, g, string_agg(line, chr(10) ORDER BY li) AS block FROM grouped GROUP BY ALL),
bare AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY bi, g) - 1 AS pos, {rx.trim_sql('block')} AS trimmed FROM pieces),
hashed AS (SELECT *, CASE WHEN trimmed <> '' AND (strlen(trimmed) >= 20 OR starts_with(trimmed, '#')) THEN substr(sha256({blocks.normal_block_sql('trimmed')}), 1, 16) END AS hash FROM bare),
ranked AS (SELECT *, CASE WHEN hash IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY result_id, hash ORDER BY pos) END AS nth FROM hashed)
"""
register("dedupe_blocks", lambda s, d: blocks.blocks(_texts(s, d), "result_id", "content").select("result_id", C("pos").cast("bigint"), "hash", C("kept")).distinct(), f"{_BLOCKS} SELECT result_id, pos, hash, nth = 1 AS kept FROM ranked")
register("dedupe_metrics", lambda s, d: _once(blocks.dedupe(_texts(s, d), "result_id", "content")), f"""{_BLOCKS}
SELECT result_id, {rx.trim_sql("regexp_replace(string_agg(CASE WHEN nth = 1 THEN block END, chr(10) || chr(10) ORDER BY pos), '\n{3,}', chr(10) || chr(10), 'g')")} AS content, count(*) AS original_blocks,
  count_if(nth = 1 AND trimmed <> '') AS unique_blocks, count_if(nth > 1) AS duplicates_found, list_sort(coalesce(list_distinct(list({blocks.duplicate_kind_sql('trimmed')}) FILTER (nth > 1)), [])) AS duplicate_signals
FROM ranked GROUP BY result_id""")  # fmt: skip
register("dedupe_signals", lambda s, d: blocks.blocks(_texts(s, d), "result_id", "content").filter(~C("kept")).dropDuplicates(["result_id", "pos"]).groupBy(blocks.duplicate_kind(C("trimmed")).alias("signal")).agg(F.count(F.lit(1)).alias("n")),
         f"{_BLOCKS} SELECT {blocks.duplicate_kind_sql('trimmed')} AS signal, count(*) AS n FROM ranked WHERE nth > 1 GROUP BY 1")
register("dedupe_lines", lambda s, d: _once(blocks.dedupe_lines(_texts(s, d), "result_id", "content")), f"""
WITH l AS (SELECT result_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT result_id, string_split(content, chr(10)) AS p FROM {TEXTS})),
k AS (SELECT *, lower({rx.trim_sql('line')}) AS key FROM l)
SELECT result_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM (SELECT *, row_number() OVER (PARTITION BY result_id, key ORDER BY pos) AS nth FROM k) WHERE key = '' OR nth = 1 GROUP BY result_id""")  # fmt: skip


def _incremental(s: SparkSession, d: str) -> DataFrame:
    b = blocks.blocks(_texts(s, d), "result_id", "content").filter("hash is not null").select("result_id", "hash").distinct().join(_each(s, d, "fetched_at"), "result_id").select("result_id", "hash", (C("fetched_at") < F.expr("timestamp'2024-07-01'")).alias("old")).distinct()
    return blocks.unseen(b.filter("not old"), b.filter("old")).groupBy("result_id").agg(F.count(F.lit(1)).alias("new_blocks"))


register("dedupe_incremental_anti", _incremental, f"""{_BLOCKS}
SELECT result_id, count(DISTINCT hash) AS new_blocks FROM ranked WHERE hash IS NOT NULL AND result_id IN (SELECT result_id FROM extractions WHERE fetched_at >= TIMESTAMP '2024-07-01')
  AND hash NOT IN (SELECT hash FROM ranked WHERE hash IS NOT NULL AND result_id IN (SELECT result_id FROM extractions WHERE fetched_at < TIMESTAMP '2024-07-01')) GROUP BY result_id""")  # fmt: skip

# Headers.
_H = lambda: headers.lower_keys(C("headers"))
_NAMES_SEEN = [n.upper() if i % 2 else n for i, n in enumerate(headers.HEADERS)]


def _more_headers(s: SparkSession, d: str) -> DataFrame:
    """The pages' header maps with one more name, in either case."""
    name = _plant("page_id", _NAMES_SEEN)
    own = F.map_filter(F.coalesce(C("headers"), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) != F.lower(name))
    return _pages(s, d).select("page_id", F.map_concat(own, F.create_map(name, F.concat(F.lit("v"), C("page_id").cast("string")))).alias("headers"))


_MORE_SQL = f"""(SELECT page_id, map_concat(map_from_entries(list_filter(map_entries(coalesce(headers, MAP {{}})), lambda e: lower(e.key) <> lower(n))), MAP {{n: 'v' || page_id}}) AS headers FROM (SELECT *, {_plant_sql('page_id', _NAMES_SEEN)} AS n FROM page_in))"""
register("header_projection", lambda s, d: _more_headers(s, d).withColumn("h", _H()).select("page_id", *[headers.header(C("h"), n).alias(headers.name_of(n)) for n in headers.HEADERS]),
         "SELECT page_id, " + ", ".join(f"{headers.header_sql('headers', n)} AS {headers.name_of(n)}" for n in headers.HEADERS) + f" FROM {_MORE_SQL}")
#: Header maps that reach every rule, made from the page number.
_FAKE = [n for n in dict.fromkeys(r[0] for r in headers.CDN_RULES) if n != "X-Shopify-*"] + ["X-Shopify-Stage", "X-Shopify-Request-ID"]
_CASES = [(n, p) for n, p, *_ in headers.CDN_RULES if n != "X-Shopify-*"] + [("X-Shopify-Stage", ""), ("X-Shopify-Request-ID", ""), ("Server", "")]


def _fake_headers(s: SparkSession, d: str) -> DataFrame:
    case = F.pmod(C("page_id"), F.lit(len(_CASES)))
    name, part = F.lit(""), F.lit("")
    for i, (n, p) in enumerate(_CASES):
        name, part = F.when(case == i, n.upper() if i % 2 else n).otherwise(name), F.when(case == i, p).otherwise(part)
    made = F.create_map(name, F.concat(F.lit("1.1 a "), part, F.lit(" (X)")))
    return _pages(s, d).select("page_id", F.map_concat(F.map_filter(F.coalesce(C("headers"), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) != F.lower(name)), made).alias("headers"))


_FAKE_SQL = (
    "(SELECT page_id, map_concat(coalesce(headers, MAP {}), MAP {" + "CASE page_id % " + str(len(_CASES)) + " " + " ".join(f"WHEN {i} THEN {rx.q(n.upper() if i % 2 else n)}" for i, (n, _) in enumerate(_CASES)) + " END: "
    "'1.1 a ' || CASE page_id % " + str(len(_CASES)) + " " + " ".join(f"WHEN {i} THEN {rx.q(p)}" for i, (_, p) in enumerate(_CASES)) + " END || ' (X)'}) AS headers FROM page_in)"
)
register("cdn_fingerprint", lambda s, d: _fake_headers(s, d).select("page_id", headers.cdn(_H()).alias("c")).select("page_id", "c.*"),
         f"SELECT page_id, {headers.cdn_sql('headers')[0]} AS provider, {headers.cdn_sql('headers')[1]} AS signals FROM {_FAKE_SQL}")
_VIA = "CASE WHEN page_id % 3 = 0 THEN '2.0 edge (only), ' ELSE '' END || '1.1 varnish, HTTP/2 h' || page_id || ' (squid, x), (only), cache-' || page_id || ', ,1.0  b c'"
_VIA_HOP = f"""{{'protocol': CASE WHEN len(f) >= 2 THEN f[1] ELSE '' END, 'host': CASE WHEN len(f) >= 2 THEN f[2] ELSE coalesce(f[1], '') END, 'comment': c}}"""
register("via_hops", lambda s, d: _pages(s, d).select("page_id", headers.via_hops(F.concat(F.when(C("page_id") % 3 == 0, "2.0 edge (only), ").otherwise(""), F.lit("1.1 varnish, HTTP/2 h"), C("page_id").cast("string"), F.lit(" (squid, x), (only), cache-"), C("page_id").cast("string"), F.lit(", ,1.0  b c"))).alias("hops")).withColumn("proxy_layers", F.size("hops").cast("bigint")),
         f"""WITH p AS (SELECT page_id, list_filter(list_transform(string_split({_VIA}, ','), lambda x: {rx.trim_sql('x')}), lambda x: x <> '') AS parts FROM page_in),
e AS (SELECT page_id, list_transform(parts, lambda x: regexp_extract(x, '(?s)^[^(]*(\\(.*\\))', 1)) AS cs, parts FROM p),
h AS (SELECT page_id, list_transform(list_zip(parts, cs), lambda z: {{'f': {rx.words_sql("CASE WHEN z[2] <> '' THEN string_split(z[1], '(')[1] ELSE z[1] END")}, 'c': z[2]}}) AS zs FROM e),
o AS (SELECT page_id, list_filter(list_transform(zs, lambda z: {_VIA_HOP.replace('len(f)', 'len(z.f)').replace('f[1]', 'z.f[1]').replace('f[2]', 'z.f[2]').replace("'comment': c", "'comment': z.c")}), lambda s: s.host <> '' OR s.protocol <> '') AS hops FROM h)
SELECT page_id, hops, len(hops) AS proxy_layers FROM o""")  # fmt: skip
_TRACE = ("CASE page_id % 3 WHEN 0 THEN lpad(to_hex(page_id), 16, '0') WHEN 1 THEN lpad(to_hex(page_id), 32, '0') ELSE 'zz' END", "'00-' || upper(lpad(to_hex(page_id), 32, '0')) || '-aa-01'")


def _traced(s: SparkSession, d: str) -> DataFrame:
    i, hexed = C("page_id"), F.hex("page_id")
    b3 = F.when(i % 3 == 0, F.lpad(hexed, 16, "0")).when(i % 3 == 1, F.lpad(hexed, 32, "0")).otherwise("zz")
    entries = F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), F.lpad(hexed, 32, "0"), F.lit("-aa-01")), F.when(i % 2 == 0, "b3").otherwise("x-b3-traceid"), F.when(i % 2 == 0, F.concat(b3, F.lit("-1"))).otherwise(b3), F.when(i % 5 == 0, "x-amzn-trace-id").otherwise("x-trace-id"), F.lit("r"))
    return _pages(s, d).select("page_id", headers.trace(entries).alias("t")).select("page_id", "t.*")


register("trace_info", _traced, """
SELECT page_id, ['w3c', 'b3', CASE WHEN page_id % 5 = 0 THEN 'xray' ELSE 'generic' END] AS formats, CASE WHEN page_id % 3 < 2 THEN 'b3-w3c-match' ELSE '' END AS correlation FROM page_in""")
_LINK = "'<https://a/' || page_id || '>; rel=\"LLMS-txt\", <https://b/x>; rel=preload' || CASE WHEN page_id % 2 = 0 THEN ', <https://full/' || page_id || '>; rel=llms-full-txt' ELSE '' END"
register("llms_txt_url", lambda s, d: _pages(s, d).select("page_id", headers.llms_txt(F.concat(F.lit("<https://a/"), C("page_id").cast("string"), F.lit('>; rel="LLMS-txt", <https://b/x>; rel=preload'), F.when(C("page_id") % 2 == 0, F.concat(F.lit(", <https://full/"), C("page_id").cast("string"), F.lit(">; rel=llms-full-txt"))).otherwise("")), F.lit("/x")).alias("url")),
         "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://full/' || page_id ELSE 'https://a/' || page_id END AS url FROM page_in")
register("url_host", lambda s, d: table(s, d, "extractions").select("result_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("domain"), site_of(F.coalesce("final_url", "url")).alias("site")).distinct(),
         r"SELECT DISTINCT result_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS domain, regexp_replace(lower(regexp_extract(coalesce(final_url, url), '^[A-Za-z]+://([^/:?#]*)', 1)), '^(www\.|m\.)', '') AS site FROM extractions")


_OPTIONS = {"timeout_ms": 30000, "max_retries": 0, "max_retry_wait_ms": 10000}
_AGENT = "pagewright/1.0"


def _configured(s: SparkSession, d: str) -> DataFrame:
    """Every option of each page's domain; only positive numbers and non-empty texts replace the defaults."""
    cfg = table(s, d, "domain_cfg").groupBy(F.lower(F.trim("domain")).alias("site")).agg(*[F.max(n).alias(n) for n in _OPTIONS], F.max(F.trim("user_agent")).alias("user_agent"))
    p = _pages(s, d).select("page_id", site_of(C("url")).alias("site"))
    options = [F.coalesce(F.when(C(n) > 0, C(n)), F.lit(v)).cast("bigint").alias(n) for n, v in _OPTIONS.items()]
    return p.join(cfg, "site", "left").select("page_id", *options, F.coalesce(F.nullif("user_agent", F.lit("")), F.lit(_AGENT)).alias("user_agent"))


register("domain_config_join", _configured, rf"""
SELECT page_id, {', '.join(f'coalesce(CASE WHEN {n} > 0 THEN {n} END, {v})::BIGINT AS {n}' for n, v in _OPTIONS.items())}, coalesce(nullif(user_agent, ''), '{_AGENT}') AS user_agent
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)), '^(www\.|m\.)', '') AS site FROM page_in)
LEFT JOIN (SELECT lower(trim(domain)) AS site, {', '.join(f'max({n}) AS {n}' for n in _OPTIONS)}, max(trim(user_agent)) AS user_agent FROM domain_cfg GROUP BY 1) USING (site)""")


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Two runs by site name: mean size of the records before and after a day, and which run gave more by a fifth."""
    e = _once(table(s, d, "extractions").select("result_id", F.lower(F.trim("sitename")).alias("name"), "length", (C("fetched_at") < F.expr("timestamp'2024-07-01'")).alias("old"))).filter("name is not null")
    runs = e.groupBy("name").agg(F.avg(F.when(C("old"), C("length"))).alias("baseline"), F.avg(F.when(~C("old"), C("length"))).alias("current"))
    verdict = F.when(C("baseline").isNull(), "new").when(C("current").isNull(), "gone").when(C("current") > C("baseline") * 1.2, "win").when(C("baseline") > C("current") * 1.2, "loss").otherwise("tie")
    return runs.select("name", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"), verdict.alias("verdict"), (C("current") >= C("baseline") * 0.85).alias("no_regression"))


register("baseline_compare", _compared, f"""
SELECT name, round(b, 4) AS baseline, round(c, 4) AS current, CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'gone' WHEN c > b * 1.2 THEN 'win' WHEN b > c * 1.2 THEN 'loss' ELSE 'tie' END AS verdict, c >= b * 0.85 AS no_regression
FROM (SELECT lower(trim(sitename)) AS name, avg(length) FILTER (fetched_at < TIMESTAMP '2024-07-01') AS b, avg(length) FILTER (fetched_at >= TIMESTAMP '2024-07-01') AS c FROM {RECORDS} WHERE sitename IS NOT NULL GROUP BY 1)""")
register("redirect_chain", lambda s, d: _pages(s, d).select("page_id", F.size(F.coalesce(F.slice("redirect_chain", 1, 10), F.array().cast("array<string>"))).cast("bigint").alias("redirects"), F.coalesce(F.get("redirect_chain", F.least(F.size("redirect_chain"), F.lit(10)) - 1), F.lit("")).alias("last_from")),
         "SELECT page_id, coalesce(len(redirect_chain[1:10]), 0) AS redirects, coalesce(redirect_chain[1:10][-1], '') AS last_from FROM page_in")
register("redirect_lag", lambda s, d: _pages(s, d).select("page_id", F.posexplode("redirect_chain").alias("hop", "to_url")).distinct().withColumn("from_url", F.lag("to_url").over(Window.partitionBy("page_id").orderBy("hop"))).select("page_id", C("hop").cast("bigint"), "from_url", "to_url"),
         "SELECT page_id, hop, lag(u) OVER (PARTITION BY page_id ORDER BY hop) AS from_url, u AS to_url FROM (SELECT DISTINCT page_id, unnest(range(len(redirect_chain))) AS hop, unnest(redirect_chain) AS u FROM page_in)")
register("winner_tally", lambda s, d: table(s, d, "extractions").select("result_id", F.octet_length("content").alias("ours"), C("length").alias("theirs")).distinct().agg(F.count_if(C("ours") > C("theirs") * 1.2).alias("wins"), F.count_if(C("theirs") > C("ours") * 1.2).alias("losses"), F.count(F.lit(1)).alias("total"), F.round(F.avg("ours"), 4).alias("mean")),
         "SELECT count_if(o > t * 1.2) AS wins, count_if(t > o * 1.2) AS losses, count(*) AS total, round(avg(o), 4) AS mean FROM (SELECT DISTINCT result_id, strlen(content) AS o, length AS t FROM extractions)")


def _medians(s: SparkSession, d: str) -> DataFrame:
    """Exact medians from counts of equal lengths, which are summed before the shuffle; a category has few distinct lengths."""
    n = _once(table(s, d, "extractions").select("result_id", "status_code", "length")).filter("length is not null").groupBy("status_code", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("status_code")
    n = n.withColumns({"upto": F.sum("n").over(w.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(w)})
    low, high = F.floor((C("total") + 1) / 2), F.floor(C("total") / 2) + 1
    return n.groupBy("status_code").agg(((F.min(F.when(C("upto") >= low, C("length"))) + F.min(F.when(C("upto") >= high, C("length")))) / 2).alias("median"))


register("median_size", _medians, "SELECT status_code, median(length) AS median FROM (SELECT DISTINCT result_id, status_code, length FROM extractions) GROUP BY 1")


def _rollup(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of a category hashed in 65,536 ranges first, then the ranges' hashes: no task holds a category."""
    e = _once(table(s, d, "extractions").select("result_id", C("status_code").alias("category"), fingerprint.fingerprint(C("content")).alias("fp")))
    ranges = e.groupBy("category", F.substring("fp", 1, 4).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("fp")), ""), 256).alias("h"))
    return ranges.groupBy("category").agg(F.sum("n").alias("fixtures"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ""), 256).alias("aggregate_hash"))


register("fixture_rollup", _rollup, f"""
WITH e AS (SELECT category, substr(fp, 1, 4) AS r, fp FROM (SELECT status_code AS category, {fingerprint.fingerprint_sql('content')} AS fp FROM {RECORDS})),
k AS (SELECT category, r, count(*) AS n, sha256(string_agg(fp, '' ORDER BY fp)) AS h FROM e GROUP BY 1, 2)
SELECT category, sum(n)::BIGINT AS fixtures, sha256(string_agg(h, '' ORDER BY r)) AS aggregate_hash FROM k GROUP BY 1""")
