"""Page detectors: single-page shells, blocked pages, soft 404, binary types, model instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import rx

# Pattern banks.
JS_REQUIRED = [r"(?i)javascript\s+(is\s+)?(required|disabled|not\s+enabled)", r"(?i)please\s+enable\s+javascript", r"(?i)this\s+app\s+requires\s+javascript", r"(?i)you\s+need\s+to\s+enable\s+javascript"]
SPA_ROOT = [r"""<div\s+id=["']root["']\s*>""", r"""<div\s+id=["']app["']\s*>""", r"""<div\s+id=["']__next["']\s*>"""]
BLOCKED_HEAD = [
    r"(?i)<title>\s*just\s+a\s+moment", r"(?i)<title>[^<]*cloudflare", r"(?i)<title>[^<]*captcha", r"(?i)<title>[^<]*access\s+denied", r"(?i)<title>\s*client\s+challenge",
    r"(?i)<title>[^<]*rate\s+limit", r"(?i)window\._cf_chl_opt", r"(?i)/_px(Capt|vid|hc)", r"(?i)px-captcha", r"(?i)_incapsula_resource", r"(?i)<title>[^<]*pardon\s+our\s+interruption",
    r'(?i)action="[^"]*validateCaptcha', r"(?i)opfcaptcha\.amazon", r"(?i)csm-captcha-instrumentation", r"(?i)AwsWafIntegration", r'(?i)<div\s+id="challenge-container">\s*</div>',
]
BLOCKED_BODY = [
    r"(?i)captcha", r"(?i)are\s+you\s+a\s+(human|robot)", r"(?i)verify\s+you('re|\s+are)\s+(human|not\s+a\s+robot)", r"(?i)access\s+(denied|blocked)", r"(?i)bot\s+(detected|protection)",
    r"(?i)please\s+complete\s+the\s+security\s+check", r"(?i)cloudflare", r"(?i)ddos[\s-]protection", r"(?i)checking\s+your\s+browser", r"(?i)too\s+many\s+requests", r"(?i)rate\s+limit",
    r"(?i)<title>\s*just\s+a\s+moment",
]
SHELL_MARKERS = [('<div id="__next"', "nextjs-shell"), ('<div id="__nuxt"', "nuxt-shell"), ('<div id="app"></div>', "vue-empty-shell"), ('<div id="root"></div>', "react-empty-shell"), ("<noscript>you need to enable javascript", "noscript-warning"), ("<noscript>please enable javascript", "noscript-warning"), ("window.__INITIAL_STATE__", "ssr-hydration")]
BOT_MARKERS = [("cf-browser-verification", "cloudflare-challenge"), ("challenge-running", "cloudflare-challenge"), ("_cf_chl_opt", "cloudflare-challenge"), ("datadome", "datadome-protection"), ("perimeterx", "perimeterx-protection"), ("distil_r_captcha", "distil-protection"), ("incapsula", "incapsula-protection"), ("access denied", "access-denied")]
SOFT404 = ["page not found", "404 not found", "404 error", "page doesn't exist", "page does not exist", "this page could not be found", "the requested page", "sorry, we couldn't find", "oops! we couldn't find", "we can't find that page", "no longer exists", "has been removed", "has been deleted", "content not available", "content unavailable"]
BINARY_TYPES = ["image/", "audio/", "video/", "application/pdf", "application/zip", "application/gzip", "application/x-tar", "application/x-rar", "application/octet-stream", "application/x-msdownload", "application/vnd.ms-", "application/x-shockwave-flash", "font/"]
LLM_GATE = ["llm", "language model", "ai agent"]
LLM_TEXT = [r"(?i)instructions?\s+for\s+LLMs?", r"(?i)instructions?\s+for\s+(AI|language\s+model|large\s+language)", r"(?i)LLM\s+instructions?", r"(?i)AI\s+agent\s+instructions?"]
RETRYABLE = ["connection reset", "connection refused", "no such host", "i/o timeout", "eof"]
RETRYABLE_KINDS = ["ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "timeout", "dns-temporary"]
_NOSCRIPT = r"(?is)<noscript[^>]*>(.*?)</noscript>"


def body_part(h: Column) -> Column:
    """From the first <body to the first </body>; null unless both stand in this order behind the start."""
    low = F.lower(h)
    a, b = F.instr(low, "<body"), F.instr(low, "</body>")
    return F.when((a > 1) & (b > a), F.substring(h, a, b - a))


def body_part_sql(h: str) -> str:
    a, b = f"strpos(lower({h}), '<body')", f"strpos(lower({h}), '</body>')"
    return f"CASE WHEN {a} > 1 AND {b} > {a} THEN substr({h}, {a}, {b} - {a}) END"


def spa_signals(h: Column) -> Column:
    text = rx.trim(rx.replace(body_part(h), "<[^>]*>"))
    inside = F.lower(F.regexp_extract(h, rx.java(_NOSCRIPT), 1))
    return rx.compact(
        F.when(rx.matches(h, JS_REQUIRED), F.lit("js-required-message")),
        F.when(rx.matches(h, SPA_ROOT), F.lit("spa-root-element")),
        F.when(F.octet_length(text) < 200, F.lit("minimal-body-content")),
        F.when(F.contains(inside, F.lit("javascript")) | F.contains(inside, F.lit("enable")), F.lit("noscript-warning")),
    )


def spa_signals_sql(h: str) -> str:
    text = rx.trim_sql(rx.replace_sql(body_part_sql(h), "<[^>]*>"))
    inside = f"lower(regexp_extract({h}, {rx.q(_NOSCRIPT)}, 1))"
    return rx.list_sql(
        f"CASE WHEN {rx.matches_sql(h, JS_REQUIRED)} THEN 'js-required-message' END",
        f"CASE WHEN {rx.matches_sql(h, SPA_ROOT)} THEN 'spa-root-element' END",
        f"CASE WHEN strlen({text}) < 200 THEN 'minimal-body-content' END",
        f"CASE WHEN contains({inside}, 'javascript') OR contains({inside}, 'enable') THEN 'noscript-warning' END",
    )


def _bare_sql(h: str) -> str:
    x = body_part_sql(h)
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", "<[^>]*>"):
        x = rx.replace_sql(x, p)
    return rx.trim_sql(x)


def is_blocked(h: Column) -> Column:
    bare = body_part(h)
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", "<[^>]*>"):
        bare = rx.replace(bare, p)
    bare = rx.trim(bare)
    return rx.matches(h, BLOCKED_HEAD) | F.coalesce((F.octet_length(bare) <= 1000) & rx.matches(bare, BLOCKED_BODY), F.lit(False))


def is_blocked_sql(h: str) -> str:
    bare = _bare_sql(h)
    return f"({rx.matches_sql(h, BLOCKED_HEAD)} OR coalesce(strlen({bare}) <= 1000 AND {rx.matches_sql(bare, BLOCKED_BODY)}, false))"


def browser_reason(h: Column) -> Column:
    """Why a page needs a browser; empty: it does not."""
    low = F.lower(h)
    at = F.instr(low, "<body")
    few = (at > 0) & (F.size(rx.words(rx.replace(F.substring(low, at, F.length(low)), "<[^>]*>", " "))) < 100)
    out = F.lit("")
    for mark, why in reversed(BOT_MARKERS):
        out = F.when(F.contains(low, F.lit(mark)), F.lit(why)).otherwise(out)
    for mark, why in reversed(SHELL_MARKERS):
        out = F.when(F.contains(low, F.lit(mark)) & few, F.lit(why)).otherwise(out)
    return out


def browser_reason_sql(h: str) -> str:
    low = f"lower({h})"
    tags = rx.replace_sql(f"substr({low}, strpos({low}, '<body'))", "<[^>]*>", " ")
    few = f"strpos({low}, '<body') > 0 AND len({rx.words_sql(tags)}) < 100"
    arms = [f"WHEN contains({low}, {rx.q(m)}) AND {few} THEN {rx.q(w)}" for m, w in SHELL_MARKERS] + [f"WHEN contains({low}, {rx.q(m)}) THEN {rx.q(w)}" for m, w in BOT_MARKERS]
    return f"CASE {' '.join(arms)} ELSE '' END"


def soft404_hints(h: Column, length: Column) -> Column:
    low = F.lower(h)
    phrase = F.lit(None).cast("string")
    for p in reversed(SOFT404):
        phrase = F.when(F.contains(low, F.lit(p)), F.lit("error-text:" + p.replace(" ", "-"))).otherwise(phrase)
    title = F.regexp_extract(low, "(?s)<title>(.*?)</title>", 1)
    bad = F.contains(title, F.lit("404")) | F.contains(title, F.lit("not found")) | F.contains(title, F.lit("error"))
    short = F.when((length > 0) & (length < 500), F.concat(F.lit("very-short-content:"), length.cast("string"), F.lit("-bytes")))
    return rx.compact(short, phrase, F.when(bad, F.lit("error-title")))


def soft404_hints_sql(h: str, length: str) -> str:
    low = f"lower({h})"
    phrase = "CASE " + " ".join(f"WHEN contains({low}, {rx.q(p)}) THEN {rx.q('error-text:' + p.replace(' ', '-'))}" for p in SOFT404) + " END"
    title = f"regexp_extract({low}, '(?s)<title>(.*?)</title>', 1)"
    return rx.list_sql(
        f"CASE WHEN {length} > 0 AND {length} < 500 THEN 'very-short-content:' || {length} || '-bytes' END", phrase,
        f"CASE WHEN contains({title}, '404') OR contains({title}, 'not found') OR contains({title}, 'error') THEN 'error-title' END",
    )


def is_binary(content_type: Column) -> Column:
    """Null and empty types count as text."""
    ct = rx.trim(F.regexp_replace(rx.trim(F.lower(content_type)), "(?s)(?<=.);.*", ""))
    return F.coalesce(ct.rlike("^(?:" + "|".join(t.replace(".", r"\.") for t in BINARY_TYPES) + ")"), F.lit(False))


def is_binary_sql(ct: str) -> str:
    low = rx.trim_sql(f"lower({ct})")
    cut = rx.trim_sql(f"CASE WHEN strpos({low}, ';') > 1 THEN substr({low}, 1, strpos({low}, ';') - 1) ELSE {low} END")
    return f"coalesce(regexp_matches({cut}, {rx.q('^(?:' + '|'.join(t.replace('.', chr(92) + '.') for t in BINARY_TYPES) + ')')}), false)"


def has_llm_text(c: Column) -> Column:
    low = F.lower(c)
    gate = F.lit(False)
    for g in LLM_GATE:
        gate = gate | F.contains(low, F.lit(g))
    return F.coalesce(gate & rx.matches(c, LLM_TEXT), F.lit(False))


def has_llm_text_sql(x: str) -> str:
    gate = " OR ".join(f"contains(lower({x}), {rx.q(g)})" for g in LLM_GATE)
    return f"coalesce(({gate}) AND {rx.matches_sql(x, LLM_TEXT)}, false)"


def is_retryable(error: Column, kind: Column | None = None) -> Column:
    """kind: what sort of failure the fetcher noted (an errno name, timeout, dns-temporary), where it did."""
    said = F.coalesce(F.lower(error).rlike("|".join(RETRYABLE)), F.lit(False))
    return said if kind is None else said | F.coalesce(kind.isin(RETRYABLE_KINDS), F.lit(False))


def is_retryable_sql(x: str, kind: str | None = None) -> str:
    said = f"coalesce(regexp_matches(lower({x}), {rx.q('|'.join(RETRYABLE))}), false)"
    return said if kind is None else f"({said} OR coalesce({kind} IN ({', '.join(map(rx.q, RETRYABLE_KINDS))}), false))"
