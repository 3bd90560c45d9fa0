"""Response-header columns, CDN and trace fingerprints, Via hops, crawl and retry rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import rx

# The projected response headers.
HEADERS = """Content-Type ETag Last-Modified Content-Encoding Server X-Forwarded-For Via Connection Age Cache-Control X-Cache Vary X-Cache-Hits Surrogate-Control CF-Cache-Status
X-Served-By X-Fastly-Request-ID X-Akamai-Transformed X-Akamai-Session-Info X-Akamai-Request-ID X-Request-Id X-Correlation-Id X-Varnish X-CDN X-Trace-Id X-B3-TraceId X-B3-SpanId
X-B3-ParentSpanId X-B3-Sampled b3 Traceparent Tracestate X-Amzn-Trace-Id NEL Report-To Permissions-Policy Expect-CT Feature-Policy Reporting-Endpoints Content-Security-Policy
Content-Security-Policy-Report-Only Cross-Origin-Resource-Policy Cross-Origin-Embedder-Policy Cross-Origin-Opener-Policy Strict-Transport-Security X-Content-Type-Options X-Frame-Options
Referrer-Policy X-XSS-Protection X-Permitted-Cross-Domain-Policies X-Download-Options Clear-Site-Data Timing-Allow-Origin Origin-Agent-Cluster Document-Policy Accept-CH Sec-CH-UA
Sec-CH-UA-Mobile Sec-CH-UA-Platform Sec-CH-UA-Full-Version-List Sec-CH-Prefers-Color-Scheme Critical-CH Cross-Origin-Embedder-Policy-Report-Only Cross-Origin-Opener-Policy-Report-Only
Document-Policy-Report-Only SourceMap Access-Control-Allow-Origin Access-Control-Allow-Methods Access-Control-Allow-Headers Access-Control-Allow-Credentials Access-Control-Expose-Headers
Access-Control-Max-Age Link X-Robots-Tag Content-Disposition X-Content-Duration Refresh Content-Language X-UA-Compatible Accept-Ranges Transfer-Encoding Content-Range Pragma X-Powered-By
X-AspNet-Version X-AspNetMvc-Version Server-Timing X-Generator X-Runtime X-Drupal-Cache X-Magento-Cache-Control X-Drupal-Dynamic-Cache X-Magento-Tags X-Shopify-Stage X-Shopify-Request-ID
X-WP-Total X-WP-TotalPages X-Craft-Cache X-Discourse-Route X-Ghost-Cache-Status X-Joomla-Cache X-Discourse-Media-Type X-PrestaShop-Cache X-Magento-Cache-Debug X-Typo3-Cache X-Wix-Request-Id
X-Squarespace-Request-Id X-Webflow-Request-Id X-Contentful-Request-Id X-Netlify-Request-Id X-Vercel-Id X-Heroku-Request-Id X-Render-Request-Id X-Railway-Request-Id X-Fly-Request-Id
X-Deno-Region X-Cloudflare-Workers-Request-Id X-Azure-Ref X-GCP-Region X-Amz-Cf-Id""".split()

# Column names that do not follow from the header's own name.
NAMES = {"Content-Security-Policy": "responseCsp", "Content-Security-Policy-Report-Only": "responseCspReportOnly", "Cross-Origin-Resource-Policy": "responseCorp", "Cross-Origin-Embedder-Policy": "responseCoep", "Cross-Origin-Opener-Policy": "responseCoop", "Strict-Transport-Security": "responseHsts", "Cross-Origin-Embedder-Policy-Report-Only": "responseCoepReportOnly", "Cross-Origin-Opener-Policy-Report-Only": "responseCoopReportOnly", "Accept-CH": "responseAcceptCH", "X-B3-TraceId": "responseXB3TraceId", "X-B3-SpanId": "responseXB3SpanId", "X-B3-ParentSpanId": "responseXB3ParentSpanId", "SourceMap": "responseSourceMap", "X-WP-TotalPages": "responseXWpTotalPages", "X-AspNet-Version": "responseXAspNetVersion", "X-AspNetMvc-Version": "responseXAspNetMvcVersion", "X-PrestaShop-Cache": "responseXPrestaShopCache"}


def name_of(header: str) -> str:
    return NAMES.get(header) or "response" + "".join(p[:1].upper() + p[1:].lower() for p in header.split("-"))


def lower_keys(h: Column) -> Column:
    """The map with lower-cased keys; of keys equal but for case the first counts."""
    keys = F.transform(F.map_keys(h), F.lower)
    first = F.filter(F.map_entries(h), lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def header(h: Column, name: str) -> Column:
    """Value of a header of a map with lower-cased keys; empty if absent or null."""
    value = F.coalesce(F.element_at(h, name.lower()), F.lit(""))
    if name == "SourceMap":
        value = F.coalesce(F.nullif(value, F.lit("")), F.element_at(h, "x-sourcemap"), F.lit(""))
    return value


def header_sql(h: str, name: str) -> str:
    get = lambda n: f"(list_filter(map_entries({h}), lambda e: lower(e.key) = {rx.q(n.lower())})[1]).value"
    if name == "SourceMap":
        return f"coalesce(nullif({get(name)}, ''), {get('x-sourcemap')}, '')"
    return f"coalesce({get(name)}, '')"


# The order in which CDN evidence is taken: header, what its value must contain, provider, signal.
CDN_RULES = [
    ("CF-Cache-Status", "", "cloudflare", "CF-Cache-Status"), ("X-Cloudflare-Workers-Request-Id", "", "cloudflare", "X-Cloudflare-Workers-Request-Id"),
    ("X-Amz-Cf-Id", "", "cloudfront", "X-Amz-Cf-Id"), ("X-Cache", "cloudfront", "cloudfront", "X-Cache:cloudfront"),
    ("X-Fastly-Request-ID", "", "fastly", "X-Fastly-Request-ID"), ("X-Served-By", "cache-", "fastly", "X-Served-By:cache-*"),
    ("X-Akamai-Request-ID", "", "akamai", "X-Akamai-Request-ID"), ("X-Akamai-Transformed", "", "akamai", "X-Akamai-Transformed"), ("X-Akamai-Session-Info", "", "akamai", "X-Akamai-Session-Info"),
    ("X-Varnish", "", "varnish", "X-Varnish"), ("X-Netlify-Request-Id", "", "netlify", "X-Netlify-Request-Id"), ("X-Vercel-Id", "", "vercel", "X-Vercel-Id"),
    ("X-Azure-Ref", "", "azure", "X-Azure-Ref"), ("X-GCP-Region", "", "gcp", "X-GCP-Region"), ("X-Fly-Request-Id", "", "fly", "X-Fly-Request-Id"), ("X-Deno-Region", "", "deno", "X-Deno-Region"),
    ("X-Heroku-Request-Id", "", "heroku", "X-Heroku-Request-Id"), ("X-Render-Request-Id", "", "render", "X-Render-Request-Id"), ("X-Railway-Request-Id", "", "railway", "X-Railway-Request-Id"),
    ("X-Shopify-*", "", "shopify", ""), ("X-Squarespace-Request-Id", "", "squarespace", "X-Squarespace-Request-Id"), ("X-Wix-Request-Id", "", "wix", "X-Wix-Request-Id"),
    ("X-Webflow-Request-Id", "", "webflow", "X-Webflow-Request-Id"), ("X-CDN", "", None, None), ("Via", "cloudfront", "cloudfront", "Via:cloudfront"), ("Via", "varnish", "varnish", "Via:varnish"), ("Via", "akamai", "akamai", "Via:akamai"),
]


def cdn(h: Column) -> Column:
    """struct(provider, signals) of the first rule that holds; ('', []) if none does."""
    out = F.struct(F.lit("").alias("provider"), F.array().cast("array<string>").alias("signals"))
    for name, part, provider, signal in reversed(CDN_RULES):
        if name == "X-Shopify-*":
            found = [F.when(header(h, n) != "", F.lit(n)) for n in ("X-Shopify-Request-ID", "X-Shopify-Stage")]
            signals = rx.compact(*found)
            out = F.when(F.size(signals) > 0, F.struct(F.lit(provider).alias("provider"), signals.alias("signals"))).otherwise(out)
            continue
        value = header(h, name)
        holds = F.contains(F.lower(value), F.lit(part)) if part else value != ""
        who = F.lower(value) if provider is None else F.lit(provider)
        sign = F.concat(F.lit("X-CDN:"), value) if provider is None else F.lit(signal)
        out = F.when(holds, F.struct(who.alias("provider"), F.array(sign).alias("signals"))).otherwise(out)
    return out


def cdn_sql(h: str) -> tuple[str, str]:
    """SQL of the provider and of the signals."""
    who, signs = [], []
    for name, part, provider, signal in CDN_RULES:
        if name == "X-Shopify-*":
            a, b = header_sql(h, "X-Shopify-Request-ID"), header_sql(h, "X-Shopify-Stage")
            holds, sign = f"{a} <> '' OR {b} <> ''", rx.list_sql(f"CASE WHEN {a} <> '' THEN 'X-Shopify-Request-ID' END", f"CASE WHEN {b} <> '' THEN 'X-Shopify-Stage' END")
            name_of_cdn = rx.q(provider)
        else:
            value = header_sql(h, name)
            holds = f"contains(lower({value}), {rx.q(part)})" if part else f"{value} <> ''"
            name_of_cdn = f"lower({value})" if provider is None else rx.q(provider)
            sign = f"['X-CDN:' || {value}]" if provider is None else f"[{rx.q(signal)}]"
        who.append(f"WHEN {holds} THEN {name_of_cdn}")
        signs.append(f"WHEN {holds} THEN {sign}")
    return f"CASE {' '.join(who)} ELSE '' END", f"CASE {' '.join(signs)} ELSE [] END"


def via_hops(via: Column) -> Column:
    """array<struct(protocol, host, comment)> of the Via header."""

    def hop(part: Column) -> Column:
        comment = F.regexp_extract(part, r"(?s)^[^(]*(\(.*\))", 1)
        bare = F.when(comment != "", rx.trim(F.substring_index(part, "(", 1))).otherwise(part)
        fields = rx.words(bare)
        two = F.size(fields) >= 2
        return F.struct(F.when(two, F.get(fields, 0)).otherwise("").alias("protocol"), F.coalesce(F.when(two, F.get(fields, 1)).otherwise(F.get(fields, 0)), F.lit("")).alias("host"), comment.alias("comment"))

    parts = F.filter(F.transform(F.split(F.coalesce(via, F.lit("")), ",", -1), rx.trim), lambda p: p != "")
    return F.filter(F.transform(parts, hop), lambda s: (s["host"] != "") | (s["protocol"] != ""))


def trace_id(x: Column) -> Column:
    return F.when(F.length(x) == 16, F.lpad(F.lower(x), 32, "0")).otherwise(F.lower(x))


def trace(h: Column) -> Column:
    """struct(formats, correlation)."""
    w3c, multi, single = header(h, "Traceparent"), header(h, "X-B3-TraceId"), header(h, "b3")
    formats = rx.compact(
        F.when(w3c != "", F.lit("w3c")), F.when((multi != "") | (single != ""), F.lit("b3")), F.when(header(h, "X-Amzn-Trace-Id") != "", F.lit("xray")), F.when(header(h, "X-Trace-Id") != "", F.lit("generic"))
    )
    a = F.coalesce(F.lower(F.get(F.split(w3c, "-", -1), 1)), F.lit(""))
    b = F.when(multi != "", trace_id(multi)).otherwise(trace_id(F.get(F.split(single, "-", -1), 0)))
    return F.struct(formats.alias("formats"), F.when((a != "") & (a == b), "b3-w3c-match").otherwise("").alias("correlation"))


def llms_txt(link: Column, fallback: Column) -> Column:
    """URL of the Link part with rel llms-full-txt, else llms-txt, else the fallback header."""
    parts = F.transform(F.split(link, ",", -1), rx.trim)
    rel = r"""(?i)\brel\s*=\s*["']?([a-zA-Z0-9_-]+)["']?"""

    def of(want: str) -> Column:
        urls = F.transform(F.filter(parts, lambda p: F.lower(F.regexp_extract(p, rx.java(rel), 1)) == want), lambda p: F.regexp_extract(p, "<([^>]+)>", 1))
        return F.get(F.filter(urls, lambda u: u != ""), 0)

    return F.coalesce(of("llms-full-txt"), of("llms-txt"), F.nullif(fallback, F.lit("")), F.lit(""))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as 90, 1.5, -2, 1m30 or 1h2m3 (the last unit is seconds); null if it is none."""
    t = F.concat(text, F.lit("s"))
    part = r"(?:\d+\.?\d*|\.\d+)(?:h|ms|m|s|us|µs|ns)"
    ok = t.rlike(rf"^[+-]?(?:{part})+\z")
    pieces = F.regexp_extract_all(t, F.lit(r"(\d+\.?\d*|\.\d+)(?:h|ms|m|s|us|µs|ns)"), 0)
    unit = lambda p: F.regexp_extract(p, r"([a-zµ]+)$", 1)
    size = lambda p: F.when(unit(p) == "h", 3600.0).when(unit(p) == "m", 60.0).when(unit(p) == "s", 1.0).when(unit(p) == "ms", 1e-3).when(unit(p) == "ns", 1e-9).otherwise(1e-6)
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double") * size(p))
    return F.when(ok, F.when(t.startswith("-"), -total).otherwise(total))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait: a duration, or an HTTP date minus ``now``, not below zero; null if unreadable."""
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    wait = F.greatest(F.lit(0.0), (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.coalesce(duration_seconds(value), F.when(value.rlike("^[A-Za-z]{3}, "), wait))
