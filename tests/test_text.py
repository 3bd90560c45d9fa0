import pytest
from pyspark.sql import functions as F

from pagewright.functions import detect, fingerprint, headers, markdown, scoring
from pagewright.operators import blocks


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'bigint' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "text, title",
    [
        ('---\ntitle: "A b"\n---\n# C', "A b"), ("---\r\ntitle: x\r\n---\r\n", "x"), ("---\ntitle: Hello --- world\n---\n", "Hello --- world"), ("---\ntitle: open\n# H", "H"), ("---\ntitle:\n---\n## Two words \n", "Two words"), ("# é\n", "é"), ("no", ""),
    ],
)
def test_title(spark, text, title):
    assert one(spark, markdown.title, text) == title


def test_cleanup(spark):
    assert one(spark, markdown.cleanup, "a<!-- x -->\n- [](u)\n[](v)b\nGet the app now\n\n\n\nc ") == "a\n\nb\n\nc"


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Updated 2024-01-02T10:00:00Z ok", "Updated 2023-05-06 ok", True), ("Views: 1234", "Views: 99999", True), ("3 hours ago", "10 minutes ago", True), ("v1.2.3 out", "v2.0 out", True),
        ("id 123e4567-e89b-12d3-a456-426614174000", "id 00000000-e89b-12d3-a456-426614174000", True), ("about cats", "about dogs", False), ("é123 x", "é456 x", True),
    ],
)
def test_fingerprint(spark, a, b, same):
    assert (one(spark, fingerprint.fingerprint, a) == one(spark, fingerprint.fingerprint, b)) is same


def test_significance(spark):
    assert one(spark, fingerprint.significance, "one two three", "one two three") == 0
    assert one(spark, fingerprint.significance, "alpha beta", "gamma delta") == 100
    assert one(spark, fingerprint.significance, "", "") == 0


def test_detectors(spark):
    shell = '<html><body><div id="root"></div><noscript>enable javascript</noscript></body></html>'
    assert one(spark, detect.spa_signals, shell) == ["spa-root-element", "minimal-body-content", "noscript-warning"]
    assert one(spark, detect.is_blocked, "<html><body>Please complete the security check</body></html>") is True
    assert one(spark, detect.is_blocked, "<html><body><p>fine</p></body></html>") is False
    assert one(spark, detect.browser_reason, '<body><div id="app"></div>') == "vue-empty-shell"
    assert one(spark, detect.soft404_hints, "<title>Error</title> Page not found", 80) == ["very-short-content:80-bytes", "error-text:page-not-found", "error-title"]
    assert one(spark, detect.is_binary, " Image/PNG; q=1") is True
    assert one(spark, detect.has_llm_text, "These are instructions for LLMs") is True


@pytest.mark.parametrize("length, h, p, s, blocked, want", [(50, 0, 0, 0, "f", 25), (600, 1, 1, 0, "f", 100), (600, 1, 1, 2, "t", 30), (10, 0, 0, 4, "t", 0)])
def test_confidence(spark, length, h, p, s, blocked, want):
    assert one(spark, lambda a, b, c, d, e: scoring.confidence(a, b, c, d, e == "t"), length, h, p, s, blocked) == want


def test_blocks(spark):
    text = "# Same heading\n\nA paragraph that is long enough.\n\nshort\n\nshort\n\n# Same heading\n\n**A paragraph**  that is LONG enough.\n\nLast one is also long enough\n## H2\ntail"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id bigint, t string")
    got = {r.id: r for r in blocks.dedupe(df, "id", "t").collect()}
    assert (got[1].original_blocks, got[1].duplicates_found, got[1].duplicate_signals) == (9, 2, ["card", "heading"])
    assert got[1].content.count("paragraph") == 1 and got[1].content.count("short") == 2
    assert got[2].content == "" and 3 not in got
    lines = {r.id: r.content for r in blocks.dedupe_lines(spark.createDataFrame([(1, "A\n\na \nb\n\n")], "id bigint, t string"), "id", "t").collect()}
    assert lines[1] == "A\n\nb\n\n"


@pytest.mark.parametrize("a, b, want", [("Same  text", "same text", 100), ("a b c d", "a b x y", 33), ("", "x", 0), ("x", "x x x", 300)])
def test_near_duplicates(spark, a, b, want):
    assert one(spark, blocks.near_duplicate_score, a, b) == want


@pytest.mark.parametrize("text, want", [("90", 90.0), ("1m30", 90.0), ("1.5", 1.5), ("-2", -2.0), ("1h2m3", 3723.0), ("x", None), ("", None)])
def test_durations(spark, text, want):
    assert one(spark, headers.duration_seconds, text) == want


def test_headers(spark):
    df = spark.createDataFrame([({"CF-Cache-Status": "HIT", "x-sourcemap": "m", "Via": "1.1 a (x, y), b"},), (None,)], "h map<string,string>").withColumn("h", headers.lower_keys(F.col("h")))
    got = df.select(headers.cdn(F.col("h")).alias("c"), headers.header(F.col("h"), "SourceMap").alias("m"), headers.via_hops(headers.header(F.col("h"), "Via")).alias("v")).collect()
    assert (got[0].c.provider, got[0].m, [x.host for x in got[0].v]) == ("cloudflare", "m", ["a", "y)", "b"])
    assert (got[1].c.provider, got[1].m, got[1].v) == ("", "", [])
