import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import domops, htmltree, ldjson
from pagewright.operators import extract, fetching

PAGE = '<title>T</title><nav><a href="/x">X</a></nav><article><h1>Head</h1><p>One paragraph, long enough to count, with commas.<p>Two <b>bold <i>it</b> rest</i><ul><li>a<ul><li>b</ul><li>c</ul></article><footer>F</footer>'


def test_tree_closes_what_may_be_omitted():
    d = htmltree.parse("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y")
    assert [len([k for k in d.children(i) if d.tag[k] == "li"]) for i in d.find_all("ul")] == [2, 1]
    assert [sum(d.tag[k] == "td" for k in d.children(i)) for i in d.find_all("tr")] == [2, 1]
    assert len(d.find_all("p")) == 2


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/abpdiv ul=\"'!-&;\n", max_size=80))
def test_any_text_gives_a_sound_tree(text):
    d = htmltree.parse(text)
    for i in range(len(d.tag)):
        assert i <= d.last[i] < len(d.tag) and d.parent[i] < i
        assert d.parent[i] < 0 or d.last[i] <= d.last[d.parent[i]]
    assert len(htmltree.sanitize(text)) <= len(text)
    domops.markdown(d, 0), domops.snapshot_nodes(d), domops.index_page(d), domops.fallback_text(d), domops.article(d)


def test_sanitize():
    text = '<div aria-hidden="true"><div>x</div>y</div><p hidden>z</p><p data-x="hidden">k</p><span class="sr-only">q</span><i style="display:none">w</i><!-- c -->e​nd<input type="hidden" value="v">'
    assert htmltree.sanitize(text) == '<p data-x="hidden">k</p>end'
    assert htmltree.sanitize("<p hidden>open") == "open"


def test_preprocess():
    assert htmltree.preprocess('<button a class="x twoslash">c</button>') == "<span>c</span>"
    assert htmltree.preprocess('<head></head><div id="VPContent"><div>k</div></div><div>gone</div>').count("gone") == 0


def test_article_and_markdown():
    d = htmltree.parse(PAGE)
    a = domops.article(d)
    md = domops.markdown(d, a["node"])
    assert a["title"] == "T" and md.startswith("# Head") and "- a\n  - b\n- c" in md and "X" not in md and "**bold *it***" in md


def test_cards_and_index():
    many = "".join(f'<article><h2><a href="/{i}">{"t" * (i + 1)}</a></h2><p>{"w " * 20}</p></article>' for i in range(6))
    got = domops.index_page(htmltree.parse(many))
    assert got["is_index"] and got["headlines"] == 6 and got["confidence"] == 62
    assert [c["url"] for c in domops.cards(htmltree.parse(many))][0] == "/5"
    assert not domops.index_page(htmltree.parse("<article><h1>x</h1></article>"))["is_index"]


def test_snapshot():
    d = htmltree.parse('<main><h2 id="i">Hi</h2><a href="/x">go</a><input type="checkbox" checked><p>t</p><div><button class="js-a b2">B</button></div></main>')
    n = domops.snapshot_nodes(d)
    assert [x["role"] for x in n] == ["main", "heading", "link", "checkbox", "paragraph", "button"]
    assert [x["ref"] for x in n] == ["e1", "e2", "e3", "e4", "e5", "e6"] and [x["depth"] for x in n] == [0, 1, 1, 1, 1, 1]
    assert n[1]["selector"] == "#i" and n[5]["selector"] == "button.b2" and n[3]["checked"] and n[1]["level"] == 2
    assert [x["ref"] for x in domops.snapshot_nodes(d, True)] == ["e1", "e3", "e4", "e6"]
    assert len(domops.snapshot_tree(n, 10)) < len(domops.snapshot_tree(n))


def test_ldjson(spark):
    page = '<script type="application/ld+json">{"@graph":[{"x":1},{"headline":"H","author":[{"name":"A"},"B",3],"publisher":{"name":"P"}}]}</script><script type="application/ld+json">[1,{"name":"N"}]</script><script type="application/ld+json">bad</script>'
    got = ldjson.blocks_of(page)
    shown = extract.ldjson_markdown(F.from_json(F.lit(json.dumps(got)), "array<struct<" + ",".join(f"{k}:string" for k in ldjson.FIELDS) + ">>"))
    assert spark.range(1).select(shown.alias("x")).first().x == "## H\n\nBy A, B · P\n\n## N"
    assert [(b["headline"], b["author"], b["publisher"]) for b in got] == [("H", "A, B", "P"), ("N", "", "")]


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 200), (1, "u", PAGE, 200), (2, None, None, None), (3, "v", "<title>x</title><body>captcha</body>", 503)], "page_id bigint, url string, html string, status int")
    got = {r.page_id: r for r in extract.extract(df, extract.ExtractOptions(dedupe=True, fail_fast=True)).collect()}
    assert set(got) == {1, 2, 3} and got[1].title == "T" and got[1].content.startswith("# Head")
    assert got[3].is_blocked and got[3].profile["reasons"][-1] == "http-503-service-unavailable"
    assert extract.extract(df.limit(0)).count() == 0


def test_fast_mode_and_markdown_answers(spark):
    shell = '<body><div id="root"></div></body>'
    plain = "# Head\n\n" + "A line of some length, so that it counts. " * 3 + "\n\n# Head\n"
    rows = [(1, "u", PAGE, 200, {"Content-Type": "text/html"}), (2, "v", shell, 200, None), (3, "w", plain, 200, {"content-type": "text/markdown; charset=utf-8", "Link": '</l>; rel="llms-txt"'}), (4, "x", plain, 503, {"Content-Type": "text/markdown"}), (5, "y", None, 404, {"Content-Type": "text/markdown"})]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, status int, headers map<string,string>")
    got = {r.page_id: r for r in extract.extract_negotiated(df, extract.ExtractOptions(fast_mode=True, dedupe=True)).collect()}
    assert got[2].error == "needs-browser: react-empty-shell" and got[2].content is None and got[2].validation["issues"] == ["react-empty-shell"] and got[2].validation["confidence"] == 0.1
    assert got[1].error is None and got[1].title == "T"
    assert got[3].confidence == 100 and got[3].profile["reasons"] == ["content-negotiation-markdown"] and got[3].title == "Head" and got[3].llms_txt_url == "/l" and got[3].duplicates_found == 1
    assert got[4].is_blocked and got[4].profile["class"] == "blocked" and got[5].profile is None and got[5].length == 0


def test_minimal_keeps_what_sanitising_removes(spark):
    html = '<article><h1>H</h1><p>One paragraph, long enough to count, with commas.</p><p hidden>kept here, as nothing is sanitised at all</p></article>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")
    got = {r.page_id: r.markdown for r in extract.minimal_markdown(df).collect()}
    assert "kept here" in got[1] and got[1].startswith("# H") and got[2] == ""


def test_head_preflight(spark):
    rows = [(404, None), (410, "text/html"), (405, None), (200, "image/png"), (200, "text/html"), (None, None)]
    df = spark.createDataFrame(rows, "s int, t string")
    assert [r.e for r in df.select(fetching.preflight_error(F.col("s"), F.col("t")).alias("e")).collect()] == ["HEAD preflight returned 404", "HEAD preflight returned 410", None, "skipped binary content: image/png", None, None]


def test_retry_log(spark):
    rows = [(1, 0, 502, None, None), (1, 1, 200, None, None), (2, 0, 429, None, 1.0), (2, 1, 429, None, 99.0), (3, 0, 0, "eof", None), (3, 1, 0, "eof", None)]
    df = spark.createDataFrame(rows, "req_id bigint, attempt bigint, status int, error string, retry_after_s double")
    got = sorted((r.req_id, r.attempt, r.event) for r in fetching.retry_log(df, 3, 10.0, 2.5).collect())
    assert got == [(1, 0, "retrying"), (1, 1, "success"), (2, 0, "retrying"), (2, 1, "exhausted"), (3, 0, "retrying"), (3, 1, "timeout")]


def test_linked_paragraphs_are_no_article():
    linked = "".join(f'<p><a href="/{i}">A linked line that says very little about item {i}, again</a></p>' for i in range(12))
    plain = "".join(f"<p>This is a plain paragraph with some running text, number {i}, and a comma</p>" for i in range(4))
    dom = htmltree.parse(f'<body><div id="x">{linked}</div><div id="y">{plain}</div></body>')
    assert dom.attr(domops.article(dom)["node"], "id") == "y"
    only = htmltree.parse(f'<body><div id="x">{linked}</div></body>')
    assert only.tag[domops.article(only)["node"]] == "body"  # density 1 scores nothing
