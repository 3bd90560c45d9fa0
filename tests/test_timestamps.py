import pytest
from pyspark.sql import functions as F

from pagewright.operators import timestamps as ts


@pytest.mark.parametrize(
    "text, micros",
    [
        ("2023-09-30T16:44:33.638496+00:00", 1696092273638496), ("20230731T211944Z", 1690838384000000), ("Sat, 17 Jun 2023 19:55:43 GMT", 1687031743000000), ("Thursday, 07-Dec-23 19:54:13 GMT", 1701978853000000),
        ("2023-09-30 10:08 +05:30", 1696048680000000), ("2023-08-02T08:20:16+09:00[Asia/Tokyo]", 1690932016000000), ("1692141314512", 1692141314512000), ("1729994609", 1729994609000000), ("June 21, 2023 10:45 PM CET", 1687383900000000),
        ("2023-10-09T12:09:27+00", 1696853367000000),
    ],
)
def test_placed(text, micros):
    assert [(m, p) for _, m, p in ts.readings(f" \t{text}\n")] == [(micros, True)]


@pytest.mark.parametrize("text", [None, "", "-", "n/a", "Spring 2025", "2025-02-30", "2025-13-01T00:00:00Z", "31/31/2025", "2024-06-17T25:61:00Z", "{{date}}", "3 hours ago", "13:00 PM", "2024-01-01T00:00:00+9999", "January 5, 2024 3:00 PM XYZ"])
def test_unreadable(text):
    assert ts.readings(text) == []


def test_slash_dates_have_two_readings():
    assert {f for f, _, _ in ts.readings("06/04/2025 03:26")} == {"slash_mdy", "slash_dmy"}
    assert {f for f, _, _ in ts.readings("25/04/2025")} == {"slash_dmy"}


def test_resolve(spark):
    rows = [
        ("datePublished", 1, 0, "2023-11-05 01:30", "a", "America/New_York", "en-US"),  # doubled: the offset before
        ("datePublished", 2, 0, "2023-03-12 02:30", "a", "America/New_York", "en-US"),  # skipped
        ("datePublished", 3, 0, "06/04/2025", "a", "America/New_York", "en-US"), ("datePublished", 4, 0, "06/04/2025", "b", "Europe/Berlin", "de-DE"), ("datePublished", 5, 0, "06/04/2025", None, None, None),
        ("responseLastModified", 6, 0, "2023-12-03 22:34:37", "b", "UTC", None), ("datePublished", 7, 0, None, "b", "UTC", None),
    ]
    df = spark.createDataFrame(rows, "field string, record_id bigint, pos bigint, raw string, source string, zone string, locale string")
    got = {r.record_id: r.utc_micros for r in ts.resolve(df.withColumn("form", F.lit("extra"))).collect()}
    assert got == {r[1]: ts.brute_force(r[0], r[3], r[5], r[6]) for r in rows if r[3]}
    assert got[1] == 1699162200000000 and got[2] == 1678606200000000
    assert ts.resolve(df.limit(0)).count() == 0


_VALUES = "field string, record_id bigint, pos bigint, raw string, source string, zone string, locale string"


def _value(i, raw, source, locale=None):
    return ("datePublished", i, 0, raw, source, "UTC", locale)


def test_mixture_decides_where_the_locale_is_unknown(spark):
    clear = [_value(i, f"{d}/04/2025", "s") for i, d in enumerate(range(13, 29))]
    months_first = [_value(200 + i, f"04/{d}/2025", "u") for i, d in enumerate(range(13, 29))]
    rows = clear + months_first + [_value(99, "05/06/2025", "s"), _value(98, "05/06/2025", "u"), _value(100, "05/06/2025", "t")]
    df = spark.createDataFrame(rows, _VALUES)
    got = {r.record_id: r for r in ts.resolve(df, day_first=False).collect()}
    assert got[99].form == "slash_dmy" and got[98].form == "slash_mdy" and not got[99].ambiguous
    assert got[100].ambiguous and got[100].utc_micros is None
    without = {r.record_id: r for r in ts.resolve(df, rounds=0, day_first=False).collect()}  # the method switched off
    assert without[99].ambiguous and without[98].ambiguous
    ruled = {r.record_id: r.form for r in ts.resolve(df).collect()}
    assert ruled[100] == "slash_dmy" and ruled[98] == "slash_dmy"


def test_locale_is_a_hint_that_counts_outweigh(spark):
    rows = [_value(i, f"{d}/04/2025", "s", "en-US") for i, d in enumerate(range(13, 29))] + [_value(99, "05/06/2025", "s", "en-US"), _value(98, "05/06/2025", "t", "en-US")]
    df = spark.createDataFrame(rows, _VALUES)
    hint = {r.record_id: r.form for r in ts.resolve(df, weight=ts.HINT_WEIGHT, sure=0.8, day_first=False).collect()}
    assert hint[99] == "slash_dmy" and hint[1] == "slash_dmy"
    rule = {r.record_id: r.form for r in ts.resolve(df).collect()}
    assert rule == {99: "slash_mdy", 98: "slash_mdy"}  # 13/04 is no date where the month comes first


@pytest.mark.parametrize("gap", [1, 60, 100, 101, 400])
def test_long_texts_are_read(gap):
    assert [m for _, m, _ in ts.readings("2024-01-01" + " " * gap + "00:00:00 UTC (" + "x" * gap + ")")] == [1704067200000000]


def test_tables_with_nulls_and_copies(spark):
    block = "array<struct<type: string, datePublished: string>>"
    ld = spark.createDataFrame([(1, [("a", "2023-01-01"), (None, None)]), (1, [("a", "2023-01-01"), (None, None)]), (2, None), (3, [])], f"page_id bigint, blocks {block}").withColumn("source", F.lit("clash"))
    ex = spark.createDataFrame([(1, None, "https://www.A.test:80/x", "2023-01-01 00:00:00"), (1, None, "https://www.A.test:80/x", "2023-01-01 00:00:00"), (2, None, None, None)], "result_id bigint, final_url string, url string, response_last_modified string")
    pg = spark.createDataFrame([(1, "http://m.a.test/1"), (1, "http://m.a.test/1"), (4, None)], "page_id bigint, url string")
    cfg = spark.createDataFrame([("a.test", "Asia/Tokyo", None), ("b.test", "No/Where", None), (None, None, None)], "domain string, home_zone string, locale string")
    got = sorted((r.field, r.record_id, r.pos, r.utc_micros) for r in ts.normalised_times(ld, ex, pg, cfg).collect())
    assert got == [("datePublished", 1, 0, 1672498800000000), ("responseLastModified", 1, 0, 1672531200000000)]
