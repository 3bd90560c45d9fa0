import datetime as dt

from pagewright.streaming import pages


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def _source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_changes(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", t(1), "cats 1234"), ("a", t(2), "cats 9999"), ("a", t(3), "dogs"), ("b", t(1), "x"), (None, t(1), "x"), ("c", t(1), None)]
    src = _source(spark, tmp_path, rows, "url string, fetched_at timestamp, content string")
    got = sorted((r.url, r.fetched_at.minute, r.state) for r in run(pages.changes(src), "changes"))
    assert got == [("a", 1, "new"), ("a", 2, "same"), ("a", 3, "changed"), ("b", 1, "new")]


def test_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    src = _source(spark, tmp_path, [(1, "h", t), (2, "h", t), (3, "g", t)], "id bigint, hash string, ts timestamp")
    assert sorted(r.hash for r in run(pages.without_repeats(src, ["hash"], "ts", "1 hour"), "repeats")) == ["g", "h"]


def test_cached_rules(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    src = _source(spark, tmp_path, [("a", t(0), True, 5.0), ("a", t(23), True, 9.0), ("a", t(25), False, 9.0), ("a", t(26.5), True, 2.0)], "domain string, asked_at timestamp, ok boolean, delay_s double")
    got = sorted((r.asked_at, r.delay_s, r.hit) for r in run(pages.cached_rules(src), "rules"))
    assert [(d, h) for _, d, h in got] == [(5.0, False), (5.0, True), (0.0, False), (2.0, False)]
