"""Lines repeated across one site's records: PrefixSpan over line identifiers per site.

Level one counts, for every site and normalised line, the distinct records
with the line.  Longer patterns grow by the next frequent line of the same
record (a PrefixSpan whose gap is one), so the patterns of a record grow with
its lines only.  A line's identifier hashes its site and text, so a hot site
is spread over all tasks, and equal lines are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import checkpoint, keyed_join, site_of

MIN_RECORDS, MIN_SHARE, MIN_LENGTH = 5, 0.1, 10
#: White space other than the line feed.
_BLANK = r"[\t\x0b\f\r\x1c-\x1f \x85\xa0  -     　]+"


def normal_text(content: Column) -> Column:
    """White space made one space, lower-cased, each run of digits made 0; line breaks stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(content, _BLANK, " ")), r"[0-9]+", "0")


def normal_lines(content: Column) -> Column:
    """The normalised lines of a text, blank ones included."""
    return F.split(F.regexp_replace(normal_text(content), "^ | $", ""), " ?\n ?", -1)


def record_lines(extractions: DataFrame) -> DataFrame:
    """site, result_id, lines: records without a host, a content or an id are left out."""
    src = extractions.select("result_id", site_of(F.coalesce("final_url", "url")).alias("site"), "content")
    src = src.filter(F.col("site").isNotNull() & F.col("content").isNotNull() & F.col("result_id").isNotNull())
    return src.select("site", "result_id", F.filter(normal_lines(F.col("content")), lambda x: F.length(x) >= MIN_LENGTH).alias("lines"))


def line_id(line: Column) -> Column:
    return F.xxhash64("site", line)


def frequent_lines(lines: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Level one: line_id, support, site_records of the lines in enough distinct records of their site; checkpointed.

    Only identifiers are shuffled: each record's once, to drop repeated
    deliveries, then each line's count.  A record counts for its site as one
    more line, so that the sites' sizes come from the same pass.
    """
    site_id = F.xxhash64("site")
    ids = lines.select("result_id", site_id.alias("site_id"), F.array_append(F.array_distinct(F.transform("lines", line_id)), site_id).alias("ids")).dropDuplicates(["result_id"])
    counted = ids.select("site_id", F.explode("ids").alias("line_id")).groupBy("line_id", "site_id").agg(F.count(F.lit(1)).alias("support"))
    counted = checkpoint(counted.filter((F.col("support") >= min_records) | (F.col("line_id") == F.col("site_id"))))
    sizes = counted.filter("line_id = site_id").select("site_id", F.col("support").alias("site_records"))
    kept = counted.filter((F.col("line_id") != F.col("site_id")) & (F.col("support") >= min_records)).join(sizes, "site_id")
    return checkpoint(kept.filter(F.col("support") >= F.col("site_records") * min_share).drop("site_id"))


def line_texts(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """site, line_id, line, support, site_records: a second reading of the lines against the few frequent ids."""
    each = lines.select("site", "result_id", F.explode(F.array_distinct("lines")).alias("line")).withColumn("line_id", line_id(F.col("line")))
    return keyed_join(each, frequent, "line_id", 48).groupBy("site", "line_id").agg(F.min("line").alias("line"), F.min("support").alias("support"), F.min("site_records").alias("site_records"))


def repeated_lines(extractions: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """site, line, support, site_records: the sequences of one line.

    A line twice in a record and a record delivered twice count once; ties do
    not matter, as every line over the threshold is kept.
    """
    lines = record_lines(extractions)
    frequent = frequent_lines(lines, min_records, min_share)
    return line_texts(lines, frequent).drop("line_id")


def repeated_sequences(extractions: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, max_length: int | None = None) -> DataFrame:
    """site, length, lines, support: every frequent sequence of frequent lines, of any length unless max_length is given.

    The next line of a sequence is the next frequent line of the record; other
    lines between them are passed over.  Each place of a record keeps the key
    of the frequent sequence that begins there; two neighbouring keys make a
    candidate that is one line longer, until a level is empty.
    """
    lines = record_lines(extractions)
    frequent = frequent_lines(lines, min_records, min_share)
    placed = lines.select("site", "result_id", F.posexplode("lines").alias("pos", "line")).withColumn("line_id", line_id(F.col("line")))
    placed = keyed_join(placed, frequent.select("line_id", "site_records"), "line_id", 32)
    rows = placed.groupBy("site", "result_id", "site_records").agg(F.array_sort(F.collect_set(F.struct("pos", "line"))).alias("s"))
    rows = checkpoint(rows.select("site", "result_id", "site_records", F.col("s.line").alias("s")))  # a record's own frequent lines
    keys = rows.select("site", "result_id", "site_records", F.posexplode(F.transform("s", lambda x: F.xxhash64(x))).alias("pos", "key"))
    record = Window.partitionBy("site", "result_id").orderBy("pos")
    found, length = [], 1
    while max_length is None or length <= max_length:
        level = keys.groupBy("site", "key").agg(
            F.count_distinct("result_id").alias("support"), F.min("site_records").alias("site_records"),
            F.first("result_id").alias("result_id"), F.first("pos").alias("pos"),  # any one place, to read the lines there
        )
        level = checkpoint(level.filter((F.col("support") >= min_records) & (F.col("support") >= F.col("site_records") * min_share)).withColumn("length", F.lit(length)))
        if level.isEmpty():
            break
        found.append(level)
        keys = keys.join(level.select("site", "key"), ["site", "key"], "left_semi")  # grow only from frequent sequences
        keys = keys.withColumns({"next": F.lead("key").over(record), "next_pos": F.lead("pos").over(record)}).filter("next_pos = pos + 1")
        keys = checkpoint(keys.select("site", "result_id", "site_records", "pos", F.xxhash64("key", "next").alias("key")))
        length += 1
    out = found[0] if found else level
    for level in found[1:]:
        out = out.unionByName(level)
    out = out.drop("site_records").join(rows.select("site", "result_id", "s"), ["site", "result_id"])
    return out.select("site", "length", F.expr("slice(s, pos + 1, length)").alias("lines"), "support")


def without_repeated_lines(extractions: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """result_id, site, content, removed: each record once, without the occurrences of the frequent sequences.

    A line in a frequent sequence is itself frequent, so the single lines
    decide what goes.  A site's frequent lines are at most 1 / min_share times
    the lines of its mean record, so the list joined to each record is
    bounded.  Records without a site or content stay as they are.
    """
    lines = record_lines(extractions)
    frequent = line_texts(lines, frequent_lines(lines, min_records, min_share))
    lists = checkpoint(frequent.groupBy("site").agg(F.collect_set("line_id").alias("ids")))
    src = extractions.select("result_id", site_of(F.coalesce("final_url", "url")).alias("site"), "content")
    widest = lists.agg(F.coalesce(F.max(F.size("ids")), F.lit(0))).first()[0]
    out = keyed_join(src, lists, "site", 64 + 8 * widest, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    pairs = F.arrays_zip(F.split("content", "\n", -1).alias("raw"), F.transform(normal_lines(F.col("content")), line_id).alias("id"))
    out = out.withColumn("kept", F.filter(pairs, lambda p: ~F.array_contains(F.col("ids"), p["id"])))
    out = out.select("result_id", "site", F.array_join("kept.raw", "\n").alias("content"), (F.size(F.split("content", "\n", -1)) - F.size("kept")).cast("bigint").alias("removed"))
    return out.dropDuplicates(["result_id"])
