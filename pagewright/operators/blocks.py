"""Block and line deduplication inside documents, and against a store of seen blocks.

Documents are independent, so everything happens inside each row: equal
blocks meet by sorting the row's hashes, and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import rx

# Words that tell what kind of block was repeated.
NAV = ["home", "about", "contact", "menu", "navigation", "nav"]
FOOTER = ["copyright", "©", "all rights reserved", "privacy policy", "terms of"]
RELATED = ["related", "see also", "you might also", "recommended", "popular"]
HEADING_LINE = r"^#{1,6}\s+.+"
STRIP = [(r"^#+\s*", ""), (r"\*+", ""), (r"_+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^[\-\*\+]\s+", ""), (r"(?m)^\d+\.\s+", "")]


def split_blocks(content: Column) -> Column:
    """Pieces between blank lines, every heading line a piece of its own."""

    def on_headings(block: Column) -> Column:
        # A fold that keeps the open group as its last element; a null element marks a closed group.
        def step(acc: Column, line: Column) -> Column:
            open_ = F.element_at(acc, -1)
            grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(open_, F.lit("\n"), line)))
            fresh = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(line))
            heading = F.concat(F.when(open_.isNull(), F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc), F.array(line, F.lit(None).cast("string")))
            return F.when(line.rlike(rx.java(HEADING_LINE)), heading).otherwise(F.when(open_.isNull(), fresh).otherwise(grown))

        lines = F.split(block, "\n", -1)
        many = F.aggregate(lines, F.array(F.lit(None).cast("string")), step, lambda acc: F.array_compact(acc))
        return F.when(F.size(lines) <= 1, F.array(block)).otherwise(many)

    return F.flatten(F.transform(F.split(content, "\n\n", -1), on_headings))


@dataclass(frozen=True)
class DedupeOptions:
    """min_length: shorter blocks (bytes) that are no headings always stay; fold_space, fold_case: whether white space and case tell blocks apart."""

    min_length: int = 20
    fold_space: bool = True
    fold_case: bool = True


def normal_block(block: Column, options: DedupeOptions = DedupeOptions()) -> Column:
    x = F.lower(block) if options.fold_case else block
    x = rx.trim(F.regexp_replace(x, rx.S + "+", " ") if options.fold_space else x)
    for p, to in STRIP:
        x = rx.replace(x, p, to)
    return x


def normal_block_sql(x: str) -> str:
    x = rx.trim_sql(rx.replace_sql(f"lower({x})", r"\s+", " "))
    for p, to in STRIP:
        x = rx.replace_sql(x, p, to.replace("$1", "\\1"))
    return x


def block_hash(normal: Column) -> Column:
    return F.substring(F.sha2(normal, 256), 1, 16)


def duplicate_kind(block: Column) -> Column:
    low, bare = F.lower(block), rx.trim(block)
    has = lambda bank: F.lit(False) if not bank else low.rlike("|".join(bank))
    return (
        F.when(has(NAV), "nav").when(bare.startswith("#"), "heading").when(has(FOOTER), "footer").when(has(RELATED), "related")
        .when(bare.startswith("-") | bare.startswith("*"), "card").otherwise("content")
    )


def duplicate_kind_sql(x: str) -> str:
    has = lambda bank: f"regexp_matches(lower({x}), {rx.q('|'.join(bank))})"
    return f"CASE WHEN {has(NAV)} THEN 'nav' WHEN starts_with({rx.trim_sql(x)}, '#') THEN 'heading' WHEN {has(FOOTER)} THEN 'footer' WHEN {has(RELATED)} THEN 'related' WHEN regexp_matches({rx.trim_sql(x)}, '^[-*]') THEN 'card' ELSE 'content' END"


def _first_of_each(df: DataFrame, items: str, key, to: str) -> DataFrame:
    """Adds ``to``: for each item of an array column whether no earlier one has its key; null keys are all first.

    The keys are sorted with their places and compared with their neighbours,
    so the work grows with n log n and stays in the row.
    """
    df = df.withColumn(f"{to}_sorted", F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at")))))
    order = F.col(f"{to}_sorted")
    before = F.concat(F.array(F.lit(None).cast(df.schema[f"{to}_sorted"].dataType.elementType)), F.slice(order, 1, F.greatest(F.size(order) - 1, F.lit(0))))
    flags = F.zip_with(order, F.slice(before, 1, F.size(order)), lambda x, p: F.struct(x["at"].alias("at"), F.coalesce(x["key"] != p["key"], F.lit(True)).alias("first")))
    return df.withColumn(f"{to}_flags", F.array_sort(flags)).withColumn(to, F.transform(f"{to}_flags", lambda x: x["first"])).drop(f"{to}_sorted", f"{to}_flags")


def mark_blocks(df: DataFrame, text_col: str, options: DedupeOptions = DedupeOptions(), to: str = "marked") -> DataFrame:
    """Adds ``to``: an array of block, trimmed, hash (null: blank or too short to compare), kept.  Null texts have null."""

    def hashed(x: Column) -> Column:
        bare = x["trimmed"]
        compared = (F.octet_length(bare) > 0) & ((F.octet_length(bare) >= options.min_length) | bare.startswith("#"))
        return F.struct(x["block"].alias("block"), bare.alias("trimmed"), F.when(compared, block_hash(normal_block(bare, options))).alias("hash"))

    bare = F.transform(split_blocks(F.col(text_col)), lambda b: F.struct(b.alias("block"), rx.trim(b).alias("trimmed")))  # trimmed once
    df = df.withColumn(f"{to}_blocks", F.transform(bare, hashed))
    df = _first_of_each(df, f"{to}_blocks", lambda x: x["hash"], f"{to}_kept")
    both = F.zip_with(f"{to}_blocks", f"{to}_kept", lambda b, k: F.struct(b["block"].alias("block"), b["trimmed"].alias("trimmed"), b["hash"].alias("hash"), k.alias("kept")))
    return df.withColumn(to, both).drop(f"{to}_blocks", f"{to}_kept")


def blocks(df: DataFrame, id_col: str, text_col: str, options: DedupeOptions = DedupeOptions()) -> DataFrame:
    """id, pos, block, trimmed, hash (null: blank or too short to compare), kept.

    Null texts give no rows; empty ones one blank block.  A repeated id is a document of its own.
    """
    rows = mark_blocks(df.select(id_col, text_col), text_col, options, "marked")
    return rows.select(id_col, F.inline(F.transform("marked", lambda b, i: F.struct(i.alias("pos"), *[b[k].alias(k) for k in ("block", "trimmed", "hash", "kept")]))))


def dedupe_columns(marked: Column) -> dict[str, Column]:
    """content, original_blocks, unique_blocks, duplicates_found, duplicate_signals from the array of mark_blocks."""
    kept, gone = F.filter(marked, lambda b: b["kept"]), F.filter(marked, lambda b: ~b["kept"])
    return {
        "content": rx.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda b: b["block"]), "\n\n"), r"\n{3,}", "\n\n")),
        "original_blocks": F.size(marked).cast("bigint"),
        "unique_blocks": F.size(F.filter(kept, lambda b: b["trimmed"] != "")).cast("bigint"),
        "duplicates_found": F.size(gone).cast("bigint"),
        "duplicate_signals": F.array_sort(F.array_distinct(F.transform(gone, lambda b: duplicate_kind(b["trimmed"])))),
    }


def dedupe(df: DataFrame, id_col: str, text_col: str, options: DedupeOptions = DedupeOptions()) -> DataFrame:
    """id, content, original_blocks, unique_blocks, duplicates_found, duplicate_signals of every document with a text."""
    rows = mark_blocks(df.select(id_col, text_col).filter(F.col(text_col).isNotNull()), text_col, options, "marked")
    return rows.select(id_col, *[c.alias(n) for n, c in dedupe_columns(F.col("marked")).items()])


def dedupe_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content: only the first of the lines that are equal but for case and outer space; blank lines stay."""
    rows = df.select(id_col, text_col).filter(F.col(text_col).isNotNull()).withColumn("line_list", F.split(text_col, "\n", -1))
    rows = _first_of_each(rows, "line_list", lambda x: F.nullif(F.lower(rx.trim(x)), F.lit("")), "line_first")
    kept = F.filter(F.arrays_zip("line_list", "line_first"), lambda x: x["line_first"])
    return rows.select(id_col, F.array_join(F.transform(kept, lambda x: x["line_list"]), "\n").alias("content"))


def unseen(new: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of ``new`` whose key is not in the store ``seen``; null keys stay."""
    return new.join(seen.select(key).distinct(), key, "left_anti")


def hashed_words(text: Column) -> Column:
    """Hashes of the words of a normalised text, in order and with repetitions."""
    return F.transform(F.regexp_extract_all(normal_block(text), F.lit(r"[\p{L}\p{Nd}]+"), 0), lambda w: F.xxhash64(w))


def shared_word_score(same: Column, wa: Column, wb: Column) -> Column:
    shared = F.size(F.filter(wb, lambda w: F.array_contains(wa, w)))
    union = F.size(wa) + F.size(wb) - shared
    ratio = F.floor(shared * 100 / F.when(union != 0, union)).cast("bigint")
    return F.when(same, F.lit(100).cast("bigint")).when((F.size(wa) == 0) | (F.size(wb) == 0) | (union == 0), F.lit(0).cast("bigint")).otherwise(ratio)


def near_duplicate_score(a: Column, b: Column) -> Column:
    """100 for equal normalised texts, else shared words over all words; not symmetric and not bounded by 100."""
    return shared_word_score(normal_block(a) == normal_block(b), hashed_words(a), hashed_words(b))


def near_duplicate_score_sql(a: str, b: str) -> str:
    x, y = normal_block_sql(a), normal_block_sql(b)
    wa, wb = (f"regexp_extract_all({n}, '[\\p{{L}}\\p{{Nd}}]+')" for n in (x, y))
    shared = f"len(list_filter({wb}, lambda w: list_contains({wa}, w)))"
    return f"CASE WHEN {x} = {y} THEN 100 WHEN len({wa}) = 0 OR len({wb}) = 0 THEN 0 ELSE ({shared} * 100) // (len({wa}) + len({wb}) - {shared}) END"
