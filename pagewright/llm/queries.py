"""Queries of the training-data operators, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import boilerplate, leakage, lookalike, markup, mixture, repetition, residue, sitelines
from pagewright.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(boilerplate.found_lines, "extractions", "page_in"),
        "p1_content": _on(boilerplate.main_content, "extractions", "page_in"),
        "p2_found": _on(residue.residue_records, "extractions", "page_in"),
        "p2_reasons": _on(residue.judged_records, "extractions", "page_in"),
        "p2_clean": lambda s, d: residue.without_residue(table(s, d, "extractions"), table(s, d, "page_in")).select("result_id", "page_id", "loaded_at", "content"),
        "p3_found": _on(repetition.repetitive_records, "extractions"),
        "p3_shares": lambda s, d: repetition.score_repetition(table(s, d, "extractions"), exact_for_all=True).select("result_id", "words", "repeated", F.round("repeated_share", 6).alias("repeated_share")),
        "p3_pruning": _on(repetition.pruning, "extractions"),
        "p5_found": _on(markup.marked_elements, "extractions"),
        "p5_text": _on(markup.clean_text, "extractions"),
        "p6_found": lambda s, d: sitelines.repeated_lines(table(s, d, "extractions")).select("site", "line"),
        "p6_sequences": _on(sitelines.repeated_sequences, "extractions"),
        "p6_content": _on(sitelines.without_repeated_lines, "extractions"),
        "p8_found": _on(leakage.verbatim_leaks, "documents", "eval_items"),
        "p8_leaks": _on(leakage.leaks, "documents", "eval_items"),
        "p9_shares": _on(mixture.mixture_shares, "documents", "mix_targets"),
        "p9_mixture": _on(mixture.select_mixture, "documents", "mix_targets"),
        "p10_found": _on(lookalike.look_pairs, "documents"),
        "p10_links": lambda s, d: lookalike.look_links(table(s, d, "documents")).select("a", "b"),
        "p10_classes": _on(lookalike.look_classes, "documents"),
        "p10_text": _on(lookalike.consistent_texts, "documents"),
    }


_HOST = r"""regexp_replace(lower(regexp_extract(coalesce(final_url, url), '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^(www\.|m\.)', '')"""

_P3_WORDS = r"""
records AS (SELECT result_id, any_value(content) AS content FROM extractions GROUP BY result_id),
listed AS (SELECT result_id, regexp_extract_all(regexp_replace(lower(content), '[0-9]+', '0', 'g'), '[\p{L}\p{N}]+') AS w FROM records),
starts AS (SELECT result_id, len(w) AS n, unnest(range(1, greatest(len(w) - 2, 1))) AS i, w FROM listed WHERE len(w) >= 4),
runs AS (SELECT result_id, i, row_number() OVER (PARTITION BY result_id, w[i], w[i + 1], w[i + 2], w[i + 3] ORDER BY i) AS nth FROM starts),
marked AS (SELECT result_id, count(DISTINCT i + k) AS repeated FROM runs, (SELECT unnest(range(0, 4)) AS k) WHERE nth > 1 GROUP BY result_id),
shares AS (SELECT l.result_id, coalesce(len(l.w), 0) AS words, coalesce(m.repeated, 0) AS repeated FROM listed l LEFT JOIN marked m USING (result_id))
"""

_P6 = rf"""
WITH records AS (SELECT DISTINCT result_id, {_HOST} AS site, content FROM extractions WHERE content IS NOT NULL),
lines AS (
  SELECT DISTINCT site, result_id, regexp_replace(lower(trim(regexp_replace(x, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS line
  FROM (SELECT site, result_id, unnest(string_split(content, chr(10))) AS x FROM records)),
sizes AS (SELECT site, count(DISTINCT result_id) AS m FROM records GROUP BY site)
SELECT site, line FROM lines JOIN sizes USING (site) WHERE length(line) >= 10 GROUP BY site, line, m HAVING count(*) >= 5 AND count(*) * 10 >= m
"""

# The oracle's own table of letters, Greek and Cyrillic in the order of the Latin letters they look like.
_FROM = "ΑВΒСϹЕΕНΗІΙӀЈКΚМΜΝОΟРΡԚЅТΤԜХΧУΥҮΖАаαсϲԁеһіјϳοоρрԛѕυνѵԝхуγү"
_TO = "ABBCCEEHHIIIJKKMMNOOPPQSTTWXXYYYZAaaccdehijjooppqsuvvwxyyy"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_P10 = rf"""
WITH seen AS (
  SELECT doc_id, text, translate(translate(regexp_replace(text, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g'), {_quoted(_WIDE)}, {_quoted(_NARROW)}),
    chr(160) || chr(8199) || chr(8201) || chr(8239) || chr(8194) || chr(8195) || chr(8200) || chr(8202) || chr(12288), '         ') AS x FROM documents WHERE text IS NOT NULL),
looks AS (SELECT doc_id, text, nfc_normalize(translate(replace(replace(nfc_normalize(translate(x, {_quoted(_FROM)}, {_quoted(_TO)})), 'ё', 'ë'), 'Ё', 'Ë'), {_quoted(_FROM)}, {_quoted(_TO)})) AS look FROM seen)
"""
_P10_FOUND = _P10 + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"
_P10_CLASSES = _P10 + """SELECT doc_id, min(doc_id) OVER (PARTITION BY look) AS class_id, m.texts, count(*) OVER (PARTITION BY look) AS members
FROM looks JOIN (SELECT look, count(DISTINCT text) AS texts FROM looks GROUP BY 1) m USING (look)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_P3_WORDS} SELECT result_id FROM shares WHERE words >= 8 AND repeated >= 0.3 * words",
        "p3_shares": f"WITH {_P3_WORDS} SELECT result_id, words, repeated, round(CASE WHEN words >= 8 THEN repeated / words ELSE 0 END, 6) AS repeated_share FROM shares",
        "p6_found": _P6,
        "p10_found": _P10_FOUND,
        "p10_classes": _P10_CLASSES,
    }
