"""One consistent form for visually identical text.

Look-alike classes are the transitive closure, by union-find, of four
relations over code points and short strings: width variants, canonical
(de)composition, kinds of space, and letters of other alphabets with the same
shape; invisible characters are joined with the empty string.  The most
frequent member in the corpus stands for its class.  Texts are rewritten by
leftmost-longest matches of one Aho-Corasick automaton over all members that
do not stand for their class.  Accents, case, digits, words and line breaks
are never joined.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import checkpoint

# Letters of other alphabets and the Latin letters of the same shape, from the published confusables.
LETTERS = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "ı", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Armenian
    "Լ": "L", "Ո": "U", "Տ": "S", "Օ": "O", "ա": "w", "գ": "q", "զ": "q", "հ": "h", "ո": "n", "ռ": "n", "ս": "u", "ց": "g", "ք": "f", "օ": "o", "յ": "j",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭼ": "E", "Ꭺ": "A", "Ꭻ": "J", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Small capitals and other Latin letters
    "ᴄ": "c", "ɪ": "i", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ɡ": "g", "ɑ": "a", "ǀ": "l",
}

_SPACES_KEPT = "\n\r\t\x0b\f"


def _is_invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def same_shape(c: str) -> str | None:
    """The letters that a variant form shows, by rule: width and font variants and letters standing as Roman numerals."""
    kind, _, to = unicodedata.decomposition(c).partition(" ")
    shown = "".join(chr(int(x, 16)) for x in to.split())
    if kind in ("<wide>", "<narrow>", "<font>"):
        return shown
    return shown if kind == "<compat>" and len(shown) == 1 and "ROMAN NUMERAL" in unicodedata.name(c, "") else None


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def classes_of(counts: dict[str, int]) -> dict[str, str]:
    """The rewriting of every member to its class's representative, for the code points that occur.

    counts: occurrences by code point.  Ties go to the lower code point.
    """
    sets = Classes()
    marks = sorted(c for c in counts if unicodedata.combining(c))
    # The whole relation, not only the part that occurs: classes do not depend on which members are in use.
    for other, latin in LETTERS.items():
        sets.join(other, latin)
    for c in counts:
        shown = same_shape(c)
        if _is_invisible(c):
            sets.join(c, "")
        elif unicodedata.category(c) == "Zs" and c not in _SPACES_KEPT:
            sets.join(c, " ")
        elif shown:
            sets.join(c, shown)
    # Strings: an accented letter, and every member of its base letter's class with the accent.
    singles = {x: m for m in sets.members().values() for x in m}
    accented = {c for c in counts if len(unicodedata.normalize("NFD", c)) > 1}
    bases = {x for x in singles if len(x) == 1} | {c for c in counts if unicodedata.category(c).startswith("L")}
    for b in bases:
        for m in marks:
            whole = unicodedata.normalize("NFC", b + m)
            if len(whole) == 1:
                accented.add(whole)
    for c in accented:
        nfd = unicodedata.normalize("NFD", c)
        sets.join(c, nfd)
        base, rest = nfd[0], nfd[1:]
        for x in singles.get(base, [base]):
            sets.join(x + rest, nfd)
            sets.join(unicodedata.normalize("NFC", x + rest), nfd)
    rewrite: dict[str, str] = {}
    for group in sets.members().values():
        if "" in group:
            best = ""
        elif " " in group:
            best = " "
        else:
            best = min(group, key=lambda x: (-(counts.get(x, 0) if len(x) == 1 else 0), len(x), x))
        rewrite.update((x, best) for x in group if x != best and x)
    return rewrite


def automaton_of(rewrite: dict[str, str]):
    auto = ahocorasick.Automaton()
    for member, best in rewrite.items():
        auto.add_word(member, (len(member), best))
    auto.make_automaton()
    return auto


def consistent(text: str, auto) -> str:
    """The consistent form of one text, a fixed point of the rewriting.

    Each turn composes accents and rewrites; what a turn brings together (a
    letter and its accent, parted by an invisible character) the next one
    sees.  Every turn but the last shortens the text or brings it nearer to
    representatives, so it ends.
    """
    while True:
        before = text
        text = unicodedata.normalize("NFC", text)
        out, at = [], 0
        for end, (size, best) in auto.iter_long(text):
            start = end + 1 - size
            out.append(text[at:start])
            out.append(best)
            at = end + 1
        if at:
            out.append(text[at:])
            text = "".join(out)
        if text == before:
            return text


def character_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """codepoint, n over all texts: at most one row per code point of Unicode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            codes = np.frombuffer("".join(t for t in b.column(0).to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.uint32)
            low = np.bincount(codes[codes < 128], minlength=128)
            found = [(int(i), int(low[i])) for i in np.flatnonzero(low)]
            found += [(int(c), int(n)) for c, n in zip(*np.unique(codes[codes >= 128], return_counts=True))]
            for c, n in found:
                total[c] = total.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["codepoint", "n"])

    return documents.select(text_col).mapInArrow(run, "codepoint bigint, n bigint").groupBy("codepoint").agg(F.sum("n").alias("n"))


def fit_rewrite(documents: DataFrame) -> dict[str, str]:
    """Counts all texts and builds the rewriting; what comes to the driver is bounded by Unicode."""
    return classes_of({chr(r.codepoint): r.n for r in character_counts(documents).collect()})


def _forms(batches: Iterable[pa.RecordBatch], rewrite: dict[str, str], whole: bool) -> Iterator[pa.RecordBatch]:
    auto = automaton_of(rewrite)
    ascii_moves = any(len(m) == 1 and m.isascii() for m in rewrite)
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        forms = [t if t is None or (t.isascii() and not ascii_moves) else consistent(t, auto) for t in texts]
        if whole:
            yield pa.RecordBatch.from_arrays([ids, pa.array(forms, pa.string()), pa.array([f != t for f, t in zip(forms, texts)])], names=["doc_id", "text", "changed"])
        else:
            key = lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            look = [key(f) for f in forms]
            same = [k if f is t else key(t) for k, f, t in zip(look, forms, texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(look, pa.binary()), pa.array(same, pa.binary())], names=["doc_id", "look", "exact"])


def consistent_texts(documents: DataFrame) -> DataFrame:
    """doc_id, text (in the consistent form), changed.  Null texts stay null."""
    rewrite = fit_rewrite(documents)
    return documents.select("doc_id", "text").mapInArrow(lambda bs: _forms(bs, rewrite, True), "doc_id bigint, text string, changed boolean")


def look_keys(documents: DataFrame) -> DataFrame:
    """doc_id, look, exact: 128-bit keys of the consistent form and of the text itself; no text is shuffled."""
    rewrite = fit_rewrite(documents)
    keys = documents.select("doc_id", "text").mapInArrow(lambda bs: _forms(bs, rewrite, False), "doc_id bigint, look binary, exact binary")
    return keys.filter(F.col("look").isNotNull())


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the same look), texts (different strings in the class), members."""
    keys = look_keys(documents)
    per = keys.groupBy("look", "exact").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    per = per.groupBy("look").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members"))
    return keys.join(per, "look").select("doc_id", "class_id", "texts", "members")


#: Parts into which the documents of one string are split when its pairs are listed.
SALTS = 16


def look_links(documents: DataFrame) -> DataFrame:
    """look, exact_a, exact_b, a, b: pairs of different strings that look the same, with the smallest doc_id of each."""
    return _links(checkpoint(look_keys(documents)))


def _links(keys: DataFrame) -> DataFrame:
    strings = keys.groupBy("look", "exact").agg(F.min("doc_id").alias("low"))
    mixed = strings.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select("look")
    strings = strings.join(mixed, "look", "left_semi")
    a, b = (strings.select("look", F.col("exact").alias(f"exact_{x}"), F.col("low").alias(x)) for x in "ab")
    return a.join(b, "look").filter("exact_a < exact_b")


def look_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: documents that look the same but are different strings.

    Strings are paired first, each once; then the documents of both strings
    take their places, split into SALTS parts, so that no string's documents
    meet in one task.  Copies of one string are no pairs.
    """
    keys = checkpoint(look_keys(documents))
    links = _links(keys).select("exact_a", "exact_b")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    a, b = (keys.select(F.col("exact").alias(f"exact_{x}"), F.col("doc_id").alias(f"id_{x}"), salt.alias("salt")) for x in "ab")
    pairs = links.withColumn("salt", every).join(a, ["exact_a", "salt"]).select("exact_b", "id_a", every.alias("salt")).join(b, ["exact_b", "salt"])
    return pairs.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()
