"""Evaluation passages in a corpus: canonical templates, hash join of their windows, slot consistency.

Every word is canonicalised by a rule that depends on the word alone: numbers
(in figures or words), units and names (words the items write with a capital
inside a sentence) become typed placeholders.  Windows of twelve canonical
words are hashed and joined with those of the items.  The words behind the
placeholders are the slots of a window: equal slots are a verbatim leak, a
one-to-one renaming of slots is a re-parameterised one if it holds in all
windows of the same passage, that is along one alignment of document and item.
Since equal words have equal templates, no verbatim leak is missed.

A corpus window has up to two more templates, for names that no item uses:
in one, capitalised words that the items never write are names as well, in
the other also those with a capital inside a sentence.

The readers hold a Bloom filter of the items' templates, of a fixed size
whatever the number of items, so that only matching windows leave them; the
join of what is left is by hash and exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.mail import readable
from pagewright.session import checkpoint

WINDOW = 12
#: Bits of the Bloom filter of item windows (16 MB), and the bits that each window sets.
FILTER_BITS, FILTER_HASHES = 1 << 27, 4
#: Tokens of the readers' memory are forgotten between batches beyond this.
KNOWN_TOKENS = 500_000
# Units of measurement and time.
UNITS = frozenset(
    "percent litre litres liter liters metre metres meter meters kilometre kilometres kilometer kilometers km cm mm kg gram grams kilogram kilograms ton tons tonne tonnes "
    "mile miles foot feet inch inches yard yards pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks month months year years "
    "euro euros dollar dollars cent cents degree degrees watt watts volt volts".split()
)
# Numbers in words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
_PUNCT = re.compile(r"[^\w\s]|_")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words between white space, lower-cased and without punctuation."""
    return _PUNCT.sub("", text).lower().split()


def item_text(text: str | None) -> str:
    """The item without its instruction, which is the first line."""
    return (text or "").partition("\n")[2]


def capitalised(bare: str) -> bool:
    """Whether a word without its punctuation begins with a capital of any script and is not all capitals."""
    return bare[:1].isupper() and not bare.isupper()


def inside(token: str) -> bool:
    """Whether a sentence goes on after this token."""
    return token.rstrip("\"')]}»”’")[-1:] not in (".", "!", "?", ":", "…", "")


def names_in(text: str) -> set[str]:
    """Words with a capital that do not begin a sentence or line."""
    out = set()
    for line in text.splitlines():
        tokens = line.split()
        for before, token in zip(tokens, tokens[1:]):
            bare = _PUNCT.sub("", token)
            if capitalised(bare) and inside(before):
                out.add(bare.lower())
    return out


def canonical(word: str, names: frozenset[str]) -> str:
    if word[0].isdigit() or word.isnumeric() or word in NUMBERS:
        return "\x01number"
    if word in UNITS:
        return "\x01unit"
    return "\x01name" if word in names else word


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def window_hashes(h: np.ndarray) -> np.ndarray:
    """Polynomial hash of every twelve consecutive word hashes, modulo 2^64."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out = out * _MULT + h[j : j + len(out)]
    return out


class Words:
    """What is known of each token between white space, as columns by its number."""

    def __init__(self, names: frozenset[str], ordinary: frozenset[str] = frozenset()) -> None:
        self.names, self.ordinary = names, ordinary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.rows: list[tuple] = []

    def numbers(self, text: str) -> list[int]:
        known, out = self.known, []
        for token in text.split():
            k = known.get(token)
            out.append(self._add(token) if k is None else k)
        return out

    def _add(self, token: str) -> int:
        bare = _PUNCT.sub("", token)
        word = bare.lower()
        self.known[token] = k = len(self.words)
        self.words.append(word)
        shown = canonical(word, self.names) if word else ""
        capital = capitalised(bare) and shown == word
        self.rows.append((_hash(word), _hash(shown), shown != word, capital and word not in self.ordinary, capital, inside(token)))
        return k

    def columns(self) -> list[np.ndarray]:
        """exact, template, typed, foreign (a capital, and no item has the word), capital, inside (the sentence goes on after it)."""
        return [np.array(c, np.uint64 if i < 2 else bool) for i, c in enumerate(zip(*self.rows))]


def slots_of(words: list[str], names: frozenset[str]) -> list[str]:
    return [w for w in words if canonical(w, names)[0] == "\x01"]


_NAME = np.uint64(_hash("\x01name"))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


_WINDOWS = "id bigint, part bigint, pos bigint, template bigint, exact bigint, slots array<string>"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES)], names=[x.split()[0] for x in _WINDOWS.split(", ")])


def item_words(items: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The items' names and their other words: each a set of distinct words, which grows far more slowly than the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: set[str] = set()
        words: set[str] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                names |= names_in(item_text(text))
                words.update(words_of(item_text(text)))
        every = sorted(names | words)
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([w in names for w in every], pa.bool_())], names=["word", "name"])

    got = items.select("text").mapInArrow(run, "word string, name boolean").groupBy("word").agg(F.max("name").alias("name")).collect()
    return frozenset(r.word for r in got if r.name), frozenset(r.word for r in got if not r.name)


def item_windows(items: DataFrame, names: frozenset[str]) -> DataFrame:
    """id, part (0), pos, template, exact, slots of every window of every item, each item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words_of(item_text(text))
                exact, template = (_signed(window_hashes(np.array([_hash(w) for w in x], np.uint64))) for x in (ws, [canonical(w, names) for w in ws]))
                rows += [(item, 0, k, int(t), int(e), slots_of(ws[k : k + WINDOW], names)) for k, (t, e) in enumerate(zip(template, exact))]
            yield _batch(rows)

    return items.select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates(["item_id"]).mapInArrow(run, _WINDOWS)


def _bits(template: np.ndarray, size: int) -> np.ndarray:
    """Places in the filter, one row for each of its hashes."""
    x = template.astype(np.uint64)
    width = np.uint64(64 - (size - 1).bit_length())
    with np.errstate(over="ignore"):
        return np.stack([((x ^ np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MULT) >> width for k in range(FILTER_HASHES)])


def template_filter(windows: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """The filter of the windows' templates.  It is built on the executors word by word; at most size / 64 words are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.astype(np.int64))], names=["word", "bits"])

    out = np.zeros(size // 64, np.uint64)
    got = windows.select("template").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint64)
    return out


def passes(bloom: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Whether each template may be an item's."""
    hit = np.ones(len(template), bool)
    for at in _bits(template, len(bloom) * 64):
        hit &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def corpus_windows(documents: DataFrame, names: frozenset[str], bloom: np.ndarray, ordinary: frozenset[str] = frozenset()) -> DataFrame:
    """id, part, pos, template, exact, slots of the corpus windows that pass the filter, once for each different template.

    ordinary are the items' words that are no names.
    """
    words_set = np.flatnonzero(bloom)
    packed = (words_set, bloom[words_set], len(bloom))  # sent to the readers without its zeros

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_filter = np.zeros(packed[2], np.uint64)
        own_filter[packed[0]] = packed[1]
        words = Words(names, ordinary)
        for b in batches:
            if len(words.words) > KNOWN_TOKENS:
                words.clear()
            numbers: list[int] = []
            spans: list[tuple[int, int, int]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for nth, part in enumerate(readable(text)):
                    found = words.numbers(part)
                    if len(found) >= WINDOW:
                        spans.append((doc, len(numbers), nth))
                        numbers += found
            if not spans:
                continue
            at = np.array(numbers)
            exact, shown, typed, foreign, capital, goes_on = (c[at] for c in words.columns())
            begins = np.array([s[1] for s in spans])
            part = np.searchsorted(begins, np.arange(len(at)), side="right") - 1
            within = np.concatenate([[False], goes_on[:-1]])
            within[begins] = False
            own = typed | foreign
            kept = np.array([bool(w) for w in words.words])[at]  # tokens of punctuation only are no words
            at, exact, shown, part = at[kept], exact[kept], shown[kept], part[kept]
            masks = [m[kept] for m in (typed, own, own | capital & within)]
            whole = part[: max(len(part) - WINDOW + 1, 0)] == part[WINDOW - 1 :]  # within one part
            exact, seen, rows = _signed(window_hashes(exact)), [], []
            for mask in masks:
                template = _signed(window_hashes(np.where(mask & ~masks[0], _NAME, shown)))
                hit = whole.copy()
                for other in seen:
                    hit &= template != other
                seen.append(template)
                hit &= passes(own_filter, template)
                for k in np.flatnonzero(hit).tolist():
                    slots = [words.words[i] for i in at[k : k + WINDOW][mask[k : k + WINDOW]].tolist()]
                    doc, _, nth = spans[part[k]]
                    rows.append((doc, nth, k, int(template[k]), int(exact[k]), slots))
            yield _batch(rows)

    return documents.select("doc_id", "text").mapInArrow(run, _WINDOWS)


def leaks(documents: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, windows, verbatim, reparameterised: documents with a window of an item.

    verbatim and reparameterised count the shared windows with equal slots and
    with slots renamed one to one; windows with other slots, and those of a
    passage whose windows contradict each other's renaming, do not count as
    renamed.  Items of fewer than twelve words have no window; null texts have
    none.  Every place of a document counts.
    """
    names, ordinary = item_words(items)
    right = checkpoint(item_windows(items, names))
    bloom = template_filter(right, filter_bits)
    left = corpus_windows(documents, names, bloom, ordinary).select(F.col("id").alias("doc_id"), "part", "pos", "template", "exact", "slots")
    right = right.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "template", F.col("exact").alias("item_exact"), F.col("slots").alias("item_slots"))
    hit = left.join(right, "template")
    same = F.col("exact") == F.col("item_exact")
    pairs = F.arrays_zip("slots", "item_slots")
    hit = hit.select("doc_id", "item_id", "part", (F.col("pos") - F.col("item_pos")).alias("shift"), same.alias("same"), F.when(~same, pairs).alias("pairs"))
    # A passage has as many windows as it has words, so its pairs are few.
    passage = hit.groupBy("doc_id", "item_id", "part", "shift").agg(F.count_if("same").alias("verbatim"), F.count_if(~F.col("same")).alias("other"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    size = lambda c: F.size(F.array_distinct(c))
    renamed = (F.size("pairs") == size("pairs.slots")) & (F.size("pairs") == size("pairs.item_slots"))
    out = passage.groupBy("doc_id", "item_id").agg(F.sum("verbatim").alias("verbatim"), F.sum(F.when(renamed, F.col("other")).otherwise(0)).alias("reparameterised"))
    return out.filter("verbatim + reparameterised > 0").select("doc_id", "item_id", (F.col("verbatim") + F.col("reparameterised")).alias("windows"), "verbatim", "reparameterised")


def verbatim_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of the documents that hold twelve consecutive words of an item."""
    return leaks(documents, items).filter("verbatim > 0").select("doc_id", "item_id")
