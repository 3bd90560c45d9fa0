"""Template residue, filler and error texts in extraction records.

The statements of a record are the lines of its body, which the page model of
``boilerplate`` tells from the page's furniture, and the sentences around
anything that looks like an unfilled slot.  Their canonical form has typed
tokens for numbers, slots and words of the classical filler text.  Statements
are compared across the corpus: 64-bit SimHash signatures over character
trigrams, ten tables keyed by two of five blocks (no pair within Hamming
distance 3 is missed), verified by Hamming distance and trigram similarity.

Trust comes from three sources, none of them a list of error phrases: the
records that the fetcher noted (soft 404, hints, issues, needs a browser),
published notations of placeholders, and the classical filler text.  It is
pooled over the connected components: a component is residue if it holds a
trusted slot or the filler text, or if most of its pages were noted.  A
record is residue if it has a residue slot or if residue makes up a third of
its body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import boilerplate
from pagewright.session import checkpoint, checkpoint_round

MAX_HAMMING, MIN_SIMILARITY = 3, 0.8
#: Residue statements, whose variable neighbours may stay without a label, make up this share of a residue record.
BODY_SHARE = 1 / 3
#: A component is trusted for its notes if it stands on so many pages, and this share of them was noted.
NOTED_PAGES, NOTED_SHARE = 2, 0.5
#: Rows of the ten tables that meet in one task.
TABLE_ROWS = 500_000
#: Trigrams that are hashed at once (64 bytes each).
CHUNK = 1 << 18

# The classical filler text; its words' first three letters mark filler in any corrupted form.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
_DOUBLED = re.compile(r"(.)\1")
_FILLER_HEADS = frozenset(_DOUBLED.sub(r"\1", w)[:3] for w in FILLER.split())

# Published notations of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{[^{}|\n]*\}\}|\{%[^%\n]+%\}|<%[=\-]?[^%\n]+%>|[$#]\{[A-Za-z_][\w.]*\}|\[\[\w*_\w*\]\]|%%\w+%%|%\([a-z_]\w*\)s"
    r"|(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)|@Model\.\w+|<your [^<>\n]+>|\[(?:INSERT|YOUR) [^\[\]\n]+\]|\[object Object\]|(?<![\w\\^_{}$])\{\d{1,2}\}(?![\w{^_])"
    r"|\b(?:[Ww]elcome to|[Pp]osted by|[Dd]ear|[Hh]ello|[Hh]i|[Oo]nly) (?:undefined|null|NaN)\b|\bundefined on undefined\b"
)
_WIKI_WORDS = frozenset("__TOC__ __NOTOC__ __FORCETOC__ __NOEDITSECTION__ __NOINDEX__ __INDEX__ __NEWSECTIONLINK__ __HIDDENCAT__ __NOGALLERY__ __INIT__ __MAIN__ __NAME__ __FILE__".split())
#: What may be a slot in another notation: a name between signs.  It counts only where a trusted slot stands in the same statement.
_MAYBE_SLOT = re.compile(r"<<[\w .-]+>>|(?<![\w\[])\[[A-Z][A-Z_ ]+\](?!\()|(?<![\w%])%[A-Za-z_]+%(?!\w)|(?<!\w)(?:undefined|null|NaN)(?!\w)|(?<![\w{$#])\{[A-Za-z_][\w.]*\}")
_HINTS = ("{", "<%", "<<", "<your", "[[", "[object", "%", "__", "@Model", "undefined", "null", "NaN")
_CAPITALS = re.compile(r"\[[A-Z][A-Z_ ]")
_CODE = re.compile(r"(?ms)^[ ]{0,3}(```+|~~~+).*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)|(?<!`)`[^`\n]+`(?!`)|<(pre|code|syntaxhighlight|source|script|style|math)\b.*?</\2>|\\begin\{(verbatim|lstlisting|equation\*?|align\*?)\}.*?\\end\{\3\}|\$\$.*?\$\$")
_MATH = re.compile(r"\\[A-Za-z]+(?:\{[^{}]*\}|\[[^\[\]]*\]|[_^])+|\$[^$\n]*\$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+|\d+|[\x04\x06]")
SLOT, FILL = "\x04", "\x05"


def _slots(text: str) -> tuple[str, bool]:
    """The text with its slots marked, and whether one of them is of a trusted notation."""
    trusted = False

    def mark(m: re.Match) -> str:
        nonlocal trusted
        if m[0] in _WIKI_WORDS:
            return m[0]
        trusted = True
        return f" {SLOT} "

    text = PLACEHOLDER.sub(mark, text)
    return _MAYBE_SLOT.sub(f" {SLOT} ", text), trusted


_known: dict[str, str] = {}


def _token(w: str) -> str:
    x = "0" if w[0].isdigit() else FILL if w[:3] in _FILLER_HEADS or _DOUBLED.sub(r"\1", w[:5])[:3] in _FILLER_HEADS else w
    if len(_known) < 200_000:
        _known[w] = x
    return x


def canonical(text: str) -> str:
    """Lower-cased words; numbers, and runs of words of the filler text, are one token each."""
    get = _known.get
    out = [get(w) or _token(w) for w in _WORD.findall(_CAMEL.sub(" ", text).lower())]
    if FILL in out:
        out = [x for k, x in enumerate(out) if x != FILL or not k or out[k - 1] != FILL]
    return " ".join(out)


_FILLED = canonical(FILLER)


def slot_statements(text: str) -> list[tuple[str, bool]]:
    """(canonical form, trusted) of the sentences with a slot, outside text shown as code and formulas."""
    if not (any(h in text for h in _HINTS) or _CAPITALS.search(text)):
        return []
    text = _CODE.sub(" ", text)
    if "\\" in text:
        text = _MATH.sub(" ", text)
    out = []
    for sentence in _SENTENCE.split(text):
        if any(h in sentence for h in _HINTS) or _CAPITALS.search(sentence):
            marked, trusted = _slots(sentence)
            if SLOT in marked:
                out.append((canonical(marked), trusted))
    return out


#: Eight bits as four-lane sums of 16 bits each, two for every byte.
_LANES = np.array([[sum(((byte >> (7 - 4 * half - k)) & 1) << 16 * k for k in range(4)) for half in range(2)] for byte in range(256)], np.uint64)


def signatures(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its character trigrams, as signed numbers."""
    out = np.zeros(len(texts), np.int64)
    padded = [t if len(t) >= 3 else t.ljust(3) for t in texts]
    at = 0
    while at < len(padded):
        end, size = at, 0
        while end < len(padded) and (end == at or size + len(padded[end]) <= CHUNK):
            size += len(padded[end])
            end += 1
        codes = np.frombuffer("".join(padded[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t in padded[at:end]])
        ends = np.cumsum(lengths)
        with np.errstate(over="ignore"):
            h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = inside[ends - 2] = False  # trigrams that would reach into the next text
        counts = lengths - 2
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        pieces = np.unique(np.concatenate([starts, np.arange(0, counts.sum(), 1 << 15)]))  # a lane holds 65,535
        lanes = np.add.reduceat(_LANES[h[inside[:-2]].view(np.uint8).reshape(-1, 8)].reshape(-1, 16), pieces, axis=0)
        sums = np.add.reduceat(lanes.view(np.uint16).astype(np.int64), np.searchsorted(pieces, starts), axis=0)
        out[at:end] = np.packbits(sums * 2 > counts[:, None], axis=1).view(np.int64).reshape(-1)
        at = end
    return out


def similarity(a: str, b: str) -> float:
    """Dice coefficient of the trigram multisets."""
    x, y = Counter(a[i : i + 3] for i in range(max(1, len(a) - 2))), Counter(b[i : i + 3] for i in range(max(1, len(b) - 2)))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def statements_of(batch: list[tuple], model: boilerplate.Model, known: dict) -> list[list[tuple[str, int, bool]]]:
    """batch: what the page model reads of each record -> (canonical form, words, trusted) of its statements.

    Statements of slots have no words of the body and begin with their mark,
    so that they are near each other only.  Bylines are no statements.
    """
    out = []
    for row, gone in zip(batch, boilerplate.boilerplate_lines(batch, model, known)):
        text = row[0]
        found: list[tuple[str, int, bool]] = []
        if text:
            drop = set(gone)
            for k, line in enumerate(text.split("\n")):
                if k in drop:
                    continue
                form = canonical(line)
                if form and not boilerplate.BYLINE.match(line):
                    found.append((form, line.count(" ") + 1, form == _FILLED))
            found += [(SLOT + SLOT + form, 0, trusted) for form, trusted in slot_statements(text)]
        out.append(found)
    return out


def _noted() -> Column:
    """Whether the fetcher noted anything against the record; nulls note nothing."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flag("is_soft404") | some(F.col("soft404_hints")) | some(F.col("validation.issues")) | flag("validation.needsBrowser")


_STATEMENT = "result_id bigint, page bigint, seq int, signature bigint, words bigint, slot boolean, trusted boolean, noted boolean"


def _mapped(records: DataFrame, model: boilerplate.Model, texts: bool) -> DataFrame:
    """The statements of all records, or with ``texts`` their signatures and canonical forms."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            found = statements_of(list(zip(*cols[1:8])), model, known)
            forms = list(dict.fromkeys(f for x in found for f, _, _ in x))
            signs = dict(zip(forms, signatures(forms).tolist()))
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(list(signs.values()), pa.int64()), pa.array(forms, pa.string())], names=["signature", "statement"])
                continue
            rows = [(rid, page, k, signs[f], n, f[0] == SLOT, trusted, note) for rid, note, page, x in zip(cols[0], cols[8], cols[9], found) for k, (f, n, trusted) in enumerate(x)]
            out = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _STATEMENT.split(", ")])

    return records.select(*boilerplate.read_columns(), _noted().alias("noted"), F.coalesce("page_id", -F.col("result_id")).alias("page")).mapInArrow(run, "signature bigint, statement string" if texts else _STATEMENT)


_BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def near_signatures(nodes: DataFrame) -> DataFrame:
    """nodes: signature (distinct) -> a, b: pairs within the Hamming distance.

    Ten tables, keyed by two of five blocks; a signature has a bounded number
    of neighbours within distance 3, whatever the number of statements.  Only
    signatures are shuffled.
    """

    def block(k: int) -> Column:
        start, width = _BLOCKS[k]
        return F.shiftrightunsigned("signature", start).bitwiseAND(F.lit((1 << width) - 1))

    tasks = 1 + nodes.count() * 10 // TABLE_ROWS  # so that a task's share of the tables does not grow with the corpus
    keys = F.array(*[F.shiftleft(F.lit(t).cast("bigint"), 32) + F.shiftleft(block(i), 13) + block(j) for t, (i, j) in enumerate(combinations(range(5), 2))])
    rows = nodes.select("signature", F.explode(keys).alias("key")).repartition(tasks, "key")
    a, b = (rows.select("key", F.col("signature").alias(x)) for x in "ab")
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_HAMMING))
    return pairs.select("a", "b").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose texts are similar.  texts: signature, statement."""
    x, y = (texts.select(F.col("signature").alias(k), F.col("statement").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [similarity(p, q) >= MIN_SIMILARITY for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a bigint, b bigint")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """signature, component: smallest signature reachable; checkpointed rounds of label exchange with jumps."""
    both = checkpoint_round(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = nodes.select(F.col("signature").alias("a"), F.col("signature").alias("component"))
    if both.isEmpty():
        return label.withColumnRenamed("a", "signature")
    touched = checkpoint_round(label.join(both.select("a").distinct(), "a", "left_semi"))
    while True:
        near = both.join(touched.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        new = touched.join(near, "a", "left").select("a", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = new.select(F.col("a").alias("j"), F.col("component").alias("jumped"))
        new = new.join(jump, F.col("component") == F.col("j"), "left").select("a", F.least("component", F.coalesce("jumped", "component")).alias("component"), "was")
        new = checkpoint_round(new)
        changed = not new.filter("component <> was").isEmpty()
        touched = new.select("a", "component")
        if not changed:
            break
    return label.join(touched.withColumnRenamed("component", "c"), "a", "left").select(F.col("a").alias("signature"), F.coalesce("c", "component").alias("component"))


def labelled_signatures(rows: DataFrame, texts_of) -> DataFrame:
    """signature, residue: one row per distinct signature of all statements.

    Exact copies and equal signatures collapse before any pairing.  texts_of
    gives the canonical forms of the records whose ids it gets; it is asked
    for one record of each signature that has a neighbour.
    """
    nodes = rows.groupBy("signature").agg(
        F.max("trusted").alias("trusted"), F.count_distinct("page").alias("n"), F.count_distinct(F.when(F.col("noted"), F.col("page"))).alias("noted"), F.max("slot").alias("slot"), F.min("result_id").alias("result_id"),
    )
    nodes = checkpoint(nodes)
    pairs = checkpoint(near_signatures(nodes))
    paired = pairs.select(F.col("a").alias("signature")).union(pairs.select("b")).distinct()
    asked = nodes.join(paired, "signature")
    texts = texts_of(asked.select("result_id").distinct()).join(paired, "signature", "left_semi").groupBy("signature").agg(F.min("statement").alias("statement"))
    parts = nodes.join(components(nodes, similar_pairs(pairs, checkpoint(texts))), "signature")
    noted = (F.sum("n") >= NOTED_PAGES) & (F.sum("noted") >= NOTED_SHARE * F.sum("n"))
    seen = parts.groupBy("component").agg((F.max("trusted") | (noted & ~F.max("slot"))).alias("residue"))
    return parts.join(seen, "component").select("signature", "residue")


def judged_records(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """result_id, reason (placeholder, statements): the residue records, each once.

    Null and empty contents are no residue.  A null result_id is one record.
    """
    model = boilerplate.train(extractions, pages)
    rows = checkpoint(_mapped(extractions, model, False).dropDuplicates(["result_id", "seq"]))
    texts_of = lambda ids: _mapped(extractions.join(ids, "result_id", "left_semi"), model, True)
    residue = labelled_signatures(rows, texts_of).filter("residue").select("signature", F.lit(True).alias("residue"))
    each = rows.join(residue, "signature", "left")
    weight = each.groupBy("result_id").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("residue"), F.col("words")).otherwise(0)).alias("bad"), F.max(F.col("slot") & F.coalesce("residue", F.lit(False))).alias("slot"))
    body = (F.col("bad") >= F.col("words") * BODY_SHARE) & (F.col("bad") > 0)
    return weight.filter(body | F.col("slot")).select("result_id", F.when(F.col("slot"), "placeholder").otherwise("statements").alias("reason"))


def residue_records(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    return judged_records(extractions, pages).select("result_id")


def without_residue(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """The clean rest: every column of the records that are not residue, repeated deliveries kept as they came."""
    return extractions.join(residue_records(extractions, pages), "result_id", "left_anti")
