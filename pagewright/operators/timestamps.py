"""Mixed time notations to one UTC instant, with per-source format mixtures.

Every value is parsed under each notation that fits it.  The values of a
source are first reduced to counts per set of fitting notations; on these
counts expectation-maximisation fits the source's mixture of notations, and
the posterior picks the reading or marks the value as ambiguous.  What is known
of a source beforehand (its locale) weighs the likelihood of a notation; it
bars none.  Each source also writes some texts that only look like a date, a
component of its own in the mixture.  The counts are few per source whatever
the number of values, so no task holds a source's values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import chain
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import checkpoint, site_of

# Month names of the languages read (English, German, French, Spanish).
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "janvier": 1, "janv": 1, "enero": 1, "ene": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "févr": 2, "fevrier": 2, "febrero": 2,
    "mar": 3, "march": 3, "märz": 3, "mrz": 3, "maerz": 3, "mars": 3, "marzo": 3,
    "apr": 4, "april": 4, "avril": 4, "avr": 4, "abril": 4, "abr": 4,
    "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "juil": 7, "julio": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "setiembre": 9,
    "oct": 10, "october": 10, "oktober": 10, "okt": 10, "octobre": 10, "octubre": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "december": 12, "dezember": 12, "dez": 12, "décembre": 12, "déc": 12, "decembre": 12, "diciembre": 12, "dic": 12,
}

# Hours of the zone abbreviations that are understood.
ZONE_HOURS = {"EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "JST": 9, "GMT": 0, "UTC": 0, "Z": 0}

_TIME = r"(?P<h>\d{1,2})(?:[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?)?(?:\s*Uhr)?(?:\s*(?P<ap>[ap]\.?m\.?))?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\s*\((?:[^()]*)\))?(?:\[[\w/+\-]+\])?"
_TAIL = rf"(?:(?:\s*,\s*|\s+)(?:at\s+|à\s+|um\s+|a\s+las\s+)?{_TIME}{_ZONE})?"
_WEEKDAY = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_MONTH = r"(?P<mon>[^\W\d_]{3,10})\.?"

_FORMS = [
    ("iso_basic", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_ZONE}", re.I)),
    ("iso", re.compile(rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:T|\s+){_TIME}{_ZONE})?", re.I)),
    ("year_slash", re.compile(rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_TAIL}", re.I)),
    ("dot_dmy", re.compile(rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}){_TAIL}", re.I)),
    ("slash_mdy", re.compile(rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}}){_TAIL}", re.I)),
    ("slash_dmy", re.compile(rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}){_TAIL}", re.I)),
    ("asctime", re.compile(rf"[A-Za-z]{{3,9}}\s+{_MONTH}\s+(?P<d>\d{{1,2}})\s+(?P<h>\d{{1,2}}):(?P<mi>\d{{2}}):(?P<s>\d{{2}})(?:\s+(?P<z>Z|[+-]\d{{4}}|[A-Z]{{1,5}}))?\s+(?P<y>\d{{4}})", re.I)),
    ("day_month", re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th|º)?[\s\-]+(?:de\s+|of\s+)?{_MONTH}[\s\-,]+(?:de\s+|del\s+)?(?P<y>\d{{4}}|\d{{2}}){_TAIL}", re.I)),
    ("month_day", re.compile(rf"{_WEEKDAY}{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}", re.I)),
]
_EPOCH = datetime(1970, 1, 1)
_OFFSET = re.compile(r"([+-])(\d{2}):?(\d{2})?$")


def _offset_seconds(z: str) -> int | None:
    """Seconds east of UTC; None for an unknown abbreviation or an offset beyond 18 hours."""
    if z.upper() in ZONE_HOURS:
        return ZONE_HOURS[z.upper()] * 3600
    m = _OFFSET.match(z)
    if not m:
        return None
    hours, minutes = int(m[2]), int(m[3] or 0)
    if hours > 18 or minutes > 59:
        return None
    return (hours * 3600 + minutes * 60) * (1 if m[1] == "+" else -1)


def readings(text: str | None) -> list[tuple[str, int, bool]]:
    """Every valid reading of a value: (notation, microseconds, has its own offset).

    The microseconds are UTC where the text has an offset (or is Unix time),
    else wall-clock time.  Null, empty and unreadable texts and impossible
    dates have no reading.
    """
    if text is None:
        return []
    text = " ".join(text.split())
    if text.isascii() and text.isdigit():
        n = int(text)
        if len(text) <= 11:
            return [("unix_s", n * 1_000_000, True)]
        return [("unix_ms", n * 1000, True)] if len(text) <= 14 else []
    if not any(c.isdigit() for c in text):
        return []
    out = []
    for name, form in _FORMS:
        m = form.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if "mon" in g:
            month = MONTHS.get(g["mon"].lower())
            if month is None:
                continue
        else:
            month = int(g["m"])
        year = int(g["y"])
        if len(g["y"]) == 2:
            year += 2000 if year < 69 else 1900
        hour, half = int(g.get("h") or 0), (g.get("ap") or "").lower().replace(".", "")
        if half:
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + (12 if half == "pm" else 0)
        elif g.get("h") and not g.get("mi"):
            continue  # a lone number is no time of day
        try:
            at = datetime(year, month, int(g["d"]), hour, int(g.get("mi") or 0), int(g.get("s") or 0))
        except ValueError:
            continue
        micros = (at - _EPOCH) // timedelta(microseconds=1) + int(((g.get("f") or "") + "000000")[:6])
        z = g.get("z")
        if z:
            offset = _offset_seconds(z)
            if offset is None:
                continue
            out.append((name, micros - offset * 1_000_000, True))
        else:
            out.append((name, micros, False))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("micros", T.LongType()), T.StructField("placed", T.BooleanType())])))
def readings_udf(texts: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for t in texts:
        r = known.get(t)
        if r is None:
            known[t] = r = [{"form": f, "micros": m, "placed": p} for f, m, p in readings(t)]
        out.append(r)
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def is_zone_udf(names: pd.Series) -> pd.Series:
    def known(n) -> bool:
        try:
            return bool(n) and ZoneInfo(n) is not None
        except (ValueError, KeyError, OSError):
            return False

    return names.map(known).astype(bool)


#: Likelihood of the notation that the locale speaks against, as a rule and as a hint, and of a text only looking like a date.
RULE_WEIGHT, HINT_WEIGHT, STRAY_WEIGHT = 1e-12, 0.3, 1e-6
STRAY = "none"


def em_verdicts(sets: list[list[str]], counts: list[int], against: list[str | None], weight: float, rounds: int, smoothing: float, sure: float) -> tuple[list, list]:
    """The notation and its posterior for each set of fitting notations of one source.

    against: the notation that the locale speaks against, whose likelihood is
    ``weight``.  None where no notation is sure; STRAY where the text is rather
    no date of this source.
    """
    every = sorted({f for s in sets for f in s} | {STRAY})
    mix = dict.fromkeys(every, 1.0 / len(every))

    def joint(s: list[str], bad: str | None) -> dict[str, float]:
        out = {f: mix[f] * (weight if f == bad else 1.0) for f in s}
        out[STRAY] = mix[STRAY] * STRAY_WEIGHT
        return out

    for _ in range(rounds):
        total = dict.fromkeys(every, smoothing)
        for s, k, bad in zip(sets, counts, against):
            of = joint(s, bad)
            z = sum(of.values())
            for f, x in of.items():
                total[f] += k * x / z
        z = sum(total.values())
        mix = {f: t / z for f, t in total.items()}
    best, share = [], []
    for s, bad in zip(sets, against):
        of = joint(s, bad)
        f = max(of, key=lambda x: (of[x], x))
        p = of[f] / sum(of.values())
        best.append(f if p >= sure else None)
        share.append(p)
    return best, share


def fit_mixtures(counts: DataFrame, rounds: int = 12, smoothing: float = 0.5, sure: float = 0.9, weight: float = RULE_WEIGHT) -> DataFrame:
    """EM over (source, against, forms, n): the mixture of notations of each source and a verdict per set of notations.

    forms: the sorted notations that fit; n: how many values have this set.
    Gives source, against, forms, form (null: ambiguous), posterior.  A
    source's group has as many rows as it has distinct sets, which the
    notations bound.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None  # the last source of a batch may go on in the next
        for frame in chain(frames, [None]):
            if frame is None:
                whole = left
            else:
                whole = frame if left is None else pd.concat([left, frame])
                open_ = whole["source"] == whole["source"].iloc[-1]
                left, whole = whole[open_], whole[~open_]
            if whole is None or whole.empty:
                continue
            for source, part in whole.groupby("source", sort=False):
                forms = [list(x) for x in part["forms"]]
                against = part["against"].tolist()
                best, share = em_verdicts(forms, part["n"].tolist(), against, weight, rounds, smoothing, sure)
                yield pd.DataFrame({"source": source, "against": against, "forms": forms, "form": best, "posterior": share})

    ordered = counts.repartition("source").sortWithinPartitions("source")
    return ordered.mapInPandas(run, "source string, against string, forms array<string>, form string, posterior double")


def resolve(values: DataFrame, rounds: int = 12, sure: float = 0.9, weight: float = RULE_WEIGHT, day_first: bool = True) -> DataFrame:
    """values: field, record_id, pos, raw, source, zone, locale (null: unknown) -> one row per value with a reading.

    Slash dates: a known locale speaks for the month first (en-US) or the day
    first; ``weight`` is the likelihood of the other order, which the source's
    own counts may outweigh unless it is very small.  An unknown locale speaks
    for the day if ``day_first``, else for nothing, and the counts decide.
    Adds form, posterior, ambiguous and utc_micros (null where the value is
    ambiguous or has no zone).  A text that is rather no date of its source
    gives no row.  A null source is a source of its own.  Repeated rows stay.
    """
    locale = F.coalesce("locale", F.lit("" if day_first else "unknown"))
    against = F.when(locale == "en-US", "slash_dmy").when(locale == "unknown", "").otherwise("slash_mdy")
    read = (
        values.select("field", "record_id", "pos", "raw", F.coalesce("source", F.lit("")).alias("source"), "zone", against.alias("against"), readings_udf("raw").alias("r"))
        .filter(F.size("r") > 0)
        .withColumn("forms", F.array_sort(F.expr("transform(r, x -> x.form)")))
    )
    read = checkpoint(read)  # parsed once; the counts and the verdicts read the short result
    counts = read.groupBy("source", "against", "forms").agg(F.count(F.lit(1)).alias("n"))
    verdicts = fit_mixtures(counts, rounds=rounds, sure=sure, weight=weight)
    picked = F.expr("filter(r, x -> x.form = form)")[0]
    out = read.join(verdicts, ["source", "against", "forms"]).filter((F.col("form") != STRAY) | F.col("form").isNull())
    out = out.withColumn("pick", F.when(F.col("form").isNotNull(), picked))
    local = F.to_utc_timestamp(F.timestamp_micros("pick.micros"), F.col("zone"))
    return out.select(
        "field", "record_id", "pos", "raw", "source", "form", "posterior",
        F.col("form").isNull().alias("ambiguous"),
        F.when(F.col("pick.placed"), F.col("pick.micros")).when(F.col("zone").isNotNull(), F.unix_micros(local)).alias("utc_micros"),
    )


def site_settings(domain_cfg: DataFrame) -> DataFrame:
    """site, zone, locale: one row per site; unknown zone names become null."""
    cfg = domain_cfg.select(site_of(F.concat(F.lit("//"), "domain")).alias("site"), F.trim("home_zone").alias("zone"), F.trim("locale").alias("locale"))
    cfg = cfg.filter(F.col("site").isNotNull()).groupBy("site").agg(F.min("zone").alias("zone"), F.min("locale").alias("locale"))
    return cfg.withColumn("zone", F.when(is_zone_udf("zone"), F.col("zone")))


def collected_values(ldjson: DataFrame, extractions: DataFrame, pages: DataFrame, domain_cfg: DataFrame) -> DataFrame:
    """The time texts of both tables with their site, zone and locale."""
    page_site = pages.select("page_id", site_of(F.col("url")).alias("source")).distinct().groupBy("page_id").agg(F.min("source").alias("source"))
    blocks = ldjson.select("page_id", F.posexplode("blocks").alias("pos", "b")).select(
        F.lit("datePublished").alias("field"), F.col("page_id").alias("record_id"), F.col("pos").cast("bigint"), F.col("b.datePublished").alias("raw")
    ).filter(F.col("raw").isNotNull()).distinct()
    blocks = blocks.join(page_site, blocks.record_id == page_site.page_id, "left").drop("page_id")
    blocks = blocks.join(site_settings(domain_cfg), F.col("source") == F.col("site"), "left").drop("site")
    modified = extractions.select(
        F.lit("responseLastModified").alias("field"), F.col("result_id").alias("record_id"), F.lit(0).cast("bigint").alias("pos"), F.col("response_last_modified").alias("raw"),
        site_of(F.coalesce("final_url", "url")).alias("source"),
    ).filter(F.col("raw").isNotNull()).distinct().withColumns({"zone": F.lit("UTC"), "locale": F.lit(None).cast("string")})
    return blocks.unionByName(modified)


def normalised_times(ldjson: DataFrame, extractions: DataFrame, pages: DataFrame, domain_cfg: DataFrame, weight: float = RULE_WEIGHT, day_first: bool = True) -> DataFrame:
    """Every readable time value with its notation, posterior and UTC instant."""
    return resolve(collected_values(ldjson, extractions, pages, domain_cfg), weight=weight, day_first=day_first)


def utc_text(micros: Column) -> Column:
    """ISO-8601 text of an instant, always with microseconds and Z."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def brute_force(field: str, raw: str | None, zone: str | None, locale: str | None) -> int | None:
    """The same rule for one value with the standard library; for tests."""
    barred = "slash_dmy" if locale == "en-US" else "slash_mdy"
    got = [r for r in readings(raw) if r[0] != barred]
    if not got:
        return None
    _, micros, placed = got[0]
    if placed:
        return micros
    if field == "responseLastModified":
        zone = "UTC"
    if not zone:
        return None
    at = (_EPOCH + timedelta(microseconds=micros)).replace(tzinfo=ZoneInfo(zone), fold=0)
    return micros - int(at.utcoffset() / timedelta(microseconds=1)) if at.tzinfo is not timezone.utc else micros
