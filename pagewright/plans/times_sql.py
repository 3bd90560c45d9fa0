"""DuckDB SQL of p7_found, written from the task's rules and not from the operator."""

_HOST = r"regexp_replace(lower(regexp_extract({x}, '//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^(www\.|m\.)', '')"

#: Date notations: pattern with the groups year, month, day and the rest (time and zone).
_DATES = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](.+))?$", "y m d rest"),
    (r"^(\d{4})(\d{2})(\d{2})T(.+)$", "y m d rest"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?:[, ]+(.+))?$", "y m d rest"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[, ]+(.+))?$", "d m y rest"),
    (r"^(?:\pL{2,10}\.?,? )?(\d{1,2})(?:\.|er|st|nd|rd|th)?[ -](?:de )?(\pL{3,10})\.?[ ,-]+(?:de )?(\d{4}|\d{2})(?:[, ]+(.+))?$", "d m y rest"),
    (r"^(?:\pL{2,10}\.?,? )?(\pL{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:[, ]+(.+))?$", "m d y rest"),
    (r"^[A-Za-z]{3,9} (\pL{3,10}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (\d{4})$", "m d rest y"),
]
_REST = r"^(?:at |à |um |a las )?(\d{1,2})[:h]?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?(?: Uhr)?(?: ?([APap])\.?[Mm]\.?)? ?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{3,5})?(?:\[[^\]]*\])?$"
_STARTS = "jan ene|feb fév fev|mar mär mrz|apr avr abr|may mai|jun juin|jul juil|aug aoû aou ago|sep set|oct okt|nov|dec dez déc dic"
_HOURS = {"EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "JST": 9, "GMT": 0, "UTC": 0, "Z": 0}


def _structs() -> list[tuple[str, str]]:
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[, ]+(.+))?$"
    return [*_DATES, (slash, "a b y rest")]


def _case() -> str:
    arms = []
    for p, names in _structs():
        order = names.split()
        at = {n: f"regexp_extract(t, '{p}', {i + 1})" for i, n in enumerate(order)}
        if "a" in at:
            at["m"], at["d"] = (f"CASE WHEN locale = 'en-US' THEN {x} ELSE {y} END" for x, y in ((at["a"], at["b"]), (at["b"], at["a"])))
        arms.append(f"WHEN regexp_matches(t, '{p}') THEN {{'y': {at['y']}, 'm': {at['m']}, 'd': {at['d']}, 'rest': {at['rest']}}}")
    return f"CASE {' '.join(arms)} END"


def _month() -> str:
    arms = [f"WHEN {' OR '.join(f'starts_with(lower(p.m), {w!r})' for w in ws.split())} THEN {k}" for k, ws in enumerate(_STARTS.split("|"), 1)]
    return f"CASE WHEN regexp_full_match(p.m, '[0-9]+') THEN try_cast(p.m AS INT) {' '.join(arms)} END"


_ZONE = "CASE upper(z) " + " ".join(f"WHEN '{k}' THEN {v * 3600}" for k, v in _HOURS.items()) + r" ELSE CASE WHEN regexp_full_match(z, '[+-]\d{2}(:?\d{2})?') THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (try_cast(z[2:3] AS INT) * 3600 + coalesce(try_cast(replace(z[4:], ':', '') AS INT), 0) * 60) END END"
#: Offset of a zone, in microseconds, at a UTC instant given as a plain timestamp.
_OFF = "(epoch_us(timezone(zone, timezone('UTC', {u}))) - epoch_us({u}))"

FOUND = rf"""
WITH site AS (SELECT page_id, min({_HOST.format(x='url')}) AS site FROM page_in GROUP BY 1),
cfg AS (SELECT {_HOST.format(x="'//' || domain")} AS site, min(nullif(trim(home_zone), '')) AS zone, min(trim(locale)) AS locale FROM domain_cfg GROUP BY 1),
raws AS (
  SELECT DISTINCT 'datePublished' AS field, page_id AS record_id, i - 1 AS pos, blocks[i].datePublished AS raw, zone, locale
  FROM (SELECT page_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM ldjson_blocks) LEFT JOIN site USING (page_id) LEFT JOIN cfg USING (site)
  UNION ALL SELECT DISTINCT 'responseLastModified', result_id, 0, response_last_modified, 'UTC', NULL FROM extractions),
texts AS (SELECT * EXCLUDE (raw), trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM raws WHERE raw IS NOT NULL),
dated AS (SELECT *, {_case()} AS p FROM texts),
timed AS (SELECT *, {_month()} AS mon, coalesce(p.rest, '') = '' AS bare, regexp_extract(p.rest, '{_REST}', ['h', 'mi', 's', 'f', 'ap', 'z']) AS c, regexp_matches(p.rest, '{_REST}') AS ok FROM dated),
clocked AS (SELECT *, c.z AS z, CASE WHEN bare THEN 0 WHEN c.ap = '' THEN try_cast(c.h AS INT) WHEN try_cast(c.h AS INT) BETWEEN 1 AND 12 THEN try_cast(c.h AS INT) % 12 + CASE lower(c.ap) WHEN 'p' THEN 12 ELSE 0 END END AS hour FROM timed WHERE bare OR ok),
local AS (SELECT *, try_cast(CASE WHEN length(p.y) = 2 THEN CASE WHEN p.y < '69' THEN '20' ELSE '19' END ELSE '' END || p.y || '-' || lpad(mon::VARCHAR, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || lpad(hour::VARCHAR, 2, '0') || ':' || CASE WHEN bare THEN '00:00' ELSE c.mi || ':' || CASE WHEN c.s = '' THEN '00' ELSE c.s END END AS TIMESTAMP)
  + to_microseconds(CASE WHEN bare OR c.f = '' THEN 0 ELSE try_cast(rpad(c.f[1:6], 6, '0') AS BIGINT) END) AS wall, CASE WHEN NOT bare AND z <> '' THEN {_ZONE} END AS east FROM clocked),
placed AS (SELECT * FROM local WHERE wall IS NOT NULL AND (bare OR z = '' OR east IS NOT NULL)),
near AS (SELECT *, {_OFF.format(u='(wall - INTERVAL 26 HOUR)')} AS o1, {_OFF.format(u='(wall + INTERVAL 26 HOUR)')} AS o2 FROM placed WHERE east IS NULL AND zone IS NOT NULL),
tried AS (SELECT *, wall - to_microseconds(o1) AS u1, wall - to_microseconds(o2) AS u2 FROM near)
SELECT field, record_id, pos, CASE WHEN length(t) <= 11 THEN try_cast(t AS BIGINT) * 1000000 ELSE try_cast(t AS BIGINT) * 1000 END AS utc_micros FROM texts WHERE regexp_full_match(t, '[0-9]{{1,14}}')
UNION ALL SELECT field, record_id, pos, epoch_us(wall) - east::BIGINT * 1000000 FROM placed WHERE east IS NOT NULL
UNION ALL SELECT field, record_id, pos, epoch_us(CASE WHEN {_OFF.format(u='u1')} = o1 THEN u1 WHEN {_OFF.format(u='u2')} = o2 THEN u2 ELSE u1 END) FROM tried
"""
