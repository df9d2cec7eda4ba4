"""SQL that reads the instants of free date texts: the part of the oracles that several queries share."""

from __future__ import annotations

from cascadelens.operators.timestamps import ABBREVIATIONS

_T = r"(?:[ Tt,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:\s*([AaPp][Mm])\b)?"
_Z = r"\s*((?:Z|z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2}|[A-Za-z]+/[A-Za-z_/+-]+)?(?:\[[A-Za-z_/+-]+\])?)"
_D = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,?\s+)?"
_M = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\.?"
_SAME = r"(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)"
_FIELDS = ("y", "a", "b", "h", "mi", "s", "fr", "ap", "z")
# form, pattern, the group of each of _FIELDS (0: none), a further pattern
_FORMS = [
    ("ymd", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_T}{_Z}$", (1, 2, 3, 4, 5, 6, 7, 8, 9), rf"^\d{{4}}{_SAME}"),
    ("digits", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?)?{_Z}$", (1, 2, 3, 4, 5, 6, 7, 0, 8), None),
    ("last", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_T}{_Z}$", (3, 1, 2, 4, 5, 6, 7, 8, 9), rf"^\d{{1,2}}{_SAME}"),
    ("dMy", rf"(?i)^{_D}(\d{{1,2}})[ -]{_M}[ -](\d{{4}}){_T}{_Z}$", (3, 2, 1, 4, 5, 6, 7, 8, 9), None),
    ("Mdy", rf"(?i)^{_D}{_M}\s+(\d{{1,2}}),?\s+(\d{{4}}){_T}{_Z}$", (3, 1, 2, 4, 5, 6, 7, 8, 9), None),
    ("clock", rf"(?i)^{_D}{_M}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,9}}))?\s+(\d{{4}}){_Z}$", (7, 1, 2, 3, 4, 5, 6, 0, 8), None),
    ("clockz", rf"(?i)^{_D}{_M}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})\s+([A-Z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})\s+(\d{{4}})$", (7, 1, 2, 3, 4, 5, 0, 0, 6), None),
]
_EPOCH = r"^(-?\d{9,10}|-?\d{12,13}|-?\d{15,16})(?:[.,](\d{1,6}))?(?:\s+[+-]\d{2}:?\d{2})?$"


def _parts() -> str:
    cases = []
    for form, pattern, groups, further in _FORMS:
        fields = ", ".join(f"'{n}': " + (f"regexp_extract(t, '{pattern}', {g})" if g else "''") for n, g in zip(_FIELDS, groups, strict=True))
        more = f" AND regexp_matches(t, '{further}')" if further else ""
        cases.append(f"WHEN regexp_matches(t, '{pattern}'){more} THEN {{'form': '{form}', {fields}}}")
    nothing = ", ".join(f"'{n}': ''" for n in _FIELDS if n not in "ya")
    cases.append(f"WHEN regexp_matches(t, '{_EPOCH}') THEN {{'form': 'epoch', 'y': regexp_extract(t, '{_EPOCH}', 1), 'a': regexp_extract(t, '{_EPOCH}', 2), {nothing}}}")
    return "CASE " + " ".join(cases) + " END"


_MEANT = ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items())


def instants(records: str) -> str:
    """CTEs up to `inst`(tab, row_id, loaded_at, readings): the instants that each text can denote.

    `records` selects tab, row_id, txt, collector, loaded_at.
    """
    off = "(epoch_us(timezone({z}, make_timestamptz({u}))) - ({u}))"
    early, late = f"wall - {off.format(z='zone', u='wall - 86400000000')}", f"wall - {off.format(z='zone', u='wall + 86400000000')}"
    return rf"""rec AS ({records}),
raw AS (SELECT tab, row_id, loaded_at, tz_name AS tz, date_order AS ord, regexp_replace(txt, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g') AS t FROM rec LEFT JOIN zone_ref USING (collector)),
part AS (SELECT * EXCLUDE (t), p.* FROM (SELECT *, {_parts()} AS p FROM raw)),
timed AS (SELECT *, CASE WHEN ap = '' THEN coalesce(try_cast(h AS INT), 0) WHEN try_cast(h AS INT) BETWEEN 1 AND 12 THEN try_cast(h AS INT) % 12 + CASE WHEN lower(ap) = 'pm' THEN 12 ELSE 0 END ELSE 99 END AS hour,
  coalesce(try_cast(mi AS INT), 0) AS minute, coalesce(try_cast(s AS INT), 0) AS sec, CASE WHEN fr = '' THEN 0 ELSE CAST(rpad(left(fr, 6), 6, '0') AS INT) END AS us,
  coalesce(try_cast(a AS INT), (strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(a, 3))) + 2) // 3) AS m1, try_cast(b AS INT) AS m2 FROM part WHERE form IS NOT NULL),
day AS (SELECT *, unnest(CASE WHEN form = 'epoch' THEN [{{'mo': 1, 'dd': 1}}] WHEN form = 'last' AND (ord = 'dmy' OR m1 = m2) THEN [{{'mo': m2, 'dd': m1}}]
  WHEN form = 'last' AND coalesce(ord, '') <> 'mdy' THEN [{{'mo': m2, 'dd': m1}}, {{'mo': m1, 'dd': m2}}] ELSE [{{'mo': m1, 'dd': m2}}] END) AS d FROM timed),
walls AS (SELECT *, CASE WHEN hour <= 23 AND minute <= 59 AND sec <= 59 AND form <> 'epoch' THEN epoch_us(CAST(try_cast(printf('%04d-%02d-%02d', CAST(y AS INT), d.mo, d.dd) AS DATE) AS TIMESTAMP)) + ((hour * 60 + minute) * 60 + sec)::BIGINT * 1000000 + us END AS wall,
  regexp_extract(z, '^[+-]\d{{2}}:?\d{{2}}') AS shift, CASE WHEN z = '' THEN tz WHEN z IN (SELECT name FROM pg_timezone_names()) AND contains(z, '/') THEN z END AS zone,
  CASE WHEN regexp_matches(z, '^[A-Za-z]{{3,5}}$') THEN (MAP {{{_MEANT}}})[upper(z)] END AS meant FROM day),
each AS (SELECT tab, row_id, CASE
  WHEN form = 'epoch' THEN [CASE WHEN length(replace(y, '-', '')) <= 10 THEN CAST(y AS BIGINT) * 1000000 + coalesce(try_cast(rpad(a, 6, '0') AS BIGINT), 0) WHEN length(replace(y, '-', '')) <= 13 THEN CAST(y AS BIGINT) * 1000 ELSE CAST(y AS BIGINT) END]
  WHEN wall IS NULL THEN [] WHEN shift <> '' THEN CASE WHEN CAST(right(shift, 2) AS INT) < 60 THEN [wall - CASE WHEN left(shift, 1) = '-' THEN -1 ELSE 1 END * (CAST(shift[2:3] AS BIGINT) * 60 + CAST(right(shift, 2) AS BIGINT)) * 60000000] ELSE [] END
  WHEN upper(z) IN ('Z', 'UT', 'UTC', 'GMT') THEN [wall]
  WHEN zone IS NOT NULL THEN list_filter(list_distinct([{early}, {late}]), lambda u: u + {off.format(z='zone', u='u')} = wall)
  WHEN meant IS NULL THEN []
  WHEN len(meant) > 1 AND tz IS NOT NULL AND len(list_filter(meant, lambda x: {off.format(z='tz', u='wall - x::BIGINT * 60000000')} = x::BIGINT * 60000000)) > 0
    THEN list_transform(list_filter(meant, lambda x: {off.format(z='tz', u='wall - x::BIGINT * 60000000')} = x::BIGINT * 60000000), lambda x: wall - x::BIGINT * 60000000)
  ELSE list_transform(meant, lambda x: wall - x::BIGINT * 60000000) END AS found FROM walls),
inst AS (SELECT tab, row_id, flatten(list(found)) AS readings FROM each GROUP BY 1, 2)"""


DATED = """SELECT 'lib_version' AS tab, lv_id AS row_id, commit_date AS txt, collector, loaded_at FROM lib_version
  UNION ALL SELECT 'patch', patch_id, commit_date, collector, loaded_at FROM patch UNION ALL SELECT 'cve', cve_row, published_date, collector, loaded_at FROM cve"""

FOUND = f"WITH {instants(DATED)} SELECT tab, row_id, readings[1] AS utc_us FROM inst WHERE len(readings) = 1"
