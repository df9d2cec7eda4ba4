"""Problem 1: texts of mixed formats, precisions and zones become one UTC instant each.

Every text gives an array of its valid interpretations, built from Column expressions only. A text
with one interpretation is settled. Viterbi over the whole record order of each source chooses one of each
record, where a switch of format and a jump back in time cost. A source is cut into blocks by range,
so that one with most of the records runs in many tasks: each block gives the costs between the
readings of its first and of its last record, the blocks of a source are put together over these few
numbers, and then each block is solved with its ends known. The path is the same as without blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cascadelens.operators.ordered import in_blocks
from cascadelens.session import via_table

# Offsets, in minutes, that a zone abbreviation can stand for.
ABBREVIATIONS = {
    "WET": [0], "WEST": [60], "CET": [60], "CEST": [120], "MET": [60], "MEST": [120], "EET": [120],
    "EEST": [180], "MSK": [180], "IST": [330, 60, 120], "BST": [60, 360], "JST": [540], "KST": [540],
    "HKT": [480], "SGT": [480], "NPT": [345], "PKT": [300], "AEST": [600], "AEDT": [660],
    "ACST": [570], "ACDT": [630], "AWST": [480], "NZST": [720], "NZDT": [780], "EST": [-300, 600],
    "EDT": [-240, 660], "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360],
    "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480], "HST": [-600], "AST": [-240],
    "ADT": [-180], "NST": [-210], "NDT": [-150], "BRT": [-180], "ART": [-180], "SAST": [120],
}

_TIME = r"(?:[ Tt,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:\s*([AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"\s*((?:Z|z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2}|[A-Za-z]+/[A-Za-z_/+-]+)?(?:\[[A-Za-z_/+-]+\])?)"
_DAY = r"(?:(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,?\s+)?"
_MON = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\.?"

# label, pattern, replacement that puts the parts in the order
# label|year|month|day|hour|minute|second|fraction|half of day|zone
_FORMS = [
    ("ymd", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}{_ZONE}$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("digits", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "digits|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("last", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_TIME}{_ZONE}$", "last|$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    ("dMy", rf"(?i)^{_DAY}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}){_TIME}{_ZONE}$", "dMy|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("Mdy", rf"(?i)^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}{_ZONE}$", "Mdy|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("clock", rf"(?i)^{_DAY}{_MON}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,9}}))?\s+(\d{{4}}){_ZONE}$", "clock|$7|$1|$2|$3|$4|$5|$6||$8"),
    ("clockz", rf"(?i)^{_DAY}{_MON}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})\s+([A-Z]{{1,5}}|[+-]\d{{2}}:?\d{{2}})\s+(\d{{4}})$", "clockz|$7|$1|$2|$3|$4|$5|||$6"),
]
_EPOCH = r"^(-?\d{9,10}|-?\d{12,13}|-?\d{15,16})(?:[.,](\d{1,6}))?(?:\s+[+-]\d{2}:?\d{2})?$"
_MICROS = 1_000_000
_DAY_US = 86_400 * _MICROS


def _number(col: Column) -> Column:
    return F.when(col != "", col.try_cast("bigint"))


def _zone_offset_us(instant_us: Column, zone: Column) -> Column:
    """Offset of `zone` at an instant; independent of the session's own zone."""
    stamp = F.timestamp_micros(instant_us)
    return F.unix_micros(F.from_utc_timestamp(stamp, zone)) - instant_us


def _wall_to_instants(wall_us: Column, zone: Column) -> Column:
    """All instants at which a clock in `zone` shows `wall_us`: none in a gap, two in an overlap."""
    early = wall_us - _zone_offset_us(wall_us - _DAY_US, zone)
    late = wall_us - _zone_offset_us(wall_us + _DAY_US, zone)
    shows = lambda u: (u + _zone_offset_us(u, zone)) == wall_us
    return F.array_sort(F.array_distinct(F.filter(F.array(early, late), shows)))


def _fixed_offset_us(zone: Column) -> Column:
    plain = F.regexp_replace(zone, ":", "")
    minutes = F.substring(plain, 2, 2).try_cast("int") * 60 + F.substring(plain, 4, 2).try_cast("int")
    sign = F.when(plain.startswith("-"), -1).otherwise(1)
    return F.when(F.substring(plain, 4, 2).try_cast("int") < 60, sign * minutes.cast("bigint") * 60 * _MICROS)


def _settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, which neither projections nor filters are merged through.

    A filter on the last of many staged columns would otherwise be pushed below all of them, with
    every stage written out anew for each of its uses.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with_readings(df: DataFrame, text: str, zone: str, order: str, to: str) -> DataFrame:
    """Add `to`: array<struct<form string, utc_us bigint>> of every valid reading of `text`.

    `zone` and `order` name the columns with the clock and the date order of the record's source; a
    null zone leaves texts without offset unread, a null or `ymd` order leaves both readings of
    `05/06/2020`. The steps are columns of their own, so that none is evaluated twice.
    """
    trimmed = F.col("_text")
    parts = reduce(
        lambda rest, form: F.when(trimmed.rlike(form[1]), F.regexp_replace(trimmed, form[1], form[2])).otherwise(rest),
        reversed(_FORMS),
        F.when(trimmed.rlike(_EPOCH), F.regexp_replace(trimmed, _EPOCH, "epoch|$1|$2")),
    )
    part = lambda i: F.try_element_at("_parts", F.lit(i + 1))
    form = F.col("_form")
    named = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(part(2), 1, 3))) + 2) / 3).cast("bigint")
    size = F.length(F.regexp_replace(part(1), "-", ""))
    fraction = F.coalesce(F.rpad(part(2), 6, "0").try_cast("bigint"), F.lit(0))
    epoch = F.when(size <= 10, _number(part(1)) * _MICROS + fraction).when(size <= 13, _number(part(1)) * 1000).otherwise(_number(part(1)))
    half = F.lower(part(8))
    hour = F.coalesce(_number(part(4)), F.lit(0))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(99)).when(half == "pm", hour % 12 + 12).otherwise(hour % 12)
    minute, second_of = F.coalesce(_number(part(5)), F.lit(0)), F.coalesce(_number(part(6)), F.lit(0))
    micros = F.coalesce(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    clock = F.when(
        (F.col("_hour") <= 23) & (minute <= 59) & (second_of <= 59),
        ((F.col("_hour") * 60 + minute) * 60 + second_of) * _MICROS + micros,
    )
    staged = _settle(df, _text=F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    staged = _settle(staged, _parts=F.split(parts, r"\|")).withColumn("_form", F.col("_parts")[0])
    staged = _settle(
        staged,
        _epoch=F.when(form == "epoch", epoch),
        _first=F.when(form.isin("dMy", "Mdy", "clock", "clockz"), named).when(form != "epoch", _number(part(2))),
        _second=F.when(form != "epoch", _number(part(3))),
        _year=F.when(form != "epoch", _number(part(1))),
        _hour=F.when(form != "epoch", hour),
        _spelled=F.coalesce(part(9), F.lit("")),
    )
    staged = _settle(staged, _clock=clock)

    def wall(month: Column, day: Column) -> Column:
        safe_month = F.greatest(F.least(month, F.lit(12)), F.lit(1)).cast("int")
        start = F.when((F.col("_year") >= 1) & month.between(1, 12), F.make_date(F.greatest("_year", F.lit(1)).cast("int"), safe_month, F.lit(1)))
        ok = (day >= 1) & (day <= F.dayofmonth(F.last_day(start)))
        return F.when(ok, (F.unix_date(start).cast("bigint") + day - 1) * _DAY_US + F.col("_clock"))

    first, second = F.col("_first"), F.col("_second")
    as_form = lambda label, at: F.struct(label.alias("form"), at.alias("wall"))
    last, one_way = form == "last", F.col(order)
    days = (
        F.when(last & ((one_way == "dmy") | (first == second)), F.array(as_form(F.lit("dmy"), F.col("_wall_dmy"))))
        .when(last & (one_way == "mdy"), F.array(as_form(F.lit("mdy"), F.col("_wall_md"))))
        .when(last, F.array(as_form(F.lit("dmy"), F.col("_wall_dmy")), as_form(F.lit("mdy"), F.col("_wall_md"))))
        .otherwise(F.array(as_form(form, F.col("_wall_md"))))
    )
    # one text literal each: hundreds of literal nodes would slow down every rule of the optimizer
    offsets = F.str_to_map(F.lit(",".join(f"{k}={' '.join(map(str, v))}" for k, v in ABBREVIATIONS.items())), F.lit(","), F.lit("="))
    known = "^(?:" + "|".join(_regions()).replace("+", r"\+") + ")$"
    spelled, clock_zone = F.col("_spelled"), F.col(zone)
    offset = F.regexp_extract(spelled, r"^[+-]\d{2}:?\d{2}", 0)
    staged = _settle(staged, _wall_md=wall(first, second), _wall_dmy=F.when(last, wall(second, first)))
    staged = _settle(
        staged,
        _days=F.filter(days, lambda d: d["wall"].isNotNull()),
        _offset_us=F.when(offset != "", _fixed_offset_us(offset)).when(F.upper(spelled).isin("Z", "UT", "UTC", "GMT"), F.lit(0).cast("bigint")),
        _meant=F.when(spelled.rlike("^[A-Za-z]{3,5}$"), F.split(F.try_element_at(offsets, F.upper(spelled)), " ").cast("array<int>")),
        _zone=F.when(spelled == "", clock_zone).when(spelled.contains("/") & spelled.rlike(known), spelled),
    )

    def instants(day: Column) -> Column:
        local = day["wall"]
        shifted = F.transform("_meant", lambda m: local - m.cast("bigint") * 60 * _MICROS)
        # an abbreviation with several meanings is the one that the source's own zone uses then
        own = F.filter(shifted, lambda u: (u + _zone_offset_us(u, clock_zone)) == local)
        found = (
            F.when(F.col("_offset_us").isNotNull(), F.array(local - F.col("_offset_us")))
            .when(F.col("_zone").isNotNull(), _wall_to_instants(local, F.col("_zone")))
            .when(F.col("_meant").isNull(), F.array().cast("array<bigint>"))
            .when((F.size("_meant") > 1) & clock_zone.isNotNull() & (F.size(own) > 0), own)
            .otherwise(shifted)
        )
        return F.transform(found, lambda u: F.struct(day["form"].alias("form"), u.alias("utc_us")))

    readings = F.when(form == "epoch", F.array(F.struct(F.lit("epoch").alias("form"), F.col("_epoch").alias("utc_us")))).when(
        F.size("_days") > 0, F.flatten(F.transform("_days", instants))
    )
    return _settle(staged, **{to: F.coalesce(readings, F.array().cast("array<struct<form:string,utc_us:bigint>>"))})


def _regions() -> list[str]:
    """Zone names that both Spark's and Python's zone tables know, of the continents' form."""
    from zoneinfo import available_timezones

    heads = ("Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")
    return sorted(z for z in available_timezones() if z.split("/")[0] in heads and "/" in z)


def read_instants(records: DataFrame, zones: DataFrame) -> DataFrame:
    """`records`(tab, row_id, text, collector, loaded_at) with the array `readings`.

    `zones`(collector, tz_name, date_order) is a fixed table, one row per collector; it is joined,
    not collected, and a collector without a row keeps its records (with offset-less texts unread).
    """
    clocks = zones.groupBy("collector").agg(F.min_by("tz_name", F.struct("tz_name", "date_order")).alias("_tz"), F.min_by("date_order", F.struct("tz_name", "date_order")).alias("_order"))
    records = records.select("tab", "row_id", "text", "collector", "loaded_at")
    joined = records.join(clocks, records["collector"].eqNullSafe(clocks["collector"]), "left").drop(clocks["collector"])
    return _with_readings(joined, "text", "_tz", "_order", "readings").select("tab", "row_id", "text", "collector", "loaded_at", "readings")


FORMAT_SWITCH = 1.0
BACKWARD_JUMP = 2.0
#: Costs are whole numbers, so that blocks add up exactly: a unit of the costs above, and what a reading
#: costs by its place in the array (ties go to the first readings); below that, a number of its own.
UNIT, PLACE = 1 << 44, 1 << 24

Record = tuple[int, list[tuple[str, int]]]


def _step(before: tuple[str, int], after: tuple[str, int]) -> int:
    return int(UNIT * (FORMAT_SWITCH * (before[0] != after[0]) + BACKWARD_JUMP * (after[1] < before[1])))


def _own(row_id: int, place: int) -> int:
    return PLACE * place + (((row_id * 31 + place) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40)


def _arrive(costs: list[int], before: list[tuple[str, int]], record: Record) -> tuple[list[int], list[int]]:
    """The least cost of each reading of `record` behind the readings before, and the one it comes from."""
    now, links = [], []
    for k, c in enumerate(record[1]):
        totals = [x + _step(b, c) for x, b in zip(costs, before, strict=True)]
        j = min(range(len(totals)), key=totals.__getitem__)
        now.append(totals[j] + _own(record[0], k))
        links.append(j)
    return now, links


def best_path(records: list[Record], entry: list[int] | None = None, leave: int | None = None) -> list[int]:
    """Viterbi: the index of the reading chosen for each of records (row_id, readings).

    `entry`: the cost of each reading of the first record; `leave`: the reading of the last one, if known.
    """
    costs = entry if entry is not None else [_own(records[0][0], k) for k in range(len(records[0][1]))]
    back = []
    for before, record in zip(records, records[1:], strict=False):
        costs, links = _arrive(costs, before[1], record)
        back.append(links)
    j = min(range(len(costs)), key=costs.__getitem__) if leave is None else leave
    path = [j]
    for links in reversed(back):
        j = links[j]
        path.append(j)
    return path[::-1]


def _between(records: list[Record]) -> list[list[int]]:
    """costs[i][j] of the way from reading i of the first record to reading j of the last one."""
    out = []
    for i in range(len(records[0][1])):
        costs = [0 if k == i else 1 << 60 for k in range(len(records[0][1]))]
        for before, record in zip(records, records[1:], strict=False):
            costs, _ = _arrive(costs, before[1], record)
        out.append(costs)
    return out


class _Block:
    """The records of a source in one block, in their order."""

    def __init__(self, table: pa.Table) -> None:
        order = np.lexsort((table["row_id"].to_numpy(), table["loaded_us"].to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        self.ids = table["row_id"].to_numpy()
        forms, instants = table["forms"].combine_chunks(), table["instants"].combine_chunks()
        offsets = instants.offsets.to_numpy()
        self.start, self.sizes = offsets[:-1], np.diff(offsets)
        self.flat_forms = forms.values
        self.flat_instants = instants.values.to_numpy()
        self.anchors = np.flatnonzero(self.sizes == 1)

    def record(self, i: int) -> Record:
        a, n = int(self.start[i]), int(self.sizes[i])
        return int(self.ids[i]), list(zip(self.flat_forms[a : a + n].to_pylist(), self.flat_instants[a : a + n].tolist(), strict=True))

    def records(self, start: int, end: int) -> list[Record]:
        return [self.record(i) for i in range(start, end + 1)]


_ENDS = "source string, block int, first_id bigint, first_forms array<string>, first_instants array<bigint>, last_forms array<string>, last_instants array<bigint>, costs array<bigint>"


def _block_ends(table: pa.Table) -> pa.Table:
    """The ends of a block and the costs between their readings, but for a constant."""
    b = _Block(table)
    last = len(b.ids) - 1
    if len(b.anchors):
        # every path goes through the anchors, so the costs on both sides of them add up
        left = _between(b.records(0, int(b.anchors[0])))
        right = _between(b.records(int(b.anchors[-1]), last))[0]
        costs = [x[0] + y for x in left for y in right]
    else:
        costs = [y for x in _between(b.records(0, last)) for y in x]
    least = min(costs)
    costs = [c - least for c in costs]
    (first_id, first), (_, end) = b.record(0), b.record(last)
    row = {"source": table["source"][0].as_py(), "block": table["block"][0].as_py(), "first_id": first_id, "costs": costs}
    row |= {"first_forms": [f for f, _ in first], "first_instants": [u for _, u in first], "last_forms": [f for f, _ in end], "last_instants": [u for _, u in end]}
    names = [c.split()[0] for c in _ENDS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({n: pa.array([row[n]], type=k) for n, k in zip(names, kinds, strict=True)})


def _over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over the blocks of a source: the costs at the entry of each, and the reading it leaves by."""
    pdf = pdf.sort_values("block", kind="stable")
    firsts = [list(zip(f, u, strict=True)) for f, u in zip(pdf["first_forms"], pdf["first_instants"], strict=True)]
    lasts = [list(zip(f, u, strict=True)) for f, u in zip(pdf["last_forms"], pdf["last_instants"], strict=True)]
    costs = [np.asarray(c, dtype=np.int64).reshape(len(a), len(b)) for c, a, b in zip(pdf["costs"], firsts, lasts, strict=True)]
    ids = pdf["first_id"].tolist()
    entries, exits, links = [[_own(ids[0], k) for k in range(len(firsts[0]))]], [], []
    for n in range(len(ids)):
        through = np.asarray(entries[n])[:, None] + costs[n]
        # only differences matter, and small numbers don't overflow
        exits.append((through.min(0) - through.min()).tolist())
        if n + 1 < len(ids):
            now, back = _arrive(exits[n], lasts[n], (ids[n + 1], firsts[n + 1]))
            entries.append(now)
            links.append(back)
    leave = [0] * len(ids)
    j = int(np.argmin(exits[-1]))
    for n in range(len(ids) - 1, -1, -1):
        leave[n] = j
        if n:
            j = links[n - 1][int(np.argmin(np.asarray(entries[n]) + costs[n][:, j]))]
    return pd.DataFrame({"source": pdf["source"], "block": pdf["block"], "entry": entries, "leave": leave})


def _solve(table: pa.Table, known: pa.Table) -> pa.Table:
    """The reading chosen for every record of a block, its ends known."""
    b = _Block(table)
    last = len(b.ids) - 1
    entry, leave = known["entry"][0].as_py(), known["leave"][0].as_py()
    chosen = np.zeros(len(b.ids), dtype=np.int64)
    stops = [int(a) for a in b.anchors]
    # runs of ambiguous records, with the anchors at their ends
    edges = sorted({0, last, *stops})
    for start, end in zip(edges, edges[1:], strict=False):
        if end - start > 1 or b.sizes[start] > 1 or b.sizes[end] > 1:
            path = best_path(b.records(start, end), entry if start == 0 else None, leave if end == last else None)
            chosen[start : end + 1] = path
    if last == 0:
        chosen[0] = leave
    at = pa.array(b.start + chosen)
    order = np.lexsort((table["row_id"].to_numpy(), table["loaded_us"].to_numpy()))
    tab = table["tab"].take(pa.array(order))
    return pa.table({"tab": tab, "row_id": pa.array(b.ids), "n_readings": pa.array(b.sizes.astype(np.int32)), "form": b.flat_forms.take(at), "utc_us": pa.array(b.flat_instants[b.start + chosen])})


def normalise(records: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per record: tab, row_id, status, n_readings, form, utc_us.

    status is `exact` (the text denotes one instant), `ambiguous` (several; the one on the best path
    is given) or `none` (null, empty, not a time, impossible, or skipped by the clock; utc_us null).
    A source is a collector's feed of one table, in the order of loaded_at (nulls first) and row id.
    Repeated rows are kept. Empty tables give an empty result.
    """
    read = via_table(read_instants(records, zones), "readings")
    unread = read.where(F.size("readings") == 0).select("tab", "row_id", F.lit("none").alias("status"), F.lit(0).alias("n_readings"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("utc_us"))
    status = F.when(F.col("n_readings") == 1, "exact").otherwise("ambiguous")
    return unread.unionByName(_on_best_path(read).select("tab", "row_id", status.alias("status"), "n_readings", "form", "utc_us"))


def _on_best_path(read: DataFrame) -> DataFrame:
    """tab, row_id, n_readings, form, utc_us of the reading that Viterbi chooses for each record with any."""
    source = F.concat("tab", F.lit("/"), F.coalesce(F.concat(F.lit("="), "collector"), F.lit("")))
    flat = read.where(F.size("readings") > 0).select(
        source.alias("source"),
        "tab",
        "row_id",
        F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62))).alias("loaded_us"),
        F.col("readings.form").alias("forms"),
        F.col("readings.utc_us").alias("instants"),
    )
    blocks = in_blocks(flat, ["source"], ["loaded_us", "row_id"])
    ends = blocks.groupBy("source", "block").applyInArrow(_block_ends, _ENDS)
    known = ends.groupBy("source").applyInPandas(_over_blocks, "source string, block int, entry array<bigint>, leave int")
    together = blocks.groupBy("source", "block").cogroup(known.groupBy("source", "block"))
    return together.applyInArrow(_solve, "tab string, row_id bigint, n_readings int, form string, utc_us bigint")
