"""Problem 1 against the standard library's zones, and its edge cases."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from cascadelens.operators import timestamps as ts

RECORDS = "tab string, row_id bigint, text string, collector string, loaded_at timestamp, _text string"
ZONES = [("be", "Europe/Berlin", "dmy"), ("ny", "America/New_York", "mdy"), ("in", "Asia/Kolkata", "dmy"), ("jp", "Asia/Tokyo", "ymd"), ("sy", "Australia/Sydney", "dmy")]


def us(*parts, zone="UTC"):
    return int((dt.datetime(*parts, tzinfo=ZoneInfo(zone)) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def run(spark, rows):
    records = spark.createDataFrame([("t", i, text, c, at, "clash") for i, (text, c, at) in enumerate(rows)], RECORDS)
    zones = spark.createDataFrame(ZONES, "collector string, tz_name string, date_order string")
    return {r["row_id"]: r for r in ts.normalise(records, zones).collect()}


def test_known_texts(spark):
    at = dt.datetime(2022, 1, 1)
    cases = [
        ("2021-08-07 13:15:06 +1000", "be", us(2021, 8, 7, 3, 15, 6)),
        (" 2021-03-28\r", "ny", us(2021, 3, 28, zone="America/New_York")),
        ("05/06/2020 10:00:00", "ny", us(2020, 5, 6, 10, zone="America/New_York")),
        ("05/06/2020 10:00:00", "be", us(2020, 6, 5, 10, zone="Europe/Berlin")),
        ("11/04/2012 1:10:33 PM", "ny", us(2012, 11, 4, 13, 10, 33, zone="America/New_York")),
        ("12/04/2012 12:10:33 AM", "ny", us(2012, 12, 4, 0, 10, 33, zone="America/New_York")),
        ("Thu Oct 14 10:24:16 2021 +0000", "jp", us(2021, 10, 14, 10, 24, 16)),
        ("Mon, 10 Oct 2022 16:55:39 -0000", "jp", us(2022, 10, 10, 16, 55, 39)),
        ("Nov 25, 2013 8:37:54 AM", "in", us(2013, 11, 25, 8, 37, 54, zone="Asia/Kolkata")),
        ("2019-07-29 06:44:12 IST", "in", us(2019, 7, 29, 6, 44, 12, zone="Asia/Kolkata")),
        ("2020-11-01 01:12:22 EDT", "ny", us(2020, 11, 1, 5, 12, 22)),
        ("2023-05-03T06:46:23+02:00[Europe/Berlin]", "be", us(2023, 5, 3, 4, 46, 23)),
        ("2019-09-09 15:17:23 America/New_York", "be", us(2019, 9, 9, 19, 17, 23)),
        ("1572125993", "be", 1572125993 * 10**6),
        ("1526767163189", "be", 1526767163189 * 1000),
        ("1569138696 +0530", "in", 1569138696 * 10**6),
        ("20200119T124055Z", "be", us(2020, 1, 19, 12, 40, 55)),
        ("20210324210550", "jp", us(2021, 3, 24, 21, 5, 50, zone="Asia/Tokyo")),
        ("2022-04-07 14:54:59.351321 UTC", "in", us(2022, 4, 7, 14, 54, 59, 351321)),
        ("2018-12-20 16:28:48,339", "jp", us(2018, 12, 20, 16, 28, 48, 339000, zone="Asia/Tokyo")),
    ]
    got = run(spark, [(t, c, at) for t, c, _ in cases])
    assert {t: (got[i]["status"], got[i]["utc_us"]) for i, (t, _, _) in enumerate(cases)} == {t: ("exact", u) for t, _, u in cases}


def test_no_instant_or_several(spark):
    at = dt.datetime(2022, 1, 1)
    none = [None, "", "  ", "TBD", "2021-02-30 10:11:12", "2017-13-05 08:00:00", "2018-04-05 25:10:00 +0000", "0000-00-00 00:00:00", "31/31/2020", "2021-03-28 02:30:00", "x" * 100_000]
    got = run(spark, [(t, "be", at) for t in none] + [("2021-10-31 02:30:00", "be", at), ("05/06/2020", "jp", at), ("2020-01-01", "nobody", at), ("2020-01-01T00:00:00Z", None, None)])
    assert [got[i]["status"] for i in range(len(none))] == ["none"] * len(none)
    n = len(none)
    assert [got[n + i]["status"] for i in range(4)] == ["ambiguous", "ambiguous", "none", "exact"]
    assert got[n]["utc_us"] in (us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30))


def test_the_path_follows_the_neighbours(spark):
    """An ambiguous record between two settled ones gets the reading that doesn't go back in time."""
    day = dt.timedelta(days=1)
    at = dt.datetime(2021, 11, 1)
    rows = [("2021-10-31 00:50:00 +0000", "be", at), ("2021-10-31 02:30:00", "be", at + day), ("2021-10-31 01:40:00 +0000", "be", at + 2 * day)]
    assert run(spark, rows)[1]["utc_us"] == us(2021, 10, 31, 1, 30)


def cost_of(records, path):
    chain = [r[1][j] for r, j in zip(records, path, strict=True)]
    return sum(ts._step(x, y) for x, y in zip(chain, chain[1:], strict=False))


def random_records(rng, n, most=3):
    return [(i, [(rng.choice("ab"), rng.randrange(6)) for _ in range(rng.randint(1, most))]) for i in range(n)]


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        records = random_records(rng, rng.randint(1, 6))
        paths = [[]]
        for _, r in records:
            paths = [p + [j] for p in paths for j in range(len(r))]
        assert cost_of(records, ts.best_path(records)) == min(cost_of(records, p) for p in paths)


def test_blocks_give_the_path_of_the_whole_source(spark):
    """The same path, however a source is cut; one source has most of the rows."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    sources = {"big": random_records(rng, 400, 4), "small": random_records(rng, 7), None: [(i, [("a", i), ("b", i)]) for i in range(60)]}
    rows = [("t", 1000 * k + i, c, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i // 3), r) for k, (c, records) in enumerate(sources.items()) for i, (_, r) in enumerate(records)]
    df = spark.createDataFrame(rows, "tab string, row_id bigint, collector string, loaded_at timestamp, readings array<struct<form:string,utc_us:bigint>>")
    got = {r["row_id"]: (r["form"], r["utc_us"]) for r in ts._on_best_path(df).collect()}
    for k, (_, records) in enumerate(sources.items()):
        moved = [(1000 * k + i, r) for i, r in records]
        assert [got[i] for i, _ in moved] == [r[j] for (_, r), j in zip(moved, ts.best_path(moved), strict=True)]
    assert df.where(F.size("readings") > 1).count() > 200


def test_random_wall_clocks(spark):
    rng = random.Random(5)
    rows, want = [], []
    for _ in range(400):
        c, zone, _ = rng.choice(ZONES)
        w = dt.datetime(2010, 1, 1) + dt.timedelta(seconds=rng.randrange(15 * 365 * 86400))
        rows.append((w.strftime("%Y-%m-%d %H:%M:%S"), c, dt.datetime(2024, 1, 1)))
        both = {us(*w.timetuple()[:6])}
        both = set()
        for fold in (0, 1):
            t = w.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(dt.timezone.utc)
            if t.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == w:
                both.add(int((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1)))
        want.append(both)
    got = run(spark, rows)
    for i, both in enumerate(want):
        assert got[i]["status"] == {0: "none", 1: "exact", 2: "ambiguous"}[len(both)]
        assert not both or got[i]["utc_us"] in both


def test_empty(spark):
    assert run(spark, []) == {}
