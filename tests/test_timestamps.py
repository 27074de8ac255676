import datetime as dt

import pytest

from tallyframe.operators.timestamps import invoice_dates, normalize_timestamps, offset_history

CASES = [
    ("20251227", "Europe/Berlin", "2025-12-27"), ("2026-W08-3", "UTC", "2026-02-18"), ("2025-W53-1", "UTC", None), ("03/04/2025", "America/Chicago", "2025-03-04"),
    ("03/04/2025", "Europe/Paris", "2025-04-03"), ("13/04/2025", "America/Chicago", "2025-04-13"), ("05/16/2025", "Europe/Paris", "2025-05-16"), ("32/01/2026", "Europe/Paris", None),
    ("31 November 2024", "Europe/Paris", None), ("29.02.2024", "Europe/Paris", "2024-02-29"), ("29.02.2025", "Europe/Paris", None), ("le 8 décembre 2025", "Europe/Paris", "2025-12-08"),
    ("2026年4月10日", "Asia/Tokyo", "2026-04-10"), ("1749824992", "UTC", "2025-06-13T14:29:52.000000Z"), ("1711578770413", "UTC", "2024-03-27T22:32:50.413000Z"),
    ("2025-03-30 01:14:42 CET", "UTC", "2025-03-30T00:14:42.000000Z"), ("2024-03-10 01:53:27 America/New_York", "UTC", "2024-03-10T06:53:27.000000Z"),
    ("2025-10-26 02:30", "Europe/Berlin", "2025-10-26T00:30:00.000000Z"), ("2025-03-30 02:30", "Europe/Berlin", "2025-03-30T01:30:00.000000Z"),
    ("2024-02-21 06:42:25.563204999", "UTC", "2024-02-21T06:42:25.563204Z"), ("Sat, 19 Oct 2024 08:41:20 +0800", "UTC", "2024-10-19T00:41:20.000000Z"),
    ("29/11/2025 12:04 a.m.", "Europe/London", "2025-11-29T00:04:00.000000Z"), ("2025-01-01 25:00", "UTC", None), ("Juni 2025", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("x" * 50000, "UTC", None),
    (" 2025-12-25", "UTC", "2025-12-25"), ("Date: 2025-06-05", "UTC", "2025-06-05"), ("2024-09-16 00:09:24 UTC+1", "UTC", "2024-09-15T23:09:24.000000Z"), ("1er septembre 2024", "UTC", "2024-09-01"),
]


def test_notations(spark):
    rows = [(i, t, z) for i, (t, z, _) in enumerate(CASES)]
    got = normalize_timestamps(spark.createDataFrame(rows, "i int, t string, z string"), "t", "z").collect()
    assert {r.i: r.normal_form for r in got} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_zone_is_estimated_from_arrivals(spark):
    """Local times written at +2 arrive minutes later; the least violated offset is found."""
    base = dt.datetime(2025, 7, 1, 12)
    rows = [("s", (base + dt.timedelta(days=d, hours=2)).isoformat(sep=" "), None, base + dt.timedelta(days=d, minutes=5)) for d in range(20)]
    df = spark.createDataFrame(rows, "src string, t string, z string, at timestamp")
    got = {r.normal_form for r in normalize_timestamps(df, "t", "z", "at", "src").collect()}
    assert "2025-07-01T12:00:00.000000Z" in got and len(got) == 20


def test_found_leaves_out_normal_and_unreadable(spark):
    rows = [("a", "2025-01-02"), ("b", "02.01.2025"), ("c", "soon"), ("b", "02.01.2025"), (None, None)]
    df = spark.createDataFrame([(*r, "Europe/Paris", None, "s", 1) for r in rows], "invoice_id string, invoice_date string, issuer_tz string, ingested_at timestamp, seller_name string, normal_form int")
    assert [tuple(r) for r in invoice_dates(df).collect()] == [("b", "2025-01-02")]
    assert invoice_dates(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["00000000", "99999999", "2025-13-01", "12:30", "2025-01-01T24:00"])
def test_impossible_values(spark, text):
    df = spark.createDataFrame([(text, "UTC")], "t string, z string")
    assert normalize_timestamps(df, "t", "z").collect()[0].normal_form is None


def test_history_joins_the_months(spark):
    """A month without decisive records takes its neighbours' offset; a real change is kept; the usual delay decides ties."""
    def scores(months):
        return [(m, c, float(bad.get(c, 5)), 0.0) for m, bad in months for c in (-60, 0, 60, 120)]

    assert offset_history(scores([(1, {60: 0}), (2, {0: 0, 60: 0, 120: 0, -60: 0}), (3, {60: 0})])) == {1: 60, 2: 60, 3: 60}
    assert offset_history(scores([(1, {60: 0}), (2, {60: 0}), (3, {120: 0})])) == {1: 60, 2: 60, 3: 120}
    assert offset_history(scores([(1, {60: 0}), (2, {60: 1, 120: 0}), (3, {60: 0})])) == {1: 60, 2: 60, 3: 60}


def test_usual_delay_and_quarter_hours(spark):
    """Records arrive 30 hours late, always; those with a zone tell, and +05:45 can be chosen."""
    base = dt.datetime(2025, 3, 1, 6)
    rows = []
    for d in range(40):
        utc, at = base + dt.timedelta(days=d), base + dt.timedelta(days=d, hours=30)
        local = utc + dt.timedelta(hours=5, minutes=45)
        rows.append(("s", local.isoformat(sep=" ") + (" +05:45" if d % 4 == 0 else ""), None, at))
    df = spark.createDataFrame(rows, "src string, t string, z string, at timestamp")
    got = sorted(r.normal_form for r in normalize_timestamps(df, "t", "z", "at", "src").collect())
    assert got == [(base + dt.timedelta(days=d)).strftime("%Y-%m-%dT%H:%M:%S.000000Z") for d in range(40)]
