"""Instants against an independent conversion by datetime.strptime and zoneinfo."""

import re
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from screenloom.functions import zones
from screenloom.operators import instants
from screenloom.plans import instant_queries

FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%Y%m%d_%H%M%S", "%Y%m%d%H%M%S", "%b %d, %Y %I:%M:%S %p", "%Y年%m月%d日 %H時%M分%S秒", "%Y%m%dT%H%M%S", "%Y/%m/%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S"]
OFFSET = re.compile(r"^(.*?)(?: ?(Z|UTC|JST|EDT|EST|PDT|PST|CET|CEST)|(?: UTC)? ?([+-])(\d\d):?(\d\d))$")
HOURS = {"Z": 0, "UTC": 0, "JST": 9, "EDT": -4, "EST": -5, "PDT": -7, "PST": -8, "CET": 1, "CEST": 2}


def brute(text, zone):
    if text is None:
        return None
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", text):
        return int(text) * 10 ** (16 - len(text))
    tz, micro = ZoneInfo(zone or "UTC"), 0
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", text) and (m := OFFSET.match(text)) and re.search(r":\d\d|\d{6}", m[1]):
        text, tz = m[1], timezone(timedelta(hours=HOURS[m[2]]) if m[2] else (1 if m[3] == "+" else -1) * timedelta(hours=int(m[4]), minutes=int(m[5])))
    if m := re.fullmatch(r"(.*:\d\d)\.(\d+)", text):
        text, micro = m[1], int(m[2][:6].ljust(6, "0"))
    for f in FORMATS:
        try:
            at = datetime.strptime(text, f).replace(tzinfo=tz)
        except ValueError:
            continue
        return (at.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1) + micro
    return None


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, scale):
    d = f"/root/testdata/{scale}"
    expected = {(r.src_table, r.id): v for r in instant_queries._times(spark, d).collect() if (v := brute(r.text, r.zone)) is not None}
    assert {(r.src_table, r.id): r.utc_us for r in instant_queries.p6_found(spark, d).collect()} == expected
    assert len(expected) > 100


CASES = [
    ("2025-11-02T01:30:00", "America/New_York", 1762061400000000),  # twice: the first
    ("2025-03-09T02:30:00", "America/New_York", 1741505400000000),  # skipped: an hour on
    ("2025-02-30 10:00:00", None, None), ("2024-02-29 10:00:00", None, 1709200800000000), ("2025-13-01T00:00:00", None, None), ("2025-01-01T24:00:00", None, None),
    ("", None, None), (None, "Asia/Tokyo", None), ("n/a", None, None), ("pending", None, None), ("x" * 100_000, None, None), ("2025-01-01T00:00:00 XYZ", None, None),
    ("2025-01-01T00:00:00.1234567899", None, 1735689600123456), ("1735689600", "Asia/Tokyo", 1735689600000000), ("01.02.2025 03:04", "Asia/Tokyo", 1738346640000000),
    ("Jan 1, 2025 12:00:00 AM", None, 1735689600000000), ("Jan 1, 2025 13:00:00 AM", None, None), ("２０２５-01-01T00:00:00", None, 1735689600000000), ("2025-01-01T00:00:00", "No/Such", 1735689600000000),
    ("2025/01/01 00:00:00 UTC+09:30", None, 1735655400000000), (" 2025-01-01T09:00+09:00 ", None, 1735689600000000), ("2025-01-01X00:00:00", None, None),
]


def test_cases_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, z, 1, 2) for i, (t, z, _) in enumerate(CASES)], "id long, text string, zone string, first int, mask int").drop("first")
    got = {r.id: r.utc_us for r in instants.instants(df, "text", "zone").collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(CASES)}


def test_empty(spark):
    assert instants.instants(spark.createDataFrame([], "text string, zone string"), "text", "zone").count() == 0


def test_zone_table_covers_every_change():
    for name in ("Europe/London", "Australia/Adelaide", "Asia/Kolkata", "America/Sao_Paulo"):
        z = ZoneInfo(name)
        first, changes = zones.transitions(name)
        for k in range(0, 200 * 365, 11):
            at = datetime(1901, 1, 1, 5, tzinfo=UTC) + timedelta(days=k)
            off = [o for s, o in changes if s <= (at - zones.EPOCH).total_seconds()]
            if at.year < 2100:
                assert (off[-1] if off else first) == round(at.astimezone(z).utcoffset().total_seconds())
