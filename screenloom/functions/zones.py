"""Versioned tables of the changes of local clocks, made from the installed IANA zone data."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import cache
from importlib import metadata
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

#: Years the table covers; a clock time outside is read by the nearest of them.
FIRST_YEAR, LAST_YEAR = 1900, 2100
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

#: Zone names written beside a clock time, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120, "ART": -180, "IST": 330,
}


@cache
def version() -> str:
    """Version of the zone data in use."""
    for base in TZPATH:
        p = Path(base, "tzdata.zi")
        if p.exists() and (m := re.match(r"# version (\S+)", p.open().readline())):
            return m[1]
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unknown"


def _offset(zone: ZoneInfo, at: datetime) -> int:
    return round(at.astimezone(zone).utcoffset().total_seconds())


@cache
def transitions(name: str) -> tuple[int, list[tuple[int, int]]]:
    """Seconds east of UTC at the start, then (UTC second of a change, seconds east from then on)."""
    zone, out = ZoneInfo(name), []
    at, end, week = datetime(FIRST_YEAR, 1, 2, tzinfo=UTC), datetime(LAST_YEAR, 12, 30, tzinfo=UTC), timedelta(days=7)
    first = now = _offset(zone, at)
    while at < end:
        after = at + week
        if (then := _offset(zone, after)) != now:
            lo, hi = at, after
            while hi - lo > timedelta(seconds=1):
                mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                lo, hi = (mid, hi) if _offset(zone, mid) == now else (lo, mid)
            out.append((round((hi - EPOCH).total_seconds()), then))
            now = then
        at = after
    return first, out


def by_year(name: str) -> list[tuple[str, str, int, int, list[tuple[int, int]]]]:
    """(zone, version, year, seconds east at the start of the local year, [(from, seconds east)]) where `from` is the
    local second from which the later offset holds: a clock time that occurs twice is the first, one that is skipped is
    read by the clock before the gap and so moves on by the gap's length."""
    before, changes = transitions(name)
    per_year: dict[int, list[tuple[int, int]]] = {}
    start = before
    for at, after in changes:
        local = at + max(before, after)
        per_year.setdefault((EPOCH + timedelta(seconds=local)).year, []).append((local, after))
        before = after
    out, before = [], start
    for year in range(FIRST_YEAR, LAST_YEAR + 1):
        mine = per_year.get(year, [])
        out.append((name, version(), year, before, mine))
        before = mine[-1][1] if mine else before
    return out


@cache
def all_names() -> list[str]:
    """The names that the zone data has."""
    return sorted(available_timezones())
