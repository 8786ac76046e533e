"""Mixed timestamp formats and zones to one instant, in microseconds since 1970-01-01 UTC.

Each text is reduced to its mask: every digit becomes 9, every ASCII letter a. A mask fixes the place of every field, so
each distinct mask is compiled to places once, and all texts of that mask are then cut at those places by built-in
column functions. Clock times without zone go through the zone table (functions/zones.py), versioned by its release.

A text denotes a time if its mask is one of the FORMS and its fields are in range. Null, '', words, impossible dates
and unknown zone names give null. Texts over 64 characters are none of the forms. Repeated rows are each converted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zones

#: The forms of a mask. y m d h n s: date and clock; f: fraction; z: zone; o: month name; p: am or pm; t: the letter between; e: count since 1970.
_CLOCK = r"(?P<h>99):(?P<n>99)(:(?P<s>99)([.,](?P<f>9{1,18}))?)?"
_ZONE = r"( ?(?P<z>a{1,5}([+-]9{1,2}(:?99)?)?|[+-]99(:?99)?))?"
FORMS = [
    rf"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?P<t>[a ]){_CLOCK}{_ZONE}",
    rf"(?P<y>9999)/(?P<m>9{{1,2}})/(?P<d>9{{1,2}}) {_CLOCK}{_ZONE}",
    rf"(?P<d>9{{1,2}})\.(?P<m>9{{1,2}})\.(?P<y>9999),? {_CLOCK}{_ZONE}",
    rf"(?P<y>9999)(?P<m>99)(?P<d>99)((?P<t>[a])|_)?(?P<h>99)(?P<n>99)(?P<s>99)([.,](?P<f>9{{1,18}}))?{_ZONE}",
    rf"(aaa, )?(?P<d>9{{1,2}}) (?P<o>aaa) (?P<y>9999) {_CLOCK}{_ZONE}",
    rf"(?P<o>a{{3,9}})\.? (?P<d>9{{1,2}}), (?P<y>9999),? (?P<h>9{{1,2}}):(?P<n>99)(:(?P<s>99)([.,](?P<f>9{{1,18}}))?)? (?P<p>aa){_ZONE}",
    r"(?P<y>9999)年(?P<m>9{1,2})月(?P<d>9{1,2})日 ?(?P<h>9{1,2})時(?P<n>9{1,2})分((?P<s>9{1,2})秒)?",
    r"(?P<e>-?(9{10}|9{13}|9{16}|9{19}))",
    r"(?P<e>9{10})\.(?P<f>9{1,18})",
]
_FIELDS = "ymdhnsfzopte"
_PLACES = ", ".join(f"{k} struct<at:int,len:int>" for k in _FIELDS)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
LONGEST = 64
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE = "０１２３４５６７８９：／．－＋　"
_PLAIN = "0123456789:/.-+ "


def compile_mask(mask: str) -> dict[str, tuple[int, int]] | None:
    """Place and length of each field of a mask, or None if it is none of the forms."""
    for form in FORMS:
        if m := re.fullmatch(form, mask):
            return {k: (m.start(k) + 1, len(v)) for k, v in m.groupdict().items() if v}
    return None


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [{"mask": x, **{k: (None if k not in p else {"at": p[k][0], "len": p[k][1]}) for k in _FIELDS}} for x in pdf["mask"] if (p := compile_mask(x))]
        yield pd.DataFrame(rows, columns=["mask", *_FIELDS])


def text_of(col: str) -> Column:
    """The text without outer blanks, wide digits and signs made narrow; null if too long to be a time."""
    text = F.trim(F.translate(F.col(col), _WIDE, _PLAIN))
    return F.when(F.length(text) <= LONGEST, text)


def mask_of(text: Column) -> Column:
    """Shape of a text by character class."""
    return F.translate(text, "0123456789" + _LETTERS, "9" * 10 + "a" * 52)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, by counting from a year that starts in March."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    of_era = y2 - era * 400
    day = F.floor((F.lit(153) * F.pmod(m + 9, F.lit(12)) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + day - 719468).cast("long")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _zone_seconds(z: Column) -> Column:
    """Seconds east of UTC of a written zone such as Z, +0930, CEST or UTC-03:00; null if it isn't known."""
    z = F.upper(z)
    sign = F.when(z.contains("-"), -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 2)).try_cast("int")
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(F.right(digits, F.lit(2)).try_cast("int"))
    name = F.regexp_extract(z, "^[A-Z]+", 0)
    base = F.create_map(*[F.lit(x) for kv in zones.ABBREVIATIONS.items() for x in kv])
    named = F.when(digits == "", F.element_at(base, name) * 60)
    shifted = F.when((digits != "") & name.isin("", "UTC", "GMT") & (hours <= 18) & (minutes < 60), sign * (hours * 3600 + minutes * 60))
    return F.coalesce(named, shifted)


def zone_table(names: DataFrame) -> DataFrame:
    """(zone, version, year, first, changes) of the zones in column zone. Only names of the zone data, of which there
    are some 600, are gathered, so the table is of bounded size whatever else the column holds."""
    known = names.select("zone").where(F.col("zone").isin(zones.all_names())).distinct()
    rows = [r for n in sorted(r.zone for r in known.collect()) for r in zones.by_year(n)]
    return names.sparkSession.createDataFrame(rows, "zone string, tz_version string, year int, first int, changes array<struct<at:long,off:int>>")


def instants(df: DataFrame, text: str, zone: str) -> DataFrame:
    """df with column utc_us: the instant that column text denotes, on the clock of column zone (null: UTC) if it names none."""
    df = df.withColumn("_v", text_of(text)).withColumn("_mask", mask_of(F.col("_v")))
    # places of recognised masks only: the forms bound their number (below 20,000), whatever the texts are
    masks = df.select(F.col("_mask").alias("mask")).where("mask is not null and mask <> ''").distinct().mapInPandas(_compile, f"mask string, {_PLACES}")
    df = df.join(F.broadcast(masks.select(F.col("mask").alias("_mask"), F.struct(*_FIELDS).alias("_p"))), "_mask", "left")

    def part(k: str) -> Column:
        return F.substring(F.col("_v"), F.col(f"_p.{k}.at"), F.col(f"_p.{k}.len"))

    def number(k: str) -> Column:
        return part(k).try_cast("int")

    month_name = F.lower(part("o"))
    named = F.coalesce(*[F.when(month_name.isin(MONTHS[i], MONTH_NAMES[i]), i + 1) for i in range(12)], F.when(month_name == "sept", 9))
    half = F.lower(part("p"))
    h = number("h")
    hour = F.when(F.col("_p.p").isNull(), h).when((h >= 1) & (h <= 12) & half.isin("am", "pm"), F.pmod(h, F.lit(12)) + F.when(half == "pm", 12).otherwise(0))
    df = df.withColumns({"_y": number("y"), "_m": F.coalesce(number("m"), named), "_d": number("d"), "_h": hour, "_n": number("n"), "_s": F.when(F.col("_p.s").isNull(), 0).otherwise(number("s")), "_f": F.coalesce(F.rpad(F.substring(part("f"), 1, 6), 6, "0").try_cast("long"), F.lit(0)), "_z": part("z")})
    between = F.col("_p.t").isNull() | F.upper(part("t")).isin("T", " ")
    valid = between & (F.col("_y") >= 1) & F.col("_m").between(1, 12) & F.col("_d").between(1, _month_length(F.col("_y"), F.col("_m"))) & F.col("_h").between(0, 23) & F.col("_n").between(0, 59) & F.col("_s").between(0, 59)
    df = df.withColumn("_local", F.when(valid, _days(F.col("_y"), F.col("_m"), F.col("_d")) * 86400 + F.col("_h") * 3600 + F.col("_n") * 60 + F.col("_s")))
    table = zone_table(df.select(F.col(zone).alias("zone")))
    year = F.least(F.greatest(F.col("_y"), F.lit(zones.FIRST_YEAR)), F.lit(zones.LAST_YEAR))
    df = df.withColumns({"_zone": F.when(F.col("_z").isNull(), F.col(zone)), "_year": year})
    df = df.join(F.broadcast(table.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "first", "changes")), ["_zone", "_year"], "left")
    device = F.coalesce(F.aggregate("changes", F.col("first"), lambda off, c: F.when(F.col("_local") >= c["at"], c["off"]).otherwise(off)), F.lit(0))
    east = F.when(F.col("_z").isNotNull(), _zone_seconds(F.col("_z"))).otherwise(device)
    clock = (F.col("_local") - east) * 1_000_000 + F.col("_f")
    count = part("e").try_cast("long")
    digits = F.length(F.replace(part("e"), F.lit("-"), F.lit("")))
    epoch = F.when(digits == 10, count * 1_000_000 + F.col("_f")).when(digits == 13, count * 1000).when(digits == 16, count).when(digits == 19, F.floor(count / 1000).cast("long"))
    out = F.when(F.col("_p.e").isNotNull(), epoch).otherwise(clock)
    return df.withColumn("utc_us", out.cast("long")).drop("_v", "_mask", "_p", "_y", "_m", "_d", "_h", "_n", "_s", "_f", "_z", "_zone", "_year", "_local", "first", "changes")
