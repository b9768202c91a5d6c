"""Dates: parsing by known forms and languages, relative dates, eras, time zones, source precedence. ``now`` is always given."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the months by language, abbreviated to what tells them apart.
MONTHS = {
    "en": ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    "de": ("jan", "feb", "mär", "apr", "mai", "jun", "jul", "aug", "sep", "okt", "nov", "dez"),
    "ru": ("янв", "фев", "мар", "апр", "мая", "июн", "июл", "авг", "сен", "окт", "ноя", "дек"),
    "uk": ("січ", "лют", "бер", "кві", "тра", "чер", "лип", "сер", "вер", "жов", "лис", "гру"),
}
#: Units of relative dates in seconds, by their first letters.
UNITS = {"sec": 1, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "сек": 1, "мин": 60, "час": 3600, "дн": 86400, "ден": 86400, "хв": 60, "год": 3600, "stunde": 3600, "tag": 86400, "秒": 1, "分": 60, "時間": 3600, "日": 86400}
TODAY = re.compile(r"\b(?:today|heute|сегодня|сьогодні)\b|今日", re.IGNORECASE)
YESTERDAY = re.compile(r"\b(?:yesterday|gestern|вчера|вчора)\b|昨日", re.IGNORECASE)
AGO = re.compile(r"(\d+)\s*(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\w*\s*(?:ago|назад|тому|前|zurück)", re.IGNORECASE)
TIME = re.compile(r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]\.?m\.?)?", re.IGNORECASE)
ISO = re.compile(r"(?<!\d)(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})(?!\d)")
DAY_FIRST = re.compile(r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)")
NAMED = re.compile(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th|\.)?\s+([^\W\d_]{3,})\.?,?\s+(\d{4})|([^\W\d_]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", re.IGNORECASE)
EPOCH = re.compile(r"(?<!\d)(\d{10})(?!\d)")
#: Full-width digits and signs to plain ones.
WIDE = str.maketrans("０１２３４５６７８９：／．－", "0123456789:/.-")
#: Year before the first of each era.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}


def month_of(name: str) -> int | None:
    low = name.lower()
    for names in MONTHS.values():
        for i, m in enumerate(names):
            if low.startswith(m):
                return i + 1
    return None


def era_to_year(text: str) -> str:
    """Japanese era years as years of the common era, full-width signs as plain ones."""
    text = text.translate(WIDE)
    for name, before in ERAS.items():
        text = re.sub(name + r"\s*(\d+|元)\s*年", lambda m, b=before: f"{b + (1 if m[1] == '元' else int(m[1]))}年", text)
    return text


def parsed(text: str | None, now: pd.Timestamp, day_first: bool = True) -> pd.Timestamp | None:
    """The date a text names, or None: relative words first, then epoch seconds, numbers and named months, with a time of day if there is one."""
    if not text:
        return None
    t = era_to_year(text)
    if m := AGO.search(t):
        unit = next(u for u in sorted(UNITS, key=len, reverse=True) if m[2].lower().startswith(u.lower()))
        return now - pd.Timedelta(seconds=int(m[1]) * UNITS[unit])
    day = None
    if TODAY.search(t):
        day = now.normalize()
    elif YESTERDAY.search(t):
        day = now.normalize() - pd.Timedelta(days=1)
    elif m := ISO.search(t):
        day = _day(int(m[1]), int(m[2]), int(m[3]))
    elif m := DAY_FIRST.search(t):
        a, b = (int(m[1]), int(m[2])) if day_first else (int(m[2]), int(m[1]))
        day = _day(int(m[3]), b, a) or _day(int(m[3]), a, b)
    elif (m := NAMED.search(t)) and (month := month_of(m[2] or m[4])):
        day = _day(int(m[3] or m[6]), month, int(m[1] or m[5]))
    elif m := EPOCH.search(t):
        return pd.Timestamp(int(m[1]), unit="s")
    if day is None:
        return None
    if m := TIME.search(t):
        hour = int(m[1]) % 12 + 12 * (m[4][0].lower() == "p") if m[4] else int(m[1])
        if hour < 24 and int(m[2]) < 60:
            day += pd.Timedelta(hours=hour, minutes=int(m[2]), seconds=int(m[3] or 0))
    return day


def _day(y: int, m: int, d: int) -> pd.Timestamp | None:
    try:
        return pd.Timestamp(y, m, d)
    except ValueError:
        return None


def parse_date(c: Column, now: str, day_first: bool = True) -> Column:
    """Timestamp of a date text: built-in formats first, the Pandas UDF for what they leave."""

    @F.pandas_udf("timestamp_ntz")
    def slow(text: pd.Series) -> pd.Series:
        moment = pd.Timestamp(now)
        return pd.Series([parsed(t, moment, day_first) for t in text], dtype="datetime64[us]")

    quick = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")]).cast("timestamp_ntz")
    return F.coalesce(quick, slow(F.when(quick.isNull(), c)))


#: Offsets from UTC in minutes of time zone names.
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BST": 60}


def offset_minutes(c: Column) -> Column:
    """Offset from UTC that a date text names, null if none."""
    sign, hours, minutes = (F.regexp_extract(c, r"\d{2}:\d{2}(?::\d{2})?\s*(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})", i) for i in (1, 2, 3))
    number = F.when(sign != "", (hours.cast("int") * 60 + minutes.cast("int")) * F.when(sign == "-", -1).otherwise(1))
    name = F.regexp_extract(c, r"\b(" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")\b", 1)
    zones = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(number, F.when(name != "", zones[name]))


def to_utc(ts: Column, minutes: Column) -> Column:
    return ts - F.make_interval(mins=F.coalesce(minutes, F.lit(0)))


def zone_by_url(ts: Column, url: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """A date moved by the minutes of the first rule whose pattern the URL has."""
    out = ts
    for pattern, minutes in reversed(rules):
        out = F.when(url.rlike(pattern), ts - F.make_interval(mins=F.lit(minutes))).otherwise(out)
    return out


def day_month_swapped(c: Column, keep_form: bool = False) -> Column:
    """A date whose day and month stand in each other's place."""
    ts = F.try_to_timestamp(c, F.lit("yyyy-dd-MM HH:mm:ss")).cast("timestamp_ntz")
    return F.date_format(ts, "yyyy-dd-MM HH:mm:ss") if keep_form else ts


#: Bits of the sources of a publication date (fixed values), in order of precedence.
SOURCES = {"url": 1, "rss": 2, "http_date": 4, "last_modified": 8, "dc_date": 16, "pubdate": 32, "now": 64, "sql": 128}


def publication_date(values: Mapping[str, Column], mask: Column, overwrite: Column) -> Column:
    """The first source of the mask that has a value; one of the overwrite mask replaces what stands before it."""
    out = F.lit(None).cast("timestamp_ntz")
    for name, bit in SOURCES.items():
        if name in values:
            on, over = mask.bitwiseAND(bit) != 0, overwrite.bitwiseAND(bit) != 0
            out = F.when(on & values[name].isNotNull() & (out.isNull() | over), values[name]).otherwise(out)
    return out


def last_modified(status: Column, tc_date: Column, header: Column, date: Column, now: Column, days: int) -> Column:
    """304: the stored date; else the header, the Date header, or now less some days."""
    return F.when(status == 304, tc_date).otherwise(F.coalesce(header, date, now - F.make_interval(days=F.lit(days))))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
