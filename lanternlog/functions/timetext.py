"""Readings of a time text: every instant it can name, as arrays.

Works on Arrow batches: one RE2 pattern a family extracts all texts of the
batch at once, dates are computed as numpy arrays, and zones are resolved once
a distinct zone text.
"""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"

# The families of time texts.
_T = r"(?P<h>\d{1,2}):(?P<i>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d{1,12}))?"
_Z = r"\s?(?P<z>(?:UTC|GMT)?\s?[+-]\d{2}:?\d{2}|\[[A-Za-z0-9_+/-]+\]|[A-Za-z]{1,5})?"
_HALF = r"(?:\s?(?P<a>[AaPp])\.?[Mm]\.?)?"
FAMILIES = {
    "iso": rf"^(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})[Tt ]{_T}{_Z}$",
    "compact": rf"^(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<i>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,12}}))?{_Z}$",
    "slash": rf"^(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}),? {_T}{_HALF}{_Z}$",
    "yslash": rf"^(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}),? {_T}{_HALF}{_Z}$",
    "dotted": rf"^(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}),? {_T}{_Z}$",
    "named": rf"^(?:[A-Za-z]{{3}}, ?)?(?P<d>\d{{1,2}})[ -](?P<m>[A-Za-z]{{3}})[ -](?P<y>\d{{4}}) {_T}{_Z}$",
    "ctime": rf"^[A-Za-z]{{3}} (?P<m>[A-Za-z]{{3}}) +(?P<d>\d{{1,2}}) {_T} (?P<y>\d{{4}}){_Z}$",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
UNIVERSAL = {"Z", "UTC", "GMT", "UT"}
FILETIME_EPOCH_US = 11644473600000000  # from 1601-01-01 to 1970-01-01
BLANKS = " \t\r\n\f\v\xa0﻿"
CODES = {name: i for i, name in enumerate(["number", "date", *FAMILIES])}
#: Cost of a reading that contradicts what its source declares; see operators.timeline.
AGAINST = 1000


@functools.lru_cache(None)
def zone(name: str | None) -> str | None:
    """The name if it is a known zone."""
    try:
        return name if name and zoneinfo.ZoneInfo(name) else None
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


@functools.lru_cache(None)
def abbreviations(name: str) -> dict[str, int]:
    """The offsets in microseconds that a zone's abbreviations mean, the latest use of each."""
    out = {}
    at = zoneinfo.ZoneInfo(name)
    for year in range(1995, 2038):
        for month in (1, 4, 7, 10):
            t = dt.datetime(year, month, 15, tzinfo=at)
            out[t.tzname().upper()] = int(t.utcoffset().total_seconds()) * 1_000_000
    return out


@functools.lru_cache(1 << 16)
def resolve_zone(text: str, tz: str | None) -> tuple[str, object]:
    """("offset", us), ("region", name), ("naive", None), or ("none", None) for a zone that can't be known."""
    text = text.strip()
    if not text:
        return "naive", None
    if text.upper() in UNIVERSAL:
        return "offset", 0
    if text[0] == "[":
        return ("region", zone(text[1:-1])) if zone(text[1:-1]) else ("none", None)
    if text[-1].isdigit():
        digits = text.upper().removeprefix("UTC").removeprefix("GMT").strip().replace(":", "")
        hours, minutes = int(digits[1:3]), int(digits[3:5])
        sign = -1 if digits[0] == "-" else 1
        return ("offset", sign * (hours * 60 + minutes) * 60_000_000) if hours <= 18 and minutes <= 59 else ("none", None)
    known = abbreviations(tz).get(text.upper()) if tz else None
    return ("none", None) if known is None else ("offset", known)


def wall_us(y: np.ndarray, m: np.ndarray, d: np.ndarray, seconds: np.ndarray, micros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds of a wall-clock time as if it were UTC, whether its date exists)."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    month = np.clip(m, 1, 12)
    days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month - 1] + ((month == 2) & leap)
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= days) & (y >= 1)
    first = (np.maximum(y, 1) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (month - 1)
    day = first.astype("datetime64[D]").astype(np.int64) + d - 1
    return day * 86_400_000_000 + seconds * 1_000_000 + micros, ok


def instants(wall: np.ndarray, tz: str) -> tuple[np.ndarray, np.ndarray]:
    """(the earlier, the later instant) of wall-clock times in a zone; inside a gap both by the offset before it."""
    at = pd.DatetimeIndex(wall.astype("datetime64[us]"))

    def utc(local: pd.DatetimeIndex, summer: bool) -> np.ndarray:
        there = local.tz_localize(tz, ambiguous=np.full(len(local), summer), nonexistent="NaT")
        return there.tz_convert("UTC").tz_localize(None).values.astype("datetime64[us]")

    three_hours = pd.Timedelta("3h")
    before = utc(at - three_hours, True) + np.timedelta64(3, "h")
    out = []
    for summer in (True, False):
        got = utc(at, summer)
        out.append(np.where(np.isnat(got), before, got).astype(np.int64))
    return np.minimum(*out), np.maximum(*out)


def _ints(column: pa.Array) -> np.ndarray:
    return pc.if_else(pc.equal(column, ""), "0", column).cast(pa.int64()).to_numpy(zero_copy_only=False)


def readings(text: pa.Array, tz: pa.Array, order: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, us, form, cost): the readings of each text of a batch.

    tz, order: what each text's source declares, or null. Readings of a text
    come cheapest first; readings of one instant are one, but for the two orders
    of an equal day and month, which fit what is around them either way. A text
    that names no instant (null, empty, words, an impossible date or time) has
    none.
    """
    n = len(text)
    text = pc.utf8_trim(pc.fill_null(text.cast(pa.string()), ""), BLANKS)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(rows: np.ndarray, us: np.ndarray, form: int, cost: np.ndarray | int) -> None:
        found.append((rows, us, np.full(len(rows), form), np.broadcast_to(cost, len(rows))))

    left = np.arange(n)
    digits = pc.match_substring_regex(text, r"^\d{9,19}$").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(digits)
    if len(rows):
        some = text.take(pa.array(rows))
        size, value = pc.utf8_length(some).to_numpy(zero_copy_only=False), pc.if_else(pc.greater(pc.utf8_length(some), 18), pc.utf8_slice_codeunits(some, 0, 16), some).cast(pa.int64()).to_numpy()
        us = np.select([size <= 11, size <= 14, size <= 16, size <= 18], [value * (size <= 11) * 1_000_000, value * (size <= 14) * 1000, value, value // 10 - FILETIME_EPOCH_US], value)
        add(rows, us, CODES["number"] * 8, 0)
    left = left[~digits]

    def extract(pattern: str) -> tuple[np.ndarray, pa.StructArray]:
        nonlocal left
        got = pc.extract_regex(text.take(pa.array(left)), pattern)
        hit = pc.is_valid(got).to_numpy(zero_copy_only=False)
        rows, left = left[hit], left[~hit]
        return rows, got.filter(pa.array(hit))

    rows, got = extract(r"^/Date\((?P<ms>-?\d{1,15})(?:[+-]\d{4})?\)/$")
    add(rows, _ints(got.field("ms")) * 1000, CODES["date"] * 8, 0)
    for name, pattern in FAMILIES.items():
        if not len(left):
            break
        rows, got = extract(pattern)
        if not len(rows):
            continue
        part = {f.name: got.field(f.name) for f in got.type}
        month = pc.add(pc.index_in(pc.utf8_lower(part["m"]), pa.array(MONTHS)), 1).fill_null(0).to_numpy(zero_copy_only=False) if name in ("named", "ctime") else _ints(part["m"])
        hour, minute, second = _ints(part["h"]), _ints(part["i"]), _ints(part["s"])
        fits = (minute <= 59) & (second <= 59) & (hour <= 23)
        if "a" in part:
            half = pc.utf8_lower(part["a"]).to_numpy(zero_copy_only=False)
            given = half != ""
            fits &= ~given | ((hour >= 1) & (hour <= 12))
            hour = np.where(given, hour % 12 + 12 * (half == "p"), hour)
        micros = _ints(pc.utf8_slice_codeunits(pc.utf8_rpad(part["f"], 6, "0"), 0, 6))
        y, d, seconds = _ints(part["y"]), _ints(part["d"]), hour * 3600 + minute * 60 + second
        own_tz, own_order = tz.take(pa.array(rows)), pc.utf8_lower(order.take(pa.array(rows)).cast(pa.string())).to_numpy(zero_copy_only=False)
        pairs = pa.StructArray.from_arrays([part["z"], own_tz.cast(pa.string())], ["z", "tz"]).to_pandas()
        key = [(p["z"], zone(p["tz"])) for p in pairs]
        code: dict[tuple, int] = {}
        which = np.array([code.setdefault(k, len(code)) for k in key])
        for swap in (False, True) if name == "slash" else (False,):
            wall, ok = wall_us(y, d if swap else month, month if swap else d, seconds, micros)
            ok &= fits
            mine = "mdy" if swap else "dmy"
            declared = (own_order == "dmy") | (own_order == "mdy")
            extra = np.where(declared & (own_order != mine), AGAINST, 0) if name == "slash" else np.zeros(len(rows), np.int64)
            form = CODES[name] * 8 + 4 * swap
            for (z, local), c in code.items():
                at = np.flatnonzero((which == c) & ok)
                kind, value = resolve_zone(z, local)
                if not len(at) or kind == "none":
                    continue
                if kind == "offset":
                    add(rows[at], wall[at] - value, form, extra[at])
                    continue
                region = value if kind == "region" else local
                if region:
                    early, late = instants(wall[at], region)
                    add(rows[at], early, form, extra[at])
                    add(rows[at], late, form + 1, extra[at] + AGAINST)
                if kind == "naive":
                    add(rows[at], wall[at], form + 2, extra[at] + (AGAINST if local else 0))
    row, us, form, cost = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    by = np.lexsort((np.arange(len(row)), cost, form // 4, us, row))
    row, us, form, cost, seq = row[by], us[by], form[by], cost[by], by
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (us[1:] != us[:-1]) | (form[1:] // 4 != form[:-1] // 4)
    row, us, form, cost, seq = row[first], us[first], form[first], cost[first], seq[first]
    by = np.lexsort((seq, cost, row))
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), us[by], form[by], cost[by]


@F.pandas_udf(LongType())
def first_reading(texts: pd.Series) -> pd.Series:
    """The cheapest reading of each text of a source that declares nothing, in microseconds since 1970; null if it names no instant."""
    column, none = pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string())
    offsets, us, _, _ = readings(column, none, none)
    found = np.diff(offsets) > 0
    out = pd.Series(np.full(len(texts), None), dtype="Int64")
    out[found] = us[offsets[:-1][found]]
    return out


# Keeps filters on what is made of it above it: pushed below, they would take all that leads to it along, once for every mention.
first_reading = first_reading.asNondeterministic()
