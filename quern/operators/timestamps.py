"""Free-text dates and times to one normal form.

A value is reduced to a shape mask (runs of digits, known words, punctuation);
each distinct mask is bound to a parser once per worker, all values of a mask
are parsed as a block, and local times are converted through transition tables
that are built once per zone and carry the version of the zone data.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in English, German, French and Spanish.
MONTH_NAMES = (
    ("january", "januar", "janvier", "enero"),
    ("february", "februar", "fevrier", "febrero"),
    ("march", "marz", "maerz", "mars", "marzo"),
    ("april", "avril", "abril"),
    ("may", "mai", "mayo"),
    ("june", "juni", "juin", "junio"),
    ("july", "juli", "juillet", "julio"),
    ("august", "aout", "agosto"),
    ("september", "septembre", "septiembre", "setiembre"),
    ("october", "oktober", "octobre", "octubre"),
    ("november", "novembre", "noviembre"),
    ("december", "dezember", "decembre", "diciembre"),
)
# Weekday names, by their first letters.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
# Zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "awst": 480, "nzst": 720, "nzdt": 780,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Words that stand for the present.
PRESENT_WORDS = (
    "present", "current", "now", "ongoing", "to date", "today", "till date", "until now", "currently",
    "heute", "jetzt", "aktuell", "bis heute", "actualidad", "actual", "presente", "hasta la fecha", "hoy",
    "aujourd'hui", "aujourd’hui", "présent", "actuel", "ce jour", "à ce jour", "至今", "現在", "现在",
)

YEARS = (1900, 2099)
_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_WORD = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.S)


@lru_cache(maxsize=4096)
def _month(word: str) -> int:
    """Month of a full name or of a prefix of at least three letters that names one month only, else 0."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    if len(flat) < 3:
        return 0
    hits = {m for m, names in enumerate(MONTH_NAMES, 1) for n in names if n.startswith(flat)}
    return hits.pop() if len(hits) == 1 else 0


_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?(?: ?(?P<ap>[ap]\.?m\.?(?![a-z])))?"
_ZONE = r"(?: ?(?P<off>(?:utc|gmt)?[+−-]\d{1,2}(?::?\d{2})?))?(?: ?\[(?P<zb>[a-z]+(?:/[a-z0-9_+-]+)*)\]| ?(?P<zn>[a-z]+(?:/[a-z0-9_+-]+)*))?"
_CLOCK = rf"(?:(?:t| |, ?| at ){_TIME}{_ZONE})?"
_MON = r"(?P<mon>[^\W\d_]{3,})"
_ORD = r"(?:st|nd|rd|th|er|\.|º)?"
#: Parsers by name; a mask is bound to the first one that reads it.
FORMATS = tuple(
    (name, re.compile(rx))
    for name, rx in (
        ("ymd", rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_CLOCK}"),
        ("compact", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[t ]?(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,]\d+)?{_ZONE})?(?P<ap>(?!))?"),
        ("numeric", rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_CLOCK}"),
        ("day_month", rf"(?:(?:{'|'.join(WEEKDAYS)})[a-z]*\.?,? )?(?P<d>\d{{1,2}}){_ORD}(?:[ -]|(?: de )|(?<=[.a-zº])|(?<=\d))(?P<mon>[^\W\d_]{{3,}})\.?,?(?:(?: de )|[ -])?'?(?P<y>\d{{4}}|\d{{2}}){_CLOCK}"),
        ("month_day", rf"(?:(?:{'|'.join(WEEKDAYS)})[a-z]*\.?,? )?{_MON}\.? (?P<d>\d{{1,2}}){_ORD},? (?P<y>\d{{4}}){_CLOCK}"),
        ("month_year", rf"{_MON}\.?,?(?: de)? ?(?:[-/.] ?)?(?P<y>\d{{4}})"),
        ("month_yy", rf"{_MON}\.? ?(?:-|['’`])(?P<y>\d{{2}})"),
        ("ym", r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})"),
        ("my", r"(?P<m>\d{1,2})[-/.](?P<y>\d{4})"),
        ("y", r"\(?(?P<y>\d{4})\)?"),
        ("cjk", rf"(?P<y>\d{{4}}) ?年(?: ?(?P<m>\d{{1,2}}) ?月(?: ?(?P<d>\d{{1,2}}) ?日{_CLOCK})?)?"),
        ("epoch", r"(?P<n>\d{10}|\d{13}|\d{16})"),
    )
)


def _clean(value: str) -> str:
    """NFKC, one space for each run of white space, no outer white space, lower case."""
    return " ".join(unicodedata.normalize("NFKC", value).split()).lower()


def shape_mask(text: str) -> str:
    """The character-class shape of a cleaned value: digits by count, words by class, the rest as it is.

    Words are parted as finely as the parsers tell them apart (months,
    weekdays, zones, other words in plain letters or not), so that one parser
    reads either all values of a mask or none.
    """
    out = []
    for t in _WORD.findall(text):
        if t[0].isdecimal():
            out.append("9" * len(t) if len(t) < 17 else "9+")
        elif t[0].isalpha():
            plain = "" if t.isascii() else "U"
            if _month(t):
                out.append(f"B{plain}")
            elif t in ("utc", "gmt") or len(t) < 3:
                out.append(t)
            elif t in ZONE_MINUTES:
                out.append("Z")
            else:
                out.append(f"D{plain}" if t.startswith(WEEKDAYS) else f"W{plain}")
        else:
            out.append(t)
    return "".join(out)


@lru_cache(maxsize=1)
def zone_data_version() -> str:
    """Version line of the zone data that the transition tables are built from."""
    import zoneinfo

    for p in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            f = Path(p, name)
            if f.exists():
                return f.open(errors="replace").readline().strip().lstrip("# ")
    return "unknown"


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    import zoneinfo

    return {n.lower(): n for n in zoneinfo.available_timezones()}


@lru_cache(maxsize=1024)
def transition_table(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(local seconds, offsets): a local time t has offsets[searchsorted(local, t, 'right')].

    Each switch is placed at the later of its two local readings, so a local
    time that occurs twice is the first one and a skipped one keeps the offset
    before the change.
    """
    import datetime as dt
    import zoneinfo

    name = _zone_names().get(zone.lower())
    if name is None:
        return None
    z, week = zoneinfo.ZoneInfo(name), 7 * 86400
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    off = lambda s: int((epoch + dt.timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    t, end = -2208988800, 4102444800
    offsets, local, before = [off(t)], [], off(t)
    while t < end:
        after = off(t + week)
        if after != before:
            lo, hi = t, t + week
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if off(mid) != before else (mid, hi)
            after = off(hi)
            local.append(hi + max(before, after))
            offsets.append(after)
            before = after
            t = hi
        else:
            t += week
    return np.array(local, dtype=np.int64), np.array(offsets, dtype=np.int64)


def _offset_seconds(text: str) -> int:
    text = text.removeprefix("utc").removeprefix("gmt")
    digits = text[1:].replace(":", "")
    h, m = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
    return (-1 if text[0] in "-−" else 1) * (h * 3600 + m * 60)


def _utc(seconds: np.ndarray) -> list[str]:
    return [f"{x}Z" for x in np.datetime_as_string(seconds.astype("datetime64[s]"), unit="s")]


def _block(name: str, rx: re.Pattern, values: list[str], locales: list, zones: list) -> list[str | None]:
    """Normal forms of values that share a mask."""
    n = len(values)
    groups = [rx.fullmatch(v) for v in values]
    found = [g.groupdict() if g else {} for g in groups]
    ints = lambda k: np.array([int(g[k]) if g.get(k) else -1 for g in found], dtype=np.int64)
    out: list[str | None] = [None] * n
    if name == "epoch":
        raw, size = ints("n"), len(values[0])
        for i, s in enumerate(_utc(raw // 10 ** (size - 10))):
            out[i] = s
        return out
    y, m, d = ints("y"), ints("m"), ints("d")
    short = np.array([len(g.get("y") or "") == 2 for g in found])
    y = np.where(short, np.where(y >= 31, 1900 + y, 2000 + y), y)
    if name == "numeric":
        a, b = ints("a"), ints("b")
        us = np.array([loc == "en-US" and g.get("sep") in ("/", "-") for loc, g in zip(locales, found, strict=True)])
        m, d = np.where(us, a, b), np.where(us, b, a)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = lambda mm: _DAYS[np.clip(mm, 0, 12)] + ((mm == 2) & leap)
        bad = (m < 1) | (m > 12) | (d < 1) | (d > days(m))
        m, d = np.where(bad, d, m), np.where(bad, m, d)
    if any(g.get("mon") for g in found):
        m = np.array([_month(g["mon"]) if g.get("mon") else -1 for g in found], dtype=np.int64)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok = (y >= YEARS[0]) & (y <= YEARS[1]) & np.array([bool(g) for g in found])
    has_m = (m != -1) | (name in ("month_year", "month_yy", "month_day", "day_month", "ym", "my"))
    has_d = d != -1
    ok &= ~has_m | ((m >= 1) & (m <= 12))
    ok &= ~has_d | ((d >= 1) & (d <= _DAYS[np.clip(m, 0, 12)] + ((m == 2) & leap)))
    hh, mi, ss = ints("H"), ints("M"), ints("S")
    timed = hh != -1
    if timed.any():
        ap = [(g.get("ap") or "").replace(".", "") for g in found]
        half = np.array([bool(x) for x in ap])
        ok &= ~half | ((hh >= 1) & (hh <= 12))
        hh = np.where(half, hh % 12 + 12 * np.array([x == "pm" for x in ap]), hh)
        ss = np.where(ss == -1, 0, ss)
        ok &= ~timed | ((mi < 60) & (ss < 60) & ((hh < 24) | ((hh == 24) & (mi == 0) & (ss == 0))))
        day = np.array(
            [f"{a:04d}-{b:02d}-{c:02d}" if k else "1970-01-01" for a, b, c, k in zip(y, m, d, ok, strict=True)], dtype="datetime64[D]"
        )
        local = day.astype("datetime64[s]").astype(np.int64) + hh * 3600 + mi * 60 + ss
        offset = np.zeros(n, dtype=np.int64)
        wanted: dict[str, list[int]] = {}
        for i, g in enumerate(found):
            zone = g.get("zb") or g.get("zn")
            if g.get("off"):
                offset[i] = _offset_seconds(g["off"])
            elif zone and zone in ZONE_MINUTES:
                offset[i] = ZONE_MINUTES[zone] * 60
            elif zone and zone not in _zone_names():
                ok[i] &= not timed[i]
            else:
                wanted.setdefault(zone or zones[i] or "UTC", []).append(i)
        for zone, at in wanted.items():
            tab = transition_table(zone)
            if tab is not None:
                offset[at] = tab[1][np.searchsorted(tab[0], local[at], side="right")]
        stamps = _utc(local - offset)
    for i in np.flatnonzero(ok):
        if timed[i]:
            out[i] = stamps[i]
        else:
            out[i] = f"{y[i]:04d}" + (f"-{m[i]:02d}" if has_m[i] else "") + (f"-{d[i]:02d}" if has_d[i] else "")
    return out


def normal_forms(values: pd.Series, locales: pd.Series, zones: pd.Series) -> pd.Series:
    """Normal form of each value, null where it states no date.

    Nulls, blanks, impossible dates, words and other texts, of any length, give
    null; a null locale reads the day first, a null or unknown zone is UTC. The
    order of the values doesn't matter.
    """
    keys = pd.DataFrame({"v": values, "l": locales, "z": zones}).astype(object)
    keys = keys.where(keys.notna(), None)
    uniq = keys.drop_duplicates()
    by_mask: dict[str, list[int]] = {}
    cleaned = []
    for i, v in enumerate(uniq["v"]):
        c = _clean(v) if v is not None else ""
        cleaned.append(c)
        if any(ch.isdecimal() for ch in c):
            by_mask.setdefault(shape_mask(c), []).append(i)
    res: list[str | None] = [None] * len(uniq)
    loc, zon = uniq["l"].tolist(), uniq["z"].tolist()
    for mask, at in by_mask.items():
        sample = cleaned[at[0]]
        parser = _bound(mask, sample)
        if parser is None:
            continue
        for i, r in zip(at, _block(*parser, [cleaned[i] for i in at], [loc[i] for i in at], [zon[i] for i in at]), strict=True):
            res[i] = r
    memo = dict(zip(zip(uniq["v"], loc, zon, strict=True), res, strict=True))
    return pd.Series([memo[k] for k in zip(keys["v"], keys["l"], keys["z"], strict=True)], dtype=object)


_BOUND: dict[str, tuple[str, re.Pattern] | None] = {}


def _bound(mask: str, sample: str) -> tuple[str, re.Pattern] | None:
    """The parser of a mask; values of one mask have the same tokens by class, so any of them decides it."""
    if mask in _BOUND:
        return _BOUND[mask]
    parser = next(((name, rx) for name, rx in FORMATS if rx.fullmatch(sample)), None)
    if len(mask) <= 200:  # masks of long texts aren't kept
        if len(_BOUND) > 100_000:
            _BOUND.clear()
        _BOUND[mask] = parser
    return parser


def normal_form(value: Column, locale: Column, zone: Column) -> Column:
    """Arrow-vectorised column form of normal_forms."""

    @F.pandas_udf("string")
    def run(v: pd.Series, loc: pd.Series, z: pd.Series) -> pd.Series:
        return normal_forms(v, loc, z)

    return run(value, locale, zone)


def is_present_word(value: Column) -> Column:
    """True if the value is a word for the present; null counts as no."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(value, r"[\s 　]+", " "))).isin(*PRESENT_WORDS), F.lit(False))


def contact_settings(contact: DataFrame) -> DataFrame:
    """(doc_id, locale, time_zone): of each résumé the settings delivered last."""
    latest = F.max_by(F.struct("locale", "time_zone"), F.struct("received_at", "locale", "time_zone")).alias("_s")
    return contact.groupBy("doc_id").agg(latest).select("doc_id", "_s.locale", "_s.time_zone")


def normalise_dates(records: DataFrame, contact: DataFrame, table_name: str, id_col: str, fields: list[str]) -> DataFrame:
    """(table_name, record_id, field, normal_form), one row for each value that states a date.

    Repeated rows count each; a résumé without a contact row has neither locale
    nor zone. Empty input gives no rows, further columns are ignored.
    """
    rows = records.select(F.col(id_col).alias("record_id"), "doc_id", *fields).join(contact_settings(contact), "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return (
        rows.select("record_id", "locale", "time_zone", F.explode(pairs).alias("p"))
        .where(F.col("p.value").rlike(r"[0-9０-９]"))
        .select(
            F.lit(table_name).alias("table_name"),
            "record_id",
            F.col("p.field").alias("field"),
            normal_form(F.col("p.value"), F.col("locale"), F.col("time_zone")).alias("normal_form"),
        )
        .where(F.col("normal_form").isNotNull())
    )
