"""Relative and absolute times (driver), snap-to, strftime as Columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit names.
UNITS = {
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), "s"),
    **dict.fromkeys(("m", "min", "minute", "minutes"), "m"),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), "h"),
    **dict.fromkeys(("d", "day", "days"), "d"),
    **dict.fromkeys(("w", "week", "weeks"), "w"),
    **dict.fromkeys(("mon", "month", "months"), "mon"),
    **dict.fromkeys(("q", "qtr", "qtrs", "quarter", "quarters"), "q"),
    **dict.fromkeys(("y", "yr", "yrs", "year", "years"), "y"),
}
#: Absolute formats, tried in order.
ABSOLUTE = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y:%H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%Y/%m/%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%b %d %Y %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d")


def add_units(t: datetime, n: int, unit: str) -> datetime:
    if unit in "smhdw":
        return t + timedelta(seconds=n * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit])
    months = t.year * 12 + t.month - 1 + n * {"mon": 1, "q": 3, "y": 12}[unit]
    year, month = divmod(months, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return t.replace(year=year, month=month + 1, day=min(t.day, last))


def snap(t: datetime, unit: str) -> datetime:
    t = t.replace(microsecond=0)
    if unit == "s":
        return t
    t = t.replace(second=0)
    if unit == "m":
        return t
    t = t.replace(minute=0)
    if unit == "h":
        return t
    t = t.replace(hour=0)
    if unit[0] == "w":
        day = int(unit[1:] or 0) % 7
        return t - timedelta(days=(t.isoweekday() - day) % 7)
    if unit == "d":
        return t
    t = t.replace(day=1)
    return t if unit == "mon" else t.replace(month=(t.month - 1) // 3 * 3 + 1) if unit == "q" else t.replace(month=1)


def parse_relative(text: str, now: datetime) -> datetime | None:
    """now, or +-N unit [@snap [+-N unit]]; what follows is ignored; None if the text is no relative time."""
    text = text.strip().lower()
    if text == "now":
        return now.replace(microsecond=0)
    m = re.match(r"(?:([+-])[+-]*(\d*)([a-z]+))?(?:@([a-z]+\d?)(?:([+-])(\d*)([a-z]+))?)?", text)
    if not m or not m[0]:
        return None
    t = now.replace(microsecond=0)
    if m[1]:
        if m[3] not in UNITS:
            return None
        t = add_units(t, int(m[1] + (m[2] or "1")), UNITS[m[3]])
    if m[4]:
        unit = m[4] if re.fullmatch(r"w[0-7]", m[4]) else UNITS.get(m[4])
        if unit is None:
            return None
        t = snap(t, unit)
        if m[5]:
            if m[7] not in UNITS:
                return None
            t = add_units(t, int(m[5] + (m[6] or "1")), UNITS[m[7]])
    return t


def parse_time(text: str, now: datetime) -> datetime:
    """An epoch of 10 or 13 digits, an absolute time, a time of today, or a relative time."""
    text = str(text).strip()
    if re.fullmatch(r"\d{10}|\d{13}", text):
        return datetime(1970, 1, 1) + timedelta(seconds=int(text[:10]), milliseconds=int(text[10:] or 0))
    got = parse_relative(text, now)
    if got is not None:
        return got
    bare = re.sub(r"(?:Z|[+-]\d\d:?\d\d)$", "", text) if re.search(r"\d[T ]\d", text) else text
    for f in ABSOLUTE:
        try:
            return datetime.strptime(bare, f)
        except ValueError:
            continue
    for f in ("%H:%M:%S", "%H:%M"):
        try:
            return datetime.combine(now.date(), datetime.strptime(text, f).time())
        except ValueError:
            continue
    raise ValueError(f"no time: {text!r}")


def offset_seconds(text: str) -> float:
    """Signed seconds of `now` or [+-]N(ms|s|m|h|d)."""
    if text.strip() == "now":
        return 0.0
    m = re.fullmatch(r"([+-]?)(\d+)(ms|s|m|h|d)", text.strip())
    if not m:
        raise ValueError(f"no offset: {text!r}")
    return float(m[1] + m[2]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[3]]


def has_conversion(fmt: str) -> bool:
    """Whether a format has a conversion; %% is none."""
    return re.search(r"%[-_0^#]*\d*[EO]?[A-Za-z]", fmt.replace("%%", "")) is not None


#: What each directive of a lenient parse reads.
READS = {
    "Y": r"(?P<Y>\d{4})", "y": r"(?P<y>\d{2})", "m": r"(?P<m>\d{1,2})", "d": r"\s*(?P<d>\d{1,2})", "e": r"\s*(?P<d>\d{1,2})", "H": r"\s*(?P<H>\d{1,2})", "k": r"\s*(?P<H>\d{1,2})", "I": r"\s*(?P<I>\d{1,2})", "l": r"\s*(?P<I>\d{1,2})",
    "M": r"(?P<M>\d{1,2})", "S": r"(?P<S>\d{1,2})", "f": r"(?P<f>\d{1,6})", "j": r"(?P<j>\d{1,3})", "p": r"(?P<p>[AaPp][Mm])", "z": r"(?:Z|[+-]\d\d:?\d\d)", "Z": r"[A-Za-z]*",
    "b": r"(?P<b>[A-Za-z]{3})[a-z]*", "h": r"(?P<b>[A-Za-z]{3})[a-z]*", "B": r"(?P<b>[A-Za-z]{3})[a-z]*", "a": r"[A-Za-z]+", "A": r"[A-Za-z]+", "s": r"(?P<s>\d+)", "n": r"\s+", "t": r"\s+", "%": "%",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def scan_time(text: str, fmt: str) -> datetime | None:
    """A lenient parse: short numbers, any run of blanks for a blank, %y from 1969 on, an offset dropped, 1900 without a year. What follows must end the text; None if it doesn't fit."""
    for short, long in (("%T", "%H:%M:%S"), ("%F", "%Y-%m-%d"), ("%D", "%m/%d/%y"), ("%R", "%H:%M")):
        fmt = fmt.replace(short, long)
    pattern, seen = [], set()
    for m in re.finditer(r"%[-_0^#]*\d*([A-Za-z%])|(\s+)|(.)", fmt, re.S):
        if m[1]:
            if m[1] not in READS:
                return None
            part = READS[m[1]]
            name = re.search(r"\?P<(\w)>", part)
            pattern.append(part if not name or name[1] not in seen else part.replace(f"?P<{name[1]}>", "?:"))
            seen |= {name[1]} if name else set()
        else:
            pattern.append(r"\s+" if m[2] else re.escape(m[3]))
    found = re.fullmatch("".join(pattern), text.strip(), re.ASCII)
    if not found:
        return None
    g = {k: v for k, v in found.groupdict().items() if v is not None}
    try:
        if "s" in g:
            return datetime(1970, 1, 1) + timedelta(seconds=int(g["s"]))
        year = int(g["Y"]) if "Y" in g else (2000 if int(g["y"]) < 69 else 1900) + int(g["y"]) if "y" in g else 1900
        month = MONTHS.index(g["b"].lower()) + 1 if "b" in g else int(g.get("m", 1))
        hour = int(g.get("H", 0))
        if "I" in g:
            hour = int(g["I"]) % 12 + (12 if g.get("p", "").lower() == "pm" else 0)
        at = datetime(year, month, int(g.get("d", 1)), hour, int(g.get("M", 0)), int(g.get("S", 0)), int(g.get("f", "0").ljust(6, "0")))
        return at.replace(month=1, day=1) + timedelta(days=int(g["j"]) - 1) if "j" in g else at
    except ValueError:
        return None


def stamp(micros: Column) -> Column:
    """2026-01-02 03:04:05, with .ffffff if there is a fraction."""
    t = F.timestamp_micros(micros).cast("timestamp_ntz")
    rest = F.pmod(micros, F.lit(1_000_000))
    return F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))))


def snap_column(t: Column, unit: str) -> Column:
    """Snap as a Column over timestamps; w, w0 ... w6 are weeks from Sunday, Monday, ..."""
    if unit[0] == "w":
        day = F.date_trunc("day", t)
        back = F.pmod(F.dayofweek(t) - 1 - int(unit[1:] or 0) % 7, F.lit(7))
        return (day - F.make_dt_interval(days=back)).cast("timestamp_ntz")
    return F.date_trunc({"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}[unit], t).cast("timestamp_ntz")


def strftime(fmt: str, t: Column) -> Column:
    """The C-style format as a Column; flags - _ 0 choose the padding; an unknown directive stays as it is."""
    pad2 = lambda c, n=2, ch="0": F.lpad(c.cast("string"), n, ch)
    hour12 = F.pmod(F.hour(t) + 11, F.lit(12)) + 1
    sunday = F.dayofweek(t) - 1
    micros = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000))
    number = {  # value, width, usual padding
        "Y": (F.year(t), 4, "0"), "C": (F.floor(F.year(t) / 100), 2, "0"), "y": (F.year(t) % 100, 2, "0"), "m": (F.month(t), 2, "0"), "d": (F.dayofmonth(t), 2, "0"), "e": (F.dayofmonth(t), 2, " "),
        "H": (F.hour(t), 2, "0"), "k": (F.hour(t), 2, " "), "I": (hour12, 2, "0"), "l": (hour12, 2, " "), "M": (F.minute(t), 2, "0"), "S": (F.second(t), 2, "0"), "f": (micros, 6, "0"), "j": (F.dayofyear(t), 3, "0"),
        "U": (F.floor((F.dayofyear(t) + 6 - sunday) / 7), 2, "0"), "W": (F.floor((F.dayofyear(t) + 6 - F.pmod(sunday + 6, F.lit(7))) / 7), 2, "0"),
        "V": (F.weekofyear(t), 2, "0"), "G": (F.extract(F.lit("YEAROFWEEK"), t), 4, "0"), "g": (F.extract(F.lit("YEAROFWEEK"), t) % 100, 2, "0"), "u": (F.pmod(sunday + 6, F.lit(7)) + 1, 1, "0"), "w": (sunday, 1, "0"), "s": (F.unix_seconds(t.cast("timestamp")), 1, "0"),
    }
    text = {"b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE"}
    combined = {"T": "%H:%M:%S", "X": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "x": "%m/%d/%y", "F": "%Y-%m-%d", "c": "%a %b %e %H:%M:%S %Y", "r": "%I:%M:%S %p"}
    fixed = {"n": "\n", "t": "\t", "%": "%", "z": "", "Z": ""}
    #: Directives with the same text in Spark's patterns.
    same = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a"}
    run = re.compile(r"(?:%[" + "".join(same) + r"]|[^%])*%[" + "".join(same) + "]")
    for d, f in combined.items():
        fmt = re.sub(rf"(?<!%)((?:%%)*)%{d}", lambda m, f=f: m[1] + f, fmt)
    if (m := run.match(fmt)) and m.end() > 2:
        pieces = re.findall(r"%.|[^%]+", m[0], re.S)
        pattern = "".join(same[x[1]] if x[0] == "%" else "'" + x.replace("'", "''") + "'" for x in pieces)
        head = F.date_format(t, pattern)
        return F.concat(head, strftime(fmt[m.end() :], t)) if m.end() < len(fmt) else head
    parts: list[Column] = []
    for m in re.finditer(r"%([-_0^#]*)\d*[EO]?([A-Za-z%])|([^%]+|%)", fmt):
        flags, d, plain = m[1] or "", m[2], m[3]
        if plain:
            parts.append(F.lit(plain))
        elif d in number:
            value, width, usual = number[d]
            ch = usual
            for f in flags:
                ch = {"-": "", "_": " ", "0": "0"}.get(f, ch)
            parts.append(pad2(value, width, ch) if ch and width > 1 else value.cast("string"))
        elif d in text:
            parts.append(F.date_format(t, text[d]))
        elif d == "p":
            parts.append(F.when(F.hour(t) < 12, "AM").otherwise("PM"))
        elif d in combined:
            parts.append(strftime(combined[d], t))
        else:
            parts.append(F.lit(fixed.get(d, m[0])))
    return F.concat(*parts) if parts else F.lit("")


def relative_column(text: str, t: Column) -> Column:
    """A relative time as a Column over timestamps: the same steps as parse_relative."""
    m = re.fullmatch(r"(?:([+-])(\d*)([a-z]+))?(?:@([a-z]+\d?)(?:([+-])(\d*)([a-z]+))?)?", text.strip().lower())
    if not m or not m[0]:
        raise ValueError(f"no relative time: {text!r}")

    def add(c: Column, sign: str, n: str, unit: str) -> Column:
        k, u = int(sign + (n or "1")), UNITS[unit]
        if u in "smhdw":
            return (c + F.make_dt_interval(secs=F.lit(k * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[u]))).cast("timestamp_ntz")
        return (c + F.make_ym_interval(F.lit(0), F.lit(k * {"mon": 1, "q": 3, "y": 12}[u]))).cast("timestamp_ntz")

    out = F.date_trunc("second", t).cast("timestamp_ntz")
    if m[1]:
        out = add(out, m[1], m[2], m[3])
    if m[4]:
        out = snap_column(out, m[4] if re.fullmatch(r"w[0-7]", m[4]) else UNITS[m[4]])
    return add(out, m[5], m[6], m[7]) if m[5] else out


def strptime(fmt: str, text: Column) -> Column:
    """Timestamps of texts in a format of plain directives; null where a text doesn't fit."""
    #: Directives in Spark's patterns.
    same = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "j": "DDD"}
    fmt = fmt.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d")
    pieces = re.findall(r"%.|[^%]+", fmt, re.S)
    return F.try_to_timestamp(text, F.lit("".join(same[x[1]] if x[0] == "%" else "'" + x.replace("'", "''") + "'" for x in pieces))).cast("timestamp_ntz")
