"""Token replacements as Columns. A kind gives one value for each event; rewrite() puts it into every match."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .draw import below, digest, draw

#: The 67 characters of random strings.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~+"


def ipv4(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    d = draw(seed, stanza, token, ordinal)
    return F.concat_ws(".", *[F.pmod(F.shiftright(d, 8 * k), F.lit(256)).cast("string") for k in range(4)])


def ipv6(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    m = digest(seed, stanza, token, ordinal)
    return F.concat_ws(":", *[F.regexp_replace(F.substring(m, 1 + 4 * k, 4), "^0{1,3}", "") for k in range(8)])


def mac(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    m = digest(seed, stanza, token, ordinal)
    return F.concat_ws(":", *[F.substring(m, 1 + 2 * k, 2) for k in range(6)])


def guid(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """Version 4, lower case."""
    m = digest(seed, stanza, token, ordinal)
    variant = F.translate(F.substring(m, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-4"), F.substring(m, 14, 3), F.lit("-"), variant, F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))


def integer(low: int, high: int, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    return (F.lit(low) + below(draw(seed, stanza, token, ordinal), high - low + 1)).cast("string") if high >= low else F.lit(None).cast("string")


def float_(low: str, high: str, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """A number of steps of the start text's last decimal, printed with at least one decimal and no further zeros."""
    return _steps(low, high, None, seed, stanza, token, ordinal)


def _steps(low: str, high: str, factor: Column | None, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    places = len(low.partition(".")[2])
    scale = 10**places
    a, b = round(float(low) * scale), round(float(high) * scale)
    if b < a:
        return F.lit(None).cast("string")
    k = F.lit(a) + below(draw(seed, stanza, token, ordinal), b - a + 1)
    if factor is not None:
        k = F.rint(k * factor).cast("bigint")
    text = F.concat(F.when(k < 0, "-").otherwise(""), F.floor(F.abs(k) / scale).cast("string"), F.lit("."), F.lpad(F.pmod(F.abs(k), F.lit(scale)).cast("string"), max(1, places), "0"))
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def string(n: int, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """Eight characters of each digest, of four hexadecimal digits each (a bias below 67 in 65,536)."""
    one = lambda m, at: F.substr(F.lit(ALPHABET), (F.pmod(F.conv(F.substring(m, at, 4), 16, 10).cast("int"), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
    parts = [one(digest(seed, stanza, f"{token}#{k // 8}", ordinal), 1 + 4 * (k % 8)) for k in range(n)]
    return F.concat(*parts) if parts else F.lit("")


def hexadecimal(n: int, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    parts = [digest(seed, stanza, token if k == 0 else f"{token}#{k}", ordinal) for k in range((n + 31) // 32)]
    return F.upper(F.substring(F.concat(*parts), 1, n))


def listed(values: list, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    items = F.array(*[F.lit(v if isinstance(v, str) else json.dumps(v)) for v in values])
    return F.element_at(items, (below(draw(seed, stanza, token, ordinal), len(values)) + 1).cast("int"))


def random_value(spec: str, seed: int, stanza: str, token: str, ordinal: Column) -> Column | None:
    """The Column of a `random` replacement; None for a spec that can't be read (the event stays as it is)."""
    at = (seed, stanza, token, ordinal)
    simple = {"ipv4": ipv4, "ipv6": ipv6, "mac": mac, "guid": guid}
    spec = spec.strip()
    if spec.lower() in simple:
        return simple[spec.lower()](*at)
    if m := re.fullmatch(r"(?i)integer\[(-?\d+):(-?\d+)\]", spec):
        return integer(int(m[1]), int(m[2]), *at)
    if m := re.fullmatch(r"(?i)float\[(-?\d+(?:\.\d+)?):(-?\d+(?:\.\d+)?)\]", spec):
        return float_(m[1], m[2], *at)
    if m := re.fullmatch(r"(?i)(string|hex)\((\d+)\)", spec):
        return (string if m[1].lower() == "string" else hexadecimal)(int(m[2]), *at)
    if m := re.match(r"(?i)list(\[.*?\])", spec):
        try:
            values = json.loads(m[1])
        except ValueError:
            return None
        return listed(values, *at) if values else None
    return None


def rated_float(low: str, high: str, factor: Column, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """The drawn number of steps times factor, rounded to whole steps."""
    return _steps(low, high, factor, seed, stanza, token, ordinal)


def rated_integer(low: int, high: int, factor: Column, seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    return F.rint((F.lit(low) + below(draw(seed, stanza, token, ordinal), high - low + 1)) * factor).cast("bigint").cast("string")


def java_pattern(pattern: str) -> str:
    """A pattern of Python's dialect in Java's: Unicode classes, named groups, end of text, stray braces."""
    p = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    p = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", p)
    p = re.sub(r"\{,(\d+)\}", r"{0,\1}", p)
    p = re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", p)
    return "(?U)" + _plain_sets(p)


def _plain_sets(p: str) -> str:
    """Brackets and && inside a set mean more in Java than in Python, where they are characters."""
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\":
            out.append(p[i : i + 2])
            i += 2
            continue
        if p[i] != "[":
            out.append(p[i])
            i += 1
            continue
        j = i + 1 + (p[i + 1 : i + 2] == "^")
        body = p[i:j]
        first = True
        while j < len(p) and (first or p[j] != "]"):
            if p[j] == "\\":
                body += p[j : j + 2]
                j += 2
            else:
                body += "\\" + p[j] if p[j] in "[&]" else p[j]
                j += 1
            first = False
        out.append(body + "]")
        i = j + 1
    return "".join(out)


def rewrite(text: Column, pattern: str, value: Column) -> Column:
    """value in place of every match: of group 1 if the pattern is prefix(group)suffix, else of the whole match. A null value changes nothing."""
    groups = re.compile(pattern).groups
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    m = re.fullmatch(r"((?:[^()\\]|\\.)*)\(((?:[^()\\]|\\.)*)\)((?:[^()\\]|\\.)*)", pattern) if groups == 1 else None
    if groups and not m:
        return F.coalesce(_spliced(pattern)(text, value), text)
    if m:
        done = F.regexp_replace(text, F.lit(java_pattern(f"({m[1]})(?:{m[2]})({m[3]})")), F.concat(F.lit("$1"), _apart(safe), F.lit("$2")))
    else:
        done = F.regexp_replace(text, F.lit(java_pattern(pattern)), safe)
    return F.coalesce(done, text)


def _spliced(pattern: str):
    """For patterns whose first group can't be told apart by a rewrite in the JVM: nested, alternated or repeated groups, named ones, lookarounds."""

    @F.pandas_udf(StringType())
    def splice(text: pd.Series, value: pd.Series) -> pd.Series:
        from ..operators.template import spans

        def one(t, v):
            if t is None or v is None:
                return t
            parts, at = [], 0
            for a, b in spans(pattern, t):
                parts += [t[at:a], v]
                at = b
            return "".join(parts) + t[at:]

        return pd.Series([one(*x) for x in zip(text, value)], dtype=object)

    return splice


def _apart(safe: Column) -> Column:
    """A leading digit would be read as part of the group's number."""
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("\\"), safe)).otherwise(safe)
