"""Identity rotation: format inference, identity spaces, permutation and rendering.

The arithmetic is unsigned and up to 128 bits wide; the Columns evaluate it on distinct values only and join back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

M64, M128 = (1 << 64) - 1, (1 << 128) - 1
#: The golden-ratio increments (of windows, of rounds), the finaliser's factors, the FNV-1a start and prime.
GOLDEN, ROUND, MIX1, MIX2, FNV0, FNVP = 0x9E3779B97F4A7C15, 0x9E3779B9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xCBF29CE484222325, 0x100000001B3


def mix64(x: int) -> int:
    x = (x ^ (x >> 30)) * MIX1 & M64
    x = (x ^ (x >> 27)) * MIX2 & M64
    return x ^ (x >> 31)


def fnv1a64(text: str) -> int:
    h = FNV0
    for b in text.encode():
        h = (h ^ b) * FNVP & M64
    return h


def permute(x: int, n: int) -> int:
    """A bijection of range(n): four Feistel rounds over the next even power of two, walked until inside."""
    if n <= 1:
        return 0
    x %= n
    half = (max(1, (n - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    for _ in range(64):
        left, right = x >> half, x & mask
        for r in range(4):
            left, right = right, left ^ (mix64((right + r * ROUND) & M64) & mask)
        x = left << half | right
        if x < n:
            return x
    return x % n


#: The alphabets of a mixed format's letters and digits; its first letter is none that a hexadecimal number has.
SLOTS = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "g": "ghijklmnopqrstuvwxyz", "G": "GHIJKLMNOPQRSTUVWXYZ"}
GUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
WIDEST = 38  # digits beyond this are placed, not permuted


def infer(value: str) -> str:
    """digits(w), guid, hex(w), mixed(template) or none. A template has 9, a and A for digits and letters (g or G for the first letter) and other characters as they are."""
    if re.fullmatch("[0-9]+", value):
        return f"digits({len(value)})"
    if re.fullmatch(GUID, value) or re.fullmatch(GUID, value.lower()) and value == value.upper():
        return "guid"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) and re.search("[a-fA-F]", value):
        return f"hex({len(value)})"
    shape = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", value)))
    shape = re.sub("[aA]", lambda m: "g" if m[0] == "a" else "G", shape, count=1)
    return f"mixed({shape})" if re.search("[9aAgG]", shape) else "none"


def kind_column(c: Column) -> Column:
    """infer as a Column."""
    w = F.char_length(c).cast("string")
    shape = F.translate(c, SLOTS["9"] + SLOTS["a"] + SLOTS["A"], "9" * 10 + "a" * 26 + "A" * 26)
    shape = F.regexp_replace(F.regexp_replace(shape, "^([^aA]*)a", "$1g"), "^([^aAg]*)A", "$1G")
    out = F.when(c.rlike("^[0-9]+$"), F.concat(F.lit("digits("), w, F.lit(")"))).when(c.rlike(f"^(?:{GUID}|{GUID.replace('a-f', 'A-F')})$"), F.lit("guid"))
    out = out.when(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & c.rlike("[a-fA-F]"), F.concat(F.lit("hex("), w, F.lit(")")))
    return out.when(shape.rlike("[9aAgG]"), F.concat(F.lit("mixed("), shape, F.lit(")"))).otherwise("none")


def upper_case(value: str) -> bool:
    """Whether a value's letters are all upper case (no letter: no)."""
    letters = [ch for ch in value if ch.isalpha()]
    return bool(letters) and all(ch.isupper() for ch in letters)


def space(kind: str) -> int:
    """How many identities a format has; what is beyond 128 bits counts as their most."""
    if kind.startswith("mixed("):
        return min(math.prod(len(SLOTS.get(ch, " ")) for ch in kind[6:-1]), M128)
    m = re.fullmatch(r"(digits|hex)\((\d+)\)", kind)
    if m:
        w = int(m[2])
        if m[1] == "digits":
            return 9 * 10 ** (w - 1) if w <= WIDEST else M128
        return min(6 * 16 ** (w - 1), M128)
    return 1 << 122 if kind == "guid" else 1


def render(kind: str, x: int) -> str:
    if kind.startswith("mixed("):
        out, x = [], x % space(kind)
        for ch in reversed(kind[6:-1]):
            alphabet = SLOTS.get(ch)
            out.append(alphabet[x % len(alphabet)] if alphabet else ch)
            x //= len(alphabet) if alphabet else 1
        return "".join(reversed(out))
    m = re.fullmatch(r"(digits|hex)\((\d+)\)", kind)
    if m:
        w = int(m[2])
        if m[1] == "digits":
            return str(10 ** (w - 1) + (x % space(kind) if w <= WIDEST else x))
        return f"{10 * 16 ** (w - 1) + x % (6 * 16 ** (w - 1)):0{w}x}"
    if kind == "guid":  # 122 bits around version and variant
        high, mid, low = x >> 74, x >> 62 & 0xFFF, x & ((1 << 62) - 1)
        h = f"{high:012x}4{mid:03x}{1 << 63 | low:016x}"
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    raise ValueError(f"no such format: {kind}")


def capacity(sizes: dict[str, int]) -> int:
    """How many passes of identities there are before one repeats: the least room of a format (kind -> how many values it has); 0 without any."""
    return min((space(kind) // d for kind, d in sizes.items() if d), default=0)


def pass_identity(kind: str, pass_no: int, k: int, d: int, workers: int = 1, slot: int = 0) -> str:
    n = space(kind)
    return render(kind, permute(((pass_no * workers + slot) * d + k) % n, n))


def window_identity(kind: str, text: str, window: int) -> str:
    lo = mix64(fnv1a64(text) ^ (window * GOLDEN & M64))
    hi = mix64(lo ^ 0xA5A5A5A5A5A5A5A5)
    return render(kind, ((hi << 64) | lo) % space(kind))


@F.pandas_udf(StringType())
def pass_value(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """kind, pass, k, d -> the identity; a null k (not in the table) or the kind none gives null."""
    for kind, pass_no, k, d in parts:
        yield pd.Series([None if f == "none" or pd.isna(x) else pass_identity(f, int(p), int(x), int(n)) for f, p, x, n in zip(kind, pass_no, k, d)], dtype=object)


@F.pandas_udf(StringType())
def window_value(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kind, text, window in parts:
        yield pd.Series([None if f == "none" else window_identity(f, t, int(w)) for f, t, w in zip(kind, text, window)], dtype=object)
