"""Counter-based draws: a value depends on (seed, stanza, token, ordinal) alone, never on partitioning or retries."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F


_fast: ContextVar[bool] = ContextVar("fast", default=False)


@contextmanager
def fast(on: bool = True):
    """Columns built inside draw by xxhash64, several times cheaper than md5, which other SQL engines have too."""
    token = _fast.set(on)
    try:
        yield
    finally:
        _fast.reset(token)


def digest(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """32 hexadecimal digits."""
    if _fast.get():
        return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), F.lit(stanza), F.lit(token), F.lit(half), ordinal)), 16, "0") for half in (1, 2)]))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stanza), F.lit(token), ordinal.cast("string")).cast("binary"))


def draw(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """60 uniform bits as a bigint."""
    if _fast.get():
        return fast_draw(seed, stanza, token, ordinal)
    return F.conv(F.substring(digest(seed, stanza, token, ordinal), 1, 15), 16, 10).cast("bigint")


def fast_draw(seed: int, stanza: str, token: str, ordinal: Column) -> Column:
    """As draw, by a cheaper hash that SQL elsewhere lacks."""
    return F.xxhash64(F.lit(seed), F.lit(stanza), F.lit(token), ordinal).bitwiseAND(F.lit((1 << 60) - 1))


def below(d: Column, n: Column | int) -> Column:
    return F.pmod(d, (F.lit(n) if isinstance(n, int) else n).cast("bigint"))
