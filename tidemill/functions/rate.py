"""Rate model: factors by the clock, jitter, rated counts, per-day volume with carry."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rate settings and the clock field each is keyed by (days of the week from Sunday = 0).
MAPS = {
    "hourOfDayRate": lambda t: F.hour(t),
    "dayOfWeekRate": lambda t: F.dayofweek(t) - 1,
    "minuteOfHourRate": lambda t: F.minute(t),
    "dayOfMonthRate": lambda t: F.dayofmonth(t),
    "monthOfYearRate": lambda t: F.month(t),
}


def factor(settings: dict[str, str], when: Column, only: tuple[str, ...] = tuple(MAPS)) -> Column:
    """Product of the maps' entries for `when`; a missing entry or an unreadable map counts as 1."""
    parts = [F.coalesce(F.try_element_at(F.from_json(F.lit(settings[k]), "map<string,double>"), MAPS[k](when).cast("string")), F.lit(1.0)) for k in only if k in settings]
    return reduce(lambda a, b: a * b, parts, F.lit(1.0))


def factor_at(settings: dict[str, str], when) -> float:
    """factor on the driver, for one time."""
    keys = {"hourOfDayRate": when.hour, "dayOfWeekRate": when.isoweekday() % 7, "minuteOfHourRate": when.minute, "dayOfMonthRate": when.day, "monthOfYearRate": when.month}
    out = 1.0
    for name, key in keys.items():
        try:
            out *= float(json.loads(settings.get(name) or "{}").get(str(key), 1.0))
        except (ValueError, AttributeError, TypeError):
            continue
    return out


def half_even(x: float) -> int:
    return round(x)


def jitter(randomize: float, d: Column) -> Column:
    """1 +- randomize / 2, in steps of a thousandth."""
    bound = round(randomize * 1000)
    return 1 + (F.pmod(d, F.lit(bound + 1)) - bound / 2) / 1000


def rated_count(count: Column, factor_: Column) -> Column:
    """Half-even rounding."""
    return F.rint(count * factor_).cast("bigint")


def per_interval_bytes(gb_per_day: float, interval: int) -> float:
    return gb_per_day * 1024**3 / (86400 / (interval or 86400))


def carried(wanted: Column, mean: float) -> Column:
    """Bytes emitted in each interval of an ordered array of wanted bytes: less than a mean event waits for the next interval."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        total = acc["carry"] + x
        hold = (total > 0) & (total < mean)
        return F.struct(F.when(hold, total).otherwise(F.lit(0).cast("bigint")).alias("carry"), F.concat(acc["out"], F.array(F.when(hold, F.lit(0).cast("bigint")).otherwise(total))).alias("out"))

    return F.aggregate(wanted, start, step, lambda acc: acc["out"])
