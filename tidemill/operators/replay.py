"""Replay of a recorded timeline: gaps, schedules and backward sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gaps(lines: DataFrame, time_us: str = "base_us", multiple: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """diff: the gap before each line in microseconds, times multiple (0 for the first). by: columns that name a timeline."""
    w = Window.partitionBy(*by).orderBy("line_no") if by else Window.orderBy("line_no")
    return lines.withColumn("diff", F.floor(F.coalesce(F.col(time_us) - F.lag(time_us).over(w), F.lit(0)) * F.lit(multiple)).cast("bigint"))


def schedule(gapped: DataFrame, shift: int = 1, by: list[str] | None = None) -> DataFrame:
    """offset_us of each line. With shift 1 a line waits for its predecessor's gap; negative gaps wait for nothing."""
    w = Window.partitionBy(*by).orderBy("line_no") if by else Window.orderBy("line_no")
    wait = F.greatest(F.col("diff"), F.lit(0))
    return gapped.withColumn("offset_us", F.coalesce(F.sum(wait).over(w.rowsBetween(Window.unboundedPreceding, -shift)), F.lit(0)).cast("bigint"))


def backfill(gapped: DataFrame, now_us: int, horizon_us: int, by: list[str] | None = None) -> DataFrame:
    """Events of a timeline walked backward and cyclically from now until the horizon is passed (one event lies beyond it): cycle, line_no, time_us.

    Closed form: the cycles needed follow from the sum of a timeline's gaps, so nothing is walked. A timeline without positive gaps gives none.
    """
    keys = by or []
    down = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.desc("line_no"))
    wait = F.greatest(F.col("diff"), F.lit(0))
    all_ = Window.partitionBy(*keys) if keys else Window.partitionBy()
    back = gapped.withColumn("w", wait).withColumn("upto", F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(all_)).where("total > 0")
    span = now_us - horizon_us
    cycles = back.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"{span} div total + 1"))))
    timed = cycles.withColumn("time_us", F.lit(now_us) - F.col("cycle") * F.col("total") - F.col("upto"))
    return timed.where(F.col("time_us") + F.col("w") >= horizon_us).drop("w", "upto", "total")
