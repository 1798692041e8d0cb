"""The spine of a generation plan: intervals, counts, events, line selection, event time.

Scale: intervals are few and their running sums are taken over them alone; events are made by two explodes, of chunks
and then of numbers, with a repartition between them, so that one large interval spreads over tasks. Ordinals are arithmetic, never a global row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timeexpr import stamp

CHUNK = 65536


def intervals(spark: SparkSession, start: int, until: int, step: int) -> DataFrame:
    """interval_no, t, lt (epoch seconds): a sweep from start to before until; the last interval ends at until."""
    step = max(1, step)
    n = max(0, -(-(until - start) // step))
    return spark.range(n).select(F.col("id").alias("interval_no"), (F.lit(start) + F.col("id") * step).alias("t"), F.least(F.lit(start) + (F.col("id") + 1) * step, F.lit(until)).cast("bigint").alias("lt"))


def with_offsets(counted: DataFrame, count: str = "n", name: str = "first") -> DataFrame:
    """first: the ordinal of each interval's first event, continuous across intervals. A window over intervals, which are few."""
    w = Window.orderBy("interval_no").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("bigint"))


def events(counted: DataFrame, count: str = "n", partitions: int | None = None) -> DataFrame:
    """A row for each event: the interval's columns, i (0 ...) and ordinal. Counts of 0 or less give none."""
    chunks = counted.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({count} - 1) div {CHUNK}"))))
    if partitions:
        chunks = chunks.repartition(partitions, "interval_no", "chunk")
    last = F.least(F.col(count) - 1, F.col("chunk") * CHUNK + CHUNK - 1)
    out = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    return out.withColumn("ordinal", F.col("first") + F.col("i")).drop("chunk")


def with_prefix(samples: DataFrame, size: str = "size") -> DataFrame:
    """prefix: bytes of a sample up to and with a line. Samples are small; for several samples partition by their id."""
    return samples.withColumn("prefix", F.sum(size).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def on_line(spine: DataFrame, samples: DataFrame, line: Column) -> DataFrame:
    """Joins each event with its line. Spark broadcasts the sample if it is below its own limit of bytes and deals both sides otherwise."""
    return spine.withColumn("line_no", line).join(samples, "line_no")


def sequential_time(i: str = "i") -> Column:
    """Microseconds: even steps from t towards lt, of the columns t, lt and n."""
    return F.col("t") * 1_000_000 + F.expr(f"((lt - t) * 1000000 * {i}) div n")


def windbag() -> Column:
    """The line of the windbag generator, of the columns t, lt, i and n."""
    return F.concat(stamp(sequential_time("(i + 1)")), F.lit(" -0700 WINDBAG Event "), (F.col("i") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string"))


#: Fixed value: the usual line of the counter generator.
COUNTER = "{event_ts}-0700 Counter for sample:{samplename}, Now processing event counting {loop_count} of {max_loop} cycles. Counter Values: Start_Count: {start_count} Current_Counter:{current_count} End_Count:{end_count} Counting_By: {count_by}"


def _number(c: Column) -> Column:
    """Without a fraction if there is none."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def counter(name: str, template: str = COUNTER, start: float = 0.0, end: float = 0.0, by: float = 1.0) -> Column:
    """The line of the counter generator, of the columns t, lt, i and n."""
    values = {
        "event_ts": stamp(sequential_time("(i + 1)")), "samplename": F.lit(name), "loop_count": F.col("i") + 1, "max_loop": F.col("n"), "start_count": _number(F.lit(start)),
        "current_count": _number(F.lit(start) + F.lit(by) * F.col("i")), "end_count": _number(F.lit(end)), "count_by": _number(F.lit(by)),
    }
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def match_rank(events: DataFrame, matched: Column, name: str = "r", block: int = 4096) -> DataFrame:
    """name: how many matching events come before, by ordinal (null where matched is false).

    No global sort: counts of blocks of ordinals, their running sums (a row for each block), and ranks inside blocks.
    """
    keyed = events.withColumn("_m", matched).withColumn("_block", F.expr(f"ordinal div {block}"))
    counts = keyed.where("_m").groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.sum(F.when(F.col("_m"), 1).otherwise(0)).over(Window.partitionBy("_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return keyed.withColumn("_r", inside).join(before, "_block", "left").withColumn(name, F.when(F.col("_m"), (F.col("_before") + F.col("_r")).cast("bigint"))).drop("_m", "_block", "_before", "_r")


def uniform_time(t: Column, lt: Column, d: Column) -> Column:
    """Whole seconds from t to lt, both possible."""
    return F.when(lt <= t, t).otherwise(t + F.pmod(d, lt - t + 1))


FILL = 131072  # bytes of a chunk of a random fill


def random_fill(wanted: DataFrame, samples: DataFrame, pick, lines: int, least: int, chunk: int = FILL) -> DataFrame:
    """Random lines for each row of wanted (interval_no, bytes, ...) until their bytes reach each chunk of `bytes`: fill_no, pick_no, line_no and both sides' columns.

    pick: (chunk number, pick number) -> a draw as a Column. least: bytes of the shortest line, so as many picks are drawn as can be needed and those past the
    chunk's end go. A chunk is one group of at most chunk / least rows.
    """
    n = F.expr(f"(bytes + {chunk} - 1) div {chunk}")
    chunks = wanted.where("bytes > 0").withColumn("fill_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    chunks = chunks.withColumn("fill_bytes", F.least(F.lit(chunk).cast("bigint"), F.col("bytes") - F.col("fill_no") * chunk))
    picks = chunks.withColumn("pick_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(fill_bytes - 1) div {max(1, least)}"))))
    chosen = on_line(picks, samples, F.pmod(pick(F.col("fill_no"), F.col("pick_no")), F.lit(lines)))
    w = Window.partitionBy("interval_no", "fill_no").orderBy("pick_no").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where("before < fill_bytes").drop("before")


def byte_fill(samples: DataFrame, budget: int) -> DataFrame:
    """Whole cycles of a sample and then its longest prefix within budget: cycle, line_no and the sample's columns."""
    sized = with_prefix(samples)
    total = sized.agg(F.max("prefix").alias("total"))
    cycles = sized.crossJoin(total).withColumn("whole", F.expr(f"{budget} div total")).withColumn("rest", F.expr(f"{budget} % total"))
    n = F.col("whole") + F.when(F.col("prefix") <= F.col("rest"), 1).otherwise(0)
    return cycles.where(n > 0).withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).drop("whole", "rest", "total")


def extend_indexes(text: str) -> list[str]:
    """a,b,p:3 gives a, b, p0, p1, p2; any bad item empties the list."""
    out: list[str] = []
    for item in text.split(","):
        name, colon, n = item.strip().partition(":")
        if colon and not n.strip().isdigit():
            return []
        out += [f"{name}{k}" for k in range(int(n))] if colon else [name]
    return out
