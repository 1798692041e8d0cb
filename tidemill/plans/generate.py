"""From a conf to events: stanzas, intervals, rated counts, lines, event time, tokens, envelope.

Each stanza is one declarative plan; all of them are united by name. Nothing but sample and token files is held on the driver.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import rate, timeexpr, tokens
from ..functions.draw import below, draw, fast
from ..operators import replay, rotate, spine, template
from ..sources import conf, samples

log = logging.getLogger(__name__)
EPOCH = datetime(1970, 1, 1)
EVENTS = ("stanza", "interval_no", "i", "ordinal", "line_no", "time_us", "raw", "host", "source", "sourcetype", "index")


def seconds(t: datetime) -> int:
    return int((t - EPOCH).total_seconds())


def offset(text: str | None) -> int | None:
    m = re.fullmatch(r"\s*([+-]?)(\d+)([smhSMH]?)\s*", text or "")
    return int(m[1] + m[2]) * {"": 1, "s": 1, "m": 60, "h": 3600}[m[3].lower()] if m else None


def shift(low: str | None, high: str | None, d: Column) -> Column:
    """Whole seconds between two offsets, both possible; one alone is fixed, and a bad pair shifts nothing."""
    a, b = offset(low), offset(high)
    a, b = (b if a is None else a), (a if b is None else b)
    if a is None or a > b:
        return F.lit(0).cast("bigint")
    return F.lit(a) + below(d, b - a + 1)


def file_rows(spark: SparkSession, lines: list[str], columns: list[int | None]) -> DataFrame:
    """pos, and value_<column> for each 1-based column of a file's lines (None: the whole line); null beyond a line's end."""
    cells = [x.split(",") for x in lines]
    rows = [(i, *(x if c is None else (cells[i][c - 1].strip() if 1 <= c <= len(cells[i]) else None) for c in columns)) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "pos long" + "".join(f", value_{c or 0} string" for c in columns))


def with_file(df: DataFrame, rows: DataFrame, pos: Column) -> DataFrame:
    """df with the columns of the row at pos: one join for all columns of a file. Rows come from a file that the driver has read, so Spark sees their size."""
    return df.withColumn("pos", pos).join(rows, "pos", "left").drop("pos")


def _has_value(tok: conf.Token, root: Path) -> bool:
    """Whether value_of gives a Column."""
    if tok.replacementType in ("random", "rated"):
        return tokens.random_value(tok.replacement, 0, "", "", F.lit(0)) is not None
    if tok.replacementType in ("file", "mvfile", "seqfile"):
        return _file_lines(tok, root) is not None
    if tok.replacementType in ("timestamp", "replaytimestamp"):
        return timeexpr.has_conversion(tok.replacement)
    return tok.replacementType in ("static", "integerid")


def _file_of(tok: conf.Token) -> tuple[str, int | None]:
    """Path and 1-based column of a file replacement."""
    path, _, column = tok.replacement.rpartition(":") if re.search(r":\d+$", tok.replacement) else (tok.replacement, "", "")
    return path, int(column) if column else None


def _file_lines(tok: conf.Token, root: Path) -> list[str] | None:
    """The lines of a token's file; None if it can't be read or is empty."""
    try:
        return samples.token_lines(samples.resolve(_file_of(tok)[0], root))
    except (OSError, ValueError) as e:
        log.error("token %s: %s", tok.token, e)
        return None


@dataclass
class Lines:
    """A stanza's sample lines, and which of them event (i, ordinal) gets: "i", "ordinal" (continuous over intervals) or "draw"."""

    rows: list[tuple]
    order: str = "i"

    def flags(self, pattern: str) -> list[bool]:
        return [bool(template.spans(pattern, r[1])) for r in self.rows]


def _ranked(tokens_: list[conf.Token]) -> list[tuple[int, conf.Token]]:
    return [(n, t) for n, t in enumerate(tokens_) if t.replacementType in ("seqfile", "integerid")]


def _with_match_counts(spark: SparkSession, counted: DataFrame, s: conf.Stanza, lines: Lines) -> DataFrame:
    """first_<n>: matching events before an interval, for tokens that count them; arithmetic on whole cycles and a prefix count."""
    size = len(lines.rows)
    for n, tok in _ranked(s.tokens):
        if lines.order == "i" and size:
            prefix = list(accumulate(lines.flags(tok.token), initial=0))
            rows = spark.createDataFrame(list(enumerate(prefix[:-1])), f"_rest long, _part_{n} long")
            c = counted.withColumn("_rest", F.expr(f"n % {size}")).join(rows, "_rest", "left").withColumn(f"_m_{n}", F.expr(f"(n div {size}) * {prefix[-1]} + _part_{n}")).drop("_rest", f"_part_{n}")
            counted = spine.with_offsets(c, f"_m_{n}", f"first_{n}").drop(f"_m_{n}")
    return counted


def _rank(spark: SparkSession, df: DataFrame, n: int, tok: conf.Token, lines: Lines | None) -> tuple[DataFrame, Column]:
    """How many events that the token matches come before this one. Matches are those of the sample's line."""
    if lines is None or not lines.rows:
        return df, F.col("ordinal")
    flags = lines.flags(tok.token)
    if lines.order == "draw" or lines.order == "i" and f"first_{n}" not in df.columns:
        hit = spark.createDataFrame(list(enumerate(flags)), f"line_no long, _hit_{n} boolean")
        return spine.match_rank(df.join(hit, "line_no", "left"), F.col(f"_hit_{n}"), f"_rank_{n}").drop(f"_hit_{n}"), F.col(f"_rank_{n}")
    size, total = len(flags), sum(flags)
    rows = spark.createDataFrame(list(enumerate(list(accumulate(flags, initial=0))[:-1])), f"line_no long, _before_{n} long")
    cycle = f"first_{n} + (i div {size}) * {total}" if lines.order == "i" else f"(ordinal div {size}) * {total}"
    return df.join(rows, "line_no", "left"), F.expr(f"{cycle} + _before_{n}")


def value_of(spark: SparkSession, df: DataFrame, s: conf.Stanza, tok: conf.Token, n: int, seed: int, root: Path, lines: Lines | None = None) -> tuple[DataFrame, Column | None]:
    """df, with joined columns if the token needs some, and the token's value (None: the token changes nothing)."""
    kind, key = tok.replacementType, f"t{n}"
    at = lambda us: F.timestamp_micros((us + shift(tok.offsetMin, tok.offsetMax, draw(seed, s.name, key + "/shift", F.col("ordinal"))) * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    if kind == "static":
        return df, F.lit(tok.replacement)
    if kind in ("timestamp", "replaytimestamp"):
        if not timeexpr.has_conversion(tok.replacement):
            return df, None
        value = timeexpr.strftime(tok.replacement, at(F.col("time_us") if kind == "timestamp" else F.col("lt") * 1_000_000))
        return df, F.when(F.col("lt") >= F.col("t"), value)
    if kind in ("random", "rated"):
        spec = tok.replacement.strip()
        f = rate.factor(s.settings, F.timestamp_seconds("now"), ("hourOfDayRate", "dayOfWeekRate"))
        if kind == "rated" and (m := re.fullmatch(r"(?i)integer\[(-?\d+):(-?\d+)\]", spec)) and int(m[2]) >= int(m[1]):
            return df, tokens.rated_integer(int(m[1]), int(m[2]), f, seed, s.name, key, F.col("ordinal"))
        if kind == "rated" and (m := re.fullmatch(r"(?i)float\[(-?\d+(?:\.\d+)?):(-?\d+(?:\.\d+)?)\]", spec)):
            return df, tokens.rated_float(m[1], m[2], f, seed, s.name, key, F.col("ordinal"))
        return df, tokens.random_value(spec, seed, s.name, key, F.col("ordinal"))
    if kind in ("file", "mvfile", "seqfile"):
        (path, column), texts = _file_of(tok), _file_lines(tok, root)
        if texts is None:
            return df, None
        rows = file_rows(spark, texts, [column]).withColumnRenamed(f"value_{column or 0}", f"value_{key}")
        if kind == "seqfile":
            df, place = _rank(spark, df, n, tok, lines)
            pos = F.pmod(place, F.lit(len(texts)))
        else:
            pos = below(draw(seed, s.name, f"file/{path}" if column else key, F.col("ordinal")), len(texts))
        return with_file(df, rows, pos), F.col(f"value_{key}")
    if kind == "integerid":
        df, place = _rank(spark, df, n, tok, lines)
        start = tok.replacement.strip()
        return df, (F.lit(int(start) if re.fullmatch(r"[+-]?\d+", start) else 0) + place).cast("string")
    return df, None


def moment(text: str, now: datetime) -> int:
    return seconds(timeexpr.parse_time(text, now))


def executions_of(c: dict[str, str], now: datetime, executions: int) -> list[datetime]:
    """When a stanza fires: each interval from now + delay on, as often as end allows (a number of executions or a time; below 0 or unset: as often as asked for)."""
    step = max(1, int(float(c["interval"])))
    start = now + timedelta(seconds=int(float(c.get("delay") or 0)))
    end = (c.get("end") or "").strip()
    until = None
    if re.fullmatch(r"[+-]?\d{1,9}", end):
        executions = int(end) if int(end) >= 0 else executions
    elif end:
        until = timeexpr.parse_time(end, now)
    fires = [start + timedelta(seconds=k * step) for k in range(executions)]
    return [t for t in fires if until is None or t < until]


def clock(c: dict[str, str], now: datetime) -> datetime:
    """now in a stanza's time zone (+-HHMM; local: as it is)."""
    zone = (c.get("timezone") or "local").strip()
    if re.fullmatch(r"[+-]?\d+", zone):
        hours, minutes = divmod(abs(int(zone)), 100)
        return now + timedelta(seconds=(hours * 3600 + minutes * 60) * (-1 if int(zone) < 0 else 1))
    return now


def grid_of(spark: SparkSession, s: conf.Stanza, now: datetime, executions: int = 1) -> DataFrame:
    """interval_no, now, t, lt (epoch seconds) of a stanza: its backfill sweep, which counts as one execution, and then the live ones."""
    c = s.settings
    now = clock(c, now)
    step = max(1, int(float(c["interval"])))
    sweep = None
    live = executions_of(c, now, executions)
    if c.get("backfill") and live:
        until = timeexpr.parse_time(c["backfillEnd"], now) if c.get("backfillEnd") else now
        g = spine.intervals(spark, moment(c["backfill"], now), seconds(until), step)
        sweep = g.select("interval_no", F.col("t").alias("now"), "t", "lt")
        live = [] if conf.truthy(c.get("backfillOnly")) else live[1:]
    first = max(0, -(-(seconds(until) - moment(c["backfill"], now)) // step)) if sweep is not None else 0
    rows = [(first + k, seconds(at), moment(c["earliest"], at), moment(c["latest"], at)) for k, at in enumerate(live)]
    grid = spark.createDataFrame(rows, "interval_no long, now long, t long, lt long")
    return grid if sweep is None else sweep.unionByName(grid) if rows else sweep


def counted_grid(grid: DataFrame, s: conf.Stanza, size: int, seed: int = 7) -> DataFrame:
    """grid with n, the events of each interval: rated, jittered, rounded half to even."""
    c = s.settings
    count = int(float(c["count"]))
    if conf.truthy(c.get("bundlelines")) and size:
        return grid.withColumn("n", F.lit((1 if count == -1 else max(0, count)) * size).cast("bigint"))
    f = rate.factor(c, F.timestamp_seconds("now"))
    if float(c.get("randomizeCount") or 0) > 0:
        f = f * rate.jitter(float(c["randomizeCount"]), draw(seed, s.name, "count", F.col("interval_no")))
    return grid.withColumn("n", rate.rated_count(F.lit(count if count != -1 else size or 60), f))


def sample_of(s: conf.Stanza) -> Lines:
    """A stanza's lines (none for the synthetic generators) and their order."""
    c = s.settings
    if c["generator"] in ("windbag", "counter"):
        return Lines([], "ordinal")
    turning = any(x.replacementType == "rotate" for x in s.tokens) and c.get("rotate.scope") != "window"
    order = "draw" if conf.truthy(c.get("randomizeEvents")) else "i" if conf.truthy(c.get("bundlelines")) or not turning else "ordinal"
    return Lines(samples.read(s.path, c["sampletype"], c["breaker"]), order)


def stanza_events(spark: SparkSession, s: conf.Stanza, now: datetime, executions: int = 1, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """The events of a stanza: its backfill sweep and executions from now on."""
    c = s.settings
    if c["generator"] == "replay":
        return replay_events(spark, s, now, seed)
    lines, grid = sample_of(s), grid_of(spark, s, now, executions)
    if c["generator"] == "perdayvolume":
        f = rate.factor(c, F.timestamp_seconds("now"))
        if float(c.get("randomizeCount") or 0) > 0:
            f = f * rate.jitter(float(c["randomizeCount"]), draw(seed, s.name, "count", F.col("interval_no")))
        return volume_events(spark, s, grid, lines, f, seed)
    counted = spine.with_offsets(_with_match_counts(spark, counted_grid(grid, s, len(lines.rows), seed), s, lines))
    return spine_events(spark, s, counted, lines, seed, partitions)


def spine_events(spark: SparkSession, s: conf.Stanza, counted: DataFrame, lines: Lines, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """Events of counted intervals (interval_no, now, t, lt, n, first), which may be a stream."""
    c = s.settings
    e = spine.events(counted, partitions=partitions)
    if conf.truthy(c.get("sequentialTimestamp")):
        e = e.withColumn("time_us", spine.sequential_time())
    else:
        e = e.withColumn("time_us", spine.uniform_time(F.col("t"), F.col("lt"), draw(seed, s.name, "time", F.col("ordinal"))) * 1_000_000)
    if not lines.rows:
        line = spine.windbag() if c["generator"] == "windbag" else spine.counter(s.name, c.get("count_template") or spine.COUNTER, *(float(c.get(k) or d) for k, d in (("start_count", 0), ("end_count", 0), ("count_by", 1))))
        e = e.withColumn("raw", line).withColumn("line_no", F.lit(0).cast("bigint")).withColumn("time_us", F.col("now") * 1_000_000)
        e = e.select("*", *[F.lit(None).cast("string").alias(k) for k in META])
        return finish(spark, e, s, seed, None, None)
    size, frame, templated, whole = len(lines.rows), samples.frame(spark, lines.rows), None, False
    line = {"draw": below(draw(seed, s.name, "line", F.col("ordinal")), size), "i": F.pmod("i", F.lit(size)), "ordinal": F.pmod("ordinal", F.lit(size))}[lines.order]
    if conf.truthy(c.get("templates", "true")) and s.tokens:
        # tokens of a known kind; a bad spec gives no value, found out when values are built
        usable = [t.token for t in s.tokens if _has_value(t, _root(s))]
        compiled, templated = template.compile_lines([x[1] for x in lines.rows], usable)
        frame = spark.createDataFrame([(*row, *x) for row, x in zip(lines.rows, compiled)], f"{samples.SCHEMA}, {template.FIELDS}")
        whole = all(shape >= 0 for shape, _, _ in compiled)
    return finish(spark, spine.on_line(e, frame, line), s, seed, lines, templated, whole)


META = ("index", "host", "source", "sourcetype")
BATCH = 512  # events that share an index of extendIndexes


def base_time(text: str, toks: list[conf.Token], now: datetime) -> int | None:
    """Microseconds of the first timestamp token that matches and parses; the year 1900 becomes the current one."""
    for tok in toks:
        if tok.replacementType not in ("timestamp", "replaytimestamp"):
            continue
        for a, b in template.spans(tok.token, text)[:1]:
            if tok.replacement == "%s" and text[a:b].isdigit() and b - a >= 10:
                return int(text[a:b]) * 10 ** (16 - (b - a)) if b - a <= 16 else None
            t = timeexpr.scan_time(text[a:b], tok.replacement) or timeexpr.scan_time(re.sub(r"[+-]\d{4}$", "", text[a:b]), tok.replacement)
            if t is None:
                continue
            t = t.replace(year=now.year) if t.year == 1900 else t
            return round((t - EPOCH) / timedelta(microseconds=1))
    return None


def finish(spark: SparkSession, e: DataFrame, s: conf.Stanza, seed: int, lines: Lines | None = None, templated: list[list[int]] | None = None, whole: bool = False) -> DataFrame:
    """Metadata, tokens and the schema of events for rows with raw, now, t, lt, time_us, ordinal, i, interval_no and line_no."""
    c = s.settings
    for k in META:
        e = e.withColumn(k, F.coalesce(F.col(k), F.lit(c.get(k))))
    extra = spine.extend_indexes(c["extendIndexes"]) if c.get("extendIndexes") and c["generator"] != "replay" else []
    if extra:
        batch = F.concat_ws("/", F.col("interval_no").cast("string"), F.expr(f"i div {BATCH}").cast("string"))
        names = F.array(*map(F.lit, extra))
        e = e.withColumn("index", F.element_at(names, (below(draw(seed, s.name, "index", batch), len(extra)) + 1).cast("int")))
    e, values = _values(spark, e, s, seed, lines)
    e = e.withColumn("raw", _rendered(s, values, templated, whole))
    if s.host_token:
        e, value = value_of(spark, e, s, s.host_token, 999, seed, _root(s))
        if value is not None:
            e = e.withColumn("host", tokens.rewrite(F.col("host"), s.host_token.token, value))
    return e.withColumn("stanza", F.lit(s.name)).select(*EVENTS)


def _root(s: conf.Stanza) -> Path:
    return s.path.parent.parent if s.path else Path(".")


def replay_events(spark: SparkSession, s: conf.Stanza, now: datetime, seed: int = 7) -> DataFrame:
    """The recorded lines at their recorded pace from now on (`end` passes); lines without a time go."""
    lines = samples.read(s.path, s.settings["sampletype"], s.settings["breaker"])
    timed = [(*row, at) for row in lines if (at := base_time(row[1], s.tokens, now)) is not None]
    if not timed:
        raise ValueError(f"{s.path}: no line has a time")
    df = spark.createDataFrame(timed, samples.SCHEMA + ", base_us long")
    gapped = replay.gaps(df, multiple=float(s.settings["timeMultiple"]))
    e = replay.schedule(gapped)
    passes = max(1, int(s.settings.get("end") or 1))
    length = e.agg(F.max("offset_us")).first()[0]
    e = e.withColumn("interval_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(passes - 1).cast("bigint"))))
    e = e.withColumn("time_us", F.lit(seconds(now) * 1_000_000) + F.col("interval_no") * (length + 1_000_000) + F.col("offset_us")).drop("diff", "offset_us")
    e = e.withColumn("ordinal", F.col("interval_no") * len(timed) + F.col("line_no"))
    if s.settings.get("backfill"):
        horizon = moment(s.settings["backfill"], now) * 1_000_000
        if horizon < seconds(now) * 1_000_000:
            # ordinals run backward from -1, so that recorded passes follow the oldest event on
            back = replay.backfill(gapped, seconds(now) * 1_000_000, horizon)
            back = back.withColumn("interval_no", -F.col("cycle") - 1).withColumn("ordinal", F.col("interval_no") * len(timed) + F.col("line_no"))
            e = e.unionByName(back.drop("cycle", "diff"))
    second = F.floor(F.col("time_us") / 1_000_000)
    e = e.withColumn("i", F.col("line_no")).withColumn("t", second).withColumn("lt", second).withColumn("now", second)
    return finish(spark, e, s, seed)


def size_ratio(spark: SparkSession, s: conf.Stanza, lines: Lines, seed: int = 7) -> float:
    """Bytes of the sample's lines before and after their tokens are replaced once, newlines included."""
    frame = samples.frame(spark, lines.rows).select("*", *[F.lit(0).cast("bigint").alias(k) for k in ("now", "t", "lt", "time_us", "interval_no")], F.col("line_no").alias("i"), F.col("line_no").alias("ordinal"))
    after = finish(spark, frame, s, seed).agg(F.sum(F.octet_length("raw") + 1).alias("n")).first()["n"]
    return sum(r[2] for r in lines.rows) / after if after else 1.0


def volume_events(spark: SparkSession, s: conf.Stanza, grid: DataFrame, sample: Lines, factor: Column, seed: int = 7) -> DataFrame:
    """As many bytes an interval as perDayVolume (GB) asks for; less than a mean event is carried on. The bytes are scaled by what tokens add to a line.

    Lines: whole cycles of the sample and its longest prefix; with bundlelines whole copies; with randomizeEvents random lines until each chunk is full.
    """
    lines, c = sample.rows, s.settings
    wanted = F.floor(F.lit(rate.per_interval_bytes(float(c["perDayVolume"]), int(float(c["interval"])))) * factor + 0.5).cast("bigint")
    total = sum(r[2] for r in lines)
    ordered = grid.withColumn("x", wanted).agg(F.sort_array(F.collect_list(F.struct("interval_no", "now", "t", "lt", "x"))).alias("a"))
    got = ordered.select(F.explode(F.arrays_zip(F.col("a").alias("g"), rate.carried(F.col("a.x"), total / len(lines)).alias("b"))).alias("r"))
    got = got.select("r.g.interval_no", "r.g.now", "r.g.t", "r.g.lt", F.floor(F.col("r.b") * F.lit(size_ratio(spark, s, sample, seed))).cast("bigint").alias("bytes"))
    at = spine.uniform_time(F.col("t"), F.col("lt"), draw(seed, s.name, "time", F.col("ordinal"))) * 1_000_000
    if conf.truthy(c.get("randomizeEvents")):
        least = min(r[2] for r in lines)
        pick = lambda fill, no: draw(seed, s.name, "fill", F.concat_ws("/", F.col("interval_no").cast("string"), fill.cast("string"), no.cast("string")))
        # an ordinal names an event; a chunk has at most FILL / least of them
        width = spine.FILL // least + 1
        first = spine.with_offsets(got.withColumn("n", F.expr(f"((bytes + {spine.FILL} - 1) div {spine.FILL}) * {width}")))
        e = spine.random_fill(first, samples.frame(spark, lines), pick, len(lines), least)
        e = e.withColumn("i", F.col("fill_no") * width + F.col("pick_no")).withColumn("ordinal", F.col("first") + F.col("i"))
        return finish(spark, e.withColumn("time_us", at), s, seed, Lines(lines, "draw"))
    if conf.truthy(c.get("bundlelines")):
        n = F.when(F.col("bytes") > 0, (F.expr(f"bytes div {total}") + 1) * len(lines)).otherwise(0)
    else:
        prefix = list(accumulate(r[2] for r in lines))
        steps = spark.createDataFrame([(prefix,)], "steps array<long>").select(F.col("steps"))
        got = got.crossJoin(steps)  # one row: the sums of the sample's sizes
        part = F.size(F.filter("steps", lambda p: p <= F.expr(f"bytes % {total}")))
        n = F.when(F.col("bytes") >= lines[0][2], F.expr(f"bytes div {total}") * len(lines) + part).otherwise(0)
    counted = got.withColumn("n", n.cast("bigint")).drop("steps")
    e = spine.events(spine.with_offsets(_with_match_counts(spark, counted, s, Lines(lines, "i")))).withColumn("time_us", at)
    return finish(spark, spine.on_line(e, samples.frame(spark, lines), F.pmod(F.col("i"), F.lit(len(lines)))), s, seed, Lines(lines, "i"))


def _values(spark: SparkSession, e: DataFrame, s: conf.Stanza, seed: int, lines: Lines | None = None) -> tuple[DataFrame, list[Column | None]]:
    values = []
    for at, tok in enumerate(s.tokens):
        e, value = value_of(spark, e, s, tok, at, seed, _root(s), lines)
        values.append(value)
    return e, values


def _rendered(s: conf.Stanza, values: list[Column | None], shapes: list[list[int]] | None, whole: bool = False) -> Column:
    """Token by token, or from templates where the line has one; whole: every line has one."""
    text = F.col("raw")
    turning = [(tok.token, tok.replacement) for tok in s.tokens if tok.replacementType == "rotate"]
    if turning:
        shapes = None  # each match has a value of its own
        window = int(s.settings.get("rotate.period", 60)) if s.settings.get("rotate.scope") == "window" else None
        lines = [r[1] for r in samples.read(s.path, s.settings["sampletype"], s.settings["breaker"])]
        table = rotate.line_tables(lines, turning)
    for tok, value in zip(s.tokens, values):
        if tok.replacementType == "rotate":
            fleet = [int(float(s.settings.get(f"rotate.{k}") or d)) for k, d in (("workers", 1), ("slot", 0), ("base", 0))]
            text = rotate.rewriter(tok.token, tok.replacement, table, len(lines), window, max(1, fleet[0]), min(max(0, fleet[1]), max(1, fleet[0]) - 1), fleet[2])(text, F.col("ordinal"), F.floor(F.col("time_us") / 1_000_000))
        elif value is not None:
            text = tokens.rewrite(text, tok.token, value)
    if shapes is None:
        return text
    return template.render(shapes, [v for v in values if v is not None], None if whole and shapes else text)


def generate(spark: SparkSession, path: str, now: datetime, executions: int = 1, seed: int = 7, only: str | None = None, overrides: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """The events of all stanzas of a conf file or app folder. Draws are by xxhash64."""
    stanzas = conf.load(path, only, overrides)
    if not stanzas:
        raise ValueError(f"{path}: nothing to run")
    with fast():
        return reduce(DataFrame.unionByName, [stanza_events(spark, s, now, executions, seed, partitions) for s in stanzas])


def observed(events: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """events, and what a run over them counts: events, bytes, intervals. Read it with .get after the run."""
    seen = Observation(name)
    return events.observe(seen, F.count("*").alias("events"), F.sum(F.octet_length("raw")).alias("bytes"), F.max("interval_no").alias("last_interval")), seen


def validate(path: str) -> list[str]:
    """What would run: a line of JSON for each stanza, with how often each token matches the sample's first line."""
    out = []
    for s in conf.load(path):
        lines = samples.raw_lines(samples.decode(s.path.read_bytes())) if s.path else []
        first = lines[0][0] if lines else ""
        tokens_ = [{"token": t.token, "replacementType": t.replacementType, "matches": len(template.spans(t.token, first))} for t in s.tokens]
        out.append(json.dumps({"stanza": s.stanza, "file": s.name, "generator": s.settings["generator"], "outputMode": s.settings["outputMode"], "lines": len(lines), "tokens": tokens_}))
    return out
