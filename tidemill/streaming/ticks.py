"""A streaming source of intervals, and stanzas as streams.

The offset holds the next interval, the next ordinal and, for per-day volumes, the bytes carried on, so that a checkpoint resumes exactly. The driver
makes a row for each interval and no event; events are made by Spark from these rows.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import rate

FIELDS = "interval_no long, now long, t long, lt long, n long, first long"
EPOCH = datetime(1970, 1, 1)


class TickSource(DataSource):
    """format("tidemill_ticks"); options: start (epoch seconds, now if unset), step, count (events an interval, before rating), end (intervals in all, unlimited
    if unset), settings (a stanza's, as JSON: rate maps), skip (true: intervals missed in a stall are left out), volume (bytes an interval) and mean (of an event)."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_ticks"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema):  # noqa: N802
        return TickReader(self.options)


class Span(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class TickReader(DataSourceStreamReader):
    def __init__(self, options):
        self.start = int(options.get("start") or time.time())
        self.step, self.count = max(1, int(options.get("step", 1))), int(options.get("count", 1))
        self.end = int(options["end"]) if options.get("end") else None
        self.settings = json.loads(options.get("settings") or "{}")
        self.skip = options.get("skip") == "true"
        self.volume, self.mean = float(options.get("volume") or 0), float(options.get("mean") or 1)
        self.at = None

    def initialOffset(self):  # noqa: N802
        return {"interval": 0, "from": 0, "ordinal": 0, "carry": 0}

    def _due(self) -> int:
        due = max(0, int(time.time() - self.start) // self.step + 1)
        return due if self.end is None else min(due, self.end)

    def _number(self, k: int, carry: int) -> tuple[int, int]:
        """Events (or bytes, for a volume) of interval k, and what is carried on."""
        f = rate.factor_at(self.settings, EPOCH + timedelta(seconds=self.start + k * self.step))
        if not self.volume:
            return max(0, rate.half_even(self.count * f)), 0
        total = carry + int(self.volume * f + 0.5)
        return (0, total) if 0 < total < self.mean else (total, 0)

    def _walk(self, start: dict, first: int, upto: int):
        ordinal, carry, rows = start["ordinal"], start["carry"], []
        for k in range(first, upto):
            n, carry = self._number(k, carry)
            t = self.start + k * self.step
            rows.append((k, t, t, t + self.step, n, ordinal))
            ordinal += n
        return rows, {"interval": upto, "from": first, "ordinal": ordinal, "carry": carry}

    def latestOffset(self):  # noqa: N802
        """All intervals that are due; with skip, those missed but for the last are left out."""
        at = self.at or self.initialOffset()
        upto = max(self._due(), at["interval"])
        first = max(at["interval"], upto - 1) if self.skip and upto > at["interval"] else at["interval"]
        self.at = self._walk(at, first, upto)[1] if upto > at["interval"] else at
        return self.at

    def partitions(self, start, end):
        rows = self._walk(start, max(start["interval"], end["from"]), end["interval"])[0]
        return [Span(rows[i : i + 1000]) for i in range(0, len(rows), 1000)] or [Span([])]

    def read(self, partition):
        yield from partition.rows

    def commit(self, end):
        """After a restart the checkpoint's offset is the one to go on from."""
        if self.at is None or end["interval"] > self.at["interval"]:
            self.at = end


def intervals(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(TickSource)
    return spark.readStream.format("tidemill_ticks").options(**{k: str(v) for k, v in options.items()}).load()


def ticks(spark: SparkSession, **options) -> DataFrame:
    """interval_no, t, lt, i, ordinal: a row for each event."""
    from ..operators import spine

    return spine.events(intervals(spark, **options)).select("interval_no", "t", "lt", "i", "ordinal")


def stanza_stream(spark: SparkSession, s, start: int, seed: int = 7, **options) -> DataFrame:
    """A stanza's events as a stream, an interval at a time, its lines, tokens and metadata as in a batch. start: epoch seconds.

    Rate maps count; randomizeCount, replay and per-day volumes don't run here, nor do tokens that count their matches (seqfile, integerid) unless every line has them.
    """
    from ..plans import generate

    c = s.settings
    lines = generate.sample_of(s)
    for _, tok in generate._ranked(s.tokens):
        if lines.rows and not all(lines.flags(tok.token)):
            raise ValueError(f"{s.name}: {tok.replacementType} counts matches, which a stream can't do across its batches")
    count = int(float(c["count"]))
    maps = {k: c[k] for k in rate.MAPS if k in c}
    grid = intervals(spark, start=start, step=max(1, int(float(c["interval"]))), count=count if count != -1 else len(lines.rows) or 60, settings=json.dumps(maps), **options)
    if lines.order == "i" and generate._ranked(s.tokens):
        lines = generate.Lines(lines.rows, "ordinal")
    return generate.spine_events(spark, s, grid, lines, seed)
