"""Output envelopes: agent lines, collector objects, XML events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_text(micros: Column, whole: bool) -> Column:
    """Seconds as an integer, or as the shortest decimal with at least one place."""
    seconds = F.floor(micros / 1_000_000).cast("string")
    if whole:
        return seconds
    rest = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(seconds, F.lit("."), F.regexp_replace(rest, "(?<=.)0+$", ""))


def agent_line(time: Column, host: Column, source: Column, sourcetype: Column, index: Column, event: Column) -> Column:
    """Nulls are kept."""
    return F.to_json(F.struct(time.alias("time"), host.alias("host"), source.alias("source"), sourcetype.alias("sourcetype"), index.alias("index"), event.alias("event")), {"ignoreNullFields": "false"})


def collector_object(time: Column, host: Column, source: Column, sourcetype: Column, index: Column, event: Column, override: dict | None = None, default: dict | None = None) -> Column:
    """Nulls are omitted; for each field override wins over the event's value, and that over default."""
    over, under = override or {}, default or {}
    pick = lambda name, c: F.coalesce(F.lit(over.get(name)), c, F.lit(under.get(name))).cast("string").alias(name)
    return F.to_json(F.struct(time.alias("time"), pick("host", host), pick("source", source), pick("sourcetype", sourcetype), pick("index", index), event.alias("event")))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_event(time: Column, index: Column, sourcetype: Column, source: Column, host: Column, event: Column) -> Column:
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), xml_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit(f"</{n}>"))
    return F.concat(F.lit("<event>"), tag("time", time), tag("index", index), tag("sourcetype", sourcetype), tag("source", source), tag("host", host), tag("data", event), F.lit("</event>"))
