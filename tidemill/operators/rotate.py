"""Rotation tables and rotated values as DataFrames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.identity import capacity, infer, kind_column, pass_identity, pass_value, upper_case, window_identity, window_value
from .template import spans


BLOCK = 4096  # first places of a block of ranks


def tables(values: DataFrame) -> DataFrame:
    """kind, value, k (first-seen rank within the format), d (how many values the format has), from (pos, value).

    The grouped minimum runs first, so the ranks are over distinct values. A format has few kinds and may have many values, so ranks are
    taken inside blocks of first places and added to the running counts of the blocks, of which a window sees one row each.
    """
    first = values.withColumn("kind", kind_column(F.col("value"))).where("kind <> 'none'").groupBy("kind", "value").agg(F.min("pos").alias("at"))
    placed = first.withColumn("block", F.floor(F.col("at") / BLOCK))
    inside = F.row_number().over(Window.partitionBy("kind", "block").orderBy("at", "value")) - 1
    order = Window.partitionBy("kind").orderBy("block")
    blocks = placed.groupBy("kind", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("kind", "block", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("kind")).alias("d"))
    return placed.withColumn("r", inside).join(blocks, ["kind", "block"]).select("kind", "value", (F.col("before") + F.col("r")).cast("bigint").alias("k"), F.col("d").cast("bigint").alias("d"))


def _cased(rotated: Column, value: Column, kind: Column) -> Column:
    """Upper-case hexadecimal values and identifiers get upper-case identities."""
    loud = (F.upper(value) == value) & (F.lower(value) != value) & ~kind.startswith("mixed(")
    return F.when(loud, F.upper(rotated)).otherwise(rotated)


def rotate_pass(events: DataFrame, table: DataFrame, lines: int, workers: int = 1, slot: int = 0, base: int = 0) -> DataFrame:
    """events (ordinal, value) with rotated: the identity of their pass over the sample. Distinct (value, pass) are computed once.

    Of `workers` that share a stream of identities each has a slot, from 0; base: the ordinal to go on from, rounded up to a whole pass.
    """
    start = -(-base // lines)
    keyed = events.withColumn("pass", F.expr(f"ordinal div {lines}") + start)
    ids = keyed.select("value", "pass").distinct().join(table, "value")
    ids = ids.withColumn("rotated", _cased(pass_value("kind", F.col("pass") * workers + slot, "k", "d"), F.col("value"), F.col("kind")))
    return keyed.join(ids.select("value", "pass", "rotated"), ["value", "pass"], "left").withColumn("rotated", F.coalesce("rotated", "value"))


def rotate_window(events: DataFrame, period: int) -> DataFrame:
    """events (epoch, value) with rotated: the same identity for a value within a clock window, in any stanza."""
    keyed = events.withColumn("window", F.expr(f"greatest(epoch, 0) div {max(1, period)}")).withColumn("kind", kind_column(F.col("value")))
    ids = keyed.select("value", "window", "kind").distinct().withColumn("rotated", _cased(window_value("kind", "value", "window"), F.col("value"), F.col("kind")))
    return keyed.join(ids.drop("kind"), ["value", "window"]).withColumn("rotated", F.coalesce("rotated", "value")).drop("kind")


def capacities(table: DataFrame) -> int:
    """How many passes a table of tables() lasts. A row for each kind comes to the driver."""
    return capacity({r["kind"]: r["d"] for r in table.groupBy("kind").agg(F.max("d").alias("d")).collect()})


def policy_kind(policy: str, value: str) -> str:
    """The format of a value's identities: its own for keep, same or an empty policy, else digits(N), hex(N) (1 to 48) or guid."""
    policy = policy.strip().lower()
    if policy in ("", "keep", "same"):
        return infer(value)
    m = re.fullmatch(r"(digits|hex)\((\d+)\)", policy)
    if policy == "guid" or m and 1 <= int(m[2]) <= 48:
        return policy
    raise ValueError(f"no rotation policy: {policy!r}")


def line_tables(lines: list[str], patterns: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, int]]:
    """(kind, value) -> (k, d): lines in file order, tokens in conf order, matches left to right. Samples are small."""
    seen: dict[str, dict[str, int]] = {}
    for line in lines:
        for pattern, policy in patterns:
            for a, b in spans(pattern, line):
                kind = policy_kind(policy, line[a:b])
                if kind != "none":
                    seen.setdefault(kind, {}).setdefault(line[a:b], len(seen.get(kind, {})))
    return {(kind, v): (k, len(vs)) for kind, vs in seen.items() for v, k in vs.items()}


def rewriter(pattern: str, policy: str, table: dict[tuple[str, str], tuple[int, int]], lines: int, window: int | None = None, workers: int = 1, slot: int = 0, base: int = 0):
    """A UDF (text, ordinal, epoch) that replaces each match by its own identity: by the pass over the sample, or, with window (seconds), by the clock window.

    A value that isn't in the table stays; upper-case values give upper-case identities. workers, slot and base as in rotate_pass.
    """
    start = -(-base // lines)

    def turned(value: str, turn: int) -> str:
        kind = policy_kind(policy, value)
        if kind == "none" or window is None and (kind, value) not in table:
            return value
        if window is None:
            k, d = table[kind, value]
            new = pass_identity(kind, turn, k, d, workers, slot)
        else:
            new = window_identity(kind, value, turn)
        return new.upper() if upper_case(value) and not kind.startswith("mixed(") else new

    def one(text: str, ordinal: int, epoch: int, seen: dict) -> str:
        parts, at = [], 0
        turn = ordinal // lines + start if window is None else max(epoch, 0) // window
        for a, b in spans(pattern, text):
            key = (text[a:b], turn)
            if key not in seen:
                seen[key] = turned(*key)
            parts += [text[at:a], seen[key]]
            at = b
        return "".join(parts) + text[at:]

    @F.pandas_udf(StringType())
    def rewrite(text: pd.Series, ordinal: pd.Series, epoch: pd.Series) -> pd.Series:
        seen: dict = {}  # of this batch
        return pd.Series([one(*x, seen) for x in zip(text, ordinal, epoch)], dtype=object)

    return rewrite
