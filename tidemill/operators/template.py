"""Precompiled lines: each sample line becomes literals and slots, so that an event is one concatenation without a pattern.

Tokens match the line as it is in the sample, so what one token writes is never matched by another; where that is wanted, templates are turned off.
Lines are grouped by the order of their slots; each such shape is one Column. A line whose tokens overlap keeps the token-by-token rewrite.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Line:
    literals: list[str]
    slots: list[int]  # token of each slot
    targets: list[str]  # what stands there


def spans(pattern: str, text: str) -> list[tuple[int, int]]:
    """Targets of a token: group 1 of each match if it took part, else the whole match."""
    out = []
    for m in re.finditer(pattern, text):
        out.append(m.span(1) if m.re.groups and m.start(1) >= 0 else m.span())
    return out


def compile_line(text: str, patterns: list[str]) -> Line | None:
    """None if two targets overlap."""
    found = sorted((a, b, n) for n, p in enumerate(patterns) for a, b in spans(p, text))
    literals, slots, targets, at = [], [], [], 0
    for a, b, n in found:
        if a < at:
            return None
        literals.append(text[at:a])
        slots.append(n)
        targets.append(text[a:b])
        at = b
    return Line([*literals, text[at:]], slots, targets)


FIELDS = "shape int, literals array<string>, targets array<string>"


def compile_lines(lines: list[str], patterns: list[str]) -> tuple[list[tuple[int, list[str], list[str]]], list[list[int]]]:
    """FIELDS of each line and the slots of each shape; shape -1: rewrite token by token."""
    shapes: dict[tuple[int, ...], int] = {}
    out = []
    for x in lines:
        line = compile_line(x, patterns)
        out.append((-1, [x], []) if line is None else (shapes.setdefault(tuple(line.slots), len(shapes)), line.literals, line.targets))
    return out, [list(s) for s in shapes]


def render(shapes: list[list[int]], values: list[Column], otherwise: Column | None = None) -> Column:
    """The event's text, of the columns FIELDS. A null value leaves its target as it was. otherwise: the text of lines of shape -1; None if there are none."""
    shape, literals, targets = F.col("shape"), F.col("literals"), F.col("targets")

    def one(slots: list[int]) -> Column:
        parts = [F.get(literals, F.lit(0))]
        for i, n in enumerate(slots):
            parts += [F.coalesce(values[n], F.get(targets, F.lit(i))), F.get(literals, F.lit(i + 1))]
        return F.concat(*parts)

    texts = [one(s) for s in shapes]
    if otherwise is None:
        otherwise = texts.pop()
    out = otherwise
    for n, text in reversed(list(enumerate(texts))):
        out = F.when(shape == n, text).otherwise(out)
    return out
