"""Quality rules as a short-circuit cascade.

A rule rejects a text by one feature. Each rule's cost (seconds a text) and selectivity (share of texts it rejects) are
measured on a bounded sample, and the cascade applies them by rejections per cost: a text leaves at its first failed
rule and pays for no later one. The verdict doesn't depend on the order, so the sample decides speed alone.

Scale: one map pass, no shuffle; the sample is `sample_rows` texts of up to `sample_bytes`, both parameters.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, releasing, texts, with_fields

#: The symbols that count against a text.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def n_symbols(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def n_dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def n_lines(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.strip(SPACES))


def n_repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    if len(ids) == len(words):
        return 0
    code = w[:-2] * len(ids) + w[1:-1]
    if len(ids) > 1_000_000:
        code = np.unique(code, return_inverse=True)[1]
    code = code * len(ids) + w[2:]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    again = np.concatenate(([0, 0], (count[inverse] > 1).view(np.int8), [0, 0]))
    return int(np.count_nonzero(again[:-2] | again[1:-1] | again[2:]))


@lru_cache(maxsize=1)
def _cases() -> np.ndarray:
    """Code point -> 0, or 1 for a letter, or 2 for an upper-case letter."""
    return np.array([2 if c.isupper() and c.isalpha() else 1 if c.isalpha() else 0 for c in map(chr, range(0x110000))], np.uint8)


def upper_share(text: str) -> float:
    n = np.bincount(_cases()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3)
    return float(n[2] / max(1, n[1] + n[2]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[str, list[bytes]], bool]


def _mean_length(text: str, words: list[bytes]) -> bool:
    return bool(words) and not 1.5 * len(words) <= word_chars(text) <= 20 * len(words)


def _symbols(text: str, words: list[bytes]) -> bool:
    return 10 * n_symbols(text) > 3 * len(words)


def _shouting(text: str, words: list[bytes]) -> bool:
    return upper_share(text) > 0.6


def _dup_lines(text: str, words: list[bytes]) -> bool:
    n = n_lines(text)
    return n >= 4 and 2 * n_dup_lines(text) > n


def _short(text: str, words: list[bytes]) -> bool:
    return len(words) < 50


def _repeats(text: str, words: list[bytes]) -> bool:
    return 2 * n_repeat_words(words) > len(words)


RULES = (Rule("short", _short), Rule("mean_length", _mean_length), Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("dup_lines", _dup_lines), Rule("repeats", _repeats))


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float
    rejected: float


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 200, sample_bytes: int = 1 << 16) -> list[Measured]:
    """Cost and selectivity of each rule on at most sample_rows texts of at most sample_bytes bytes, cheapest rejection first.

    The driver holds sample_rows * sample_bytes (13 MB) at most. If no text is that short, the rules go by name.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    got = [r[0] for r in docs.select(text).where(F.octet_length("t") <= sample_bytes).limit(sample_rows).collect()]
    _cases()
    out = []
    for rule in rules:
        began, no = time.perf_counter(), 0
        for t in got:
            no += rule.rejects(t, t.encode("utf-8", "surrogatepass").split())
        n = max(1, len(got))
        out.append(Measured(rule.name, (time.perf_counter() - began) / n, no / n))
    return sorted(out, key=lambda m: (-(m.rejected + 1e-6) / max(m.cost, 1e-9), m.name))


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, order: list[Measured] | None = None, features: bool = False) -> DataFrame:
    """docs with rejected_by (the first rule that a text fails, null if none) and rules_run (how many rules it paid for).

    features: also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text. Columns of docs with these
    names are replaced. Null texts count as empty. An empty table gives an empty result. A rule that isn't in order runs last.
    """
    measured = order if order is not None else measure(docs, text_col, rules)
    place = {m.name: i for i, m in enumerate(measured)}
    ordered = sorted(rules, key=lambda r: place.get(r.name, len(place)))
    new = ["rejected_by", "rules_run", *(FEATURES if features else ())]
    source = docs.select(*[c for c in docs.columns if c not in new])

    def run(batches):
        for b in cut(batches, text_col):
            by, ran, rows = [], [], []
            for t in texts(b, text_col):
                words = t.encode("utf-8", "surrogatepass").split()
                name = None
                for n, rule in enumerate(ordered, 1):  # noqa: B007
                    if rule.rejects(t, words):
                        name = rule.name
                        break
                by.append(name)
                ran.append(n if ordered else 0)
                if features:
                    rows.append((len(words), word_chars(t), n_symbols(t), n_dup_lines(t), n_repeat_words(words)))
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))] if features else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(by, pa.string()), pa.array(ran, pa.int32()), *more], names=[*b.schema.names, *new])

    ddl = "rejected_by string, rules_run int" + "".join(f", {f} long" for f in FEATURES if features)
    return source.mapInArrow(releasing(run), with_fields(source.schema, ddl))
