"""Sample readers: raw lines, breakers, CSV, token files. Samples are read on the driver and become small DataFrames."""

from __future__ import annotations

import csv
import io
import os
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .conf import DEFAULTS

SCHEMA = "line_no long, raw string, size long, index string, host string, source string, sourcetype string, time_field string"


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def raw_lines(text: str) -> list[tuple[str, int]]:
    """Lines and their bytes with a newline; empty lines go, lines of blanks stay."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x]
    return [(x, len(x.encode()) + 1) for x in lines]


def broken(text: str, breaker: str) -> list[tuple[str, int]]:
    """Events from one match of breaker to the next. The default breaker and one that is no pattern read lines."""
    if breaker == DEFAULTS["breaker"]:
        return raw_lines(text)
    try:
        found = [m.start() for m in re.finditer(f"(?m){breaker}", text) if m.start()]
    except re.error:
        return raw_lines(text)
    cuts = [0, *found, len(text)]
    pieces = [text[a:b].rstrip("\r\n") for a, b in zip(cuts, cuts[1:])]
    return [(p, len(p.encode()) + 1) for p in pieces if p]


def csv_rows(text: str) -> list[dict[str, str]]:
    """Rows with _raw; a present empty cell stays empty; short rows go."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows or "_raw" not in rows[0]:
        raise ValueError("a CSV sample needs a column _raw")
    return [dict(zip(rows[0], r)) for r in rows[1:] if len(r) >= len(rows[0])]


def read(path: str | Path, sampletype: str = "raw", breaker: str = DEFAULTS["breaker"]) -> list[tuple]:
    out = rows_of(decode(Path(path).read_bytes()), sampletype, breaker)
    if not out:
        raise ValueError(f"{path}: no event")
    return out


def rows_of(text: str, sampletype: str = "raw", breaker: str = DEFAULTS["breaker"]) -> list[tuple]:
    """The rows (of SCHEMA) of a sample's text."""
    if sampletype == "csv":
        return [(i, r["_raw"], len(r["_raw"].encode()) + 1, *(r.get(k) for k in ("index", "host", "source", "sourcetype", "_time"))) for i, r in enumerate(csv_rows(text))]
    return [(i, x, n, None, None, None, None, None) for i, (x, n) in enumerate(broken(text, breaker))]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def line_rows(texts: DataFrame, text_col: str = "text", breaker: str = DEFAULTS["breaker"]) -> DataFrame:
    """texts without text_col, with line_no, raw and size: the events of each text, read as a sample file. For sample files that are themselves rows of a table.

    Null texts have no event.
    """
    keep = [c for c in texts.columns if c not in (text_col, "line_no", "raw", "size")]
    source = texts.select(*keep, text_col)

    def run(batches):
        for b in batches:
            rows = [broken(t, breaker) if t else [] for t in b.column(text_col).to_pylist()]
            at = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64())
            new = [pa.array([n for r in rows for n in range(len(r))], pa.int64()), pa.array([x for r in rows for x, _ in r], pa.string()), pa.array([n for r in rows for _, n in r], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], *new], names=[*keep, "line_no", "raw", "size"])

    return source.mapInArrow(run, StructType([*source.select(*keep).schema.fields, *StructType.fromDDL("line_no long, raw string, size long").fields]))


def resolve(path: str, *roots: Path) -> Path:
    """A file of tokens: backslashes as slashes, $NAME and NAME segments from the environment, under the working folder or else the first root that has it."""
    parts = []
    for part in path.replace("\\", "/").split("/"):
        name = part[1:] if part.startswith("$") else part if re.fullmatch("[A-Z_]+", part) else ""
        parts.append(os.environ.get(name, part) if name else part)
    found = Path("/".join(parts))
    places = [found] if found.is_absolute() else [Path.cwd() / found, *(r / found for r in roots)]
    return next((Path(os.path.normpath(p)) for p in places if p.is_file()), Path(os.path.normpath(places[-1])))


def token_lines(path: str | Path) -> list[str]:
    lines = [x.strip() for x in decode(Path(path).read_bytes()).splitlines()]
    if not any(lines):
        raise ValueError(f"{path}: empty")
    return lines
