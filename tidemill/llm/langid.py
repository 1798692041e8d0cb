"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector. A letter trigram's vector binds (multiplies) the three letters' vectors,
permuted (rotated) by position; a text bundles (adds) its trigrams; a language's prototype bundles its
training texts. A document gets the language whose prototype has the largest cosine with its vector.

Scale: two passes of map tasks over the texts. Training sends one vector a task and language to a grouped sum; the
driver gets one row for each (language, dimension), however many documents there are: 8 KB a language there and in each
task. A training task counts the trigrams of the language it holds most of before it multiplies them out; one table of
counts (16 MB) serves all languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, releasing, with_fields

SYMBOLS = 128  # 0: anything but letters; 1-26: a-z; the rest: other letters, hashed
CACHED = 1 << 15  # trigram vectors a worker keeps (one byte a dimension)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> symbol."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of a text's letters, each run of other characters being one blank. No letter: none."""
    s = letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))].astype(np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)


class Vectors:
    """Trigram vectors, made when first asked for."""

    def __init__(self, dims: int, seed: int):
        r = np.random.default_rng(seed)
        base = r.choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))
        self.first, self.second, self.third = np.roll(base, 2, 1), np.roll(base, 1, 1), base
        self.place = np.full(SYMBOLS**3, -1, np.int32)
        self.kept = np.empty((CACHED, dims), np.int8)
        self.n = 0

    def make(self, codes: np.ndarray) -> np.ndarray:
        return self.first[codes // SYMBOLS**2] * self.second[codes // SYMBOLS % SYMBOLS] * self.third[codes % SYMBOLS]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """codes are distinct."""
        new = codes[self.place[codes] < 0]
        if self.n + len(new) > CACHED:
            return self.make(codes)
        if len(new):
            self.kept[self.n : self.n + len(new)] = self.make(new)
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.kept[self.place[codes]]


@lru_cache(maxsize=1)
def vectors(dims: int, seed: int) -> Vectors:
    return Vectors(dims, seed)


@dataclass
class Profiles:
    languages: list[str]
    matrix: np.ndarray  # a row of length 1 for each language
    dims: int
    seed: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 11, waiting_codes: int = 8_000_000) -> Profiles:
    """Prototypes of the non-null languages of docs. Rows without text, letters or language teach nothing.

    Repeated rows teach once each. An empty table gives no language. Other columns of docs, whatever their names, are not read.
    waiting_codes: trigrams a task holds, of four bytes each, before it bundles those of the language with most; the result is the same.
    """

    def bundle(batches):
        v = vectors(dims, seed)
        totals: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def merge(lang):
            c = np.bincount(np.concatenate(waiting.pop(lang)), minlength=SYMBOLS**3)
            seen = np.flatnonzero(c)
            total = totals.setdefault(lang, np.zeros(dims))
            for at in range(0, len(seen), 4096):
                part = seen[at : at + 4096]
                total += c[part].astype(np.float64) @ v.make(part)
            del held[lang]

        for b in cut(batches, "text", max_bytes=1 << 20):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                codes = trigrams(text)
                waiting.setdefault(lang, []).append(codes)
                held[lang] = held.get(lang, 0) + len(codes) + 16
            while sum(held.values()) > waiting_codes:
                merge(max(held, key=held.get))
        for lang in list(waiting):
            merge(lang)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [total]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(releasing(bundle, vectors), "lang string, v array<double>").selectExpr("lang", "posexplode(v) AS (i, x)").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sums.toArrow()
    langs = sorted(pc.unique(got["lang"]).to_pylist())
    matrix = np.zeros((len(langs), dims))
    row = pc.index_in(got["lang"], pa.array(langs, pa.string())).to_numpy()
    matrix[row, got["i"].to_numpy()] = got["x"].to_numpy()
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    keep = norm[:, 0] > 0
    return Profiles([x for x, k in zip(langs, keep) if k], (matrix[keep] / norm[keep]).astype(np.float32), dims, seed)


BANDS = 32  # of a text's length, by powers of two


def band(text_col: str = "text"):
    return F.floor(F.log2(F.char_length(text_col) + F.lit(1))).cast("int")


def floors(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang_pred, band, floor) from a result of predict(): the least score of each predicted language's texts of a band of lengths.

    A band without texts has the floor of the next shorter one with texts, the shortest ones 0. A row for each language and band, at most.
    """
    least = {(r[0], r[1]): r[2] for r in labelled.groupBy("lang_pred", band(text_col).alias("band")).agg(F.min("score").alias("floor")).collect()}
    rows = []
    for lang in sorted({x for x, _ in least}):
        at = 0.0
        for b in range(BANDS):
            at = least.get((lang, b), at)
            rows.append((lang, b, at))
    return labelled.sparkSession.createDataFrame(rows, "lang_pred string, band int, floor double")


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least).

    Columns of docs with these two names are replaced. und and 0 for null texts, texts without a letter, and if
    nothing was learned. Ties go to the first language in sorted order.
    """
    p = profiles
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*keep)

    def label(batches):
        v = vectors(p.dims, p.seed)
        for b in cut(batches, text_col):
            names, scores = [], []
            for text in b.column(text_col).to_pylist():
                codes = trigrams(text) if text else ()
                if not len(codes) or not p.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                u, c = np.unique(codes, return_counts=True)
                x = np.zeros(p.dims, np.float32)
                for at in range(0, len(u), 4096):
                    x += c[at : at + 4096].astype(np.float32) @ v.of(u[at : at + 4096]).astype(np.float32)
                cos = p.matrix @ x / max(float(np.linalg.norm(x)), 1e-9)
                best = int(np.argmax(cos))
                names.append(p.languages[best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return source.mapInArrow(releasing(label, vectors), with_fields(source.schema, "lang_pred string, score double"))
