"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents inside a task. Its words are numbered by the benchmark's vocabulary; a word that the
benchmark lacks, and a pair of neighbours that follow each other nowhere in the benchmark, can be in no window, so they
end a run. The runs of a shard, with separators, form the text of its FM-index: suffix array by prefix doubling, BWT,
wavelet-tree ranks. All windows are searched backward together, occurrences are located by sampled suffix positions, and their
spans are merged.

Scale: one map pass over the documents, no shuffle; shards have a bounded size. The benchmark is read in blocks
of `block_words` words; each block is one more narrow pass that merges its spans with the earlier ones, so what a task holds is bounded.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cut, releasing
from .shared import ALNUM

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


class WaveletTree:
    """Rank over a sequence, levels of bits from the top (the nodes of a level lie side by side)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i, for each pair."""
        start = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(up, zeros + ones[i], i - ones[i])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """text: symbols > 0, each run followed by a 0. Separators sort by place, so suffixes never compare beyond their run."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        n = self.n = len(text)
        ends = text == 0
        rank = text.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(ends.sum())
        step = 1
        sa = np.argsort(rank, kind="stable")
        while True:
            dense = np.empty(n, np.int64)
            srt = rank[sa]
            dense[sa] = np.concatenate(([0], np.cumsum(srt[1:] != srt[:-1])))
            if dense[sa[-1]] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[:-step] = dense[step:] + 1
            rank = dense * (n + 1) + after
            sa = np.argsort(rank, kind="stable")
            step *= 2
        self.bwt = text[sa - 1].astype(np.int64)
        top = int(text.max())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.tree = WaveletTree(self.bwt, max(1, top.bit_length()))
        starts = np.concatenate(([True], ends[:-1]))
        kept = (np.arange(n) % sample == 0) | starts
        self.sampled = kept[sa]
        self.position = np.where(self.sampled, sa, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each pattern (rows of patterns, left-aligned)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        top = len(self.first) - 2
        for back in range(1, patterns.shape[1] + 1):
            step = alive[lengths[alive] >= back]
            if not len(step):
                break
            c = patterns[step, lengths[step] - back]
            there = c <= top
            hi[step[~there]] = lo[step[~there]] = 0
            step, c = step[there], c[there]
            lo[step] = self.first[c] + self.tree.rank(c, lo[step])
            hi[step] = self.first[c] + self.tree.rank(c, hi[step])
            alive = alive[hi[alive] > lo[alive]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        out, steps, open_ = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.sampled[r]
            out[open_[done]] = self.position[r[done]] + steps[open_[done]]
            open_, r = open_[~done], r[~done]
            c = self.bwt[r]
            rows[open_] = self.first[c] + self.tree.rank(c, r)
            steps[open_] += 1
        return out


def _null_last(x: str | None) -> tuple[bool, str]:
    return x is None, x or ""


@dataclass
class Windows:
    """The windows of a block of benchmark items."""

    vocab: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray  # window -> slice of owners
    owners: np.ndarray
    items: list[str | None]
    pairs: np.ndarray  # sorted codes of neighbours in windows

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], size: int) -> Windows:
        vocab: dict[bytes, int] = {}
        seen: dict[tuple, set[int]] = {}
        names = sorted({i for i, w in items if w}, key=_null_last)
        at = {x: i for i, x in enumerate(names)}
        for name, w in items:
            ids = [vocab.setdefault(x, len(vocab) + 1) for x in w]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                seen.setdefault(tuple(ids[i : i + size]), set()).add(at[name])
        keys = list(seen)
        lengths = np.array([len(k) for k in keys], np.int64)
        patterns = np.zeros((len(keys), size), np.int64)
        for i, k in enumerate(keys):
            patterns[i, : len(k)] = k
        owners = [sorted(seen[k]) for k in keys]
        base = len(vocab) + 1
        both = patterns[:, :-1] * base + patterns[:, 1:]
        pairs = np.unique(both[patterns[:, 1:] > 0])
        return cls(vocab, patterns, lengths, np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64), np.array([y for x in owners for y in x], np.int64), names, pairs)


def search_shard(tokens: np.ndarray, doc_of: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """tokens: vocabulary ids, 0 for others and between documents. A hit mask over tokens; distinct (doc, item) pairs."""
    hit, none = np.zeros(len(tokens), bool), np.zeros((0, 2), np.int64)
    if not len(w.lengths) or not len(tokens):
        return hit, none
    known = tokens > 0
    base = len(w.vocab) + 1
    joins = known[:-1] & known[1:]
    at = np.flatnonzero(joins)
    code = tokens[at].astype(np.int64) * base + tokens[at + 1]
    spot = np.searchsorted(w.pairs, code)
    joins[at] = (spot < len(w.pairs)) & (w.pairs[np.minimum(spot, max(0, len(w.pairs) - 1))] == code) if len(w.pairs) else False
    starts = np.flatnonzero(known & ~np.concatenate(([False], joins)))
    stops = np.flatnonzero(known & ~np.concatenate((joins, [False]))) + 1
    long = stops - starts >= w.lengths.min()
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return hit, none
    size = stops - starts
    where = np.concatenate(([0], np.cumsum(size + 1)))
    source = np.full(where[-1], -1, np.int64)
    inside = np.ones(where[-1], bool)
    inside[where[1:] - 1] = False
    source[inside] = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    text = np.where(inside, tokens[source], 0).astype(np.int64)
    index = FMIndex(text)
    lo, hi = index.search(w.patterns, w.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return hit, none
    n = (hi - lo)[found]
    which = np.repeat(found, n)
    rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    pos = index.locate(rows)
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + w.lengths[which], -1)
    covered = (np.cumsum(cover)[:-1] > 0) & inside
    hit[source[covered]] = True
    pair = np.unique(np.stack((doc_of[source[pos]], which), 1), axis=0)
    m = w.owner_at[pair[:, 1] + 1] - w.owner_at[pair[:, 1]]
    own = w.owners[np.repeat(w.owner_at[pair[:, 1]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())]
    return hit, np.unique(np.stack((np.repeat(pair[:, 0], m), own), 1), axis=0)


NEW = ("n_words", "n_hit", "items", "spans")
_types = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.list_(pa.int64()))}


def _merged(mask: np.ndarray, old: list) -> tuple[int, list[list[int]]]:
    for a, b in old or ():
        mask[a:b] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return int(mask.sum()), edge.reshape(-1, 2).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_words: int = 200_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), items (their ids as strings, sorted) and spans
    (merged [start, end) word places, to be removed).

    Columns of docs with these names are replaced. Null and wordless texts have no word; items without words have no window;
    repeated rows and items each count as they are. Items without an id are searched like others; in items they are together one null, the last, as in a SQL count of distinct ids. An empty benchmark or table gives no hit or no row.
    """
    source = docs.select(*[c for c in docs.columns if c not in NEW])
    out = source.selectExpr("*", "0L AS n_words", "0L AS n_hit", "CAST(array() AS array<string>) AS items", "CAST(array() AS array<array<bigint>>) AS spans")
    block, held = [], 0
    blocks = 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        w = words(row["t"])
        block.append((row["i"], w))
        held += len(w)
        if held >= block_words:
            out, block, held, blocks = _pass(out, Windows.of(block, size), text_col, shard_bytes), [], 0, blocks + 1
    return _pass(out, Windows.of(block, size), text_col, shard_bytes) if block or not blocks else out


def _pass(docs: DataFrame, w: Windows, text_col: str, shard_bytes: int) -> DataFrame:
    def run(batches):
        get = w.vocab.get

        def flush(held):
            ids, lens = [], []
            for b in held:
                for t in b.column(text_col).to_pylist():
                    got = words(t)
                    ids.extend([get(x, 0) for x in got])
                    ids.append(0)
                    lens.append(len(got))
            tokens = np.array(ids, np.int32)
            del ids
            ends = np.cumsum(np.array(lens, np.int64) + 1)
            doc_of = np.repeat(np.arange(len(lens), dtype=np.int32), np.array(lens, np.int64) + 1)
            hit, pairs = search_shard(tokens, doc_of, w)
            items: dict[int, list[str | None]] = {}
            for d, i in pairs.tolist():
                items.setdefault(d, []).append(w.items[i])
            d = 0
            for b in held:
                got = {k: [] for k in NEW}
                for old_items, old_spans in zip(b.column("items").to_pylist(), b.column("spans").to_pylist()):
                    end = int(ends[d])
                    mask = hit[end - 1 - lens[d] : end - 1]
                    n, spans = _merged(mask, old_spans) if old_spans or mask.any() else (0, [])
                    got["n_words"].append(lens[d])
                    got["n_hit"].append(n)
                    got["items"].append(sorted({*old_items, *items.get(d, ())}, key=_null_last))
                    got["spans"].append(spans)
                    d += 1
                yield pa.RecordBatch.from_arrays([pa.array(got[c], _types[c]) if c in got else b.column(c) for c in b.schema.names], names=b.schema.names)

        held, size = [], 0
        for b in cut(batches, text_col):
            held.append(b)
            size += b.column(text_col).nbytes
            if size >= shard_bytes:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(releasing(run), docs.schema)


def _window_hash(w: list[bytes], at: int, n: int) -> int:
    return xxhash.xxh64_intdigest(b" ".join(w[at : at + n]))


def remove_spans(scanned: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", size: int = 10) -> DataFrame:
    """The result of contamination() with its spans cut out of text_col and the four new columns dropped.

    A cut leaves one line break. Where the words on both sides of cuts form a window again, they are cut, too. Texts without spans stay as they are.
    A task holds 8 bytes for each window of the benchmark (a sorted array of 64-bit hashes).
    """
    sizes, hashed = set(), array("Q")
    for row in benchmark.select(F.col(item_text_col).alias("t")).toLocalIterator():
        w = words(row["t"])
        sizes |= {min(len(w), size)} - {0}
        hashed.extend(_window_hash(w, i, size) for i in range(max(1, len(w) - size + 1) if w else 0))
    known = np.unique(np.array(hashed, np.uint64))

    def clean(text, spans):
        while spans:
            places = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
            parts, at = [], 0
            for a, b in spans:
                parts.append(text[at : places[a][0]].rstrip())
                at = places[b - 1][1]
            parts.append(text[at:].lstrip())
            text = "\n".join(p for p in parts if p)
            w = words(text)
            mask = np.zeros(len(w), bool)
            for n in sizes:
                got = np.array([_window_hash(w, i, n) for i in range(len(w) - n + 1)], np.uint64)
                for i in np.flatnonzero(np.isin(got, known)).tolist():
                    mask[i : i + n] = True
            spans = _merged(mask, [])[1]
        return text

    keep = [c for c in scanned.columns if c not in NEW]

    def run(batches):
        for b in cut(batches, text_col):
            out = [clean(t, s) if s else t for t, s in zip(b.column(text_col).to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else b.column(c) for c in keep], names=keep)

    return scanned.mapInArrow(releasing(run), scanned.select(*keep).schema)
