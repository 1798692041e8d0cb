"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, updated by whole-word pairs.

q(w | h) = P(class of w | h) P(w | class). Every token has a class: the most frequent words one each, other words one by a hash of their
ending, the end of a text one. P(class | h) is a softmax over the summed weights of hashed features: the previous word's bucket, the class of
the word before it (a skip feature), their combination (an n-gram feature) and a bias; its weights are trained by gradient updates that tasks compute.
P(w | class) is the word's smoothed frequency. The word-level n-gram features are pairs (g, w) of a context and a whole word: their weight
log(1 + n(g, w) / (a q)), with a = LEAST + n(g), is the posterior one under q, and the normaliser is 1 + n(g) / a, so that
P(w | h) = (n(g, w) + a q(w | h)) / (n(g) + a) sums to one. g is the previous word if it is one of the `known` most frequent ones, else one of BUCKETS hashes.

Scale: three map passes over the texts, in numpy, without a Python object for a word. What is gathered grows with the corpus: a count for
each distinct word and each distinct pair. A task holds and broadcasts only what has a fixed bound: the known words, the counts of contexts, the pairs
that are one in 2^PAIR_SHARE of all tokens (so 2^PAIR_SHARE at most). Words and pairs are dealt by hashed shards into
as many parts as the tokens need; a scoring task sends each part the tokens it has to look up and gets back what they add to their texts. No part is hot: known words are looked up where they
stand, their pairs are dealt by the pair, the frequent pairs aren't dealt, and any other word is rare. The class counts that the gradient
passes read have a fixed number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut, releasing
from .hashing import mix, words
from .shared import dropped, stored

TOPS = 48  # words with a class of their own
CLASSES = 128  # 0: the end; 1..TOPS; the rest by ending
ENDINGS = CLASSES - 1 - TOPS
PREV = 256  # buckets of the previous word: 0 the start, 1..127 frequent words, the rest by ending
OWN = 127
COMBINED = 2048
FEATURES = 1 + PREV + CLASSES + COMBINED
CELLS = PREV * CLASSES * CLASSES
END = 0  # its class; as a context the buckets and classes before a text are 0
BUCKETS = 1 << 18  # contexts of words that aren't known
LEAST = 1.0  # tokens that q counts for in a context that was never seen
PAIR_SHARE = 19  # a pair is frequent if it is one in 2^19 of all tokens
GRADIENTS = 12  # shards of the class counts
PART_TOKENS = 3_000_000  # tokens for a part of the word and pair tables
CHUNK_TOKENS = 600_000  # tokens that a scoring task handles at once (training: twice as many, counting words: five times)

#: Kinds of blobs.
WORDS, PAIRS, KNOWN, RARE, TEXTS, ADDED = range(6)
BLOB = "to long, part int, kind int, n long, data binary"


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' keys, their last seven bits replaced by the ending's number; words of each text."""
    keys, ending, n = words(column)
    return keys & np.uint64(M64 ^ 127) | (ending % np.uint32(ENDINGS)).astype(np.uint64), n


M64 = (1 << 64) - 1
END_KEY = np.uint64(0xFFFFFFFFFFFFFF7F)  # no ending has the number 127


def context_features() -> np.ndarray:
    """The features of each context (previous bucket * CLASSES + class before it)."""
    c = np.arange(PREV * CLASSES, dtype=np.int64)
    prev, skip = c // CLASSES, c % CLASSES
    both = (prev * 40503 + skip * 2654435761) % 4294967296 % COMBINED
    return np.stack((np.zeros_like(c), 1 + prev, 1 + PREV + skip, 1 + PREV + CLASSES + both), 1)


def log_probabilities(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    z = weights[context_features()[contexts]].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Known:
    """The known words by key, their rank by frequency."""

    keys: np.ndarray
    rank: np.ndarray

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """-1: not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == keys, self.rank[i], -1).astype(np.int32)


@dataclass
class Tokens:
    """The tokens of a chunk of texts: text, key, rank, class, context of the class model, and context g of the pairs."""

    doc: np.ndarray
    key: np.ndarray
    rank: np.ndarray
    cls: np.ndarray
    ctx: np.ndarray
    g: np.ndarray

    def pairs(self) -> np.ndarray:
        """A 64-bit hash for each pair (g, word)."""
        return mix(mix(self.g.astype(np.uint64) + np.uint64(1)) ^ self.key)

    def shards(self, pair: np.ndarray) -> np.ndarray:
        """The shard of each token's lookup: of the word if it is rare, of the pair otherwise."""
        return (np.where((self.rank < 0) & (self.cls != END), mix(self.key), pair) >> np.uint64(48)).astype(np.int64)


def tokens(columns: list[pa.Array], known: Known) -> Tokens:
    parts = [word_keys(c) for c in columns]
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    rank, number = known.ranks(key), (key & np.uint64(127)).astype(np.int32)
    # two pads before each text and an end behind it
    ends = np.cumsum(n + 3)
    start = ends - n - 3
    place = np.arange(len(key)) + np.repeat(2 + 3 * np.arange(len(n)), n)
    size = int(ends[-1]) if len(ends) else 0
    cls, bucket, g = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    cls[place] = np.where((rank >= 0) & (rank < TOPS), 1 + rank, 1 + TOPS + number)
    bucket[place] = np.where((rank >= 0) & (rank < OWN), 1 + rank, 1 + OWN + number)
    top = len(known.keys)
    g[place] = np.where(rank >= 0, 1 + rank, 1 + top + (mix(key) % np.uint64(BUCKETS)).astype(np.int32))
    keys, ranks = np.full(size, END_KEY, np.uint64), np.full(size, -1, np.int32)
    keys[place], ranks[place] = key, rank
    token = np.ones(size, bool)
    token[start] = token[start + 1] = False
    at = np.flatnonzero(token)
    return Tokens(np.repeat(np.arange(len(n), dtype=np.int32), n + 1), keys[at], ranks[at], cls[at], np.minimum(bucket[at - 1], PREV - 1) * CLASSES + cls[at - 2], g[at - 1])


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _chunks(batches, column: str, most: int = CHUNK_TOKENS):
    """Lists of batches of about `most` tokens (by a bound from their bytes); a text stays whole."""
    held, size = [], 0
    for b in cut(batches, column, max_bytes=2 << 20):
        held.append(b)
        size += b.column(column).nbytes // 5 + b.num_rows
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _blobs(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    cols = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["to", "part", "kind", "n", "data"])


def _buffers(b: pa.RecordBatch):
    """The blobs' data, without a copy."""
    return (x.as_buffer() for x in b.column("data"))


def _packed(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of numbers, so many bytes of each, plane by plane and compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize)[:, :width].T) for c, width in columns if len(c)]
    return pa.compress(b"".join(x.tobytes() for x in planes), codec="zstd", asbytes=True)


def _parsed(n: int, data, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of _packed as 64-bit numbers."""
    if not n:
        return [np.zeros(0, np.uint64) for _ in widths]
    planes, at, out = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd"), np.uint8), 0, []
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = planes[at : at + n * w].reshape(w, n).T
        out.append(x.view(np.uint64).ravel())
        at += n * w
    return out


def _dealt(part: np.ndarray, parts: int, columns: list[tuple[np.ndarray, int]], steps: bool = False):
    """(part, rows, packed columns) for each part that has rows. steps: the first column is sorted and kept as differences."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [(c[order], width) for c, width in columns]
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = cuts[p], cuts[p + 1]
        some = [(c[a:b], width) for c, width in columns]
        if steps:
            some[0] = (np.diff(some[0][0], prepend=some[0][0].dtype.type(0)), some[0][1])
        yield p, int(b - a), _packed(some)


def _low_bytes(total: int) -> int:
    """Bytes of a pair's hash besides its shard: the space of features grows with the corpus."""
    return 3 if total < 1 << 28 else 4 if total < 1 << 36 else 5


def _feature(pair: np.ndarray, shard: np.ndarray, low: int) -> np.ndarray:
    """What names a pair: its shard, and `low` bytes of its hash."""
    return (shard.astype(np.uint64) << np.uint64(8 * low)) | (pair & np.uint64((1 << 8 * low) - 1))


#: Bytes of the columns of each kind of blob; low stands for the number of a pair's bytes.
def _widths(kind: int, low: int) -> tuple[int, ...]:
    return {WORDS: (8, 8), PAIRS: (low, 2, 4), KNOWN: (4, low, 4, 2), RARE: (4, low, 4, 8), ADDED: (4, 4, 8, 4)}[kind]


CELL = (4, 8)


@dataclass
class Model:
    weights: np.ndarray
    known: Known
    counts: np.ndarray  # of the known words, by rank
    contexts: np.ndarray  # n(g): the texts, the known words, the buckets
    total: int
    distinct: int
    texts: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    table: DataFrame  # (key, c) of all training words
    pairs: DataFrame  # blobs of the counts of pairs
    parts: int
    frequent: tuple[np.ndarray, np.ndarray]  # features of the frequent pairs, sorted, and their counts

    @property
    def class_norm(self) -> np.ndarray:
        return np.log10(self.class_total + self.class_distinct + 1.0)


def held_out(ident, folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text", known: int = 1 << 17, passes: int = 20, rate: float = 0.35, ridge: float = 1.0) -> Model:
    """Learn from all rows of docs, whole texts. Null texts count as empty ones (an end each). Without any row the model is uniform over classes.

    Repeated rows each count. Further columns of docs are ignored.
    """
    source = docs.select(F.col(text_col).alias("text"))

    def count(batches):
        texts = 0
        for held in _chunks(batches, "text", 5 * CHUNK_TOKENS):
            key, c = _counted(np.concatenate([word_keys(b.column("text"))[0] for b in held]))
            texts += sum(b.num_rows for b in held)
            for at in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 200_000].view(np.int64)), pa.array(c[at : at + 200_000])], names=["key", "c"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts], pa.int64())], names=["key", "c"])

    table = stored(spark, source.mapInArrow(releasing(count), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    only = table.where("key IS NOT NULL")
    per = only.selectExpr("key & 127 AS e", "c").groupBy("e").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    texts = (table.where("key IS NULL").agg(F.sum("c")).first() or [0])[0] or 0
    top = _most_frequent(only, known).sort_values(["c", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
    total, distinct = sum(r["n"] for r in per) + texts, sum(r["v"] for r in per) + (texts > 0)
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        class_total[1 + TOPS + r["e"]], class_distinct[1 + TOPS + r["e"]] = r["n"], r["v"]
    for k, c in zip(top["key"][:TOPS], top["c"][:TOPS]):
        class_total[1 + TOPS + (k & 127)] -= c
        class_distinct[1 + TOPS + (k & 127)] -= 1
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(key, kind="stable")
    words_ = Known(key[by_key], by_key.astype(np.int32))
    parts, low = max(1, -(-int(total) // PART_TOKENS)), _low_bytes(int(total))
    shared = spark.sparkContext.broadcast(words_)

    def gather(batches):
        known_, cells, often, n_tokens = shared.value, np.zeros(CELLS, np.int64), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        for held in _chunks(batches, "text", 2 * CHUNK_TOKENS):
            t = tokens([b.column("text") for b in held], known_)
            held.clear()
            cells += np.bincount(t.ctx * CLASSES + t.cls, minlength=CELLS)
            pair = t.pairs()
            feature, n = _counted(_feature(pair, t.shards(pair), low))
            n_tokens += len(pair)
            often = _counted(*(np.concatenate(x) for x in zip(often, (feature[n > 1], n[n > 1]))))
            if len(often[0]) > 4 << PAIR_SHARE:
                often = tuple(x[often[1] > n_tokens >> PAIR_SHARE + 1] for x in often)
            shard = (feature >> np.uint64(8 * low)).astype(np.int64)
            yield _blobs([(0, p, PAIRS, m, data) for p, m, data in _dealt(shard * parts >> 16, parts, [(feature, low), (shard.astype(np.uint16), 2), (n.astype(np.uint32), 4)])])
        seen = np.flatnonzero(cells)
        some = often[1] >= max(2, n_tokens >> PAIR_SHARE + 1)
        rows = [(0, -1, PAIRS, int(some.sum()), _packed([(often[0][some], 8), (often[1][some], 8)]))]
        rows += [(0, -2, p, n, data) for p, n, data in _dealt(seen // CLASSES % GRADIENTS, GRADIENTS, [(seen.astype(np.int32), 4), (cells[seen], 8)])]
        yield _blobs(rows)

    blobs = stored(spark, source.mapInArrow(releasing(gather), BLOB))
    pairs = blobs.where("part >= 0")
    weights = _class_weights(spark, blobs.where("part = -2"), passes, rate, ridge)
    frequent = _frequent_pairs(spark, blobs, int(total), low)
    contexts = np.zeros(1 + len(top) + BUCKETS, np.int64)
    contexts[0] = texts
    contexts[1 : 1 + len(top)] = top["c"]
    contexts[1 + len(top) :] = _bucket_counts(only, shared)
    return Model(weights, words_, top["c"].to_numpy(np.int64), contexts, int(total), int(distinct), int(texts), class_total, class_distinct, table, pairs, parts, frequent)


def _most_frequent(table: DataFrame, most: int):
    """At most `most` of the most frequent keys: those above a count that a histogram of the counts' logarithms gives, and of the next class those above a hash that does."""
    level = F.floor(F.log2("c") * 256)
    order = F.pmod(F.xxhash64("key"), F.lit(4096))
    at, room = None, most
    for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if r["n"] > room:
            few, low = table.where(level == r["level"]), None
            for s in few.groupBy(order.alias("o")).agg(F.count("*").alias("n")).orderBy("o").collect():
                if s["n"] > room:
                    break
                low, room = s["o"], room - s["n"]
            more = few.where(F.lit(False) if low is None else order <= low)
            return table.where(F.lit(False) if at is None else level >= at).unionByName(more).toPandas()
        at, room = r["level"], room - r["n"]
    return table.toPandas()


def _bucket_counts(table: DataFrame, shared) -> np.ndarray:
    """n(g) of the buckets: tokens of the words that aren't known, a fixed number of sums."""

    def run(batches):
        known, sums = shared.value, np.zeros(BUCKETS, np.int64)
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            rare = known.ranks(key) < 0
            np.add.at(sums, (mix(key[rare]) % np.uint64(BUCKETS)).astype(np.int64), b.column("c").to_numpy()[rare])
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["g", "n"])

    out = np.zeros(BUCKETS, np.int64)
    got = table.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out[got["g"].to_numpy(np.int64)] = got["n"]
    return out


def _frequent_pairs(spark: SparkSession, blobs: DataFrame, total: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that tasks found frequent and that are there, in these tasks, one in 2^PAIR_SHARE of all tokens, so 2^PAIR_SHARE at most, with their full counts."""

    def named(batches):
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), _buffers(b)):
                f, c = _parsed(n, data, (8, 8))
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c.view(np.int64))], names=["f", "n"])

    found = blobs.where("part = -1").mapInArrow(named, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total >> PAIR_SHARE))
    feature = np.sort(found.toPandas()["f"].to_numpy(np.int64).view(np.uint64))
    if not len(feature):
        return feature, np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast(feature)

    def counts(batches):
        wanted = shared.value
        sums = np.zeros(len(wanted), np.int64)
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), _buffers(b)):
                pair, shard, c = _parsed(n, data, _widths(PAIRS, low))
                f = _feature(pair, shard, low)
                i = np.searchsorted(f, wanted)  # a blob is sorted by shard and pair
                i[i == len(f)] = 0
                sums += np.where(f[i] == wanted, c[i], 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], names=["i", "n"])

    got = blobs.where("part >= 0").mapInArrow(counts, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(feature), np.int64)
    n[got["i"].to_numpy(np.int64)] = got["n"]
    return feature, n


def _class_weights(spark: SparkSession, blobs: DataFrame, passes: int, rate: float, ridge: float) -> np.ndarray:
    """The weights of the class softmax: gradient passes over the counts of (context, class), each summed over tasks and applied."""

    def summed(batches):
        cells = np.zeros(CELLS, np.int64)
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), _buffers(b)):
                cell, c = (x.astype(np.int64) for x in _parsed(n, data, CELL))
                cells[cell] += c
        seen = np.flatnonzero(cells)
        if len(seen):
            yield _blobs([(0, -2, 0, len(seen), _packed([(seen.astype(np.int32), 4), (cells[seen], 8)]))])

    shards = stored(spark, blobs.repartition(GRADIENTS, "kind").mapInArrow(releasing(summed), BLOB))
    weights = np.zeros((FEATURES, CLASSES))
    for _ in range(passes):
        got = shards.mapInArrow(_gradient(weights), "g binary, h binary").toArrow()
        if not got.num_rows:
            break
        g, h = (sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in got.column(c)).reshape(FEATURES, CLASSES) for c in ("g", "h"))
        g -= ridge * 0.01 * weights
        weights = weights + np.clip(rate * g / (h + ridge), -2.0, 2.0)
    dropped(spark, shards)
    return weights.astype(np.float32)


def _gradient(weights: np.ndarray):
    """Gradient and diagonal curvature of the log likelihood of the shards of a task."""
    w = weights.astype(np.float32)

    def run(batches):
        feats, g, h = context_features(), None, None
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), _buffers(b)):
                if g is None:
                    g, h = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((FEATURES, CLASSES), np.float32)
                cell, c = (x.astype(np.int64) for x in _parsed(n, data, CELL))
                ctx, inverse = np.unique(cell // CLASSES, return_inverse=True)
                seen = np.bincount(inverse * CLASSES + cell % CLASSES, c, len(ctx) * CLASSES).reshape(len(ctx), CLASSES)
                all_ = seen.sum(1, keepdims=True)
                p = np.exp(log_probabilities(w, ctx))
                first_order, second_order = (seen - all_ * p).astype(np.float32), (all_ * p * (1 - p)).astype(np.float32)
                for f in range(feats.shape[1]):
                    order = np.argsort(feats[ctx, f], kind="stable")
                    at, first = np.unique(feats[ctx[order], f], return_index=True)
                    g[at] += np.add.reduceat(first_order[order], first, axis=0)
                    h[at] += np.add.reduceat(second_order[order], first, axis=0)
        if g is not None:
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["g", "h"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, base_score, score (log10 probabilities of the whole text).

    A token is a lower-cased word or the end. base_score: the sum of log10((c + 1) / (N + V + 1)); c, N and V of the training
    tokens. id_col is a number (or null); further columns are ignored. Null texts are empty: an end. A very long text is worked through whole, in numpy. Rows and ids that
    repeat each come back. An empty table gives an empty result. An unseen word has the probability of one unseen word of its class.
    """
    parts, low, m = model.parts, _low_bytes(model.total), model
    shared = spark.sparkContext.broadcast((m.known, np.log10(m.counts + 1.0), m.contexts, m.frequent, m.weights, m.class_norm))
    end_log, norm, has_end = float(np.log10(m.texts + 1.0)), float(np.log10(m.total + m.distinct + 1)), int(m.texts > 0)

    def ask(batches):
        known, log_c, contexts, (often, often_n), weights, class_norm = shared.value
        log_a, log_n_a = np.log10(LEAST + contexts), np.log10(LEAST + 2.0 * contexts)
        logp = np.full((PREV * CLASSES, CLASSES), np.nan, np.float32)
        chunk = TaskContext.get().partitionId() << 33
        for held in _chunks(batches, "text"):
            t = tokens([b.column("text") for b in held], known)
            new = np.unique(t.ctx[np.isnan(logp[t.ctx, 0])])
            for at in range(0, len(new), 512):  # sparse: four weight rows a context
                logp[new[at : at + 512]] = log_probabilities(weights, new[at : at + 512]) / np.log(10)
            n, ids = sum(b.num_rows for b in held), pa.concat_arrays([b.column("id") for b in held])
            held.clear()
            end, is_known = t.cls == END, t.rank >= 0
            own, rare = (t.cls >= 1) & (t.cls <= TOPS), ~end & (t.rank < 0)
            lc = np.where(is_known, log_c[np.maximum(t.rank, 0)] if len(log_c) else 0.0, 0.0)
            # log10 of a * q, as if a rare word were unseen
            lq = logp[t.ctx, t.cls] + np.where(end | own, 0.0, lc - class_norm[t.cls]) + log_a[t.g]
            model_ = lq - log_n_a[t.g]
            pair = t.pairs()
            shard = t.shards(pair)
            if len(often):
                f = _feature(pair, shard, low)
                i = np.searchsorted(often, f)
                i[i == len(often)] = 0
                hit = (often[i] == f) & ~rare
                model_[hit] += np.log10(1.0 + often_n[i[hit]] * 10.0 ** -lq[hit])
            else:
                hit = np.zeros(len(pair), bool)
            sums = lambda x: np.bincount(t.doc, x, minlength=n)
            local = pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (sums(None), sums(is_known).astype(np.int64) + has_end, sums(lc) + end_log, sums(model_)))],
                names=["id", "n_tokens", "n_known", "base", "model"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, local.schema) as w:
                w.write_batch(local)
            rows = [(chunk, chunk % parts, TEXTS, n, sink.getvalue().to_pybytes())]
            part = shard * parts >> 16
            for kind, some in ((KNOWN, ~rare & ~hit), (RARE, rare)):
                at = np.flatnonzero(some)
                last = mix(t.key[at]) if kind == RARE else shard[at].astype(np.uint16)
                cols = zip((t.doc[at], pair[at], lq[at].astype(np.float32), last), _widths(kind, low))
                rows += [(chunk, p, kind, k, data) for p, k, data in _dealt(part[at], parts, list(cols), steps=True)]
            yield _blobs(rows)
            chunk += 1

    def tabled(batches):
        known = shared.value[0]
        for b in batches:
            key = b.column("key").to_numpy().view(np.uint64)
            rare = known.ranks(key) < 0
            key, c = mix(key[rare]), b.column("c").to_numpy()[rare]
            yield _blobs([(0, p, WORDS, n, data) for p, n, data in _dealt((key >> np.uint64(48)).astype(np.int64) * parts >> 16, parts, [(key, 8), (c, 8)])])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = source.mapInArrow(releasing(ask), BLOB)
    table = m.table.where("key IS NOT NULL").coalesce(max(1, parts // 2)).mapInArrow(tabled, BLOB)
    every = asked.unionByName(table).unionByName(m.pairs)
    dealt = every.repartition(parts, "part").sortWithinPartitions("part", "kind")
    answered = dealt.mapInArrow(releasing(_answers(low)), BLOB).repartition("to").sortWithinPartitions("to", "kind")
    got = answered.mapInArrow(_texts, "id long, n_tokens long, n_known long, base double, model double")
    return got.select(F.col("id").alias(id_col), "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), F.col("model").alias("score"))


def _answers(low: int):
    """For the blobs of a part, tables first: what each chunk's lookups add to its texts. Blobs of texts pass through."""

    def run(batches):
        part, key, count, feature, times = None, None, None, None, None
        held: dict[int, list] = {WORDS: [], PAIRS: []}
        for b in batches:
            for to, p, kind, n, data in zip(*(b.column(c).to_pylist() for c in ("to", "part", "kind", "n")), _buffers(b)):
                if p != part:
                    part, key, held = p, None, {WORDS: [], PAIRS: []}
                if kind == TEXTS:
                    yield _blobs([(to, p, kind, n, data.to_pybytes())])
                    continue
                if kind == WORDS:
                    held[kind].append(_parsed(n, data, _widths(kind, low)))
                    continue
                if kind == PAIRS:
                    pair, shard, c = _parsed(n, data, _widths(kind, low))
                    held[kind].append((_feature(pair, shard, low), c.astype(np.uint32)))
                    continue
                if key is None:
                    key, count = _table(held[WORDS])
                    feature, times = _table(held[PAIRS])
                    held = {WORDS: [], PAIRS: []}
                doc, pair, lq, last = _parsed(n, data, _widths(kind, low))
                doc, lq = np.cumsum(doc), lq.astype(np.uint32).view(np.float32).astype(np.float64)
                seen = _looked(feature, times, _feature(pair, last >> np.uint64(48) if kind == RARE else last, low))
                c = _looked(key, count, last) if kind == RARE else np.zeros(n, np.int64)
                at = np.flatnonzero((seen > 0) | (c > 0))
                if not len(at):
                    continue
                more = np.log10(seen[at] * 10.0 ** -lq[at] + c[at] + 1.0)
                where, doc_at = np.unique(doc[at], return_inverse=True)
                sums = [np.bincount(doc_at, x, len(where)) for x in (more, np.log10(c[at] + 1.0), c[at] > 0)]
                cols = (where.astype(np.uint32), sums[0].astype(np.float32), sums[1], sums[2].astype(np.uint32))
                yield _blobs([(to, p, ADDED, len(where), _packed(list(zip(cols, _widths(ADDED, low)))))])

    return run


def _table(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _counted(*(np.concatenate(x) for x in zip(*parts)))


def _looked(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys (keys are sorted), 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, values[i], 0)


def _texts(batches):
    """A chunk's texts with what the parts add to them; the blob of the texts comes first."""
    to, local, sums = None, None, None
    names = ["id", "n_tokens", "n_known", "base", "model"]

    def row():
        cols = [local.column("id"), local.column("n_tokens"), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        for at, n, data in zip(*(b.column(c).to_pylist() for c in ("to", "n")), _buffers(b)):
            if at != to:
                if local is not None:
                    yield row()
                to, local = at, pa.ipc.open_stream(data).read_next_batch()
                sums = [local.column(c).to_numpy().copy() for c in ("model", "base", "n_known")]
                continue
            where, more, lc, known = _parsed(n, data, _widths(ADDED, 0))
            for s, x in zip(sums, (more.astype(np.uint32).view(np.float32), lc.view(np.float64), known)):
                s[where.astype(np.int64)] += x.astype(s.dtype)
    if local is not None:
        yield row()
