"""BPE encoding and decoding over a distinct-word table.

A text is split into words at white space, which no token of the vocabulary spans. The corpus's distinct words are counted, each
is encoded once into a table word -> ids, and the ids come back to the texts by position. Decoding joins ids with the pieces.

Scale: a counting pass that shuffles each task's distinct words (never texts or word positions), then a map pass. The table is
broadcast, so a frequent word can't make a hot key; its size is bounded by `table_words` words of `LONGEST` characters. Where the
corpus has more distinct words, the table holds the most frequent ones, and the rest, all of them rare, are encoded where they
stand. The piece table has the vocabulary's size.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import cut, releasing, trim, with_fields
from .shared import dropped, stored

#: Characters that str.split() takes as white space and the tokenizer doesn't.
CONTROL = re.compile("[\x1c-\x1f]")
#: White space as the tokenizer's patterns have it.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")

#: Marks that the tokenizer never joins to letters.
MARKS = ",.!?;:#$%&*()[]{}-+=/\\~\"@^_"

#: A longer word isn't kept in the shared table.
LONGEST = 48


@lru_cache(maxsize=4)
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def _word_ends(definition: str) -> np.ndarray:
    """id -> whether its piece ends a word (never, for vocabularies without a mark for that)."""
    end = json.loads(definition)["model"].get("end_of_word_suffix")
    return np.array([bool(end) and p.endswith(end) for p in pieces(definition)])


def _split(text: str) -> list[str]:
    """Words, in lower case where that can't make a control string of another one."""
    if text.isascii() and "<|" not in text:
        text = text.lower()
    return [w for w in SPACE.split(text) if w] if CONTROL.search(text) else text.split()


def _segments(text: str, size: int = 1 << 18):
    """The text in parts of about `size` characters, cut at white space (a longer word stays whole)."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if end <= at:
            space = SPACE.search(text, at + size)
            end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _letters(text: str) -> bool:
    """Whether a text is letters and stays so in composed form and lower case (a dotted capital I, for one, becomes a letter and a mark)."""
    if not text.isalpha():
        return False
    return text.isascii() or "".join([c.lower() for c in unicodedata.normalize("NFC", text)]).isalpha()


class WordTable(dict):
    """word -> place; at[place] to at[place + 1] are the word's ids in `flat`.

    It starts from the shared table (words, ids) and learns what that lacks; with `most` learned words it starts anew.
    """

    def __init__(self, definition: str, most: int, shared: pa.Table | None = None):
        super().__init__()
        self.definition, self.most, self.shared = definition, most, shared
        self.start()

    def start(self) -> None:
        self.clear()
        self.flat, self.at = array("i"), array("q", [0])
        if self.shared is not None and self.shared.num_rows:
            words, ids = (self.shared.column(c).combine_chunks() for c in ("word", "ids"))
            self.update(zip(words.to_pylist(), range(len(words))))
            self.flat.frombytes(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes())
            self.at.frombytes(np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64).tobytes())
        self.first = len(self)

    def _split_off(self, w: str) -> tuple[str, str]:
        """A word's letters and the marks behind them, which the tokenizer splits there as well; otherwise the whole word."""
        core = w.rstrip(MARKS)
        if not _letters(core):
            return w, ""
        return core.lower() if core.isascii() else core, w[len(core) :]

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self]
        if not new:
            return
        if len(self) - self.first + len(new) > self.most:
            self.start()
            new = [w for w in dict.fromkeys(words) if w not in self]
        split = [self._split_off(w) for w in new]
        unknown = [x for x in dict.fromkeys(x for pair in split for x in pair if x) if x not in self]
        for at in range(0, len(unknown), 1000):  # the library's results are large objects
            self._encode_parts(unknown[at : at + 1000])
        for w, parts in zip(new, split):
            if w not in self:
                self._add(w, [i for x in parts if x for i in self.flat[self.at[self[x]] : self.at[self[x] + 1]]])

    def _add(self, word: str, ids) -> None:
        self[word] = len(self.at) - 1
        self.flat.extend(ids)
        self.at.append(len(self.flat))

    def _encode_parts(self, few: list[str]) -> None:
        """Runs of letters or marks go through the library as one text, whose ids are cut at the pieces that end a word."""
        encoder, ends = _tokenizer(self.definition), _word_ends(self.definition)
        runs = [x for x in few if not x.strip(MARKS) or _letters(x)]
        ids = encoder.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids
        stops = (np.flatnonzero(ends[ids]) + 1).tolist() if ids else []
        if len(stops) == len(runs):
            for x, i, j in zip(runs, [0, *stops], stops):
                self._add(x, ids[i:j])
            few = [x for x in few if x not in self]
        for x, e in zip(few, encoder.encode_batch_fast(few, add_special_tokens=False)):
            self._add(x, e.ids)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, and how many each word has: the table joined to the words by position."""
        self.learn(words)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        place = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        flat, at = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.at, np.int64)
        sizes = at[place + 1] - at[place]
        ends = np.cumsum(sizes)
        return flat[np.repeat(at[place] - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


def word_counts(docs: DataFrame, text_col: str = "text", table_words: int = 100_000) -> DataFrame:
    """The distinct words of all texts (those of up to LONGEST characters), each with its number of occurrences: word, n.

    A task's words are distinct already, so they are dealt before Spark aggregates them.
    """

    def run(batches):
        seen: Counter[str] = Counter()
        for b in cut(batches, text_col, max_bytes=1 << 20):
            for t in b.column(text_col).to_pylist():
                for part in _segments(t or ""):
                    seen.update(_split(part))
            if len(seen) >= 2 * table_words:
                yield from flush(seen)
                seen.clear()
        yield from flush(seen)

    def flush(seen):
        kept = [w for w in seen if len(w) <= LONGEST]
        for at in range(0, len(kept), 10_000):
            few = kept[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.string()), pa.array([seen[w] for w in few], pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(releasing(run), "word string, n bigint").repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, definition: str, text_col: str = "text", table_words: int = 100_000) -> pa.Table:
    """word, ids of the most frequent distinct words, at most table_words (all of them, if there are no more), each encoded once.

    Words are taken by classes of their count (16 to a doubling), so that the choice needs a histogram and no sort.
    """
    spark = docs.sparkSession
    counts = stored(spark, word_counts(docs, text_col, table_words))
    level = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for at, n in sorted(map(tuple, counts.groupBy(level).count().collect()), reverse=True):
        total += n
        if total > table_words:
            break
        least = at

    def run(batches):
        for b in batches:
            table = WordTable(definition, b.num_rows)
            ids, sizes = table.encode(b.column("word").to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), ids], names=["word", "ids"])

    chosen = counts.select("word").where(F.lit(False) if least is None else level >= least)
    table = chosen.mapInArrow(releasing(run, _tokenizer, _word_ends), "word string, ids array<int>").toArrow()
    dropped(spark, counts)
    return table


def encode(docs: DataFrame, definition: str, text_col: str = "text", table_words: int = 100_000) -> DataFrame:
    """docs with ids (array of int); an older column ids is replaced. definition: the tokenizer's JSON text.

    The ids are those of encode(text, add_special_tokens=False) on the whole text. It holds for tokenizers whose normaliser and splitting work word
    by word (white space between words removed), as word_bpe_49k does. Null, empty and blank texts have none; each repeated row
    comes back. An empty table gives an empty result.
    """
    source = docs.select(*[c for c in docs.columns if c != "ids"])
    run = _encoder(docs, definition, text_col, table_words)
    return source.mapInArrow(releasing(run, _tokenizer, _word_ends), with_fields(source.schema, "ids array<int>"))


def _encoder(docs: DataFrame, definition: str, text_col: str, table_words: int):
    shared = docs.sparkSession.sparkContext.broadcast(word_table(docs, definition, text_col, table_words))

    def run(batches):
        table = WordTable(definition, table_words, shared.value)
        _word_ends(definition), _tokenizer(definition)
        trim()
        for b in cut(batches, text_col, max_bytes=1 << 18):
            texts = b.column(text_col).to_pylist()
            if len(texts) == 1:  # perhaps a very long one
                ids = np.concatenate([table.encode(_split(part))[0] for part in _segments(texts[0] or "")])
                at = [0, len(ids)]
            else:
                words = [_split(t) if t else [] for t in texts]
                ids, sizes = table.encode([w for ws in words for w in ws])
                at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(ws) for ws in words])))]
            out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "ids"])

    return run


def pieces(definition: str) -> list[str]:
    """id -> piece."""
    d = json.loads(definition)
    by_id = {i: w for w, i in d["model"]["vocab"].items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def decode(encoded: DataFrame, definition: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the pieces of ids_col joined by single blanks (what a tokenizer without a decoder gives).

    Null or empty id lists give an empty text.
    """
    source = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    return source.mapInArrow(releasing(_decoder(definition, ids_col)), with_fields(source.schema, "decoded string"))


def _decoder(definition: str, ids_col: str):
    def run(batches):
        table = np.array(pieces(definition), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                col = b.column(ids_col)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                out, start = [], 0
                for end in ends.tolist():
                    out.append(" ".join(" ".join(table[flat[i : min(i + 100_000, end)]].tolist()) for i in range(start, end, 100_000)))
                    start = end
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return run


def round_trip(docs: DataFrame, definition: str, text_col: str = "text", table_words: int = 100_000) -> DataFrame:
    """decode(encode(docs)), both in the same Python worker; the text doesn't come back."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded", text_col)]
    source = docs.select(*keep, text_col)
    there, back = _encoder(docs, definition, text_col, table_words), _decoder(definition, "ids")

    def run(batches):
        for b in back(there(batches)):
            yield b.select([*keep, "ids", "decoded"])

    return source.mapInArrow(releasing(run, _tokenizer, _word_ends), with_fields(source.select(*keep).schema, "ids array<int>, decoded string"))


def digests() -> list[Column]:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of the results of encode and decode."""
    return [
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]
