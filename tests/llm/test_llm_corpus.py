"""Operators over the whole corpus against brute force, and their edge cases."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, maxent, minhash, queries, warc
from tidemill.llm.shared import connected_components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def grams(text, width):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, percent=80):
    sets = [(i, grams(t, width)) for i, t in rows]
    home = {i: i for i, _ in sets}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(n)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((root(i), root(j)))
            home[q] = p
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_near_duplicates_table(spark, medium):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    assert result(queries.op1_minhash(spark, medium)) == brute_components(rows, 4)


def test_near_duplicates_chains_and_groups(spark):
    """Random walks (chains of near copies), one large group, a shared passage, short texts."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    common = " ".join(r.choices(vocab, k=60))
    rows, i = [], 0
    for _ in range(12):
        w = r.choices(vocab, k=r.choice((6, 30, 120)))
        for _ in range(r.choice((1, 8, 25))):
            rows.append((i, " ".join(w)))
            i += 1
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
    base = r.choices(vocab, k=150)
    for _ in range(150):
        w = list(base)
        w[r.randrange(150)] = r.choice(vocab)
        w[r.randrange(150)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
        i += 1
    for _ in range(60):
        rows.append((i, common + " " + " ".join(r.choices(vocab, k=r.choice((5, 15, 60))))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one two three"), (i + 3, "One two THREE"), (i + 4, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS component", "3 AS id")
    assert result(minhash.near_duplicates(spark, df)) == brute_components(rows, 5)


def test_near_duplicates_edges(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e F"), (None, "a b c d e f")]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got.collect()) == [(-1, None, True), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert minhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_a_shared_passage(spark, monkeypatch):
    """4,000 documents of one passage and some words of their own, none linked: no pair is compared; 30 copies among them are found."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(88))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(16 + i % 3))) for i in range(4000)]
    rows += [(5000 + i, rows[7 * i][1] + " z") for i in range(30)]
    compared = []
    real = minhash._estimated

    def counting(pairs, cand, k):
        compared.append(pairs.count())
        return real(pairs, cand, k)

    monkeypatch.setattr(minhash, "_estimated", counting)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=4).collect()}
    assert {i: c for i, c in got.items() if i != c} == {5000 + i: 7 * i for i in range(30)}
    assert sum(compared) < 6 * len(rows), compared


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, x) for x in range(201, 260)]
    home = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            home[a] = home[b] = min(home[a], home[b])
    got = {row["node"]: row["component"] for row in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in home.items() if k not in loops}


def brute_leaks(docs, items, size=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(str(i))
    sizes = {len(x) for x in wins}
    out = {}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(UPPER))
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own_k := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= own_k
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate_table(spark, medium):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op7_decontaminate(spark, medium).collect()}
    want = brute_leaks(docs, items)
    assert got == want and any(x[-1] for x in want.values())


def test_decontaminate_small(spark):
    """Short items, blocks of the benchmark, tiny shards, words that repeat, cleaning."""
    r = random.Random(2)
    words = list("abcdefg") + ["é", "x1"]
    items = [(n, " ".join(r.choices(words, k=r.choice((0, 1, 3, 9, 10, 12, 25))))) for n in range(3, 30)] + [(99, None), (2, "q r s")]
    items = [x for x in items if len((x[1] or "").split()) != 1] + [(1, "zz")]
    docs = [(n, " ".join(r.choices([*words, "other", "zz"], weights=[9] * 9 + [2, 0.1], k=r.choice((0, 2, 30, 200))))) for n in range(60)]
    docs += [(100 + n, f"Start. {t or ''}! End") for n, t in items] + [(300, None), (301, "."), (302, items[0][1]), (302, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "'x' AS n_hit")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for block in (7, 1_000_000):
        got = decontaminate.contamination(d, b, block_words=block, shard_bytes=2000)
        for row in got.collect():
            assert (row["n_words"], row["n_hit"], len(row["items"]), hashlib.sha256(",".join(row["items"]).encode()).hexdigest(), row["n_hit"] > 0) == want[row["doc_id"]]
        clean = decontaminate.remove_spans(got, b).collect()
        assert len(clean) == len(docs)
        again = brute_leaks([(n, row["text"]) for n, row in enumerate(clean)], items)
        assert not any(x[-1] for x in again.values())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(d.where("false"), b).count() == 0


def test_decontaminate_items_without_id(spark, tmp_path):
    """They are hits, are cut, and count in the query as in its SQL; blocks of the benchmark don't change that."""
    import duckdb

    items = [(None, "a b c d e f g h i j k"), (None, "p q r s"), (7, "p q r s"), (8, "k l m")]
    docs = [(1, "x a b c d e f g h i j y"), (2, "x p q r s y"), (3, "x k l m y. A b c d e f g h i j k!"), (4, "nothing")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op7_decontaminate(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op7_decontaminate"]).fetchall())
    d, b = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    for block in (3, 1_000_000):
        found = decontaminate.contamination(d, b, block_words=block)
        assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: [None], 2: ["7", None], 3: ["8", None], 4: []}
        clean = {r["doc_id"]: r["text"].split() for r in decontaminate.remove_spans(found, b).collect()}
        assert clean == {1: ["x", "y"], 2: ["x", "y"], 3: ["x", "y.", "!"], 4: ["nothing"]}


def test_fm_index():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 500)
    text[-1] = 0
    fm = decontaminate.FMIndex(text)
    s = "".join(map(str, text))
    for p in ("1", "12", "123", "3331", "2"):
        lo, hi = fm.search(np.array([[int(c) for c in p]]), np.array([len(p)]))
        want = [i for i in range(len(s)) if s.startswith(p, i)]
        assert sorted(fm.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_warc_table(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet").collect()
    top = defaultdict(int)
    for r in pages:
        top[r["html"] or ""] = max(top[r["html"] or ""], r["page_id"])
    want = {}
    for r in pages:
        body = (r["html"] or "").encode()
        first = top[r["html"] or ""] == r["page_id"]
        want[r["page_id"]] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[r["html"] or ""])
    assert {r[0]: tuple(r[1:]) for r in queries.op3_warc(spark, medium).collect()} == want


def test_warc_edges(spark):
    rows = [(1, "u\r\nX: y", None, 5), (2, None, "", 5), (3, "u", "é\r\n\r\nWARC/1.1\r\n", 5), (9, "u", "same", 5), (4, "u", "same", 5), (9, "u", "same", 5), (5, "u", "x" * 3_000_000, 5), (None, "u", "same", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r["page_id"] or -1, r["url"], r["payload"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(pages, frame_bytes=1000), payload=True).collect()), key=str)
    assert got == sorted([(1, "u\r\nX: y", "", "revisit", 2), (2, "", "", "response", None), (3, "u", "é\r\n\r\nWARC/1.1\r\n", "response", None), (9, "u", "same", "response", None), (9, "u", "same", "response", None), (4, "u", "", "revisit", 9), (5, "u", "x" * 3_000_000, "response", None), (-1, "u", "same", "response", None)], key=str)
    assert warc.read_bundles(warc.write_bundles(pages, min_bytes=10)).where("record_type = 'revisit'").count() == 0
    assert warc.read_bundles(warc.write_bundles(pages.where("false"))).count() == 0
    one = warc.write_bundles(pages.coalesce(1), frame_bytes=1000).collect()
    bundles = [warc.Bundle(bytes(r["content"])) for r in one]
    holder = next(b for b in bundles if "3" in b.index())
    head, body = holder.read("3")
    assert body.decode() == rows[2][2] and head["WARC-Type"] == "response"


def test_language_model(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").collect()
    import zlib
    from collections import Counter
    from math import log10

    toks = lambda t: SPACE.findall((t or "").translate(UPPER))
    count, ends = Counter(), 0
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2:
            count.update(toks(d["text"]))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r["doc_id"]: r for r in queries.op4_lm_score(spark, medium).collect()}
    assert len(got) == len(docs)
    gain = 0.0
    for d in docs:
        r, w = got[d["doc_id"]], toks(d["text"])
        base = sum(log10((count[x] + 1) / (n + v + 1)) for x in w) + log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(x in count for x in w) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


class PlainModel:
    """The language model again, in plain Python: dictionaries of words and pairs, dense gradients."""

    def __init__(self, model, texts):
        self.model, self.count, self.pair, self.context, self.cells = model, {}, {}, {}, {}
        self.rank_of_key = dict(zip(model.known.keys.tolist(), model.known.rank.tolist()))
        self.seen = {}
        for t in texts:
            for h, skip, w in self.tokens(t):
                self.count[w] = self.count.get(w, 0) + 1
                g = self.g(h)
                self.pair[g, w] = self.pair.get((g, w), 0) + 1
                self.context[g] = self.context.get(g, 0) + 1
                at = (self.bucket(h), self.cls(skip) if skip else 0)
                self.cells[at, self.cls(w)] = self.cells.get((at, self.cls(w)), 0) + 1
        self.total = {}
        for w, c in self.count.items():
            n, v = self.total.get(self.cls(w), (0, 0))
            self.total[self.cls(w)] = (n + c, v + 1)

    def tokens(self, text):
        """(previous word, word before it, word) with None for a text's start and b"" for its end."""
        ws = [None, None, *(w.encode() for w in SPACE.findall((text or "").translate(UPPER))), b""]
        return [(ws[i - 1], ws[i - 2], ws[i]) for i in range(2, len(ws))]

    def key(self, w):
        if w not in self.seen:
            import pyarrow as pa

            self.seen[w] = int(maxent.word_keys(pa.array([w.decode()]))[0][0])
        return self.seen[w]

    def rank(self, w):
        return self.rank_of_key.get(self.key(w), -1)

    def cls(self, w):
        if w == b"":
            return 0
        return 1 + self.rank(w) if 0 <= self.rank(w) < maxent.TOPS else 1 + maxent.TOPS + (self.key(w) & 127)

    def bucket(self, h):
        if h is None:
            return 0
        return 1 + self.rank(h) if 0 <= self.rank(h) < maxent.OWN else min(255, 1 + maxent.OWN + (self.key(h) & 127))

    def g(self, h):
        if h is None:
            return ("start",)
        return ("word", h) if self.rank(h) >= 0 else ("bucket", int(maxent.mix(np.array([self.key(h)], np.uint64))[0]) % maxent.BUCKETS)

    def features(self, at):
        prev, skip = at
        return 0, 1 + prev, 1 + maxent.PREV + skip, 1 + maxent.PREV + maxent.CLASSES + (prev * 40503 + skip * 2654435761) % 4294967296 % maxent.COMBINED

    def trained(self, passes=20, rate=0.35, ridge=1.0):
        w = np.zeros((maxent.FEATURES, maxent.CLASSES))
        rows = {}
        for (at, c), n in self.cells.items():
            rows.setdefault(at, np.zeros(maxent.CLASSES))[c] += n
        for _ in range(passes):
            g, h = np.zeros_like(w), np.zeros_like(w)
            for at, seen in rows.items():
                z = sum(w[f] for f in self.features(at))
                p = np.exp(z - z.max())
                p /= p.sum()
                for f in self.features(at):
                    g[f] += seen - seen.sum() * p
                    h[f] += seen.sum() * p * (1 - p)
            w += np.clip(rate * (g - ridge * 0.01 * w) / (h + ridge), -2.0, 2.0)
        return w

    def q(self, h, skip, w):
        z = sum(self.model.weights[f].astype(float) for f in self.features((self.bucket(h), self.cls(skip) if skip else 0)))
        p = np.exp(z - z.max())
        c = self.cls(w)
        out = p[c] / p.sum()
        if c > maxent.TOPS:
            n, v = self.total.get(c, (0, 0))
            out *= (self.count.get(w, 0) + 1) / (n + v + 1)
        return out

    def probability(self, h, skip, w):
        n, a = self.context.get(self.g(h), 0), maxent.LEAST
        a += n
        return (self.pair.get((self.g(h), w), 0) + a * self.q(h, skip, w)) / (n + a)

    def score(self, text):
        return sum(np.log10(self.probability(*t)) for t in self.tokens(text))


@pytest.mark.parametrize("known", [1 << 17, 60])
def test_language_model_is_the_plain_one(spark, small, known, monkeypatch):
    """Training and scoring again in plain Python; with few known words, most are looked up as rare ones. Small parts and chunks, so that several meet."""
    monkeypatch.setattr(maxent, "PART_TOKENS", 5_000)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 40").cache()
    some = docs.where("doc_id % 3 > 0")
    model = maxent.train(spark, some, known=known, passes=4)
    plain = PlainModel(model, [r["text"] for r in some.collect()])
    assert len(model.counts) <= known and model.parts > 1 and len(model.frequent[0])
    assert np.allclose(plain.trained(4), model.weights, atol=2e-3)
    texts = [r["text"] for r in docs.collect()] + [None, "", "Zzyx qqq Zzyx the the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in maxent.score(spark, rows, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain.score(t), rel=1e-6), i
    # over all next words, an unseen one of each class standing for its share, the probabilities add up to 1
    others, at = {}, 0
    while len(others) < maxent.ENDINGS:
        others.setdefault(plain.cls(f"~~~{at}".encode()), f"~~~{at}".encode())
        at += 1
    for h, skip in ((None, None), (b"the", b"of"), (b"never-seen", b"the")):
        assert sum(plain.probability(h, skip, w) for w in [*plain.count, *others.values()]) == pytest.approx(1, abs=1e-6)


def test_language_model_edges(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat ate a dog", None, "", "x" * 3_000_000, "the cat sat on the mat"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    model = maxent.train(spark, docs)
    again = maxent.score(spark, spark.createDataFrame([(1, None), (1, ""), (None, "x y")], "doc_id long, text string"), model).collect()
    assert len(again) == 3
    twice = [r["score"] for r in maxent.score(spark, docs, model).where("doc_id IN (0, 6)").collect()]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    none = maxent.train(spark, docs.where("false"))
    assert maxent.score(spark, docs, none).where(F.isnan("score") | F.isnan("base_score")).count() == 0
    assert maxent.score(spark, docs.where("false"), model).count() == 0
