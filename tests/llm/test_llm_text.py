"""Operators of one text at a time against brute force, and their edge cases."""

import hashlib
import json
import re
import zlib
from collections import Counter

import public_tokenizers as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, extract, langid, licenses, quality, queries
from tidemill.llm.shared import space_words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, lang_pred string, items int, rejected_by int"
EDGES = [
    (1, None, None, None, None, "x", "y", 1, 2),
    (2, "", "en", "s", 0, None, None, None, None),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7, None, None, None, None),
    (4, "one two", "en", "s", 7, None, None, None, None),
    (4, "one two", "en", "s", 7, None, None, None, None),
    (5, "9 !! 8", None, "s", 7, None, None, None, None),
    (6, "wort und ding " * 30_000, "de", "s", 7, None, None, None, None),
    (7, "été Straße\u0085x\x1cy 'S don't ΣΑΣ İ é <|endoftext|>a<|startoftext|> ½² ａ", "fr", None, None, None, None, None, None),
    (None, "no id here", "en", "s", 7, None, None, None, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_space_words(spark, edges):
    for r in edges.select("text", space_words(F.col("text")).alias("w")).collect():
        assert r["w"] == WORDS.findall(r["text"] or "")


def test_bpe_is_the_library(spark, small, edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for i, text in [*((k, r["text"]) for k, r in docs_of(spark, small).items())]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.op5_bpe(spark, small).collect()}
    assert got == want
    out = bpe.decode(bpe.encode(edges, queries.vocabulary(), table_words=5), queries.vocabulary()).collect()
    assert len(out) == len(EDGES)
    trip = bpe.round_trip(edges, queries.vocabulary(), table_words=5).drop("lang").collect()
    assert sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in trip) == sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in out)
    for r in out:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_of_any_characters():
    """30,000 texts of letters of every kind, marks, joiners, combining characters, blanks and control strings, against the library."""
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    letters = "abzAZ\u0130\u0131\u00df\u1e9e\u03a3\u03c2\u01c5\u02b0\u0958\u0b5c\u0374\u2126\u212b\u05d0\u4e2d\uf900\uac00\u1100\u1161\u0e01\u0915\u1e00\u00c9\U0001d400\ufb01\u00aa"
    others = "0\u0660\u00b2\u0301\u0307\u0338\u093f\u200d\u200b\ufeff\u00ad\u0345'\u2019\U0001f600\x00\x1c\x1f\u180e"
    blanks = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2007\u2028\u2029\u202f\u205f\u3000"
    pieces = [*letters * 3, *others, *bpe.MARKS, *blanks, "'s", "'T", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "KITAB\u0130", " ", " "]
    texts = ["\u0130.", "T\u00dcRK\u0130, evet", "K\u0130TAB\u0130: bir"] + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(30_000)]
    texts += [f"{a}{m}" for a in letters + others for m in bpe.MARKS]
    table = bpe.WordTable(queries.vocabulary(), 5_000)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        words = [bpe._split(x) for x in some]
        ids, sizes = table.encode([w for ws in words for w in ws])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(ws) for ws in words])))]
        for x, i, j, e in zip(some, ends, ends[1:], t.encode_batch(some, add_special_tokens=False)):
            assert ids[i:j].tolist() == e.ids, ascii(x)


def test_bpe_empty(spark, empty):
    assert bpe.decode(bpe.encode(empty, queries.vocabulary()), queries.vocabulary()).count() == 0


def test_bpe_segments():
    for text in ("", "ab cd", "a" * 50 + " b", "one two\u00a0three\nfour " * 9):
        parts = list(bpe._segments(text, 10))
        assert "".join(parts) == text and [w for p in parts for w in bpe._split(p)] == bpe._split(text)


def test_bpe_word_table(spark, edges):
    """Each distinct word once, with the library's ids; a small bound keeps the most frequent ones."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counts = Counter(w for r in edges.collect() for w in bpe._split(r["text"] or "") if len(w) <= bpe.LONGEST)
    rows = bpe.word_table(edges, queries.vocabulary()).to_pylist()
    assert {r["word"]: r["ids"] for r in rows} == {w: t.encode(w, add_special_tokens=False).ids for w in counts} and len(rows) == len(counts)
    few = bpe.word_table(edges, queries.vocabulary(), table_words=20).column("word").to_pylist()
    assert len(few) <= 20 and min(counts[w] for w in few) >= max(n for w, n in counts.items() if w not in few)


def naive_quality(text):
    words = WORDS.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality_features(spark, small, edges):
    docs = docs_of(spark, small)
    for r in queries.op10_quality(spark, small).collect():
        n, *rest = naive_quality(docs[r["doc_id"]]["text"] or "")
        assert [r[c] for c in quality.FEATURES] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    got = quality.cascade(edges, features=True).collect()
    assert len(got) == len(EDGES) and "ids" in got[0].asDict()
    assert [[r[c] for c in quality.FEATURES] for r in got] == [list(naive_quality(r["text"] or "")) for r in got]


def test_licenses_clashing_names(spark):
    docs = spark.sql("SELECT 1 AS doc_id, 'x' AS text, 2 AS split, 3 AS Hits, 4 AS joined, 5 AS __s, 6 AS license")
    got = licenses.scan(docs.union(docs)).collect()
    assert len(got) == 2 and got[0].asDict() == {"doc_id": 1, "text": "x", "split": 2, "Hits": 3, "joined": 4, "__s": 5, "n_sentences": 1, "sentence_ids": "", "n_known": 0, "license": "none"}


def test_quality_order_does_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = quality.measure(docs)
    rejected = lambda order: {r[0] for r in quality.cascade(docs, order=order).where("rejected_by IS NOT NULL").select("doc_id").collect()}
    assert rejected(one) == rejected(one[::-1]) and 0 < len(rejected(one)) < docs.count()


def test_quality_keeps_labelled_good(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    got = queries.op10_quality(spark, medium).join(labels, "doc_id").where("NOT base_failed")
    assert got.where("quality = 1 AND NOT kept").count() == 0
    assert got.where("quality = 0 AND NOT kept").count() > 0


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "word " * 30_000), (2, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert len(quality.measure(docs)) == len(quality.RULES) == len(quality.measure(docs.where("doc_id = 1")))
    assert {m.name: m.rejected for m in quality.measure(docs)}["short"] == 1.0
    assert {r["doc_id"]: r["rejected_by"] for r in quality.cascade(docs, order=[]).collect()} == {1: "repeats", 2: "short", 3: "short"}


def test_quality_empty(spark, empty):
    assert quality.cascade(empty, features=True).count() == 0


def test_language_held_out(spark, medium, edges, empty):
    lang = {k: r["lang"] for k, r in docs_of(spark, medium).items()}
    got = queries.op9_language(spark, medium).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.99 * len(held)
    p = langid.fit(edges)
    out = {r["doc_id"]: r for r in langid.predict(edges, p).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 5)] == ["und"] * 4
    assert out[6]["lang_pred"] == "de"
    assert langid.predict(edges, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, p).count() == 0


def test_language_rerun(spark, small):
    """op9 against prototypes, labels and cosines made text by text in plain Python; bundling in small flushes changes nothing."""
    docs = docs_of(spark, small)
    v = langid.vectors(1024, 11)
    symbol = lambda c: 0 if not c.isalpha() else ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % 101

    def vector(text):
        s = [symbol(c) for c in f" {text} "]
        s = [b for a, b in zip([1, *s], s) if a or b]
        n = Counter(zip(s, s[1:], s[2:]))
        return sum((k * v.first[a].astype(float) * v.second[b] * v.third[c] for (a, b, c), k in n.items()), np.zeros(1024))

    one = {d: vector(r["text"] or "") for d, r in docs.items()}
    taught = {d for d, r in docs.items() if zlib.crc32(str(d).encode()) % 5 and r["lang"] is not None}
    langs = sorted({docs[d]["lang"] for d in taught})
    proto = np.stack([sum(one[d] for d in taught if docs[d]["lang"] == x) for x in langs])
    proto /= np.linalg.norm(proto, axis=1, keepdims=True)
    for r in queries.op9_language(spark, small).collect():
        cos = proto @ one[r["doc_id"]] / max(np.linalg.norm(one[r["doc_id"]]), 1e-9)
        if not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert abs(r["score"] - max(0, cos.max())) < 1e-5 and cos[langs.index(r["lang_pred"])] > cos.max() - 1e-5
    p = langid.fit(spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id").isin(list(taught))), waiting_codes=500)
    assert p.languages == langs and np.abs(p.matrix - proto).max() < 1e-6


def test_language_is_the_bundle(spark):
    """The gathered counts give the very vector that binding and bundling letter by letter gives."""
    v = langid.vectors(64, 11)
    codes = langid.trigrams("Hallo, du")
    want = sum(v.first[c // 128**2].astype(int) * v.second[c // 128 % 128] * v.third[c % 128] for c in codes.tolist())
    import numpy as np

    u, n = np.unique(codes, return_counts=True)
    assert (n @ v.of(u).astype(int) == want).all()


CONV = "conv_id long, turn long, role string, text string, loss string"


def test_chat_round_trip(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op8_chat(spark, small).collect()}
    assert got == want


def test_chat_edges(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "\\<|im_end|>\\n<", "x"), (2, 0, "assistant", "early", "x"), (2, 1, None, "", "x"), (3, 0, "us\ner<|", "a", None), (3, 0, "us\ner<|", "a", None)]
    turns = spark.createDataFrame(rows, CONV)
    seg = chat.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat.read_back(seg).collect()}
    assert back[1]["valid"] and not back[2]["valid"] and not back[3]["valid"]
    assert back[1]["loss_chars"] == len("\\<|im_end|>\\n<")
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\n\\<|im_end|>\\n<\n").hexdigest()
    assert back[3]["turns_sha256"] == hashlib.sha256(b"us\ner<|\na\n" * 2).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


PAGES = {
    "<html><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><main><article><header><h1>T &amp; U</h1></header><p>First <b>bold</b>\n text.</p><div class='ad'>Buy</div><p>Second&nbsp;one</p>"
    "<section id='comments'><p>I like it very much, thanks for this.</p></section></article></main><aside>Other</aside><div class='cookie-notice'>We use cookies</div><form><p>Name</p></form><footer>(c)</footer></body></html>": "T & U\nFirst bold text.\nSecond one",
    "<div class='sidebar'><p>side text here</p></div><div class='post-content'><p>Body one.</p><p>Body <a href='x'>two</a>.</p></div><ul class='menu'><li><a>m</a></li></ul>": "Body one.\nBody two.",
    "<p>plain &lt;p&gt; text<script>var a='</p>';</script> goes on<p>again": "plain <p> text goes on\nagain",
    "<!-- <p>no</p> --><article>kept</article><style>p{}</style>": "kept",
    "<div class='layout with-sidebar'><div class='header'>Site</div><article><div class='entry-header'><h1>T</h1></div><p>Body.</p><ul><li>One</li><li>Two</li></ul></article><div class='comments'><article class='comment'><p>Nice one</p></article></div></div>": "T\nBody.\nOne\nTwo",
    "<main><p>Body.</p></main><section class='related'><article class='teaser'><p>Read this next</p></article></section>": "Body.",
    "": "",
}


def test_extract(spark):
    pages = spark.createDataFrame([*enumerate(PAGES), (98, None)], "page_id long, html string").selectExpr("*", "'u' AS url", "1 AS text")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    assert got == {**dict(enumerate(PAGES.values())), 98: ""}
    assert extract.extract(pages.where("false")).count() == 0


def test_extract_boilerplate_inside():
    """Marked blocks between content paragraphs of a marked article or main element, short and long ones."""
    long = "I read all of this with great interest and would like to add that my own experience was rather different from what is told here. " * 3
    marked = [f"<{tag}{a}><p>{{}}</p></{tag}>" for tag, a in (("div", " class='ad'"), ("aside", ""), ("div", " class='notice'"), ("div", " class='related'"), ("div", " class='comments'"), ("section", " id='comments'"), ("footer", ""), ("form", ""))]
    marked += ["<div class='comments'><article class='entry'><div class='text'>{}</div></article></div>", "<aside><article><p>{}</p></article></aside>", "<div class='related-posts'><article class='post'><p>{}</p></article></div>"]
    for top, end in (("<article class='post'>", "</article>"), ("<main id='content'>", "</main>"), ("<main id='content'><div class='post-content'>", "</div></main>"), ("<main><div class='content with-sidebar'>", "</div></main>"), ("<div class='layout has-comments'><article class='post'>", "</article></div>")):
        for box in marked:
            for text in ("Buy this now", long):
                page = f"<html><body>{top}<h1>Title</h1><p>First.</p>{box.format(text)}<p>Second.</p>{box.format(text)}{end}</body></html>"
                assert extract.main_text(page) == "Title\nFirst.\nSecond.", (top, box, text)


def test_extract_by_the_cut(spark):
    """Short unmarked blocks follow their neighbours: a subtitle between paragraphs stays, a line of links' labels between boilerplate goes."""
    para = "A paragraph of the story that is long enough to speak for itself, with several clauses and a good deal of detail in each of them. "
    page = f"<body><div id='top'><div class='nav'>Home</div><div>Log in</div><div class='ad'>Buy</div></div><div><p>{para}</p><p>A subtitle</p><p>{para}</p><p>The end</p></div><div class='footer'><p>About</p></div><div>Imprint</div></body>"
    got = extract.labelled(page)
    assert extract.main_text(page) == "\n".join([para.strip(), "A subtitle", para.strip(), "The end"])
    assert [t for t, x, k in got if k and x < 0] == ["A subtitle", "The end"] and {t for t, _, k in got if not k} == {"Home", "Log in", "Buy", "About", "Imprint"}
    assert extract.main_text("<p>Hello</p><p>there</p>") == "Hello\nthere"
    row = extract.extract(spark.createDataFrame([(page, 7)], "html string, n_flipped int")).first()
    assert row["n_flipped"] == 2 and row["text"].startswith("A paragraph")


def test_extract_takes_linear_time():
    import time

    for bad in ("<a \"x ", "<a 'x ", "<a \"x <!-- ", "<", "<a b=\">", "</p '", "<![CDATA["):
        for tail in ("", "'>", ">"):
            began = time.perf_counter()
            extract.main_text("<p>Text</p>" + bad * (1_000_000 // len(bad)) + tail)
            assert time.perf_counter() - began < 8, (bad, tail)
    assert [b[0] for b in extract.blocks("<p>One</p><a href=\"x>two</a><p>Three</p>")] == ["One", "two", "Three"]


def test_extract_tables(spark, small):
    """On the given pages the article's own blocks, and nothing else."""
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        want = [" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " " if False else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner[1])]
        assert extract.main_text(r["html"]) == "\n".join(w for w in want if w)


def test_min_cut_is_minimal():
    import itertools
    import random

    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.4]
        cost = lambda keep: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        assert cost(extract.min_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


def test_licenses(spark, edges, empty):
    texts = ["All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.", "x. Released under the MIT License. y", "Licensed under the Apache License, Version 2.0. Then. You may not use this file except in compliance with the License.", "nothing", None]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, license int")
    got = [(r["sentence_ids"], r["license"]) for r in licenses.scan(rows).orderBy("doc_id").collect()]
    assert got == [("RESERVED,GPL3", "gpl-reserved"), ("MIT", "mit"), ("APACHE2,APACHE2-USE", "apache-2.0-full"), ("", "none"), ("", "none")]
    assert licenses.scan(edges).count() == len(EDGES) and licenses.scan(empty).count() == 0


APACHE = """Copyright 2020 The Authors
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.
"""


def test_licenses_real_texts(spark):
    """Headers and texts as they are published: wrapped, in comments, or on one line."""
    want = [
        (APACHE, "APACHE2,APACHE2-USE,APACHE2-AS-IS,APACHE2-SEE", "apache-2.0-full"),
        (MIT, "MIT,MIT-GRANT,MIT-NOTICE,AS-IS,MIT-LIABLE", "mit-full"),
        (BSD, "RESERVED,BSD-GRANT,BSD-SOURCE,BSD-BINARY", "bsd"),
        (GPL.format(":", ",", 3), "GPL3", "gpl-3.0"),
        (GPL.format(";", ",", 2), "GPL2", "gpl-2.0"),
        ("You may not use this file except in compliance with the License.", "APACHE2-USE", "apache-2.0"),
    ]
    texts = [(f(t), ids, name) for t, ids, name in want for f in (str, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */", lambda t: "".join(f"# {x}\n" for x in t.splitlines()))]
    texts += [("\n\n".join(" ".join(p.split()) for p in MIT.split("\n\n")), want[1][1], "mit-full")]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["sentence_ids"], r["license"]) for r in got] == [x[1:] for x in texts]


def test_vocabulary_is_json():
    assert json.loads(queries.vocabulary())["model"]["type"] == "BPE"
