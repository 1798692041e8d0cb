"""The pipeline's stages against plain Python, each on its own input."""

import corpus_pipeline as P
import pytest
from test_llm_corpus import brute_components, brute_leaks

from tidemill.llm.shared import stored


@pytest.fixture(scope="module")
def outs(spark, small):
    docs, got = P.table(spark, small, "documents"), []
    got.append(docs)
    for _, stage in P.STAGES:
        docs = stored(spark, stage(spark, docs, small))
        got.append(docs)
    return got


def test_stages(spark, small, outs):
    docs, lang, kept, one, clean, ids = ({r["doc_id"]: r for r in x.collect()} for x in outs)
    assert all(x.columns == list(P.COLUMNS) for x in outs[1:5])
    assert all(any(c.isalpha() for c in r["text"] or "") for r in lang.values())
    assert all(any(c.isalpha() for c in docs[i]["text"] or "") is False for i in docs.keys() - lang.keys())
    assert lang.keys() > kept.keys()
    want = {i for i, (_, _, first) in brute_components([(i, r["text"]) for i, r in kept.items()], 5).items() if first}
    assert one.keys() == want
    items = [(r["item_id"], r["text"]) for r in P.table(spark, small, "benchmark").collect()]
    before, after = (brute_leaks([(i, r["text"]) for i, r in x.items()], items) for x in (one, clean))
    assert any(x[-1] for x in before.values()) and not any(x[-1] for x in after.values())
    for i, r in clean.items():
        assert r["n_chars"] == len(r["text"]) and (before[i][-1] or r["text"] == one[i]["text"])
    assert ids.keys() == clean.keys()


def test_language_verdict(spark, small):
    """Unlabelled texts of no learned language go, those of a learned one and all labelled ones stay; without labels every text with a letter stays."""
    docs = P.table(spark, small, "documents")
    own = next(r["text"] for r in docs.where("n_chars > 300 AND lang = 'en'").orderBy("doc_id").collect())
    foreign = ("Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. ", "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。")
    rows = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate((own, *[x * 4 for x in foreign]))]
    more = docs.select(*P.COLUMNS).unionByName(spark.createDataFrame(rows, docs.select(*P.COLUMNS).schema))
    kept = {r["doc_id"] for r in P.language(spark, more, small).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")} | {10**9}
    none = more.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert P.language(spark, none, small).count() == sum(any(c.isalpha() for c in r["text"] or "") for r in more.collect())


def test_run(spark, small, outs):
    assert sorted(map(str, P.run(spark, small).collect())) == sorted(map(str, outs[-1].collect()))


def test_edges(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "the cat sat on a mat " * 3 + " ".join(f"w{i} x{i}" for i in range(80)), "en", "a", 9)]
    rows += [(9, rows[-1][1], "en", "a", 9)] * 2
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES:
            docs = stored(spark, stage(spark, docs, small))
        assert docs.count() == (2 if some else 0)
