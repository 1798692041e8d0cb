"""Near-duplicate detection with bottom-k sketches of one hash function.

Each document's set of word shingles is hashed once; its k smallest hashes are its sketch. Inverted
lists of retained values propose pairs, an estimate on the union's sketch filters them, and exact
Jaccard on the full sets confirms them. Links are closed to components.

Scale: equal sets collapse to one representative first, by a grouped minimum. Two sets with Jaccard
>= t share, but for a chance below 1e-8, at least 0.4 k of their union's k smallest values, so a sketch
may leave its 0.4 k - 1 most frequent values out of the index (prefix filter): passages that many
documents share are mostly not indexed. Within a list no
pairs are enumerated. The first round links each member with the list's head, the document with the fewest values of its own,
which is the likely original. Members of lists that still hold two components get a second index, over the rarest shingles of
their full sets, with the positional bound of prefix-filtered joins: what lies before the rarest shared shingle is in no
intersection, so members that can reach no other are never paired: those that can't reach the smallest set of their list leave it before it is read. Its rounds link the members with 4, 32, 256, ... leaders that then leave their lists,
until no list holds two components; their number is logarithmic in the longest list. A group of n near copies costs about n pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ascii_lower, connected_components, dropped, space_words, stored

#: Least share of a sketch that a linked pair has in common (see above).
SHARE = 0.4


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, grams: the sorted distinct 64-bit hashes of the word shingles. No words: empty array."""
    words = docs.select(F.col(id_col).alias("id"), space_words(ascii_lower(F.col(text_col))).alias("w"))
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(width)]))
    return words.select("id", F.when(F.size("w") == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(gram))).alias("grams"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 40) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    docs: any table with an integer id_col and text_col; further columns are ignored. A pair is linked
    if 100 * |A and B| >= percent * |A or B|, for percent >= 80. Null, empty and wordless texts have no
    shingles and are linked with nothing. Repeated rows (same id, same text) each come back with the same
    component; an id must not have two texts. A null id is linked with nothing, component_id null, kept. An empty
    table gives an empty result. Equal sets count as linked (their Jaccard is 1).
    """
    if percent < 80:
        raise ValueError("the index is lossless for similarities of 0.8 or more")
    sets = shingle_sets(docs, id_col, text_col, width)
    base = stored(spark, sets.select("id", F.size("grams").cast("bigint").alias("n"), F.xxhash64("grams").alias("f1"), F.xxhash64(F.lit(7), "grams").alias("f2"), F.slice("grams", 1, k).alias("sketch")))
    full = base.where("n > 0 AND id IS NOT NULL")
    reps = stored(spark, full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")))
    # inverted lists, without each sketch's most frequent values
    rows = reps.select("rep", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    freq = rows.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    by_rarity = F.sort_array(F.collect_list(F.struct("freq", "value")))  # at most k values a document
    shared = rows.join(freq, "value").groupBy("rep", "s").agg(by_rarity.alias("vs")).withColumn("own", F.col("s") - F.size("vs"))
    take = F.col("s") - F.ceil(F.col("s") * SHARE).cast("int") + 1 - F.col("own")
    lists = stored(spark, shared.select("rep", "own", F.explode(F.slice("vs", 1, F.greatest(take, F.lit(0)))).alias("x")).select(F.col("x.value").alias("value"), "rep", "own"))
    cand = _candidates(spark, docs, lists, id_col, text_col, width, k)

    heads = lists.groupBy("value").agg(F.min(F.struct("own", "rep")).alias("h")).select("value", F.col("h.rep").alias("lead"))
    met = lists.join(heads, "value").where("rep <> lead")
    pairs = met.selectExpr("least(rep, lead) AS a", "greatest(rep, lead) AS b").distinct()
    links, comp = _linked(spark, pairs, cand, percent, k, None, None)
    open_ = _mixed(_with_component(met.select("value", "rep"), comp))
    lists2 = stored(spark, _prefix_lists(cand, open_.select(F.col("rep").alias("id")).distinct(), percent))
    dropped(spark, lists)
    lists = stored(spark, _with_component(lists2, comp))
    dropped(spark, lists2)

    fits = f"100 * least(i, li) >= {percent} * (n + ln - least(i, li))"
    leaders = 4
    while True:
        open_ = stored(spark, _reachable(_mixed(lists), percent))
        dropped(spark, lists)
        if open_.isEmpty():
            dropped(spark, open_)
            break
        order = Window.partitionBy("value").orderBy(F.desc("c"), F.desc("i"), "rep")
        # the limit on the rank is applied by each task before the lists are dealt, so a long list meets in no task
        first = open_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= leaders)
        lead = stored(spark, first.selectExpr("value", "rep AS lead", "c AS lc", "n AS ln", "i AS li"))
        # those behind a leader in another component have a smaller one
        pairs = open_.join(lead, "value").where(f"c < lc AND {fits}").selectExpr("least(rep, lead) AS a", "greatest(rep, lead) AS b").distinct()
        links, comp = _linked(spark, pairs, cand, percent, k, links, comp)
        rest = open_.join(lead.selectExpr("value", "lead AS rep"), ["value", "rep"], "left_anti")
        lists = stored(spark, _with_component(rest.select("value", "rep", "n", "i"), comp))
        dropped(spark, open_, lead)
        leaders *= 8
    dropped(spark, cand)

    keyed = base.join(reps.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"], "left")
    if comp is not None:
        keyed = keyed.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    out = keyed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _candidates(spark: SparkSession, docs: DataFrame, lists: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """id, n, sketch and grams (the full set) of the documents that share a list."""
    ids = lists.join(lists.groupBy("value").agg(F.count("*").alias("len")).where("len > 1"), "value").select(F.col("rep").alias("id")).distinct()
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id").dropDuplicates(["id"])
    return stored(spark, shingle_sets(some, "id", "text", width).select("id", F.size("grams").alias("n"), F.slice("grams", 1, k).alias("sketch"), "grams"))


def _prefix_lists(cand: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """value, rep, n, i: inverted lists of the rarest shingles of the full sets of ids, as many as a link needs one of.

    i: the most that an intersection can hold whose rarest shingle is this one. Linked sets pass that bound at the rarest
    shingle they share, so pairs that fail it need no test there.
    """
    grams = cand.join(ids, "id").select("id", "n", F.explode("grams").alias("value"))
    df = grams.groupBy("value").agg(F.count("*").alias("df"))
    placed = grams.join(df, "value").withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("df", "value")))
    reach = placed.withColumn("i", F.expr("n - p + 1")).where(f"df > 1 AND 100 * i >= {percent} * n")
    return reach.selectExpr("value", "id AS rep", "n", "i")


def _with_component(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return lists.withColumn("c", F.col("rep"))
    return lists.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists that hold two components."""
    return lists.join(lists.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("value"), "value")


def _reachable(lists: DataFrame, percent: int) -> DataFrame:
    """The members that can link with the smallest set of their list, and so with any: an intersection of at most i makes percent of a union with it. Lists of a passage that many documents share, and nothing else, go whole."""
    small = lists.groupBy("value").agg(F.min("n").alias("least"))
    return lists.join(small, "value").where(f"{100 + percent} * i >= {percent} * (n + least)").drop("least")


def _linked(spark: SparkSession, pairs: DataFrame, cand: DataFrame, percent: int, k: int, links: DataFrame | None, comp: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """links and their components, with those of pairs that hold."""
    close = stored(spark, _estimated(pairs, cand, k))
    found = stored(spark, _confirmed(close, cand, percent))
    dropped(spark, close)
    if found.isEmpty():
        return links, comp
    links = found if links is None else links.union(found)
    new = stored(spark, connected_components(spark, links))
    dropped(spark, comp)
    return links, new


def _estimated(pairs: DataFrame, cand: DataFrame, k: int) -> DataFrame:
    """Pairs whose sketches have at least SHARE of their union's k smallest values in common."""
    side = lambda x: cand.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = j.select("a", "b", F.array_intersect("sa", "sb").alias("i"), union.alias("u"))
    return both.where(F.size(F.array_intersect("i", "u")) >= F.lit(SHARE) * F.size("u")).select("a", "b")


def _confirmed(close: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    side = lambda x: cand.select(F.col("id").alias(x), F.col("grams").alias(f"g{x}"))
    j = close.join(side("a"), "a").join(side("b"), "b")
    n = j.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
    return n.where(F.expr(f"100 * i >= {percent} * (s - i)")).select("a", "b")
