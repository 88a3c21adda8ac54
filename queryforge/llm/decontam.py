"""Benchmark decontamination over a positional index (native: DataFrame functions only).

1. Count the corpus postings of every benchmark term (one scan, partial counts).
2. For each window of an item take its two rarest terms.  A window with a term
   that the corpus lacks cannot occur.
3. Store the postings (document, term, position) of those terms alone: the
   positional index, spread over the cluster by document.
4. Intersect the lists: a posting at ``pos`` of item word ``q`` puts the item's start
   at ``pos - q``; a place survives when at least two of the item's rare terms agree on
   it (one, for an item of a single word).
5. Compare the surviving places word by word, which gives the exact windows.

Proximity matches (``near_matches``) use the same index and comparison, but their own
terms: so many of an item's rarest that every place with enough agreement holds some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_rows, keep_rows, materialize, sized, words

_KEY = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as words; rows that repeat doc_id and text share one key and so one result."""
    return doc_rows(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))


def _items(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: item (its id as a string; null: 'null'), item_words, k (window length)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             words(F.col(text_col).cast("string")).alias("item_words"))
    return items.where(F.size("item_words") > 0).distinct().select(
        "item", F.xxhash64("item", "item_words").alias("item_key"), "item_words", F.least(F.lit(window), F.size("item_words")).alias("k"))


def _rare_terms(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, item_key, q): for each window that can occur, its two rarest terms and their places in the item."""
    terms = items.select("item_key", "k", F.size("item_words").alias("n"), F.posexplode("item_words").alias("q", "term"))
    terms = terms.join(counts, "term")
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("k") + 1), F.least(F.col("q"), F.col("n") - F.col("k")))
    windows = terms.withColumn("start", F.explode(starts))  # at most k rows for each item word
    whole = Window.partitionBy("item_key", "start")
    rank = F.row_number().over(whole.orderBy("count", "q"))
    return (windows.withColumns({"rank": rank, "present": F.count("*").over(whole)})
            .where("rank <= 2 and present = k").select("term", "item_key", "q").distinct())


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, term) of the given terms in all documents."""
    return docs.select(*_KEY, F.posexplode("words").alias("pos", "term")).join(sized(terms), "term")


def _counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, count): the corpus postings of every benchmark term that has any."""
    vocabulary = materialize(items.select(F.explode("item_words").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode("words").alias("term"))
    return materialize(tokens.join(sized(vocabulary), "term").groupBy("term").count(), "term-counts")


def _starts(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_key, at, q): the item's start that each posting of a rare term (term, item_key, q) asks for."""
    index = materialize(_postings(docs, materialize(rare.select("term").distinct(), "index-terms")), "postings")
    return index.join(sized(rare), "term").select(*_KEY, "item_key", (F.col("pos") - F.col("q")).alias("at"), "q")


def _places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_key, at): places at which the item's rarest terms agree."""
    rare = materialize(_rare_terms(items, _counts(docs, items)), "rare-terms")
    agreed = _starts(docs, rare).groupBy(*_KEY, "item_key", "at").agg(F.count_distinct("q").alias("agree"))
    need = items.select("item_key", F.least(F.lit(2), F.col("k")).alias("need"))
    return materialize(agreed.join(need, "item_key").where("agree >= need").select(*_KEY, "item_key", "at"), "places")


def _near_places(docs: DataFrame, items: DataFrame, least_share: float, most_asked: int = 3) -> DataFrame:
    """(doc_id, text_hash, item_key, at): all places at which ``least_share`` of the item's words can agree.

    Such a place misses at most ``missed`` = n - ceil(least_share * n) of the n words, so of any ``missed + asked``
    of them, here the rarest, it holds ``asked`` or more.  Words that the corpus lacks come first and have
    no postings.  ``most_asked`` only weighs postings against places to compare.
    """
    needed = F.greatest(F.lit(1), F.ceil(F.lit(least_share) * F.size("item_words") - F.lit(1e-9)))
    bounds = items.select("item_key", "item_words", F.least(F.lit(most_asked), needed).alias("asked"),
                          (F.size("item_words") - needed).alias("missed"))
    terms = bounds.select("item_key", "asked", "missed", F.posexplode("item_words").alias("q", "term"))
    counted = terms.join(_counts(docs, items), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy("count", "q"))
    rare = materialize(counted.withColumn("rank", rank).where("rank <= missed + asked and count > 0")
                       .select("term", "item_key", "q"), "near-terms")
    agreed = _starts(docs, rare).groupBy(*_KEY, "item_key", "at").agg(F.count_distinct("q").alias("agree"))
    return materialize(agreed.join(bounds, "item_key").where("agree >= asked").select(*_KEY, "item_key", "at"), "near-places")


def _same(at: str = "at") -> Column:
    """For each item word: does the document hold it at its place (beyond either end: no)."""
    return F.expr("transform(sequence(0, size(item_words) - 1), j -> "
                  f"{at} + j >= 0 and coalesce(get(words, {at} + j), '') = item_words[j])")


def _compared(docs: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    return (docs.join(sized(places), _same_key(docs, places)).drop(places["doc_id"]).drop(places["text_hash"])
            .join(items.select("item", "item_key", "item_words", "k"), "item_key").withColumn("same", _same()))


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def exact_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item, first, k): every occurrence of a window, ``first`` the document word it starts at."""
    return _matches(_keyed(docs, id_col, text_col), materialize(_items(benchmark, window, item_col, item_text_col), "items"))


def _matches(keyed: DataFrame, items: DataFrame) -> DataFrame:
    compared = _compared(keyed, items, _places(keyed, items))
    starts = F.expr("filter(sequence(0, size(same) - k), s -> forall(slice(same, s + 1, k), x -> x))")
    return (compared.select(*_KEY, "item", "k", "at", F.explode(starts).alias("start"))
            .select(*_KEY, "item", "k", (F.col("at") + F.col("start")).alias("first")))


def near_matches(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.8, window: int = 13, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item, at, share): places where at least ``least_share`` of an item's words stand in their order and distance.

    ``at`` is the document word at which the item would start; negative where its first words are cut off.
    Whole items are compared, so ``window`` changes nothing.
    """
    if not 0 < least_share <= 1:
        raise ValueError(f"least_share must be above 0 and at most 1, not {least_share}")
    keyed = _keyed(docs, id_col, text_col)
    items = materialize(_items(benchmark, window, item_col, item_text_col), "items")
    share = F.size(F.filter("same", lambda x: x)) / F.size("same")
    return (_compared(keyed, items, _near_places(keyed, items, least_share)).select(*_KEY, "item", "at", share.alias("share"))
            .where(F.col("share") >= least_share).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive item words, or all words of a shorter item; an item without words
    has none.  A document word inside any occurrence is hit.  ``contaminated``: n_hit > 0 and
    ``share * n_hit >= n_words``.  Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; rows that repeat doc_id and text get equal results; repeated item_ids count once, a null
    item_id counts as the item 'null'.  Other columns are ignored.
    """
    return _decided(docs, benchmark, window, share, id_col, text_col, item_col, item_text_col).drop("text_hash")


def _decided(docs, benchmark, window, share, id_col, text_col, item_col, item_text_col) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    matches = materialize(_matches(keyed, materialize(_items(benchmark, window, item_col, item_text_col), "items")), "matches")
    covered = matches.select(*_KEY, F.explode(F.sequence("first", F.col("first") + F.col("k") - 1)).alias("pos")).distinct()
    hits = covered.groupBy(*_KEY).agg(F.count("*").alias("n_hit"))
    found = matches.select(*_KEY, "item").distinct().groupBy(*_KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    result = hits.join(found, _same_key(hits, found)).select(hits["doc_id"], hits["text_hash"], "n_hit", F.size("items").cast("long").alias("n_items"), items)
    result = materialize(result, "hits")
    sizes = keyed.select(*_KEY, F.size("words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return sizes.join(sized(result), _same_key(sizes, result), "left").select(
        sizes["doc_id"], sizes["text_hash"], "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, **columns) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay."""
    names = {"id_col": "doc_id", "text_col": "text", "item_col": "item_id", "item_text_col": "text"} | columns
    decided = _decided(docs, benchmark, window, share, **names)
    kept = decided.select(*_KEY, (~F.col("contaminated")).alias("kept"))
    return keep_rows(docs, kept, names["id_col"], names["text_col"], one_of_repeats=False)
