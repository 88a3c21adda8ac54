"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every document becomes its set of word shingles, hashed once to 64 bits; the
   ``k`` smallest values are its sketch.  Documents with equal sets form a class,
   and one document of each class goes on.
2. Inverted lists: value -> classes that retain it.  Two sets at or above the
   threshold share at least ``c`` of their retained values (``c`` from the binomial
   tail, missed with probability below 1e-9), so they also share one among
   the ``k - c + 1`` rarest of each.  Only these are listed: shingles of a passage
   that many documents hold are the commonest values and drop out by themselves.
3. Overlaps: each list first links its members to a hub instead of to each other.
   Pairs pass the size bound and the union-sketch estimate, then the exact
   Jaccard similarity of the full sets.
4. What the hubs leave: in lists that still hold several components, every pair
   across components is compared, in short lists as joined pairs, in long lists
   block by block on full sets inside the tasks, which return links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_rows, keep_rows, materialize, sized
from .components import components

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles (A-Z lower-cased, words between blanks).

    A shorter text is one shingle, its whole word sequence; without words the set is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i:len(h) - size + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def least_common(k: int, percent: int, miss: float = 1e-9) -> int:
    """The most values that two sketches of sets at the threshold share with probability 1 - ``miss``."""
    p, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * p ** c * (1 - p) ** (k - c)
        if tail >= miss:
            return max(c, 1)
    return k


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))


def _sketched(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingle_set(t.as_py(), size) for t in part.column("text")]
                marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(marks, pa.binary()), _lists([s[:k] for s in sets])], ["doc_id", "text_hash", "n", "mark", "sketch"])
    return run


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield pa.RecordBatch.from_arrays([part.column("class"), _lists([shingle_set(t.as_py(), size) for t in part.column("text")])],
                                                 ["class", "shingles"])
    return run


def _class_table(nodes: DataFrame) -> DataFrame:
    """One row per distinct set: class (its first row), min_id, its first document, size and sketch."""
    first = F.min(F.struct("row", "doc_id", "text_hash"))
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return nodes.where("n > 0").groupBy("mark").agg(first.alias("of"), keep.alias("keep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def _rare_lists(classes: DataFrame, k: int, c: int, percent: int) -> DataFrame:
    """(value, class, n): the inverted lists, each class under its rarest retained values only."""
    postings = classes.select("class", "n", F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").count().where("count > 1")
    listed = postings.join(shared, "value")
    by_class = Window.partitionBy("class")  # at most k rows each
    kept = F.least(F.lit(k), "n")
    need = F.least(F.lit(c), F.ceil(F.col("n") * percent / 100))
    listed = listed.withColumns({"rank": F.row_number().over(by_class.orderBy("count", "value")), "listed": F.count("*").over(by_class)})
    # values held by one class alone are rarer still: they come first in the order
    return listed.where(F.col("rank") + kept - F.col("listed") <= kept - need + 1).select("value", "class", "n")


def _near_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _hub_pairs(lists: DataFrame, percent: int, salt: Column) -> DataFrame:
    """Each member of a list with the hub of its list and size range; at most one pair per member."""
    lists = lists.withColumn("range", F.floor(F.log("n") / -math.log(percent / 100)) if percent < 100 else F.col("n"))
    hubs = materialize(lists.groupBy("value", "range").agg(F.min(F.struct(F.xxhash64("class", salt).alias("h"), "class")).alias("hub"), F.count("*").alias("m"))
                       .where("m > 1").select("value", "range", F.col("hub.class").alias("hub")), "hubs")
    pairs = lists.join(hubs, ["value", "range"]).where("class <> hub")
    return pairs.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, c: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: size bound, union-sketch estimate, exact similarity."""
    def side(table: DataFrame, end: str) -> DataFrame:
        return table.withColumnsRenamed({x: end if x == "class" else f"{x}_{end}" for x in table.columns})

    for end in ("a", "b"):
        pairs = pairs.join(side(sketches, end), end)
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    exact = F.least(F.lit(c / k), F.lit(percent / 100))
    passed = materialize(pairs.where(_near_size("n_a", "n_b", percent) & (common >= F.floor(F.size(union) * exact))).select("a", "b"), "passed")
    for end in ("a", "b"):
        passed = passed.join(side(sets, end), end)
    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    whole = F.size("shingles_a") + F.size("shingles_b") - inter
    return materialize(passed.where(inter * 100 >= whole * percent).select("a", "b"), "links")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, with each member's label and the commonest label of the list."""
    named = lists.join(sized(labels.withColumnRenamed("node", "class")), "class", "left").withColumn("label", F.coalesce("label", "class"))
    counts = named.groupBy("value", "label").agg(F.count("*").alias("m"), F.sum("n").alias("words"))
    open_lists = counts.groupBy("value").agg(F.max(F.struct("m", "label", "words")).alias("top"), F.sum("m").alias("members"),
                                             F.sum("words").alias("words"), F.count("*").alias("labels"))
    open_lists = materialize(open_lists.where("labels > 1").select(
        "value", "members", F.col("top.label").alias("main"), "words", (F.col("words") - F.col("top.words")).alias("other_words")), "open-lists")
    return materialize(named.join(open_lists, "value"), "open")


def _short_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs across components within short lists (the member bound makes their number linear)."""
    out = members.where("label <> main").select("value", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
    pairs = out.join(members, "value").where((F.col("label") != F.col("label_a")) & _near_size("n", "n_a", percent))
    return pairs.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct()


def _block_links(percent: int):
    """Links across components within one block of a long list; for each member one link per component met."""
    def compare(out, members) -> Iterator[tuple[int, int]]:
        sets = [*members["shingles"], *out["shingles"]]
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0, *map(len, sets)])
        n, at = np.diff(ends), len(members)
        label, cls = members["label"].to_numpy(), members["class"].to_numpy()
        for i, (own, own_label) in enumerate(zip(out["class"], out["label"])):
            mark = np.zeros(len(values), bool)
            mark[ids[ends[at + i]:ends[at + i + 1]]] = True
            inter = np.add.reduceat(mark[ids[:ends[at]]].astype(np.int64), ends[:at])
            linked = (inter * 100 >= (n[:at] + n[at + i] - inter) * percent) & (label != own_label)
            if linked.any():
                _, one = np.unique(label[linked], return_index=True)
                for other in cls[linked][one]:
                    yield int(own), int(other)

    def run(frames):
        import pandas as pd

        held, key = [], None

        def done():
            rows = pd.concat(held)
            out, members = rows[rows["out"]], rows[~rows["out"]]
            if len(out) and len(members):
                found = list(compare(out, members))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

        for frame in frames:  # sorted by block: a block may span frames
            for block, rows in frame.groupby(["value", "rb", "mb"], sort=False):
                if held and block != key:
                    yield from done()
                    held = []
                key = block
                held.append(rows)
        if held:
            yield from done()
    return run


def _long_links(members: DataFrame, sets: DataFrame, percent: int, block: int = 2_000_000) -> DataFrame:
    """Compare the members outside a list's main component with all its members, in blocks of about ``block`` shingles a side."""
    blocks = {"rbs": F.ceil(F.col("other_words") / block).cast("int"), "mbs": F.ceil(F.col("words") / block).cast("int")}
    members = members.withColumns(blocks).select("value", "class", "label", "main", "rbs", "mbs")
    outside = members.where("label <> main").select(
        "value", F.pmod(F.xxhash64("class"), "rbs").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"),
        "class", "label", F.lit(True).alias("out"))
    inside = members.select("value", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)).alias("rb"),
                            F.pmod(F.xxhash64("class"), "mbs").cast("int").alias("mb"), "class", "label", F.lit(False).alias("out"))
    placed = outside.unionByName(inside).join(sets, "class").repartition("value", "rb", "mb").sortWithinPartitions("value", "rb", "mb")
    return materialize(placed.mapInPandas(_block_links(percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 64, short: int = 32, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``shingle``-word
    shingles; ``component_id`` is the smallest doc_id reachable over links.  A text with fewer words is one
    shingle; a null or empty one has none and is linked with nothing.  A null doc_id never
    names a component that has another id.  Exactly one row of each component has ``kept``: the first with
    the smallest doc_id.  Rows that repeat an id are separate documents; other columns are ignored.
    """
    spark, c = docs.sparkSession, least_common(k, percent)
    rows = doc_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    nodes = rows.mapInArrow(_sketched(shingle, k), "doc_id bigint, text_hash bigint, n bigint, mark binary, sketch array<bigint>")
    nodes = materialize(nodes.withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = materialize(_class_table(nodes).select("mark", F.col("of.row").alias("class"), F.col("of.doc_id").alias("of_id"),
                                                     F.col("of.text_hash").alias("of_hash"), "keep", "n", "sketch"), "classes")
    lists = materialize(_rare_lists(classes, k, c, percent), "lists")
    met = lists.join(lists.groupBy("value").count().where("count > 1"), "value", "left_semi").select("class").distinct()
    sketches = materialize(classes.join(met, "class", "left_semi").select("class", "n", "sketch", "of_id", "of_hash"), "met")
    wanted = sketches.select("class", "of_id", "of_hash")
    texts = rows.join(sized(wanted), rows["doc_id"].eqNullSafe(wanted["of_id"]) & (rows["text_hash"] == wanted["of_hash"]))
    sets = materialize(texts.select("class", "text").mapInArrow(_full(shingle), "class bigint, shingles array<bigint>")
                       .dropDuplicates(["class"]), "sets")
    sketches = sketches.select("class", "n", "sketch")
    given = (sketches, sets, k, c, percent)

    links = _links(_hub_pairs(lists, percent, F.lit(0)), *given)
    members = _labelled(lists, components(links))
    long = members.where(F.col("members") > short)
    if not long.isEmpty():  # other hubs, one per value, before the blocks
        links = links.unionByName(_links(_hub_pairs(long.select("value", "class", "n"), percent, F.col("value")), *given))
        members = _labelled(lists, components(links))
    links = links.unionByName(_links(_short_pairs(members.where(F.col("members") <= short), percent), *given))
    links = links.unionByName(_long_links(members.where(F.col("members") > short), sets, percent))

    labels = components(links).withColumnRenamed("node", "class")
    linked = labels.join(classes.select("class", "keep", "mark"), "class")
    best = linked.groupBy("label").agg(F.min("keep").alias("best"))
    best = materialize(linked.join(best, "label").select("mark", "best"), "linked")
    final = classes.join(sized(best), "mark", "left").select("mark", F.coalesce("best", "keep").alias("best"))
    final = materialize(final, "components")
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = F.coalesce("best", alone)
    return nodes.join(final, "mark", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                                                    best["doc_id"].alias("component_id"), (best["row"] == F.col("row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                         **options) -> DataFrame:
    """``docs`` with one row of each component of near duplicates; all columns stay."""
    return keep_rows(docs, near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col, **options), id_col, text_col)
