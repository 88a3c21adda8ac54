"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word sums, with a forward algorithm, over all its segmentations
into pieces; a text's likelihood is the product over its words.  The piece
probabilities come from expectation maximisation over the same sums, on word counts of
a bounded sample of documents per language, distributed over Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_LETTERS = regex.compile(r"\p{L}+").findall
#: Probability of a character outside the vocabulary, for every language.
UNKNOWN = 1e-8


#: Words of up to this many letters are computed together; longer ones are rescaled on the way.
SHORT = 32


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Number of each lower-case piece of letters in a sentencepiece vocabulary, and the longest piece's length.

    A leading U+2581 marks the beginning of a word.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    kept = sorted({p for p in every if p.removeprefix("▁").isalpha()} | {"▁"})
    return {p: i for i, p in enumerate(kept)}, max(map(len, kept))


class Pieces:
    """Looks up many substrings at once: the sorted 64-bit hashes of the pieces behind a table of their upper bits."""

    BITS, STEP, MIX = 20, np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, numbers: dict[str, int], longest: int):
        self.count, self.longest = len(numbers), longest
        hashes = np.zeros(len(numbers), np.uint64)
        for piece, i in numbers.items():
            h = 0
            for c in piece:
                h = (h * int(self.STEP) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        hashes *= self.MIX
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.filled = np.zeros(1 << self.BITS, bool)
        self.filled[self.hashes >> np.uint64(64 - self.BITS)] = True

    def arcs(self, marked: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(end, length) -> the rows of ``marked`` (code points by place and word) with a piece there, and its number."""
        out, h = {}, np.zeros(marked.shape, np.uint64)
        for k in range(1, min(self.longest, len(marked)) + 1):
            h = h[:len(marked) - k + 1] * self.STEP + marked[k - 1:]
            mixed = h * self.MIX
            begin, row = np.nonzero(self.filled[mixed >> np.uint64(64 - self.BITS)])
            asked = mixed[begin, row]
            at = np.minimum(np.searchsorted(self.hashes, asked), self.count - 1)
            there = self.hashes[at] == asked
            begin, row, number = begin[there], row[there], self.order[at[there]]
            edges = np.searchsorted(begin, np.arange(len(h) + 1))
            for b, (i, j) in enumerate(zip(edges, edges[1:])):
                if i < j:
                    out[b + k, k] = row[i:j], number[i:j]
        return out


class Lattice:
    """All segmentations of some words of at most ``SHORT`` letters: their pieces by end and length."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.ends = np.array([len(w) + 1 for w in words])
        longest = int(self.ends.max())
        points = np.array(words, f"U{longest - 1}").view(np.uint32).reshape(len(words), -1).T
        self.arcs = pieces.arcs(np.vstack([np.full(len(words), ord("▁")), points]).astype(np.uint64))
        self.at, self.places, self.longest = np.arange(len(words)), longest + 1, pieces.longest

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sums up to each place (places, words, columns of ``probability``)."""
        out = np.zeros((self.places, len(self.at), probability.shape[1]))
        out[0] = 1
        for e in range(1, self.places):
            out[e] = out[e - 1] * UNKNOWN
            for k in range(1, min(e, self.longest) + 1):
                if (e, k) in self.arcs:
                    row, number = self.arcs[e, k]
                    out[e, row] += out[e - k, row] * probability[number]
        return out

    def log_likelihood(self, probability: np.ndarray) -> np.ndarray:
        return np.log(self.forward(probability)[self.ends, self.at])

    def uses(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in ``counts`` copies of each word, for one column of probabilities."""
        ahead = self.forward(probability[:, None])[:, :, 0]
        behind = np.zeros_like(ahead)
        behind[self.ends, self.at] = counts / ahead[self.ends, self.at]
        out = np.zeros(len(probability))
        for e in range(self.places - 1, 0, -1):
            behind[e - 1] += behind[e] * UNKNOWN
            for k in range(1, min(e, self.longest) + 1):
                if (e, k) in self.arcs:
                    row, number = self.arcs[e, k]
                    arc = probability[number] * behind[e, row]
                    np.add.at(out, number, arc * ahead[e - k, row])
                    behind[e - k, row] += arc
        return out


def lattices(words: list[str], pieces: Pieces, most: int = 4096) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places in ``words``, lattice) for groups of words of like length."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(order), most):
        part = order[i:i + most]
        yield part, Lattice([words[j] for j in part], pieces)


def words_of(text: str | None) -> list[str]:
    return _LETTERS((text or "").lower())


def word_likelihood(word: str, numbers: dict[str, int], longest: int, probability: np.ndarray) -> np.ndarray:
    """log probability of a word per language (columns of ``probability``): the sum over all segmentations.

    The sums are rescaled as they go, so words of any length neither underflow nor lose a language.
    """
    marked = "▁" + word
    unknown = np.full(probability.shape[1], UNKNOWN)
    ahead = [np.ones(probability.shape[1])]  # sums up to each of the last positions
    shift = np.zeros(probability.shape[1])
    for end in range(1, len(marked) + 1):
        total = ahead[-1] * unknown
        for back in range(1, min(len(ahead), longest) + 1):
            number = numbers.get(marked[end - back:end])
            if number is not None:
                total = total + ahead[-back] * probability[number]
        ahead.append(total)
        if end % 16 == 0:
            ahead = ahead[-longest:]
            scale = ahead[-1].copy()
            ahead = [a / scale for a in ahead]
            shift += np.log(scale)
    return np.log(ahead[-1]) + shift


def expected_pieces(word: str, numbers: dict[str, int], longest: int, probability: list[float]) -> dict[int, float]:
    """Expected uses of each piece in a word of at most ``SHORT`` letters of one language, over all segmentations."""
    found = Lattice([word], Pieces(numbers, longest)).uses(np.asarray(probability), np.ones(1))
    return {int(i): float(found[i]) for i in np.flatnonzero(found)}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w) for w in words_of(text) if len(w) <= SHORT)  # longer runs of letters teach nothing about pieces
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, path: str, most_docs: int = 400, rounds: int = 2, smoothing: float = 0.05, lang_col: str = "lang",
          id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities): learnt from about ``most_docs`` documents of each language, drawn by a hash of the doc_id.

    Rows without a language are ignored; whole texts of the drawn documents count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, most_docs / sizes[lang])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < share[F.col("lang")])
    counted = drawn.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n bigint")
    counted = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism), "words")
    numbers, longest = pieces(path)
    probability = np.full((len(numbers), len(langs)), 1 / len(numbers))
    column = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(probability)  # vocabulary x languages

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Pieces(*pieces(path))
            uses = np.zeros((len(langs), table.count))
            for batch in batches:
                for lang, own in batch.to_pandas().groupby("lang"):
                    counts, at = own["n"].to_numpy(float), column[lang]
                    for part, lattice in lattices(own["word"].tolist(), table):
                        uses[at] += lattice.uses(np.ascontiguousarray(sent.value[:, at]), counts[part])
            at, piece = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[at, piece])],
                                             ["lang", "piece", "uses"])

        found = (counted.mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
                 .toPandas())  # at most vocabulary x languages rows
        probability = np.full((len(numbers), len(langs)), smoothing)
        probability[found["piece"].to_numpy(int), found["lang"].to_numpy(int)] += found["uses"].to_numpy(float)
        probability /= probability.sum(axis=0)
    return langs, probability


class Scorer:
    """Scores texts; the likelihoods of words seen before come from a bounded table."""

    def __init__(self, langs: list[str], probability: np.ndarray, path: str, most_words: int = 300_000):
        self.langs, self.probability, self.most_words = langs, probability, most_words
        self.numbers, self.longest = pieces(path)
        self.pieces = Pieces(self.numbers, self.longest)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(langs)))

    def _learn(self, words: list[str]) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        if len(self.known) > len(self.table):
            self.table = np.concatenate([self.table[:first], np.empty((len(self.known), len(self.langs)))])
        new = self.table[first:first + len(words)]
        short = np.array([i for i, w in enumerate(words) if len(w) <= SHORT], int)
        for part, lattice in lattices([words[i] for i in short], self.pieces):
            new[short[part]] = lattice.log_likelihood(self.probability)
        for i, word in enumerate(words):
            if len(word) > SHORT:
                new[i] = word_likelihood(word, self.numbers, self.longest, self.probability)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share of the likelihood) of each text."""
        listed = [words_of(t) if self.langs else [] for t in texts]
        if len(self.known) > self.most_words:
            self.known.clear()
        new = set().union(*listed).difference(self.known)
        if new:
            self._learn(list(new))
        out = []
        for words in listed:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            weight = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.langs[best], float(weight[best] / weight.sum())))
        return out


def identify(docs: DataFrame, langs: list[str], probability: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the likelihood) of every row of ``docs``.

    A text that is null, empty or without a letter, or a model without languages, gives ``und`` and 0.  Ties go to the
    language that sorts first.  Null and repeated doc_ids pass through, one row each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, path)
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                found = scorer.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()),
                                                  pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def train_and_identify(docs: DataFrame, training: DataFrame, path: str, **options) -> DataFrame:
    """Learn from ``training`` and predict every row of ``docs``."""
    return identify(docs, *train(training, path, **options), path)
