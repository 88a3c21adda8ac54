"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays.

An n-gram is a pair of 64-bit hashes: its context (all words but the last) and its last word.

1. Tasks count the words and n-grams of blocks of training texts.  Only (kind, bucket, arrays) rows are shuffled, at most one for each
   block and bucket; the number of buckets follows the bytes of the texts.  A bucket holds some contexts and some last words,
   so the successors of one frequent word spread over a whole row of buckets.
2. Each bucket merges its blocks and writes its sorted arrays to the shared folder.  It passes on the totals of its contexts, and
   what the order below counts: in how many different contexts each shorter n-gram stands.  Orders go down one by one to words.
3. Workers map the arrays into memory and look up the sorted queries of a block of texts at a time, in the buckets
   that hold them.  Pages are read when needed; no worker loads the model.  The maps stay with the worker.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, materialize, scratch_path
from .files import local_path, store_of, written

_ODD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
#: Marks around a text; no word contains a blank.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin", b" end"))
#: Kinds of rows besides the n-grams of order 2 and more, whose kind is their order: words, totals of contexts, numbers.
WORDS, CONTEXTS, NUMBERS = 1, 100, -1


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, between blanks), then the end mark."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, where each text begins) of some texts."""
    parts = [token_hashes(t) for t in texts]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Mixed once more, so that bits taken of it say nothing of those of the hash."""
    x = hashes * _ODD
    return (x ^ (x >> _HALF)) * _FOLD


def contexts(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1, 2, .. order - 1: the hash of that many tokens before each token; before a text stand begin marks."""
    n = len(tokens)
    first = np.zeros(n, bool)
    first[starts] = True
    since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    out: list[np.ndarray] = []
    for length in range(1, order):
        before = np.concatenate([np.full(length, BEGIN), tokens])[:n]
        before[since < length] = BEGIN
        # a longer context is the shorter one and the word before it
        out.append(before if length == 1 else _spread(out[-1] ^ _spread(before + np.uint64(length))))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: sorted ones (the first) by their steps, hashes that recur as places in a list of them."""
    parts, shape = [], []
    for i, a in enumerate(arrays):
        stored = [np.diff(a, prepend=a.dtype.type(0))] if i == 0 else [a]
        if i and a.dtype.itemsize == 8 and len(a) > 1:
            own, places = np.unique(a, return_inverse=True)
            if 8 * len(own) + 4 * len(a) < 8 * len(a):
                stored = [np.diff(own, prepend=own.dtype.type(0)), places.astype(np.uint32)]
        shape += [len(stored), *(x for b in stored for x in (len(b), b.dtype.itemsize))]
        parts += [np.ascontiguousarray(b).view(np.uint8).reshape(-1, b.dtype.itemsize).T.tobytes() if len(b) else b"" for b in stored]
    plain = np.array([len(arrays), len(shape), *shape], np.int64).tobytes() + b"".join(parts)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    count, width = np.frombuffer(plain, np.int64, 2).tolist()
    shape, at, out = iter(np.frombuffer(plain, np.int64, width, 16).tolist()), 16 + 8 * width, []
    for i in range(count):
        stored = []
        for _ in range(next(shape)):
            n, size = next(shape), next(shape)
            plane = np.frombuffer(plain, np.uint8, n * size, at).reshape(size, n).T
            stored.append(np.ascontiguousarray(plane).view({4: np.uint32, 8: np.uint64}[size]).ravel())
            at += n * size
        if i == 0 or len(stored) == 2:
            stored[0] = np.cumsum(stored[0], dtype=stored[0].dtype)
        out.append(stored[0][stored[1]] if len(stored) == 2 else stored[0])
    return out


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before them."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _firsts(keys)
    return keys[at], [np.add.reduceat(n[order], at) if len(at) else np.empty(0, np.int64) for n in numbers]


def _grams(tails: list[np.ndarray], context: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple:
    """Distinct n-grams by context and word: (contexts, their tails, how many words each has, words, counts)."""
    order = np.lexsort((words, context))
    context, words = context[order], words[order]
    at = _firsts(context, words)
    counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    context, words = context[at], words[at]
    own = _firsts(context)
    return context[own], [t[order][at][own] for t in tails], np.diff(own, append=len(context)), words, counts


@dataclass(frozen=True)
class Grid:
    """Buckets of n-grams: ``rows`` bits of the context by ``columns`` bits of the word; words and contexts by all bits."""

    bits: int

    @property
    def columns(self) -> int:
        return self.bits // 2

    def of_grams(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        rows = self.bits - self.columns
        return (self._top(context, rows) << self.columns) | self._top(words, self.columns)

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        return self._top(keys, self.bits)

    @staticmethod
    def _top(keys: np.ndarray, bits: int) -> np.ndarray:
        return (_spread(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _parts(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places of its rows, in their order."""
    order = np.argsort(buckets, kind="stable")
    at = _firsts(buckets[order])
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(buckets[order[a]]), order[a:b]


_BLOCK = "kind int, bucket int, data binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["kind", "bucket", "data"])


def _gram_rows(kind: int, grid: Grid, tails: list[np.ndarray], context: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    for bucket, at in _parts(grid.of_grams(context, words)):
        own, own_tails, many, last, sums = _grams([t[at] for t in tails], context[at], words[at], counts[at])
        yield kind, bucket, _pack(own, many.astype(np.uint32), last, sums.astype(np.uint32), *own_tails)


def _key_rows(kind: int, grid: Grid, keys: np.ndarray, *numbers: np.ndarray) -> Iterator[tuple]:
    keys, numbers = _summed(keys, *numbers)
    for bucket, at in _parts(grid.of_keys(keys)):
        yield kind, bucket, _pack(keys[at], *(n[at].astype(np.uint64) for n in numbers))


def _counted(order: int, grid: Grid, most_tokens: int):
    def block(texts: list) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _ in texts])
        before = [np.concatenate([c[i] for _, c in texts]) for i in range(order - 1)]
        one, none = np.ones(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        rows = [*_key_rows(WORDS, grid, tokens, one, none)]
        if order > 1:
            rows += _gram_rows(order, grid, before[:-1][::-1], before[-1], tokens, one)
        return pa.RecordBatch.from_pandas(_frame(rows), schema=_ARROW, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                tokens, starts = _joined(part.column("text").to_pylist())
                held.append((tokens, contexts(tokens, starts, order)))
                size += len(tokens)
                if size >= most_tokens:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)
    return run


def _write(uri: str, name: str, array: np.ndarray) -> None:
    with written(uri, name) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).ravel().tobytes() if len(array) else b"")


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """In half the bytes where all of them fit."""
    return numbers.astype(np.uint32 if numbers.max(initial=0) < 2 ** 32 else np.int64)


def _merged(order: int, grid: Grid, uri: str):
    """Merge one bucket: n-grams of ``order`` are written, their contexts' totals and what they say of the order below passed on."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(key[0]), int(key[1])
        blocks = [_unpack(b) for b in rows.pop("data")]
        if kind == CONTEXTS or kind == WORDS:
            own, numbers = _summed(*(np.concatenate([b[i] for b in blocks]) for i in range(len(blocks[0]))))
            return _frame([(kind, bucket, _pack(own, *numbers))])
        many = [b[1] for b in blocks]
        context = np.concatenate([np.repeat(b[0], m) for b, m in zip(blocks, many)])
        tails = [np.concatenate([np.repeat(b[i], m) for b, m in zip(blocks, many)]) for i in range(4, 4 + order - 2)]
        words, counts = (np.concatenate([b[i] for b in blocks]) for i in (2, 3))
        del blocks
        own, tails, many, words, counts = _grams(tails, context, words, counts.astype(np.int64))
        del context
        name = f"{order}-{bucket}"
        begins = np.cumsum(many) - many
        _write(uri, f"{name}.contexts", own)
        _write(uri, f"{name}.begins", _narrow(np.append(begins, len(words))))
        _write(uri, f"{name}.words", words)
        _write(uri, f"{name}.counts", np.minimum(counts, 255).astype(np.uint8))
        high = np.flatnonzero(counts >= 255)
        _write(uri, f"{name}.many", np.concatenate([high, counts[high]]).astype(np.int64))
        total = lambda x: np.add.reduceat(x.astype(np.int64), begins)
        out = [*_key_rows(CONTEXTS, grid, own, total(counts), total(counts == 1), total(counts == 2), total(counts > 2))]
        one, none = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
        if order == 2:
            out += _key_rows(WORDS, grid, words, none, one)
        else:
            below = [np.repeat(t, many) for t in tails]
            out += _gram_rows(order - 1, grid, below[1:], below[0], words, one)
        return _frame([*out, (NUMBERS, -1, _NUMBER.join([np.sum(counts == i) for i in (1, 2, 3, 4)]))])
    return run


def _key_arrays(uri: str):
    """Write a bucket of words (count, contexts before it) or of contexts (total, kinds of successors)."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(key[0]), int(key[1])
        blocks = [_unpack(b) for b in rows["data"]]
        own, numbers = _summed(*(np.concatenate([b[i] for b in blocks]) for i in range(len(blocks[0]))))
        numbers = [n.astype(np.int64) for n in numbers]
        name = f"words-{bucket}" if kind == WORDS else f"contexts-{kind - CONTEXTS}-{bucket}"
        _write(uri, f"{name}.keys", own)
        _write(uri, f"{name}.stats", _narrow(np.array(numbers, np.int64).T))
        if kind != WORDS:
            return _frame([])
        counts, ahead = numbers
        sums = [counts.sum(), (counts > 0).sum(), ahead.sum(), *((ahead == i).sum() for i in (1, 2, 3, 4)), (ahead > 2).sum()]
        return _frame([(NUMBERS, -1, _NUMBER.join(sums))])
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; 0.5, 1, 1.5 where the counts of counts cannot give them."""
    if not min(n1, n2, n3, n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


class _Maps:
    """Mapped arrays of one model, kept by the worker; a model in a store that is no folder is fetched file by file.

    A fetched file has no name any more once it is mapped, so nothing of it outlives the map.
    """

    def __init__(self, uri: str):
        self.uri, self.root, self.arrays = uri, local_path(uri), {}

    def get(self, name: str, kind) -> np.ndarray:
        if name not in self.arrays:
            path = f"{self.root}/{name}" if self.root else self._fetched(name)
            empty = not path or not os.path.exists(path) or not os.path.getsize(path)
            self.arrays[name] = np.empty(0, kind) if empty else np.memmap(path, kind, "r")
            if path and not self.root:
                os.unlink(path)
        return self.arrays[name]

    def numbers(self, name: str, count: int) -> np.ndarray:
        """``count`` integers that ``_narrow`` wrote."""
        raw = self.get(name, np.uint8)
        return raw.view(np.uint32 if len(raw) == 4 * count else np.int64)

    def _fetched(self, name: str) -> str | None:
        store, base = store_of(self.uri)
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
            return None
        handle, path = tempfile.mkstemp(prefix="lm-")
        os.close(handle)
        fs.copy_files(f"{base}/{name}", path, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        return path


_OPEN: dict[str, _Maps] = {}


def _maps(uri: str) -> _Maps:
    """The maps of a model; a worker keeps those of one model at a time."""
    if uri not in _OPEN:
        _OPEN.clear()
        _OPEN[uri] = _Maps(uri)
    return _OPEN[uri]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all tokens share; ``gram_discounts``: of orders 2, 3, .."""

    uri: str
    order: int
    grid: Grid
    tokens: int
    vocabulary: int
    kinds: int
    word_discounts: np.ndarray
    word_rest: float
    gram_discounts: list[np.ndarray] = field(default_factory=list)

    def _key_stats(self, name: str, asked: np.ndarray, width: int) -> np.ndarray:
        """Numbers of some keys; zeros for those the model does not have."""
        keys, back = np.unique(asked, return_inverse=True)
        out = np.zeros((len(keys), width), np.int64)
        maps = _maps(self.uri)
        for bucket, at in _parts(self.grid.of_keys(keys)):
            own = maps.get(f"{name}-{bucket}.keys", np.uint64)
            if len(own):
                place = np.searchsorted(own, keys[at])
                place[place == len(own)] = 0
                there = own[place] == keys[at]
                out[at[there]] = maps.numbers(f"{name}-{bucket}.stats", len(own) * width).reshape(-1, width)[place[there]]
        return out[back]

    def _gram_counts(self, order: int, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        maps, out = _maps(self.uri), np.zeros(len(words), np.int64)
        for bucket, at in _parts(self.grid.of_grams(context, words)):
            name = f"{order}-{bucket}"
            own = maps.get(f"{name}.contexts", np.uint64)
            if not len(own):
                continue
            place = np.searchsorted(own, context[at])
            place[place == len(own)] = 0
            at, place = at[own[place] == context[at]], place[own[place] == context[at]]
            begins, last = maps.numbers(f"{name}.begins", len(own) + 1), maps.get(f"{name}.words", np.uint64)
            low, end = begins[place].astype(np.int64), begins[place + 1].astype(np.int64)
            high, asked = end.copy(), words[at]
            while (wide := low < high).any():  # binary search, all queries at once
                middle = (low + high) // 2
                less = np.zeros(len(low), bool)
                less[wide] = last[middle[wide]] < asked[wide]
                low, high = np.where(wide & less, middle + 1, low), np.where(wide & ~less, middle, high)
            there = low < end
            there[there] = last[low[there]] == asked[there]
            found = maps.get(f"{name}.counts", np.uint8)[low[there]].astype(np.int64)
            if (found == 255).any():
                many, exact = maps.get(f"{name}.many", np.int64).reshape(2, -1)
                found[found == 255] = exact[np.searchsorted(many, low[there][found == 255])]
            out[at[there]] = found
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, and log10 probability under the model."""
        tokens, starts = _joined(texts)
        own = self._key_stats("words", tokens, 2)
        counts, ahead = own.T
        share = np.maximum(ahead - self.word_discounts[np.minimum(ahead, 3)], 0)
        chance = self.word_rest / (self.vocabulary + 1) + (share / self.kinds if self.kinds else 0.0)
        for order, before in enumerate(contexts(tokens, starts, self.order), 2):
            discount = self.gram_discounts[order - 2]
            about = self._key_stats(f"contexts-{order}", before, 4)
            count = self._gram_counts(order, before, tokens)
            total, rest = about[:, 0], about[:, 1:] @ discount[1:]
            share = np.maximum(count - discount[np.minimum(count, 3)], 0)
            chance = np.where(total > 0, (share + rest * chance) / np.maximum(total, 1), chance)
        base = np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        ends = np.append(starts[1:], len(tokens))
        return (ends - starts, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(chance), starts))


class _NUMBER:
    """Integers of a bucket as text, which Spark adds up: a row for each place comes back, however many buckets there are."""

    @staticmethod
    def join(numbers) -> bytes:
        return ",".join(str(int(n)) for n in numbers).encode()

    @staticmethod
    def sums(rows: DataFrame, width: int) -> list[int]:
        at = rows.where(F.col("kind") == NUMBERS).select(F.posexplode(F.split(F.col("data").cast("string"), ",")).alias("i", "v"))
        found = {r["i"]: int(r["s"]) for r in at.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
        return [found.get(i, 0) for i in range(width)]


def train(docs: DataFrame, order: int = 2, text_col: str = "text", bucket_bytes: int = 8_000_000, most_tokens: int = 1_200_000) -> Model:
    """Count all of ``docs`` (whole texts, null: empty) into a model of n-grams up to ``order`` in the shared folder.

    A bucket takes ``bucket_bytes`` of text on average, whatever the number of texts or partitions.  An empty table gives a model
    that knows no token.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    grid = Grid(max(0, int(size // bucket_bytes)).bit_length())
    uri = scratch_path(spark, "lm")
    rows = texts.mapInArrow(_counted(order, grid, most_tokens), _BLOCK)
    grams, keys = [], []
    for k in range(order, 1, -1):
        rows = materialize(rows.groupBy("kind", "bucket").applyInPandas(_merged(k, grid, uri), _BLOCK), f"lm-{k}")
        grams.insert(0, discounts(*_NUMBER.sums(rows, 4)))
        keys.append(rows.where(F.col("kind") == CONTEXTS).withColumn("kind", F.lit(CONTEXTS + k)))
        rows = rows.where(F.col("kind").between(WORDS, CONTEXTS - 1))
    for part in keys:
        rows = rows.unionByName(part)
    ends = materialize(rows.groupBy("kind", "bucket").applyInPandas(_key_arrays(uri), _BLOCK), "lm-ends")
    tokens, vocabulary, kinds, n1, n2, n3, n4, more = _NUMBER.sums(ends, 8)
    word = discounts(n1, n2, n3, n4)
    rest = float(word[1:] @ [n1, n2, more]) / kinds if kinds else 1.0
    return Model(uri, order, grid, tokens, vocabulary, kinds, word, rest, grams)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most_texts: int = 512) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``.

    A null or empty text is the end mark alone; an untrained model gives every token probability 1 over its empty vocabulary.
    Null and repeated doc_ids pass through, one row each; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, most_texts) for i in range(0, batch.num_rows, most_texts)):
                n, known, base, own = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()),
                     pa.array(base), pa.array(own), pa.array(10 ** (-own / n))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return doc_rows(docs, id_col, text_col).mapInArrow(run, schema)
