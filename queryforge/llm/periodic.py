"""Runs (maximal periodic stretches of words) by the branching-tandem test on an enhanced suffix array.

Texts are taken in blocks; each block is one numpy computation over all its words.

1. Only stretches in which every word occurs often enough to be in a run are kept: a run of exponent e holds
   each of its words floor(e) times, and a word outside cannot extend it.  The rest of the text has no run.
2. Suffix array, inverse (ISA) and LCP array of those stretches by prefix doubling, which sorts again only the
   suffixes not yet told apart; stretches never share a group.  The ranks of every doubling step stay at hand.
3. LCP intervals are pairs of array bounds (nearest smaller LCP to the left and right), no tree nodes.  For an
   interval of depth d, every suffix i of all children but the largest asks whether ISA[i + d] or ISA[i - d]
   is inside the interval and outside i's own child: then a square of period d branches there.
4. A run of period d has one branching square of that period, at its end; it rotates to the left, by powers of
   two, as long as the words agree, which gives the run's start.  Squares of multiples of a period end in the
   same stretch and merge into the one with the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_rows


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _frequent(words: np.ndarray, doc: np.ndarray, least: int, times: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(positions, stretch of each): stretches of ``least`` words or more, each of them ``times`` times or more in its stretch.

    After ``rounds`` the stretches are taken as they are: what is left out has no run in any case.
    """
    at, part, kinds = np.arange(len(words)), doc, int(words.max(initial=0)) + 1
    for _ in range(rounds):
        _, of, count = np.unique(part * np.int64(kinds) + words[at], return_inverse=True, return_counts=True)
        often = count[of] >= times
        before, at, part = len(at), at[often], part[often]
        part = np.cumsum(_changes(part, at - np.arange(len(at)))) - 1
        long = np.bincount(part, minlength=1)[part] >= least
        at, part = at[long], part[long]
        if len(at) == before:
            break
    return at, part


def _ranks(keys: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Level k: equal numbers where 2^k words are equal, in the order of the suffixes; all differ in the last. One entry more, -1, at the end.

    ``end`` is where the stretch of each position ends; ``keys`` of two stretches differ.
    """
    size = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(_changes(keys[order]))
    many = np.diff(new, append=size)
    rank = np.full(size + 1, -1, np.int32)
    rank[order] = np.repeat(new, many)
    levels, step, active = [rank], 1, order[np.repeat(many > 1, many)]
    while len(active):
        own = rank[active].astype(np.int64)
        ahead = active + step
        keys = own * (size + 1) + np.where(ahead < end[active], rank[np.minimum(ahead, size)] + 1, 0)
        order = np.argsort(keys, kind="stable")
        active, own = active[order], own[order]
        at = np.arange(len(active))
        fresh = _changes(keys[order])
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        group = np.maximum.accumulate(np.where(_changes(own), at, 0))
        rank = rank.copy()
        rank[active] = own + start - group
        many = np.diff(np.flatnonzero(fresh), append=len(active))
        active = active[np.repeat(many > 1, many)]
        levels.append(rank)
        step *= 2
    return levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at ``i`` and ``j`` have in common."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        out += (levels[k][i + out] == levels[k][j + out]).astype(np.int64) << k
    return out


def _nearest_smaller(lcp: np.ndarray, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each index in ``asked``, the nearest ones to the left and right with a smaller value, at most ``most`` away."""
    tables = [lcp]
    while 1 << len(tables) <= most:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        tables.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    value, left, right = lcp[asked], asked - 1, asked + 1
    for k in range(len(tables) - 1, -1, -1):
        table, width = tables[k], 1 << k
        if len(table):
            start = left - width + 1
            left = left - width * ((start >= 0) & (table[np.maximum(start, 0)] >= value))
            right = right + width * ((right < len(table)) & (table[np.minimum(right, len(table) - 1)] >= value))
    return left, right


def _squares(levels: list[np.ndarray], most: np.ndarray, times: int, slice_rows: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of branching squares with a period up to ``most`` at their place, of intervals of ``times`` suffixes or more."""
    isa = levels[-1]
    size = len(isa) - 1
    order = np.empty(size, np.int64)
    order[isa[:-1]] = np.arange(size)
    lcp = np.zeros(size + 1, np.int64)
    lcp[1:-1] = _common(levels, order[:-1], order[1:])
    widest = int(np.bincount(levels[0][:-1]).max(initial=1)) + 1  # an interval has one first word
    asked = np.flatnonzero(lcp > 0)
    low, high = _nearest_smaller(lcp, asked, widest)
    fit = (high - low >= times) & (lcp[asked] <= most[order[asked]])
    asked, low, high = asked[fit], low[fit], high[fit]
    depth = lcp[asked]
    by = np.lexsort((asked, depth, low))
    asked, low, high, depth = asked[by], low[by], high[by], depth[by]
    # children of one interval end at its asked indices, the last one at its upper bound
    first = _changes(low, depth)
    group = np.cumsum(first) - 1
    last = np.flatnonzero(first[1:].tolist() + [True] if len(first) else [])
    start = np.concatenate([np.where(first, low, np.roll(asked, 1)), asked[last]])
    end = np.concatenate([asked, high[last]])
    low, high, depth = (np.concatenate([x, x[last]]) for x in (low, high, depth))
    group = np.concatenate([group, group[last]])
    width = end - start
    by = np.lexsort((-width, group))
    smaller = by[~_changes(group[by])]  # all but the largest child of each interval
    start, end, low, high, depth, width = (x[smaller] for x in (start, end, low, high, depth, width))
    done = np.cumsum(width)
    edges = np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, slice_rows))
    for a, b in zip(edges, [*edges[1:], len(done)]):
        child = np.repeat(np.arange(a, b), width[a:b])
        place = np.arange(len(child)) - np.repeat(done[a:b] - width[a:b] - (done[a] - width[a]) if b > a else done[:0], width[a:b]) + start[child]
        suffix, period = order[place], depth[child]
        for partner, square in ((suffix + period, suffix), (suffix - period, suffix - period)):
            rank = isa[np.where((partner < 0) | (partner > size), size, partner)]
            hit = (rank >= low[child]) & (rank < high[child]) & ((rank < start[child]) | (rank >= end[child]))
            yield square[hit], period[hit]


def find_runs(words: np.ndarray, doc: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period), by start then period, of all runs in ``words`` (numbers), whose text numbers ``doc`` never fall.

    A run is a stretch inside one text with smallest period q and at least max(least_length, least_exponent * q) words
    that no neighbouring word extends; ``least_exponent`` is 2 or more.
    """
    assert least_exponent >= 2
    at, part = _frequent(words, doc, max(least_length, least_exponent), least_exponent)
    if not len(at):
        return np.empty((0, 3), np.int64)
    begins = np.flatnonzero(_changes(part))
    sizes = np.diff(begins, append=len(at))
    begin, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    levels = _ranks(part.astype(np.int64) * (int(words.max()) + 1) + words[at], end)
    found = list(_squares(levels, (end - begin) // least_exponent, least_exponent))
    square, period = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((), ())))
    both = np.unique(square * np.int64(len(at) + 1) + period)
    square, period = both // (len(at) + 1), both % (len(at) + 1)
    start = square.copy()
    for k in range(len(levels) - 2, -1, -1):
        back = start - (1 << k)
        same = levels[k][np.maximum(back, 0)] == levels[k][np.maximum(back, 0) + period]
        start = np.where((back >= begin[square]) & same, back, start)
    stop = square + 2 * period
    fit = stop - start >= np.maximum(least_length, least_exponent * period)
    start, stop, period = start[fit], stop[fit], period[fit]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    lone = _changes(start, stop)
    start, stop, period = start[lone], stop[lone], period[lone]
    by = np.lexsort((period, start))
    return np.column_stack([at[start], stop - start, period])[by]


def _summary(words: list[bytes], runs: list[list[int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli of the best run, and the two digests, of one text."""
    best = None
    for s, n, q in runs:  # by start then period, so the first of equals is the one wanted
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    kept = words
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


_OUT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
Order = Callable[[int | None, int], np.ndarray | None]


def _block(ids: list[int | None], texts: list[list[bytes]], least_length: int, least_exponent: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts])
    numbers = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    runs = find_runs(numbers, np.repeat(np.arange(len(texts)), sizes), least_length, least_exponent)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1  # of several texts at one place, all but the last are empty
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs[:, 0] -= starts[owner]
    rows = [_summary(t, runs[a:b].tolist()) for t, a, b in zip(texts, edges, edges[1:])]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [c.split()[0] for c in _OUT.split(", ")])


def collapse_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, order: Order | None = None, most_words: int = 400_000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: n_runs, its run with the greatest exponent, and digests of all runs and of the text without repetitions.

    Words are what stands between blanks.  ``order(doc_id, n)``, where given, names the words to take, in order, or None for all n
    as they are.  A word goes if a run holds it after the run's first period; the kept ones are joined by one space.  Of equal
    exponents the smallest start counts, then the smallest period.  A null or empty text has no words and no runs; null and repeated
    doc_ids pass through, one row each; other columns are ignored; an empty table gives no rows.  A task holds about
    ``most_words`` words, or one text if that has more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode().split()
                which = order(i, len(words)) if order else None
                words = words if which is None else [words[k] for k in which.tolist()]
                if texts and size + len(words) > most_words:
                    yield _block(ids, texts, least_length, least_exponent)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
        if texts:
            yield _block(ids, texts, least_length, least_exponent)

    return doc_rows(docs, id_col, text_col).mapInArrow(run, _OUT)
