"""Licence scans with a generalised suffix automaton over licence words.

All templates and phrases form one automaton whose symbols are words.  A text is
streamed through it once; at each word the automaton holds the longest match that
ends there (the matching statistics).  Right-maximal matches of ``least_match`` words
or more are looked up in the templates and chained in order, which gives the
covered template spans; a template is found wherever a chain covers ``least_cover`` of its
words, as often as chains that do not overlap do.  Phrases are read off the same states.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_rows, text_words
from .license_texts import NOTICES, TAG, templates  # noqa: F401

TEMPLATES = templates()

# Phrases and their labels (given by the contract).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Words that tell licences apart wherever they stand; those that do before "general"; those that do after BY or NC.
ALWAYS = frozenset(b"noncommercial sharealike noderivatives noderivs neither".split())
BEFORE_GENERAL = frozenset(b"lesser affero library".split())
AFTER_BY = frozenset(b"nc sa nd".split())
#: A number after one of these is a version; so is a second number, unless it is 0.
BEFORE_VERSION = frozenset(b"version v by nc sa nd attribution noncommercial sharealike noderivatives noderivs license licence cc0 bsd".split())


def telling(words: list[bytes]) -> list[int]:
    """How many of the words before each place tell licences apart (one entry more than words)."""
    out, before, before2, n = [0], b"", b"", 0
    for i, w in enumerate(words):
        if w in ALWAYS or w in AFTER_BY and before in (b"by", b"nc"):
            n += 1
        elif w in BEFORE_GENERAL and words[i + 1:i + 2] == [b"general"]:
            n += 1
        elif w.isdigit() and (before in BEFORE_VERSION or before.isdigit() and before2 in BEFORE_VERSION and w != b"0"):
            n += 1
        out.append(n)
        before2, before = before, w
    return out


def told_before(words: list[bytes]) -> list[bool]:
    """Whether the words from each place on that tell licences apart all stand before it already (one entry more than words)."""
    own = telling(words)
    told = [w if own[i + 1] > own[i] else None for i, w in enumerate(words)]
    return [{*told[i:]} - {None} <= {*told[:i]} for i in range(len(words) + 1)]


class Automaton:
    """Generalised suffix automaton of word sequences; ``outputs`` and ``ends`` say what a state matches."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.symbols: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.templates = {name: len(text_words(t)) for name, t in templates.items()}
        self.telling = {name: telling(text_words(t)) for name, t in templates.items()}
        self.told_before = {name: told_before(text_words(t)) for name, t in templates.items()}
        self.shortest = min((len(text_words(t)) for t in [*phrases, *templates.values()]), default=0)
        own_ends: dict[int, set[tuple[str, int]]] = {}
        for name, text in templates.items():
            state = 0
            for end, symbol in enumerate(self._symbols(text), 1):
                state = self._extend(state, symbol)
                own_ends.setdefault(state, set()).add((name, end))
        for text in phrases:
            state = 0
            for symbol in self._symbols(text):
                state = self._extend(state, symbol)
        self.ends: list[list[tuple[str, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[state] = sorted(own_ends.get(state, ()))
            own_ends.setdefault(self.link[state], set()).update(own_ends.get(state, ()))
        at: dict[int, list[tuple[int, str]]] = {}
        for text, label in phrases.items():
            at.setdefault(self._walk(text), []).append((len(text_words(text)), label))
        self.outputs: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.outputs[state] = self.outputs[self.link[state]] + at.get(state, [])

    def _symbols(self, text: str) -> list[int]:
        return [self.symbols.setdefault(w, len(self.symbols) + 1) for w in text_words(text)]

    def _walk(self, text: str) -> int:
        state = 0
        for symbol in self._symbols(text):
            state = self.next[state][symbol]
        return state

    def _new(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(next_)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state for the longest match of ``state`` followed by ``symbol``, cut off its longer class if needed."""
        to = self.next[state][symbol]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(symbol) == to:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new

    def matches(self, words: list[bytes], least_match: int) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
        """(phrase places as (start, words, label), right-maximal matches as (end, words, state)) of a text."""
        get = self.symbols.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate(([0], ids != 0, [0])).astype(np.int8)
        edges = np.diff(known)
        phrases, found = [], []
        next_, link, length, outputs = self.next, self.link, self.length, self.outputs
        for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if end - begin < min(2, self.shortest):
                continue
            state = size = 0
            for i, symbol in enumerate(ids[begin:end].tolist(), begin):
                before, before_size = state, size
                while state and symbol not in next_[state]:
                    state = link[state]
                    size = length[state]
                if symbol in next_[state]:
                    state = next_[state][symbol]
                    size += 1
                if size <= before_size and before_size >= least_match:
                    found.append((i, before_size, before))
                for n, label in outputs[state]:
                    if n <= size:
                        phrases.append((i + 1 - n, n, label))
            if size >= least_match:
                found.append((end, size, state))
        return phrases, found

    def pieces(self, found: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int, int]]]:
        """Per template its matches as (end in the text, end in the template, words), in order."""
        by_name: dict[str, list[tuple[int, int, int]]] = {}
        for end, size, state in found:
            for name, at in self.ends[state]:
                by_name.setdefault(name, []).append((end, at, size))
        return {name: sorted(pieces) for name, pieces in by_name.items()}

    def chains(self, found: list[tuple[int, int, int]], gap: int, told: list[int] | None = None) -> dict[str, tuple[float, int, int]]:
        """Per template the best chain of matches in order: (share of its words covered, first word, one past the last word)."""
        out = {}
        for name, pieces in self.pieces(found).items():
            chain: list[tuple[int, int, int, int]] = []  # covered words, first word, end in the text, end in the template
            best = (0, 0, 0)
            for end, at, size in pieces:
                covered, first = min(size, at), end - size
                for before, start, text_end, template_end in reversed(chain):
                    if end - size - text_end > gap:
                        break
                    new = min(at - max(template_end, at - size), end - max(text_end, end - size))  # no word counts twice
                    if text_end < end and template_end < at and new > 0 and before + new > covered and self._same(name, told, text_end, end - size, template_end, at - size):
                        covered, first = before + new, start
                chain.append((covered, first, end, at))
                best = max(best, (covered, -first, end))
            out[name] = (best[0] / self.templates[name], -best[1], best[2])
        return out

    def _same(self, name: str, told: list[int] | None, text_end: int, text_next: int, template_end: int, template_next: int) -> bool:
        """No word that tells licences apart is left out of the text or the template between two matches."""
        if told is None:
            return True
        own = self.telling[name]
        return told[max(text_next, text_end)] == told[text_end] and own[max(template_next, template_end)] == own[template_end]

    def spans(self, name: str, pieces: list[tuple[int, int, int]], gap: int, least_cover: float, told: list[int] | None = None) -> list[tuple[float, int, int]]:
        """The chains of a template as in ``chains``, all that reach ``least_cover``: those that do not overlap and cover most in sum.

        With ``told`` (``telling`` of the text) a chain holds all words of the template that tell it apart, save that at its end
        it may miss some that it holds earlier, and the text has no other
        such word inside the chain or right at its ends.
        """
        words, own = self.templates[name], self.telling[name]
        chains: list[list[tuple[int, int]]] = []  # per piece (first word, covered words) of the chains that end with it, none better in both
        ends = [end for end, _, _ in pieces]
        total, chosen = [0], [None]  # best sum over the first pieces; the chain that it ends with
        for i, (end, at, size) in enumerate(pieces):
            first = end - size
            begins = told is None or not own[max(at - size, 0)] and told[first] == told[max(first - 1, 0)]
            best = {first: min(size, at)} if begins else {}
            for j in range(i - 1, -1, -1):
                text_end, template_end, _ = pieces[j]
                if end - size - text_end > gap:
                    break
                new = min(at - max(template_end, at - size), end - max(text_end, end - size))  # no word counts twice
                if text_end < end and template_end < at and new > 0 and self._same(name, told, text_end, end - size, template_end, at - size):
                    for first, before in chains[j]:
                        best[first] = max(best.get(first, 0), before + new)
            kept, most = [], 0
            for first in sorted(best, reverse=True):
                if best[first] > most:
                    most = best[first]
                    kept.append((first, most))
            chains.append(kept)
            total.append(total[-1])
            chosen.append(None)
            whole = told is None or self.told_before[name][at] and told[min(end + 1, len(told) - 1)] == told[end]
            for first, covered in kept if whole else ():
                if covered / words >= least_cover and covered + total[before := bisect_right(ends, first, 0, i)] > total[-1]:
                    total[-1], chosen[-1] = covered + total[before], (covered / words, first, end, before)
        out, i = [], len(pieces)
        while i:
            if chosen[i]:
                out.append(chosen[i][:3])
                i = chosen[i][3]
            else:
                i -= 1
        return out[::-1]


def _longest(spans: list[tuple[str, float, int, int]], lengths: dict[str, int]) -> list[dict]:
    """Of spans that share more than half of the words of the lesser one, the one that covers most words; by label and place."""
    out: list[tuple[str, float, int, int]] = []
    for name, cover, first, end in sorted(spans, key=lambda s: (-round(s[1] * lengths[s[0]]), s[0], s[2])):
        if all(2 * (min(end, e) - max(first, f)) <= min(end - first, e - f) for _, _, f, e in out):
            out.append((name, cover, first, end))
    rows = sorted({(name.split("#")[0], first, end): cover for name, cover, first, end in out}.items())
    return [{"template": label, "first": first, "end": end, "cover": cover} for (label, first, end), cover in rows]


def _least(name: str, least_cover: float) -> float:
    """A tag holds its whole id; other templates need ``least_cover``."""
    return 1.0 if name.rpartition("#")[2].startswith(TAG) else least_cover


def _scan(automaton: Automaton, least_match: int, least_cover: float, gap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                        ("spans", pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])))])

    def one(doc_id, text) -> tuple:
        words = text_words(text)
        phrases, found = automaton.matches(words, least_match)
        told = telling(words) if found else [0]
        chains = automaton.chains(found, gap, told)
        starts, base = [p[0] for p in phrases], {p[2] for p in phrases}
        pieces = automaton.pieces(found)
        spans = [(n, *s) for n in chains if chains[n][0] >= _least(n, least_cover) for s in automaton.spans(n, pieces[n], gap, _least(n, least_cover), told)]
        covers = [c for n, (c, _, _) in chains.items() if c < _least(n, least_cover) and not n.rpartition("#")[2].startswith(TAG)]
        cover = max(covers + [s[1] for s in spans] + [1.0] * bool(base), default=0.0)
        spans = _longest(spans, automaton.templates)
        labels = base | {s["template"] for s in spans}
        return (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), cover, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column("doc_id"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows
                                             else [pa.array([], f.type) for f in schema], schema=schema)
    return run


def license_scan(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, str] = TEMPLATES, least_match: int = 3,
                 least_cover: float = 0.8, gap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base``: places where a phrase's words stand consecutively; first/last_word: their least and greatest start
    (null without any).  ``spans``: every place of a template whose chain of matches covers ``least_cover`` of
    its words (at most ``gap`` foreign words between matches) and agrees with it in all words that tell licences apart
    (``telling``: versions, Affero, Lesser, NC, SA, ND, ..); of spans over the same words the one that covers most; an SPDX tag
    stands with its whole id.  A template's label is its name up to ``#``.  ``labels``: those of the spans and the phrases.
    ``score``: the greatest cover of any template, one that reaches ``least_cover`` only as a span; 1 when a phrase stands in the text.  A null or empty text has no words and
    score 0; a null doc_id and repeated rows pass through, one row each; other columns are ignored.
    """
    schema = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
              "score double, spans array<struct<template: string, first: bigint, end: bigint, cover: double>>")
    return doc_rows(docs, id_col, text_col).mapInArrow(_scan(Automaton(phrases, templates), least_match, least_cover, gap), schema)
