"""Secret scans: fixed patterns, and a guess-cost model for credential values.

The value that follows a credential word is cut into dictionary words, dates, repeats,
keyboard walks and brute-force characters; dynamic programming finds the cut an
attacker would guess first.  Values whose cheapest cut takes at least ``10 ** least_cost``
guesses are secrets of their own, whatever their alphabet.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_rows

# The patterns given by the contract, with the least length of the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters and more of the maximal run
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Credential words before a value, beyond those of ASSIGN; no letter stands before them, but for the hump of a camelCase name.
CONTEXT = re.compile(r"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))"""
                     r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key)"""
                     r"""["']?[\x20\t]*(?:[:=]|\x20is\x20)[\x20\t]*["']?([^\s"'<>,;]+)""", re.A | re.I)
#: Values that name where a secret comes from and are none: calls, subscripts, variables and templates.
REFERENCE = re.compile(r"""[A-Za-z_][\w.]*[(\[].*|\$[\w({].*|\{\{.*|%[({].*|<.*""", re.A | re.S)
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?P<s>[-/.]?)(?:0\d|1[0-2])(?P=s)(?:[0-2]\d|3[01])|(?:[0-2]\d|3[01])(?P<t>[-/.]?)(?:0\d|1[0-2])(?P=t)(?:19|20)\d\d|(?:19|20)\d\d")
# Cost, in powers of ten, of one brute-force character, a date, a repeat's character, a walk's start, and a cut.
CHARACTER, DAY, REPEAT, WALK, CUT = 1.0, 4.3, 1.5, 1.9, 0.3
COMMON = ("password", "passwd", "letmein", "welcome", "admin", "login", "master", "dragon", "monkey", "shadow", "secret", "changeme",
          "default", "test", "guest", "root", "user", "example", "love", "hello")


def _neighbours() -> dict[str, frozenset[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x), (y + 1, x - 1)):
                if 0 <= v < len(KEYBOARD) and 0 <= u < len(KEYBOARD[v]):
                    near.setdefault(key, set()).add(KEYBOARD[v][u])
    return {k: frozenset(v) for k, v in near.items()}


NEIGHBOURS = _neighbours()


@lru_cache(maxsize=4)
def word_ranks(path: str | None) -> dict[str, int]:
    """Rank of each dictionary word: the common passwords, then the whole words of a public vocabulary file in its order."""
    words = {w: i for i, w in enumerate(COMMON, 1)}
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token in sorted(vocabulary, key=vocabulary.get):
            word = token.removesuffix("</w>")
            if word != token and len(word) > 2 and word.isalpha():
                words.setdefault(word, len(words) + 1)
    return words


def guess_cost(value: str, words: dict[str, int], longest: int = 24) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; linear in its length."""
    low, n = value.lower(), len(value)
    cost = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for m in (m for i in range(n) if value[i].isdigit() and (m := DATE.match(value, i))):
        dates.setdefault(m.end(), []).append(m.start())
    same = walk = 1
    for end in range(1, n + 1):
        if end > 1:
            same = same + 1 if value[end - 1] == value[end - 2] else 1
            walk = walk + 1 if low[end - 1] in NEIGHBOURS.get(low[end - 2], ()) else 1
        best = cost[end - 1] + CHARACTER
        for begin in dates.get(end, ()):
            best = min(best, cost[begin] + DAY + CUT)
        # a word or date may reach into a run from before; none does by more than its length
        for begin in range(end - same, min(end - same + longest, end - 3) + 1):
            best = min(best, cost[begin] + REPEAT + math.log10(end - begin) + CUT)
        for begin in range(end - walk, min(end - walk + longest, end - 3) + 1):
            best = min(best, cost[begin] + WALK + 0.3 * (end - begin) + CUT)
        for begin in range(max(0, end - longest), end - 2):
            rank = words.get(low[begin:end])
            if rank:
                case = 0.0 if value[begin:end].islower() else 0.3 if value[begin:end].istitle() else 1.0
                best = min(best, cost[begin] + math.log10(rank + 1) + case + CUT)
        cost[end] = best
    return cost[n]


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values after credential words; a value that is a credential word itself is followed on."""
    at = 0
    while m := CONTEXT.search(text, at):
        yield m.span(1)
        at = m.start(1)


def find_spans(text: str | None, words: dict[str, int], least_cost: float) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start and then kind; code points, end exclusive."""
    text = text or ""
    out = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "=" in text or ":" in text or " is " in text.lower():
        out += [(a, "guess", b) for a, b in context_values(text) if b - a >= 6 and not REFERENCE.fullmatch(text, a, b)
                and guess_cost(text[a:b], words) >= least_cost]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _scan(path: str | None, least_cost: float):
    def joined(spans) -> str:
        return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ranks(path)
        for batch in batches:
            found = [find_spans(t.as_py(), words, least_cost) for t in batch.column("text")]
            count = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(joined(s for s in x if s[1] != "guess").encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *count, pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def secret_scan(docs: DataFrame, vocabulary: str | None = None, least_cost: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    ``spans`` lists kind:start:end, by start and kind; ``guess`` spans are values after a credential word
    whose cheapest segmentation takes ``10 ** least_cost`` guesses or more; calls, variables and templates are no
    values, and a credential word inside a longer word is none.  ``base_sha256`` covers the other kinds.  ``vocabulary``: a public tokenizer file (JSON) whose whole words serve as the dictionary.
    A null text is empty and has no spans; null and repeated doc_ids pass through; other columns are ignored.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"
    return doc_rows(docs, id_col, text_col).mapInArrow(_scan(vocabulary, least_cost), schema)
