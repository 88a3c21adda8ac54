"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The encoding of a prefix of a piece ends in exactly one token: the vocabulary
token that is a suffix of the prefix and fits after the encoding of what stands
before it (two tokens fit when merging their joined bytes gives the two back).  So
each position of a piece has one predecessor, and the final encoding is a path of
predecessors.  A token is settled as soon as every position at which a token
reaching past the input could still begin agrees on it; that lookahead is bounded by
the longest token.  A state of the transducer is what is left to settle: the last settled
token and the bytes after it.  States and transitions are made when first met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows

_NONE = -1


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file: base64 of the token's bytes, a blank, its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes pieces of bytes by merge ranks, lowest rank first, leftmost first.

    A state is (last settled token, open bytes, the token that ends each open
    prefix, the live positions: those at which a token reaching past the input
    could begin).  States are numbered and their transitions kept, both up to ``most_states``.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.most_states = most_states
        self._begins = {t[:n] for t in ranks for n in range(1, len(t))}
        self._fit: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._states = [(_NONE, b"", (), (0,))]
        self._number = {self._states[0]: 0}
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """Plain merging, for the joined bytes of at most two tokens."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (_NONE: begin a piece)?"""
        key = (left, right)
        fit = self._fit.get(key)
        if fit is None:
            if len(self._fit) >= 4 * self.most_states:
                self._fit.clear()
            if left == _NONE:
                fit = self._merge(self.bytes_of[right]) == [right]
            else:
                fit = self._fits(_NONE, right) and self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._fit[key] = fit
        return fit

    def _trail(self, path: tuple[int, ...], end: int) -> list[int]:
        """Tokens from the settled boundary to position ``end``."""
        out = []
        while end:
            out.append(path[end - 1])
            end -= self.length[path[end - 1]]
        return out[::-1]

    def _settle(self, path: tuple[int, ...], live: list[int]) -> int:
        """The last position through which the trails of all live positions pass."""
        cut = live[0]
        for end in live[1:]:
            while cut != end:
                if cut > end:
                    cut -= self.length[path[cut - 1]]
                else:
                    end -= self.length[path[end - 1]]
        return cut

    def _step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """(next state, tokens settled) for one more byte, made when first met."""
        settled, open_, path, live = self._states[number]
        open_ += bytes((byte,))
        last, still = _NONE, []
        for start in live:
            tail = open_[start:]
            if last == _NONE:
                token = self.ranks.get(tail)
                if token is not None and self._fits(path[start - 1] if start else settled, token):
                    last = token
            if tail in self._begins:
                still.append(start)
        path += (last,)
        if last != _NONE:
            still.append(len(open_))
        cut = self._settle(path, still)
        out = self._trail(path, cut)
        if cut:  # positions on no trail of a live one never count again
            kept = self._on_trails(path, still, cut)
            path = tuple(t if i in kept else _NONE for i, t in enumerate(path[cut:], cut + 1))
            open_, still = open_[cut:], [s - cut for s in still]
            settled = out[-1]
        if 0 not in still:
            settled = _NONE
        if len(self._states) >= self.most_states:
            self._forget()
            number = -1
        state = (settled, open_, path, tuple(still))
        to = self._number.setdefault(state, len(self._states))
        if to == len(self._states):
            self._states.append(state)
        if number >= 0:
            self._steps[number << 8 | byte] = to, tuple(out)
        return to, tuple(out)

    def _on_trails(self, path: tuple[int, ...], live: list[int], cut: int) -> set[int]:
        """Positions after ``cut`` on the trails of the live positions."""
        seen: set[int] = set()
        for end in live:
            while end > cut and end not in seen:
                seen.add(end)
                end -= self.length[path[end - 1]]
        return seen

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        state, out, steps = 0, [], self._steps.get
        for byte in piece:
            state, settled = steps(state << 8 | byte) or self._step(state, byte)
            if settled:
                out += settled
            steps = self._steps.get
        _, _, path, _ = self._states[state]
        return out + self._trail(path, len(path))


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters completed so far, ``close`` the rest.

    The state is the bytes of an unfinished character and how many it lacks; bytes
    that cannot continue become U+FFFD, as in a whole decode with replacement.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the unfinished character at the end of ``data`` (0: none)."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:  # a lead byte: 2, 3 or 4 bytes in all
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need and byte <= 0xF4 and byte >= 0xC2 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Splits a text by ``pattern`` and encodes each match; pieces seen before come from a table of two bounded halves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 400_000, most_states: int = 300_000):
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, most_states)
        self.bytes_of, self.most_pieces = self.transducer.bytes_of, most_pieces
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Half of the bound holds the newest pieces, half those before; pieces met again move to the newer half."""
        if 2 * len(self.pieces) >= self.most_pieces:
            self.pieces, self.older = {}, self.pieces
        ids = self.older.get(piece) or tuple(self.transducer.encode(piece.encode()))
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out = []
        for piece in self.split(text or ""):
            out += self.pieces.get(piece) or self._piece(piece)
        return out

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """The text of ``ids`` in parts, each made of whole characters."""
        stream, ids = Utf8Stream(), list(ids)
        for i in range(0, len(ids), chunk):
            yield stream.feed(b"".join(map(self.bytes_of.__getitem__, ids[i:i + chunk])))
        yield stream.close()


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str, *sizes: int) -> Codec:
    """One codec per Python worker, vocabulary and table sizes."""
    with open(path, "rb") as f:
        return Codec(read_ranks(f), pattern, *sizes)


def _tokens(path: str, pattern: str, digests: bool, keep_tables: bool = True, sizes: tuple[int, ...] = (), rows: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, *sizes)
        try:
            for batch in batches:
                for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                    ids = [codec.encode(t.as_py()) for t in part.column("text")]
                    if not digests:
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                        continue
                    sha = lambda parts: (h := hashlib.sha256(), [h.update(p) for p in parts])[0].hexdigest()
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([sha([" ".join(map(str, x)).encode()]) for x in ids]),
                         pa.array([sha(t.encode() for t in codec.decode_stream(x)) for x in ids])],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            if not keep_tables:  # the memory goes back to the system, not to the worker's next task
                _codec.cache_clear()
                del codec
                pa.default_memory_pool().release_unused()
    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``; a null or empty text has no ids; other columns are ignored.

    ``path`` names a rank file that every worker can read, ``pattern`` splits a text into pieces.
    """
    return doc_rows(docs, id_col, text_col).mapInArrow(_tokens(path, pattern, False), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, keep_tables: bool = True, most_pieces: int = 400_000, most_states: int = 300_000,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one blank) and decoded_sha256 (the decoded bytes) of every row.

    A null text counts as empty; null and repeated doc_ids pass through, one row each; other columns are ignored.
    ``keep_tables`` leaves what a task learnt to the worker's next task, for speed; without it the memory is free for
    other stages.  ``most_pieces`` and ``most_states`` bound the tables of a worker.  The rows are the same.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return doc_rows(docs, id_col, text_col).mapInArrow(_tokens(path, pattern, True, keep_tables, (most_pieces, most_states)), schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): streamed UTF-8, unknown bytes as U+FFFD; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            texts = ["".join(codec.decode_stream(x.as_py() or ())) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return tokens.select("doc_id", F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
