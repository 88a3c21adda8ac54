"""Runs against the definition."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from queryforge.llm import periodic

SCHEMA = "doc_id bigint, text string, start string, period int"


def brute(words, least=6, exponent=4):
    """All runs (start, length, period) by comparing every word with the one q further on."""
    out, seen, n = [], set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts, least=6, exponent=4):
    words = np.array([w for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, n, q in periodic.find_runs(words, doc, least, exponent).tolist():
        d = doc[s]
        out[d].append((s - starts[d], n, q))
    return out


def expected(doc_id, text, plant=None):
    words = (text or "").encode().split()
    if plant:
        words = plant(doc_id, words)
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=60),
                          st.tuples(st.lists(st.integers(0, 3), max_size=5), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(3, 9),
                                    st.lists(st.integers(0, 3), max_size=5)).map(lambda x: x[0] + x[1] * x[2] + x[3])), max_size=8),
       st.sampled_from([(6, 4), (2, 2), (1, 3), (6, 2)]))
def test_runs_equal_brute_force(texts, bounds):
    assert runs_of(texts, *bounds) == [brute(t, *bounds) for t in texts]


def test_runs_of_one_word_and_of_large_blocks():
    rng = np.random.default_rng(2)
    texts = [[0] * 5, [0] * 6, [0] * 2000, [], [1, 2] * 900 + [1], list(range(50)) * 7 + list(range(20))]
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 30))
        texts.append([*a, *np.tile(b, rng.integers(1, 9)), *np.tile(a, rng.integers(1, 9)), *b])
    assert runs_of(texts) == [brute(t) for t in texts]


def test_slices_of_children_give_the_same_squares():
    rng = np.random.default_rng(3)
    words = np.tile(rng.integers(0, 3, 40), 30)
    end = np.full(len(words), len(words))
    levels = periodic._ranks(words, end)

    def squares(rows):
        return sorted((s, p) for a, b in periodic._squares(levels, end // 4, 4, rows) for s, p in zip(a.tolist(), b.tolist()))

    assert squares(7) == squares(10**6) != []


def test_operator_on_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "b c " * 5), (5, "x " + "é ü " * 8 + "y"), (6, "no runs at all"),
            (7, "a b a b a b a b\x0b\x0ca a a a a a")]
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in periodic.collapse_runs(df, most_words=10).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert periodic.collapse_runs(df.limit(0)).collect() == []


def test_registered_query_equals_brute_force(spark):
    from queryforge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    small = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) < 1500}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and len(small) > 100
    assert {i: got[i] for i in small} == {i: expected(i, t, planted) for i, t in small.items()}
