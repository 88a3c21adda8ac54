"""The language model of several orders against an exact one in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from queryforge.llm import lm


def exact(train, order):
    """log10 probability of a text under interpolated modified Kneser-Ney, and (count, N, V), from the definition."""
    tok = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), "</s>"]
    grams = Counter()
    for t in train:
        words = ["<s>"] * (order - 1) + tok(t)
        grams.update(tuple(words[i - order + 1:i + 1]) for i in range(order - 1, len(words)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    found = {k: lm.discounts(*[sum(n == i for n in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}
    about = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k, counts in levels.items():
        for g, n in counts.items():
            about[k][g[:-1]][0] += n
            about[k][g[:-1]][min(n, 3)] += 1
    plain = Counter(w for t in train for w in tok(t))

    def chance(gram):
        k = len(gram)
        lower = 1 / (len(plain) + 1) if k == 1 else chance(gram[1:])
        total, *kinds = about[k][gram[:-1]]
        if not total:
            return lower
        n = levels[k][gram]
        return (max(n - found[k][min(n, 3)], 0) + sum(d * c for d, c in zip(found[k][1:], kinds)) * lower) / total

    def score(text):
        words = ["<s>"] * (order - 1) + tok(text)
        return sum(math.log10(chance(tuple(words[i - order + 1:i + 1]))) for i in range(order - 1, len(words)))
    return score, plain, chance


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("buckets", [1 << 30, 200])
def test_model_equals_an_exact_one(spark, order, buckets):
    random.seed(order)
    words = ["The", "cat", "dog", "sat", "on", "a", "mat", "é"]
    train = [" ".join(random.choice(words) for _ in range(random.randint(0, 25))) for _ in range(150)] + [None, "the the the " * 300]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id bigint, text string").repartition(4)
    model = lm.train(table, order=order, bucket_bytes=buckets, most_tokens=200)
    score, plain, chance = exact(train, order)
    texts = ["the cat sat", "", None, "zebra on a mat", "the " * 50, *train[:20]]
    rows = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, score int, n_tokens string")
    got = {r["doc_id"]: r for r in lm.score(rows, model, most_texts=7).collect()}
    assert (model.tokens, model.vocabulary) == (sum(plain.values()), len(plain))
    for i, t in enumerate(texts):
        assert math.isclose(got[i]["score"], score(t), rel_tol=1e-9), t
    # probabilities of all words and one unknown word sum to one in any context
    for context in [("<s>",) * (order - 1), ("the",) * (order - 1), ("no", "such", "words")[:order - 1]]:
        assert math.isclose(sum(chance((*context, w)) for w in [*plain, "unknown"]), 1, rel_tol=1e-9)


def test_empty_tables_nulls_and_repeats(spark):
    schema = "doc_id bigint, text string"
    empty = lm.train(spark.createDataFrame([], schema), order=3)
    rows = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], schema)
    got = lm.score(rows, empty).collect()
    assert len(got) == 3 and all(r["base_score"] == r["score"] == 0 and r["n_known"] == 0 for r in got)
    assert lm.score(rows.limit(0), empty).collect() == []
    with pytest.raises(ValueError):
        lm.train(rows, order=1)


def test_exact_on_whole_documents(spark):
    """No two words share statistics: all texts of a real table score as under the exact model."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    score, _, _ = exact(list(texts.values()), 2)
    got = {r["doc_id"]: r["score"] for r in lm.score(table, lm.train(table, bucket_bytes=100_000)).collect()}
    assert all(math.isclose(got[i], score(t), rel_tol=1e-9) for i, t in texts.items()) and len(got) == len(texts)


def test_packed_blocks_come_back_and_recurring_hashes_take_few_bytes():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, kinds in ((0, 1), (1, 1), (7, 3), (20_000, 500), (300, 10 ** 6)):
        hashes = lambda k: rng.integers(0, 2 ** 64, k, np.uint64)
        first, words, counts = np.sort(hashes(n)), rng.choice(hashes(kinds), n), rng.integers(1, 4, n).astype(np.uint32)
        arrays = [first, counts, words, counts.astype(np.uint64), words]
        packed = lm._pack(*arrays)
        back = lm._unpack(packed)
        assert [a.dtype for a in back] == [a.dtype for a in arrays] and all(np.array_equal(a, b) for a, b in zip(back, arrays))
    packed = lm._pack(np.sort(hashes(20_000)), rng.choice(hashes(500), 20_000))
    assert len(packed) < 20_000 * (8 + 3)  # the steps, and a place in a list of 500
