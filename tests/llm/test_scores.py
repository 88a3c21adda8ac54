"""Toxicity features and scores, and guess costs, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queryforge.llm import secrets, toxicity


def _slow_ngrams(text, sizes):
    plain = "".join((c.lower() if c.isalnum() else " ") if c < "\x80" else c for c in f" {text or ''} ")
    out = []
    for n in sizes:
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i:i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            out.append(((h ^ n) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


@pytest.mark.parametrize("text", [None, "", "a", "Straße 7, ÀÉ!", "日本語 abc", "x\ud800y", "Z" * 40])
def test_ngrams_are_of_characters(text):
    assert toxicity.ngrams(text, (3, 4, 5)).tolist() == _slow_ngrams(text, (3, 4, 5))


def _tables(spark, n=60):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["vile", "nasty"] if i % 2 else ["kind", "calm"]) for _ in range(3)) + " é plain words") for i in range(n)]
    docs = spark.createDataFrame([(i, t, 9, "clash") for i, t in rows], "doc_id bigint, text string, toxic int, score string")
    return rows, docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")


def test_scores_of_a_model_equal_brute_force(spark):
    rows, docs, labels = _tables(spark)
    model = toxicity.train(docs, labels)
    used = np.flatnonzero(model.weights)
    has = np.array([[int(u in set(_slow_ngrams(t, model.sizes))) for u in used] for _, t in rows])
    toxic = np.array([i % 2 for i, _ in rows])
    ratio = np.log(((has[toxic == 1].sum(0) + .5) / 31) / ((has[toxic == 0].sum(0) + .5) / 31))
    expected = 1 / (1 + np.exp(-(model.intercept + has @ model.weights[used])))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i][0] - e) < 1e-9 and got[i][1] == (e >= 0.7) == i % 2 for (i, _), e in zip(rows, expected))
    # weights are those of a logistic regression on features scaled by the log-count ratios: their gradient is zero
    scaled = has * ratio
    w = model.weights[used] / ratio
    gradient = ((expected - toxic) @ scaled) / len(rows) + 0.003 * w
    assert np.abs(gradient).max() < 1e-3


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1)], [(0, 0)], [(1, None), (2, 7)]])
def test_labels_of_one_class_reject_nothing(spark, labels):
    _, docs, _ = _tables(spark)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()} == {(0.5, 0)}
    assert toxicity.drop_toxic(docs, model).count() == 60


def test_ties_repeats_and_empty_tables(spark):
    _, docs, labels = _tables(spark)
    model = toxicity.train(docs.union(docs), labels)
    one = docs.limit(1)
    exact = toxicity.score(one, model).first()["score"]
    rows = one.union(one).union(one.withColumn("doc_id", F.lit(None).cast("bigint")))
    assert [r["predicted"] for r in toxicity.score(rows, model, threshold=exact).collect()] == [1, 1, 1]
    assert [r["predicted"] for r in toxicity.score(rows, model, threshold=math.nextafter(exact, 2)).collect()] == [0, 0, 0]
    kept = toxicity.drop_toxic(rows, model, threshold=math.nextafter(exact, 2))
    assert kept.columns == docs.columns and kept.count() == 3 and toxicity.drop_toxic(rows, model, threshold=exact).count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0 == toxicity.drop_toxic(docs.limit(0), model).count()
    assert toxicity.drop_toxic(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def _cheapest(value, words):
    """The cost of the best of all segmentations, piece by piece."""
    low, best = value.lower(), [0.0] + [math.inf] * len(value)
    for end in range(1, len(value) + 1):
        for begin in range(end):
            piece, plain, options = value[begin:end], low[begin:end], []
            if end - begin == 1:
                options.append(secrets.CHARACTER)
            if (m := secrets.DATE.match(value, begin)) and m.end() == end:
                options.append(secrets.DAY + secrets.CUT)
            if end - begin > 2 and len(set(piece)) == 1:
                options.append(secrets.REPEAT + math.log10(end - begin) + secrets.CUT)
            if end - begin > 2 and all(b in secrets.NEIGHBOURS.get(a, ()) for a, b in zip(plain, plain[1:])):
                options.append(secrets.WALK + 0.3 * (end - begin) + secrets.CUT)
            if end - begin > 2 and plain in words:
                options.append(math.log10(words[plain] + 1) + (0.0 if piece.islower() else 0.3 if piece.istitle() else 1.0) + secrets.CUT)
            for o in options:
                best[end] = min(best[end], best[begin] + o)
    return best[-1]


def test_guess_cost_is_that_of_the_cheapest_segmentation():
    rnd = random.Random(3)
    words = {w: i for i, w in enumerate(["pass", "password", "ass", "sea", "qwe", "was", "assassin", "aaa", "dragon"], 1)}
    bits = ["pass", "Word", "sss", "qwert", "1999-01-02", "20010203", "a", "Z", "9", "!", "asdf", "DRAGON", "aaaa", "sea", "zxc", "111"]
    for _ in range(800):
        value = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6)))
        assert abs(secrets.guess_cost(value, words) - _cheapest(value, words)) < 1e-9, value


@pytest.mark.parametrize("text, values", [
    ("password: secret: Xq7vT9zLm2Rk", ["Xq7vT9zLm2Rk"]), ("compass: Zusammenarbeit bypass: unternehmerisch", []), ("token = get_access_token()", []),
    ("DB_PASSWORD=Xq7vT9zLm2Rk", ["Xq7vT9zLm2Rk"]), ("accessToken: 'Xq7vT9zLm2Rk'", ["Xq7vT9zLm2Rk"]), ("password=${DB_PASS_WORD_X}", []),
    ("api_key = os.environ['MY_KEY_NAME_X']", []), ("The Password IS Xq7vT9zLm2Rk", ["Xq7vT9zLm2Rk"]), ("pwd=password", []), ("auth: {{ vault_token_9x }}", [])])
def test_values_after_credential_words(text, values):
    assert [text[a:b] for a, k, b in secrets.find_spans(text, {"password": 1}, 8.0) if k == "guess"] == values
