"""Near duplicates and components against brute force; the pipeline on a small table."""

import random

import corpus_pipeline
from conftest import SF_SMALL

from queryforge.llm import near_dedup
from queryforge.llm.components import components

SCHEMA = "doc_id bigint, text string, kept string, n string"


def brute(rows, size, percent):
    sets = [set(near_dedup.shingle_set(t, size).tolist()) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    return sets, label


def corpus():
    random.seed(11)
    word = lambda: f"w{random.randint(0, 4000)}"
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(150)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "three"), (6, "a b c"), (7, "A b c")]
    for i in range(100, 220):  # a large group whose members differ more and more
        copy = list(base)
        for _ in range(random.randint(0, 14)):
            copy[random.randrange(150)] = word()
        rows.append((i, " ".join(copy)))
    for i in range(300, 380):  # a passage that many documents share
        rows.append((i, " ".join(word() for _ in range(random.randint(20, 120))) + " " + passage))
    rows += [(400, "long " + " ".join(word() for _ in range(30_000))), (400, "one two"), (None, "one two")]
    return [(*r, None, None) for r in rows]


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    for size, percent, short in ((3, 85, 32), (5, 80, 4)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size, percent, short=short).collect()
        sets, label = brute(rows, size, percent)
        best = {}
        for (i, *_), x in zip(rows, label):
            best[x] = min(best.get(x, (True, 0)), (i is None, i or 0))
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(
            ((i, len(s), best[x][1] if not best[x][0] else None) for (i, *_), s, x in zip(rows, sets, label)), key=key)
        assert sum(r["kept"] for r in got) == len(set(label))


def test_empty_and_dropped_rows(spark):
    table = spark.createDataFrame(corpus(), SCHEMA)
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0
    left = near_dedup.drop_near_duplicates(table)
    assert left.columns == table.columns and left.where("doc_id in (3, 4)").count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000), (6000, 6001)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(100)}) == 1
    assert len(set(got.values())) == 3 and 5000 not in got


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "bpe"]
    kept = corpus_pipeline.drop_near(spark, corpus_pipeline.drop_exact(spark, docs, SF_SMALL), SF_SMALL)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    _, label = brute(rows, 5, 80)
    assert kept.count() == len(set(label))
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert 0 < out.count() <= len(set(label)) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
