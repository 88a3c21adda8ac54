"""Exact duplicates, shards and benchmark windows against plain Python on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np

from queryforge.llm import decontam, exact_dedup, sharding, toxicity

SCHEMA = "doc_id bigint, text string, shard string, kept string, size string"
ROWS = [(1, "a b", "x", None, None), (2, "ab", "x", None, "9"), (3, None, None, None, None), (4, "", "y", "k", None), (5, "a  b", "x", None, None),
        (None, "a b", None, None, None), (7, "Überall ÄÖ", "x", None, None), (7, "Überall ÄÖ", "x", None, None), (8, "b" * 200_000, "x", None, None)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_duplicates_against_python(spark):
    got = exact_dedup.exact_duplicates(docs(spark)).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len({key(r[1]) for r in ROWS})
    for r in got:
        group = [x for x in ROWS if hashlib.sha256(key(x[1]).encode()).hexdigest() == r["text_sha256"]]
        best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert r["group_size"] == len(group) and r["keep_id"] == best[0]
    left = exact_dedup.drop_exact_duplicates(docs(spark))
    assert left.columns == docs(spark).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 5, 7, 8]


def test_heavy_and_light_groups_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", None, None, None) for i in range(600)]
    for support in (0.5, 1e-4):  # all groups light, most groups heavy
        got = exact_dedup.exact_duplicates(docs(spark, rows), support=support).collect()
        assert {r["doc_id"]: r["keep_id"] for r in got} == {i: min(j for j, t, *_ in rows if t == x) for i, x, *_ in rows}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert decontam.contamination(none, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_shards_are_near_equal_and_gapless(spark):
    rows = ROWS + [(100 + i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 17), None, None, None) for i in range(900)]
    for law, most in (("bytes", 200_001), ("rows", 1)):
        got = sharding.shard(docs(spark, rows), 16, law, ranges=8, per_range=8, range_rows=20).collect()
        assert len(got) == len(rows)
        assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
            (i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        by = {s: [r for r in got if r["shard"] == s] for s in range(16)}
        for part in by.values():
            assert sorted(r["slot"] for r in part) == list(range(len(part)))
        load = [len(p) if law == "rows" else sum(r["size"] for r in p) for p in by.values()]
        even = sum(load) / 16  # a shard holds its share, give or take the row that crosses its end
        assert all(even - most <= x <= even + most for x in load) and all(r["grown_shard"] is None for r in got)


def test_windows_against_python(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Kurz ÜBER alles"), (None, "solo"), (3, ""), (4, None), (2, "kurz ÜBER alles"), (5, "ha " * 15)]
    texts = ["x " + " ".join(f"W{i}" for i in range(3, 17)) + " y", "w3 w4", None, "", "kurz ÜBER alles, kurz ÜBER alles", "kurz über alles",
             "solo!", "z " * 500 + "solo", "ha " * 40, long + " " + long, " ".join(f"w{i}" for i in range(17, 30))]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(9, texts[9], None, None, None), (None, texts[0], None, None, None)]
    got = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(13, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[s:s + k]:
                        hit.update(range(p, p + k))
                        found.add("null" if item is None else str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    near = decontam.near_matches(docs(spark, [(1, " ".join("zz" if i == 20 else f"w{i}" for i in range(30)), None, None, None)]),
                                 spark.createDataFrame(items[:1], "item_id bigint, text string")).collect()
    assert [(r["item"], r["at"]) for r in near] == [("1", 0)] and 0.9 < near[0]["share"] < 1


def test_near_matches_against_brute_force(spark):
    random.seed(3)
    words = "a b c d e f g h i j k l m n".split()
    items = [[random.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 8, 10, 13, 13, 25)]
    items += [["lacking", *items[8][1:]], [*items[10][:12], "lacking", *items[10][13:]], ["lacking"] * 4]
    texts = [[random.choice(words) for _ in range(random.randint(0, 60))] for _ in range(30)]
    for item in items * 3:  # one word changed, or the first one cut off
        at = random.randrange(len(item))
        texts += [["a", *item[:at], "other", *item[at + 1:], "b"], item[1:]]
    table = docs(spark, [(i, " ".join(w), None, None, None) for i, w in enumerate(texts)])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    for share in (0.8, 0.5, 1.0):
        want = set()
        for i, w in enumerate(texts):
            for j, v in enumerate(items):
                for at in range(1 - len(v), len(w)):
                    same = sum(0 <= at + q < len(w) and w[at + q] == x for q, x in enumerate(v))
                    if same / len(v) >= share:
                        want.add((i, str(j), at, same / len(v)))
        got = decontam.near_matches(table, benchmark, least_share=share).drop("text_hash").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_filter_stages_keep_repeated_clean_rows(spark):
    clean, bad = "clean words only", "w1 w2 w3"
    rows = [(1, clean, "en", "s1", None), (1, clean, "de", "s2", None), (None, clean, "en", "s3", None), (None, clean, "fr", "s4", None),
            (2, bad, "en", "s5", None), (2, bad, "de", "s6", None), (None, bad, "en", "s7", None), (3, None, "en", "s8", None),
            (3, None, "de", "s9", None)]
    table, left = docs(spark, rows), sorted(r[3] for r in rows if r[1] != bad)
    benchmark = spark.createDataFrame([(1, bad)], "item_id bigint, text string")
    kept = decontam.drop_contaminated(table, benchmark)
    assert kept.columns == table.columns and sorted(r[3] for r in kept.collect()) == left

    weights = np.zeros(1 << toxicity.BITS)
    weights[toxicity.ngrams(bad, (3,))] = 10.0
    kept = toxicity.drop_toxic(table, toxicity.Model(weights, -5.0, (3,)))
    assert kept.columns == table.columns and sorted(r[3] for r in kept.collect()) == left
