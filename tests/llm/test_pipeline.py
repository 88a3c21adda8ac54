"""The whole pipeline, stage by stage, against a brute-force version; edge cases through all stages."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from queryforge.llm import toxicity

#: Columns of documents, and others whose names the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n string, score string, class string"


def _key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def _fixture():
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "short one"), (None, "short one"), (None, None), (4, "Short  one"), (5, "short one")]
    for i in range(10, 50):
        rows.append((i, f"{'vile nasty filth' if i % 2 else 'calm kind words'} {text(30)} é"))
    base = text(120).split()
    for i in range(60, 75):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(120)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(80, text(20) + " " + item), (81, text(900) + " " + " ".join(item.split()[:13])), (82, item.upper()), (83, rows[20][1]), (83, rows[20][1]),
             (84, rows[21][1] + "  "), (85, "long " + text(5000))]
    labels = [(i, i % 2) for i in range(10, 50)] + [(81, None), (999, 1)]
    return rows, labels, [(7, item), (8, None), (9, ""), (7, item)]


def _write(spark, path, rows, labels, items):
    df = spark.createDataFrame([(i, t, "xx", "s", 1, "a", "b", "c", "d") for i, t in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=_key)


def _exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def _near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for r, x in zip(rows, label):
        groups.setdefault(x, []).append(r)
    return [min(g, key=_key) for g in groups.values()]


def _clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i:i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    out = []
    for r in rows:
        w = words(r[1])
        hit = {p for g in windows for i in range(len(w) - len(g) + 1) if tuple(w[i:i + len(g)]) == g for p in range(i, i + len(g))}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def _same(got, wanted):
    """Equal rows; of rows without id and with equal text it does not matter which one stays."""
    assert Counter(got) == Counter(sorted(wanted, key=_key))


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, labels, items = _fixture()
    docs = _write(spark, str(tmp_path), rows, labels, items)
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    clean = [r for r in rows if model.score(r[1]) < 0.7]
    assert 10 < len(clean) < len(rows) and (None, "short one") in clean
    stages = dict(corpus_pipeline.STAGES)
    wanted = {"toxicity": clean, "exact dedup": _exact(clean)}
    wanted["near dedup"] = _near(wanted["exact dedup"])
    wanted["decontamination"] = _clean(wanted["near dedup"], items)
    for name, right in wanted.items():
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stages[name](spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        _same(_rows(docs), right)
    assert len(wanted["decontamination"]) < len(wanted["near dedup"]) < len(wanted["exact dedup"]) < len(clean)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    encoded = []
    for i, t in wanted["decontamination"]:
        ids = own.encode_ordinary(t or "")
        encoded.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    before = spark.conf.get(corpus_pipeline.ARROW_ROWS)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == Counter(encoded)
    spark.conf.set(corpus_pipeline.ARROW_ROWS, 10_000)
    assert before in ("1000", "10000")


def test_empty_tables(spark, tmp_path):
    rows, labels, items = _fixture()
    _write(spark, f"{tmp_path}/a", [], labels, items)
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    before = spark.conf.get(corpus_pipeline.ARROW_ROWS)
    small = [r for r in rows if r[0] in (None, 1, 2, 5, 60, 61, 82)]
    _write(spark, f"{tmp_path}/b", small, [], [])
    out = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert out.count() == len(_near(_exact(small))) and spark.conf.get(corpus_pipeline.ARROW_ROWS) == before
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id bigint, text string").withColumns({c.split()[0]: F.lit(None).cast("string") for c in SCHEMA.split(", ")[2:]})
    nulls.write.parquet(f"{tmp_path}/c/documents.parquet")
    spark.createDataFrame([(None, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/c/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/c/benchmark.parquet")
    assert [r["n_tokens"] for r in corpus_pipeline.run(spark, f"{tmp_path}/c").collect()] == [0]
