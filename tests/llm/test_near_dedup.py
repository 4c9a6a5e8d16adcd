"""Near-duplicate removal against brute-force Jaccard, and on NULL and repeated ids."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from treeline.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_groups(texts):
    """For each text the first position that pairs of similarity 0.8 or more lead to."""
    g, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(g)):
        for j in range(i):
            if g[i] == g[j] or 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [None, "", " \n ", "a a a a a", "A a a a a a", "one two", "One  two", "one two three"]
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.choice([30, 80, 200]))
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):  # edits to either side of 0.8, each of the one before
            w = list(w)
            for k in rng.sample(range(len(w)), rng.randrange(1, max(2, len(w) // 25))):
                w[k] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def test_stage_equals_brute_force_jaccard(spark, monkeypatch):
    texts = corpus(random.Random(8))
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    want = sorted(set(slow_groups(texts)))
    assert 60 < len(want) < len(texts)
    for shard in (1024, 2):
        monkeypatch.setattr(minhash, "SHARD", shard)
        assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == want


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=40)) for _ in range(12)]
    rows = [(None, t, "en", "s", 0) for t in texts[:6]] + [(7, t, "en", "s", 0) for t in texts[6:11]]
    rows += [(3, texts[0], "en", "s", 0), (None, texts[11], "en", "s", 0), (None, texts[11], "en", "s", 0), (7, texts[6], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for kept in (simhash.near_dedup(docs), cp.near_duplicates(spark, docs, "")):
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert Counter(t for _, t in got) == Counter(texts) and (3, texts[0]) in got and kept.columns == docs.columns


def test_simhash_links_are_candidates(spark):
    """Without any shared band, what the fingerprints link is still compared."""
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        w = rng.choices([f"w{k}" for k in range(3000)], k=900)
        texts += [" ".join(w), " ".join(w[:-1] + ["end"])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, ""), (98, "  ")], "doc_id long, text string").repartition(3)
    signed = docs.mapInArrow(minhash._sign, "doc_id long, key long, fp long, bands array<long>")
    uniq = signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("fp").alias("fp"), F.array().cast("array<long>").alias("bands"))
    id_of = {r["key"]: r["least_id"] for r in uniq.collect()}
    found = {frozenset((id_of[r["u"]], id_of[r["v"]])) for r in minhash.links(docs, uniq).collect()}
    fps = [simhash.fingerprint_of(minhash.shingles(t.encode())) for t in texts]
    assert found == {frozenset((k, k + 1)) for k in range(0, 16, 2) if (fps[k] ^ fps[k + 1]).bit_count() <= 4} and len(found) > 4
