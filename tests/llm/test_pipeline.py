"""The pipeline's stages on small documents, each against what it must keep."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from treeline.llm import simhash

from .test_operators import slow_components, slow_fingerprint, words


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, words(rng, 50), "en", f"s{k % 3}", 0) for k in range(120)]
    docs += [(200 + k, " ".join(w + "%%%" for w in words(rng, 50).split()), "en", "s0", 0) for k in range(80)]
    docs += [(400 + k, docs[k][1], "en", "s1", 0) for k in range(20)] + [(500, "mail x@y.example.org now " + words(rng, 30), "en", "s2", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 300), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "near_duplicates", "redact_personal_data", "mix_sources", "encode_pieces"]
    kept = cp.quality_filter(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == cp.COLUMNS and len(ids & set(range(200, 280))) <= 4 and len(ids) >= 138
    once = cp.near_duplicates(spark, kept, d)
    rows = [r for r in docs if r[0] in ids]
    fps = [slow_fingerprint(r[1]) for r in rows]
    assert {r["doc_id"] for r in once.collect()} == set(slow_components(fps, [r[0] for r in rows])) and once.columns == cp.COLUMNS
    clean = cp.redact_personal_data(spark, once, d)
    assert clean.where("doc_id = 500").first()["text"].startswith("mail <EMAIL> now") and clean.where("n_chars <> length(text)").isEmpty()
    assert clean.count() == once.count() and clean.columns == cp.COLUMNS
    mixed = cp.mix_sources(spark, clean, d)
    assert mixed.columns == cp.COLUMNS and 0.6 * clean.count() < mixed.count() < 1.4 * clean.count()
    last = cp.run(spark, d)
    assert last.columns == ["doc_id", "ids"] and last.count() == mixed.count() and last.where("size(ids) = 0").isEmpty()


def test_stages_on_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0
    assert simhash.fingerprint(b"") == 0


def test_stages_on_odd_rows(spark, tmp_path):
    rng, d = random.Random(4), str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {c: F.lit(1) for c in ("score", "_score", "copy", "shuffle_key", "root", "key", "label", "quality", "__tl_key", "n_docs", "rate")}
    long = " ".join(words(rng, 60_000).split())
    plain = [(k, words(rng, 50), "en", f"s{k % 3}", 1) for k in range(60)]
    odd = [(None, None, None, None, None), (None, "", None, "s0", 0), (61, "   ", None, None, None), (62, None, "en", "", None), (63, long, None, "s1", None)]
    odd += [(None, words(rng, 40), "en", "s2", 1), (None, words(rng, 40), "en", "s2", 1), (1, words(rng, 40), None, "s1", 1), plain[5], plain[5]]
    rows = plain + odd
    docs = spark.createDataFrame(rows, schema).withColumns(extra)
    labels = [(k, 1, 0) for k in range(60)] + [(None, 0, 0), (3, None, None), (4, 0, 0), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    kept = cp.quality_filter(spark, docs, d)
    texts = lambda df: Counter(r["text"] for r in df.collect())
    assert kept.columns == cp.COLUMNS and all(n in (0, dict(Counter(r[1] for r in rows))[t]) for t, n in texts(kept).items())
    once = cp.near_duplicates(spark, docs, d)
    want = Counter({t for _, t, *_ in rows if t and t.strip()})  # these differ, so each stays once; the blank ones make one group
    found = texts(once)
    assert once.columns == cp.COLUMNS and Counter({t: n for t, n in found.items() if t and t.strip()}) == want and found.total() == len(want) + 1
    clean = cp.redact_personal_data(spark, docs, d)
    assert clean.columns == cp.COLUMNS and texts(clean) == Counter(r[1] for r in rows)
    assert {(r["text"], r["n_chars"]) for r in clean.collect() if not (r["text"] or "").strip()} == {(None, None), ("", 0), ("   ", 3)}
    mixed, again = cp.mix_sources(spark, docs, d), cp.mix_sources(spark, docs.repartition(5), d)
    assert mixed.columns == cp.COLUMNS and texts(mixed) == texts(again) and set(texts(mixed)) <= {r[1] for r in rows}
    assert texts(mixed)[plain[5][1]] % 3 == 0  # its three rows are drawn alike
    ids = cp.encode_pieces(spark, docs, d).collect()
    assert len(ids) == len(rows) and sum(not r["ids"] for r in ids) >= 3 and max(len(r["ids"]) for r in ids) > 60_000
