"""The training-data operators against brute force, libraries and round trips, and on awkward rows.

AWKWARD has NULL and empty texts, a NULL id, repeated rows, ties, a long text, and columns named like the operators' own.
"""

import hashlib
import io
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeline.llm import ann, ctw, imatch, mixing, ordered, pii, quality, sentencepieces, simhash, tokenfiles, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, score double, copy int, rate double, _salt int, block long"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta Straße naïve ring, bolt. x y z über".split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", "   \n\t ", "one", "one two", "A b C d", "mail a.b@c.example.com or +49 (30) 123456-78 or 10.0.0.255 or 4111 1111 1111 1111!", words(rng, 60_000), "日本語 テキスト 😀  end", "tail  \n\n  spaces "]
    texts += [words(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += [texts[12]] * 6 + [texts[14] + " more"]
    out = [(k, t, "en", "abc"[k % 3] if k % 5 else None, None if t is None else len(t), 1, 0.5, 2, 9.0, 3, 4) for k, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "no id", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def in_order(rows):
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


# --- 1: I-Match --------------------------------------------------------------------------------------------------------


def test_imatch(docs, rows, none, monkeypatch):
    monkeypatch.setattr(ordered, "PART_BYTES", 1 << 12)
    found = by_id(imatch.neighbours(docs))
    texts = [t or "" for _, t in in_order(rows)]
    following = texts[1:] + texts[:1]
    want = Counter((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, _), t, n in zip(in_order(rows), texts, following))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    own = {r["doc_id"]: r["fingerprint"] for r in found}
    text_of = {i: t or "" for i, t in in_order(rows)}
    for a in own:
        for b in own:
            if text_of[a] == text_of[b]:
                assert own[a] == own[b]
    assert all(0 <= r[k] <= 1 for r in found for k in ("near_edited", "near_next"))
    assert imatch.neighbours(none).count() == 0
    assert imatch.neighbours(docs.where("doc_id = 5")).first()["near_next"] == 1.0


def test_imatch_band_and_signatures_equal_brute_force(spark, monkeypatch):
    """Exact document frequencies, both edges of the band, and every signature by its definition."""
    monkeypatch.setattr(imatch, "WAITING", 50)
    rng, s = random.Random(6), imatch.Settings(least_idf=0.7, most_idf=3.0, least_docs=2, subsets=3, levels=5)
    texts = [" ".join(["Common"] + [f"mid{rng.randrange(12)}" for _ in range(6)] + [f"rare{k}"] + ["pair"] * (k in (3, 4))) for k in range(60)] + [None, ""]
    lexicon = imatch.lexicon(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), s)
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    want = {w for w, n in df.items() if max(2, len(texts) * math.exp(-3.0)) <= n <= len(texts) * math.exp(-0.7)}
    assert lexicon.tolist() == sorted(xxhash.xxh64_intdigest(w.encode()) | 1 for w in want)
    assert "common" not in want and "rare7" not in want and "pair" not in want and len(want) > 5
    f, u64 = imatch.Fingerprints(lexicon, s), (1 << 64) - 1
    for t in [*texts[:20], "common rare1", ""]:
        found = {w: xxhash.xxh64_intdigest(w.encode()) for w in set((t or "").lower().split())}
        terms = sorted(h | 1 for w, h in found.items() if w in want) or sorted(h & ~1 for h in found.values())
        for r, salt in enumerate(map(int, f.salts)):
            for level in range(s.levels):
                total = n = 0
                for h in terms:
                    m = h * salt & u64
                    m = (m ^ (m >> 32)) * 0xD6E8FEB86659FD93 & u64
                    if m >> (64 - level) == 0 or level == 0:
                        v = m * 0x9E3779B97F4A7C15 & u64
                        v = (v ^ (v >> 29)) * 0xBF58476D1CE4E5B9 & u64
                        total, n = (total + v * pow(imatch._BASE, n, 1 << 64)) & u64, n + 1
                assert f.of((t or "").encode())[r, level] == (max((total * 0x94D049BB133111EB & u64) >> 48, 1) if n else 0)


def test_imatch_likeness_follows_overlap():
    s, rng = imatch.Settings(), random.Random(1)
    vocabulary = [f"w{k}" for k in range(5000)]
    f = imatch.Fingerprints(np.sort([xxhash.xxh64_intdigest(w.encode()) | 1 for w in vocabulary]).astype(np.uint64), s)
    error = []
    for share in (0.0, 0.2, 0.5, 0.8):
        for _ in range(12):
            pool = rng.sample(vocabulary, 400)
            common = int(round(share * 400))
            a, b = pool[: (400 + common) // 2], pool[(400 - common) // 2 :]
            got = f.likeness(f.of(" ".join(a).encode()), f.of(" ".join(b).encode()))
            error.append(got - len(set(a) & set(b)) / len(set(a) | set(b)))
    # a subset's run of agreeing levels has a spread of about 2.6, so 32 of them leave 0.15 to 0.2 at these shares
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.2


# --- 2: SentencePiece --------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_library(docs, rows, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in by_id(sentencepieces.encode(docs, PIECES)):
        text = {i: t for i, t, *_ in rows}[r["doc_id"]]
        assert r["ids"] == lib.encode(text or ""), r["doc_id"]
    assert docs.count() == sentencepieces.encode_decode(docs, PIECES).where("exact").count()
    back = sentencepieces.decode(sentencepieces.encode(docs, PIECES), PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t, *_ in rows}
    assert sentencepieces.encode(none, PIECES).count() == 0


def test_sentencepiece_fuzz():
    lib, model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.Model(Path(PIECES).read_bytes()), random.Random(3)
    texts = ["".join(rng.choice(["a", "th", "e ", " ", "  ", "\n", "é", "字", "😀", "ing", "<s>", "▁", "0"]) for _ in range(rng.choice([0, 1, 4, 30, 200]))) for _ in range(400)] + ["ab" * 400, " " * 90]
    assert [x.tolist() for x in sentencepieces.Encoder(model).encode([t.encode() for t in texts])] == [lib.encode(t) for t in texts]


def test_viterbi_equals_brute_force():
    model, rng = sentencepieces.Model(Path(PIECES).read_bytes()), random.Random(5)
    model.score = np.array([-rng.uniform(1, 12) for _ in model.pieces])
    lost = model.score.min() - 10.0

    def best(w):
        if not w:
            return 0.0
        return max((model.score[model.id_of[w[:n]]] if w[:n] in model.id_of else lost if n == 1 else -math.inf) + best(w[n:]) for n in range(1, len(w) + 1))

    for length in (1, 4, 9):
        texts = ["".join(rng.choice("abeinrst▁é字") for _ in range(length)) for _ in range(20)]
        codes = np.array([[ord(c) for c in w] for w in texts], np.uint64)
        for w, end in zip(texts, model.viterbi(codes, model.table(codes))):
            parts = [w[i:e] for i, e in enumerate(end) if e]
            assert "".join(parts) == w
            assert sum(model.score[model.id_of[p]] if p in model.id_of else lost for p in parts) == pytest.approx(best(w))


# --- 3: context trees --------------------------------------------------------------------------------------------------


def test_ctw_base_and_order(docs, rows, none):
    found = by_id(ctw.score(docs))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in in_order(rows)]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    sizes = Counter((i, len(b" ".join(ws[:-1])) + 1) for i, ws in tokens)
    assert Counter((r["doc_id"], r["n_bytes"]) for r in found) == sizes
    assert all(math.isclose(r["bits_per_byte"] * r["n_bytes"], -r["score"] * math.log2(10)) for r in found)
    assert ctw.score(none).count() == 0


def test_ctw_blocks_come_from_files(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    assert ctw._of_files(spark.read.parquet(path).where("doc_id > 3").select("doc_id", "text"))
    assert not ctw._of_files(docs) and not ctw._of_files(spark.read.parquet(path).union(spark.read.parquet(path)))
    scores = [Counter((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in by_id(ctw.score(d))) for d in (docs, spark.read.parquet(path))]
    assert scores[0] == scores[1]


def test_ctw_equals_brute_force(spark):
    """Every decision's mixture by recursion over its contexts."""
    texts = ["the cat sat", "the mat", "a cat", "that hat", "cat the"]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    seen: dict = {}

    def decisions(t):
        data = b"\n" * ctw.DEPTH + b" ".join(t.encode().split()) + b"\n"
        for k in range(ctw.DEPTH, len(data)):
            for j in range(8):
                yield data[k - ctw.DEPTH : k], (1 << j) | (data[k] >> (8 - j)), data[k] >> (7 - j) & 1

    for t in texts:
        for ctx, node, bit in decisions(t):
            seen.setdefault((ctx, node), [0, 0])[bit] += t in train
    for t in set(texts) - set(train):
        assert t not in train

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def node_of(ctx, depth, node):
        return [x for (c, m), x in seen.items() if m == node and c.endswith(ctx[ctw.DEPTH - depth :] if depth else b"")]

    def weigh(ctx, depth, node):
        a, b = (sum(x[k] for x in node_of(ctx, depth, node)) for k in (0, 1))
        if depth == ctw.DEPTH:
            return block(a, b)
        tail = ctx[ctw.DEPTH - depth :] if depth else b""
        below = {c[ctw.DEPTH - depth - 1 :] for (c, m) in seen if m == node and c.endswith(tail)}
        rest = sum(weigh(b"\0" * (ctw.DEPTH - depth - 1) + x, depth + 1, node) for x in below)
        return np.logaddexp(math.log(0.5) + block(a, b), math.log(0.5) + rest)

    def predict(ctx, depth, node):
        a, b = (sum(x[k] for x in node_of(ctx, depth, node)) for k in (0, 1))
        kt = (b + 0.5) / (a + b + 1)
        if depth == ctw.DEPTH:
            return kt
        stop = math.exp(math.log(0.5) + block(a, b) - weigh(ctx, depth, node))
        return stop * kt + (1 - stop) * predict(ctx, depth + 1, node)

    for i in (0, 4):
        want = sum(math.log10(p if bit else 1 - p) for ctx, node, bit in decisions(texts[i]) for p in [predict(ctx, 0, node)])
        assert got[i] == pytest.approx(want, abs=1e-9)


# --- 4: WARC -----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    pages = [(1, "u", "<p>x</p>"), (2, "u\r\nv", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "ö" * 200_000), (0, "u", "ö" * 200_000), (6, "u", "a\r\n\r\nb"), (6, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string")
    payload = lambda h: (h or "").encode()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[payload(h)] = min(first.get(payload(h), i), i)
    for least in (0, 5):
        want = Counter()
        for i, _, h in pages:
            p = payload(h)
            original = len(p) < least or i == first[p]
            want[i, len(p), warc.digest(p), "response" if original else "revisit", None if original else first[p]] += 1
        assert Counter(map(tuple, warc.write_and_read(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    whole = b"".join(warc.encode_record(k, "u", b"payload %d" % k, warc.digest(b"payload %d" % k), None, True) for k in range(3))
    assert [r.http()[1] for r in warc.Reader(io.BytesIO(whole))] == [b"payload 0", b"payload 1", b"payload 2"]
    wrong = warc.encode_record(1, "u", b"x", warc.digest(b"y"), None, True)
    for data in (whole[:-30], wrong, b"plain"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.Reader(io.BytesIO(data)))


# --- 5: neighbours -----------------------------------------------------------------------------------------------------


def test_ann_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + 2 * rng.normal(size=(9, 16))[rng.integers(0, 9, 900)]
    x[100:130] = x[100]
    rows = [(k, [float(np.float32(y)) for y in v]) for k, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df, df.where("vec_id % 50 = 0"), 5, ann.Settings(group=100, block=7)).collect()
    v = np.array([r[1] for r in rows[:900]], np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        top = np.lexsort((np.arange(900), -s))[:5]
        hits += len({r["vec_id"] for r in own} & set(top.tolist()))
        for r in own:
            assert r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-9)
    assert hits / 90 >= 0.9 and {r["query_id"] for r in found} == set(range(0, 900, 50))
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    assert ann.search(df.where("vec_id > 1999"), df, 5).count() == 0
    assert ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2
    odd = [(0, [1e200, 1e200]), (50, [1e200, 0.9e200]), (51, [1e-300, 0.0]), (52, [1.0]), (53, [1.0, 2.0, 3.0]), (54, [0.0, 5e-324])]
    odd = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(odd, odd.where("vec_id % 50 = 0"), 5).collect()}
    assert set(got) == {(0, 50), (0, 51), (0, 54), (50, 0), (50, 51), (50, 54)} and got[0, 51] == pytest.approx(0.5**0.5) and got[0, 50] == pytest.approx(1.9 / 2**0.5 / 1.81**0.5)


def test_ann_recall_of_the_registered_settings(spark):
    """Recall over whole tables: random directions, which no cut helps, and clusters, where few parts are looked through."""
    rng = np.random.default_rng(3)
    clusters = rng.normal(size=(40, 32))[rng.integers(0, 40, 12_000)] * 3 + rng.normal(size=(12_000, 32))
    for x, most in ((rng.normal(size=(12_000, 64)), 12), (clusters, 4)):
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
        index = ann.fit(ann.usable(df), len(x))
        assert index.router.w.shape[1] == 12 and index.probes <= most
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit[::50] @ unit.T
        near[np.arange(len(near)), np.arange(0, len(x), 50)] = -9
        want = {(50 * q, int(v)) for q, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for v in row}
        got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, df.where("vec_id % 50 = 0")).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


# --- 6: mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_rates(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4500, "big").when(F.col("id") < 5900, "mid").otherwise(F.lit(None)).alias("source"), F.lit(1).alias("rate"))
    out = mixing.mix(df, {"big": 1.0, "mid": 1.0, None: 2.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["big"] == pytest.approx(1500, rel=0.1) and n["mid"] == pytest.approx(1500, rel=0.1) and n[None] == pytest.approx(3000, rel=0.1)
    assert mixing.mix(df, {"big": 1.0}).where("source <> 'big' OR source IS NULL").count() == 0
    assert "rate" in out.columns
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert out.exceptAll(mixing.mix(df.repartition(7), {"big": 1.0, "mid": 1.0, None: 2.0})).isEmpty()


def test_poisson_inverts():
    def least(rate, u):
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        return k

    assert [least(1.0, u) for u in (0.0, 0.36, 0.37, 0.99)] == [0, 0, 1, 4]


def test_poisson_column(spark):
    got = spark.range(20_000).select(*(mixing.poisson(F.lit(r), lambda i: mixing.uniform("t", F.col("id"), i)).alias(f"p{k}") for k, r in enumerate((0.0, 0.4, 3.0, 50.0)))).agg(*(F.avg(f"p{k}") for k in range(4)), *(F.variance(f"p{k}") for k in range(4))).first()
    for k, r in enumerate((0.0, 0.4, 3.0, 50.0)):
        assert got[k] == pytest.approx(r, rel=0.05) and got[4 + k] == pytest.approx(r, rel=0.05)


def test_mixing_awkward(docs, none):
    out = mixing.mix(docs, epochs=3.0)
    same = out.where("doc_id = 20").groupBy("copy").count().collect()
    assert all(r["count"] == 3 for r in same)  # the repeated row's copies agree
    assert set(docs.columns) <= set(out.columns) and mixing.mix(none).count() == 0
    alike = docs.sparkSession.createDataFrame([(None, f"text {k}", "a") for k in range(400)] + [(None, None, ""), (None, "", None)], "doc_id long, text string, source string")
    n = {r["text"]: r["count"] for r in mixing.mix(alike, {"a": 1.0, "": 0.0}).groupBy("text").count().collect()}
    assert 200 < len(n) < 310 and sum(n.values()) == pytest.approx(402, rel=0.2) and None not in n  # rows without an id draw apart


def test_lookup_joins_hot_keys(spark):
    from treeline.llm._common import lookup

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    small = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    for few in (0, 10_000):
        out = lookup(df, small, "k", "n", 3000, F.col("id"), few=few)
        assert out.columns == ["id", "k", "first"] and out.count() == 3000
        assert out.where("k = 'hot' AND first <> 0 OR k IS NULL AND first <> 1 OR first IS NULL").isEmpty()


# --- 7: quality --------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    rng = random.Random(8)
    good = [(k, words(rng, 40)) for k in range(300)]
    bad = [(300 + k, " ".join(w + "$$$" for w in words(rng, 40).split())) for k in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in good + bad] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    scored = quality.score_quality(df, model).collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] < 300) for r in held]) > 0.97
    out = quality.score_quality(docs, model, keep=["doc_id"])
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    over = quality.score_quality(docs, model)  # docs has a score of its own
    assert sorted(over.columns) == sorted(docs.columns) and over.where("score < 0 OR score > 1").isEmpty()
    twice = docs.sparkSession.createDataFrame([(k // 2, f"good words {k}" if k % 4 < 2 else f"%%% {k}") for k in range(80)], "doc_id long, text string")
    labels = docs.sparkSession.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert (quality.fit(twice, labels)[0] == quality.fit(twice.orderBy(F.desc("text")).repartition(5), labels)[0]).all()
    empty = quality.fit(none, labels)
    assert quality.score_quality(none, empty, keep=["doc_id"]).count() == 0
    assert quality.score_quality(df, empty).agg(F.max("score")).first()[0] == 0.5


# --- 8: SimHash --------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids, radius=4):
    up = list(range(len(fps)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    root = [find(k) for k in range(len(fps))]
    low = {}
    for r, i in zip(root, ids):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in root]


def test_simhash(docs, rows, none):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_components(docs).collect())
    fps = [slow_fingerprint(r[1]) for r in rows]
    assert got == Counter(zip([r[0] for r in rows], fps, slow_components(fps, [r[0] for r in rows])))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(slow_components(fps, [r[0] for r in rows])))
    assert simhash.near_dedup(none).count() == 0


def test_links_chains_and_shards(spark, monkeypatch):
    rng, fps = random.Random(6), []
    for _ in range(40):  # chains whose ends are far apart
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
    base = rng.getrandbits(64)
    fps += [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = slow_components(fps, list(range(len(fps))))
    for shard in (8192, 16):
        monkeypatch.setattr(simhash, "SHARD", shard)
        comp = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(df)).collect()}
        classes: dict = {}
        for k, f in enumerate(fps):
            classes.setdefault(comp.get(f, f"alone {f}"), set()).add(want[k])
        assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want))


def test_simhash_masks_lose_no_link(spark, monkeypatch):
    """Every choice of k, and another radius: components equal brute force; any few differing bits leave a mask whole."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for f in fps for _ in range(4)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bucket, radius, keys in ((1000, 4, 5), (0, 4, 70), (0, 6, 210), (1000, 2, 3)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        kept = simhash.masks(len(fps) if bucket else 1 << 60, radius)
        monkeypatch.setattr(simhash, "masks", lambda n, r, kept=kept: kept)
        assert len(kept) == keys
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & d == 0 for m in kept)
        comp = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(df, radius)).collect()}
        root = {f: f for f in fps}
        for i, a in enumerate(fps):  # the least reachable by joining classes
            for b in fps[:i]:
                if (a ^ b).bit_count() <= radius and root[a] != root[b]:
                    lo, hi = sorted((root[a], root[b]))
                    root = {f: lo if r == hi else r for f, r in root.items()}
        assert len(set(root.values())) == len({comp.get(f, f) for f in fps}) and all((comp.get(a, a) == comp.get(b, b)) == (root[a] == root[b]) for a in fps[::7] for b in fps)
        monkeypatch.undo()


# --- 9: token files ----------------------------------------------------------------------------------------------------


def test_token_files(docs, rows, none, monkeypatch):
    monkeypatch.setattr(ordered, "PART_BYTES", 1 << 12)
    raw = Path(BYTES).read_bytes()
    tok = Tokenizer.from_file(BYTES)
    want, start = [], 0
    for i, t in in_order(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, tokenfiles.write_and_read(docs, raw).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    monkeypatch.setattr(tokenfiles, "FILE_TOKENS", 300)
    again = tokenfiles.write_and_read(docs, raw).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == want
    assert tokenfiles.write_and_read(none, raw).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 300, 1001).astype(np.uint32), rng.integers(0, 1 << 31, 70_003).astype(np.uint32), (rng.zipf(1.2, 90_001) % 200_000).astype(np.uint32)):
        assert (tokenfiles.unpack(len(ids), *tokenfiles.pack(ids)) == ids).all()


def test_token_encoder_equals_library():
    tok, rng = Tokenizer.from_file(BYTES), random.Random(9)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "×", "€", " ", "　", " ", "\x85", "'s", "don't", "12", "!?", "\r\n", "<|endoftext|>", "字", "😀", "ing,", " the.", " x***"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(1500)]
    own = tokenfiles.Encoder(Path(BYTES).read_bytes())
    for part in (texts, ["a <|endoftext|> b", None, "", "x\ny z"], [], ["even text\nof two lines"] * 3):
        ids, sizes = own.encode(pa.array(part, pa.string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert 50256 in own.encode(pa.array(["a <|endoftext|> b"]))[0]


# --- 10: personal data -------------------------------------------------------------------------------------------------

import re  # noqa: E402

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for kind, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a012459.@+- ()%é\n") for _ in range(rng.choice([3, 20, 60])))
        assert pii.base_spans(t) == slow_spans(t)
    long = "1." * 30_000 + "a" * 60_000 + "@" + "9" * 60_000 + " 1" * 30_000 + "@" * 30_000 + "+1 " * 20_000
    assert isinstance(pii.candidates(long), list)  # linear in the text


def test_pii_results(docs, rows, none, spark):
    model = pii.fit(docs)
    text_of = {i: t or "" for i, t, *_ in rows}
    for r in by_id(pii.find(docs, model)):
        base = slow_spans(text_of[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        assert set(pii.spell(base).split(",")) <= set(r["spans"].split(","))
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs, model).collect()}
    assert out[6] == "mail <EMAIL> or <PHONE> or <IP> or <CARD>!" and out[0] is None and out[1] == ""
    assert pii.find(none, pii.fit(none)).count() == 0 and pii.redacted(none, model).count() == 0


def test_boosting_learns_and_adds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    b = pii.Boosted(pii.Settings()).fit(x[:1500], y[:1500])
    assert ((b.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    model = pii.Model(b)
    model.boosted.predict = lambda z: np.ones(len(z))
    model.thresholds = (0.5,) * 4
    t = "write to jane at host dot example soon"
    assert pii.redact(t, pii.all_spans(t, model)) == "write to <EMAIL> soon"
    assert pii.all_spans(t, pii.Model(None)) == []
