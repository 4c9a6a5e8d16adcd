"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax, numpy SGD."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import batches, bounded_batches, give_back, texts_of


@dataclass(frozen=True)
class Settings:
    """buckets: rows of the hashed table; dim: of the vectors; grams: lengths of character n-grams, in bytes;
    max_train: labelled documents that a fit takes at most, smallest crc32 of the id first."""

    buckets: int = 1 << 16
    dim: int = 16
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 4
    rate: float = 0.4
    max_train: int = 3000
    seed: int = 1


_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BACK, k, 1 << 64))])
        return self.up, self.down


def features(text: bytes, powers: Powers, s: Settings) -> list[np.ndarray]:
    """Buckets of a whole text's features, in groups: the end (always once), words, word pairs, n-grams of bytes.

    Words are runs without ASCII white space, and n-grams run over the words with one space around each. A word that
    repeats its neighbour makes one and the same pair, whatever the word.
    """
    groups, shift = [np.zeros(1, np.int64)], np.uint64(65 - s.buckets.bit_length())
    words = text.split()
    if not words:
        return groups
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    wide = data.astype(np.uint64)
    up, down = powers.upto(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(wide * up[: len(data)])])
    spaces = np.flatnonzero(data == 32)
    start, end = spaces[:-1] + 1, spaces[1:]
    word = (sums[end] - sums[start]) * down[start]
    groups.append(((word * _MIX) >> shift).astype(np.int64))
    pair = ((word[:-1] * np.uint64(31) + word[1:] + np.uint64(1)) * _MIX) >> shift
    groups.append(np.where(word[:-1] == word[1:], 1, pair.astype(np.int64)))
    for n in s.grams:
        gram = np.full(max(0, len(data) - n + 1), np.uint64(n))
        for k in range(n):
            gram = (gram << np.uint64(8)) | wide[k : len(data) - n + 1 + k]
        groups.append(((gram * _MIX) >> shift).astype(np.int64))
    return groups


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """SGD over the softmax's logistic form: (what each bucket adds to a document's mean logit, bias)."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    if not examples:
        return np.zeros(s.buckets, np.float32), 0.0
    steps, done = s.epochs * len(examples), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(examples)):
            ids, counts, label = examples[k]
            rate = np.float32(s.rate * (1 - done / steps))
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p * np.float32(0.1)
            vectors[ids] -= (rate * share)[:, None] * back[None, :] * np.float32(len(ids) ** 0.5)
            done += 1
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


_EXAMPLE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())])


def _id_type(s: Settings) -> type:
    return np.uint16 if s.buckets <= 1 << 16 else np.int32


def _examples(s: Settings):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            powers = Powers()
            for b in bounded_batches(it):
                for i, y, t in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), texts_of(b.column("text")), strict=True):
                    counts = np.bincount(np.concatenate(features(t, powers, s)), minlength=s.buckets)
                    ids = np.flatnonzero(counts)
                    counts = counts[ids].astype(np.int32)
                    counts = counts.astype(np.uint8) if counts.max() < 256 else counts
                    yield i, zlib.crc32(t), y, ids.astype(_id_type(s)).tobytes(), counts.tobytes(), counts.itemsize

        return batches(_EXAMPLE, rows(), 200)

    return run


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on docs (doc_id, text) and labels (doc_id, quality) where not held_out. The sample's bound is s.max_train.

    NULL labels are left out; of several labels of a document the least counts, and of several texts that
    of the least crc32. Without any example every score is the same.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))), "doc_id").limit(s.max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_examples(s), "doc_id long, h long, label int, ids binary, counts binary, width int")
    # ids and counts as bytes of the least width: they are most of what the driver holds
    found = sample.toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["h"].to_pylist(), range(found.num_rows), strict=True))
    first = [k for n, (i, _, k) in enumerate(rows) if not n or rows[n - 1][0] != i]
    examples = []
    for k in first:
        ids, counts = (found[c][k].as_buffer() for c in ("ids", "counts"))
        width = np.uint8 if found["width"][k].as_py() == 1 else np.int32
        examples.append((np.frombuffer(ids, _id_type(s)), np.frombuffer(counts, width), 1 if found["label"][k].as_py() else 0))
    model = train(examples, s)
    del examples, found, rows
    give_back(docs.sparkSession)
    return model


def _scores(model, s: Settings, keep: list[str], score: str):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = pickle.loads(model.value)
        powers = Powers()
        for b in bounded_batches(it):
            out = []
            for t in texts_of(b.column("text")):
                groups = features(t, powers, s)
                mean = sum(float(value[g].sum(dtype=np.float64)) for g in groups) / sum(map(len, groups))
                out.append(1 / (1 + np.exp(-np.clip(mean + bias, -700, 700))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, score])

    return run


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns `keep` of docs (all, if None) and a score from 0 to 1 of the whole text (higher: label 1 likelier).

    A column of the score's name is replaced. NULL and empty texts get what the end feature alone gives. Equal texts get equal scores. The model, of fixed size,
    is broadcast.
    """
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    types = dict(docs.dtypes)
    if score == "text":
        raise ValueError("the score can't replace the text")
    keep = [c for c in keep if c != score]
    cols = keep if "text" in keep else [*keep, "text"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{score}` double"
    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(_scores(sent, s, keep, score), schema)
