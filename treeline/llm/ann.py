"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts; a small softmax classifier learns to tell a vector's part.
Every row is indexed in its likeliest part, and a query looks through its several likeliest parts, exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """parts: of the graph at most, one for 1000 vectors; sample: vectors that the fit takes at most, smallest hash of the
    id first; neighbours: of the graph; recall: of the nearest of a held-out tenth of the sample, which the number of parts
    that a query looks through is fitted to; group, block: vectors and queries that one task compares at most, about."""

    parts: int = 64
    sample: int = 6000
    neighbours: int = 10
    rounds: int = 30
    epochs: int = 40
    rate: float = 0.5
    recall: float = 0.95
    group: int = 20_000
    block: int = 4000
    seed: int = 5


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: exact, and no square leaves a double's range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """graph[i]: the k nearest others of each unit vector, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        if k:
            out[lo : lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def cut_graph(graph: np.ndarray, x: np.ndarray, s: Settings) -> np.ndarray:
    """Balanced parts of a neighbour graph: from a random direction's order, vertices move to the part that most of their
    neighbours are in, strongest wish first, while a part has fewer than 1.1 times its share."""
    rng, n = np.random.default_rng(s.seed), len(graph)
    parts = max(1, min(s.parts, n))
    room = int(np.ceil(1.1 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.full(n, -1)
    like = x @ centres.T
    sizes = np.zeros(parts, np.int64)
    for i in np.argsort(-like.max(axis=1), kind="stable"):
        for p in np.argsort(-like[i], kind="stable"):
            if sizes[p] < room:
                part[i], sizes[p] = p, sizes[p] + 1
                break
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(s.rounds):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[wish[i]] < room and rng.random() < 0.7:
                sizes[part[i]] -= 1
                sizes[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax regression from unit vectors to parts, on soft labels: where a vector's neighbours and itself are."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, part: np.ndarray, s: Settings):
        rng, n, parts = np.random.default_rng(s.seed), len(x), int(part.max()) + 1
        y = np.bincount(np.repeat(np.arange(n), graph.shape[1]) * parts + part[graph].ravel(), minlength=n * parts).reshape(n, parts).astype(float)
        y[np.arange(n), part] += max(1, graph.shape[1])
        y /= y.sum(axis=1, keepdims=True)
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        for e in range(s.epochs):
            rate = s.rate * 20 * (1 - e / s.epochs)
            for at in np.array_split(rng.permutation(n), max(1, n // 128)):
                g = self._softmax(x[at] @ self.w + self.b) - y[at]
                self.w -= rate * x[at].T @ g / len(at)
                self.b -= rate * 0.1 * g.mean(axis=0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def parts(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The likeliest parts of unit vectors, likeliest first; the same for equal vectors."""
        z = np.stack([(x * w).sum(axis=1) for w in self.w.T], axis=1) + self.b
        return np.argsort(-z, axis=1, kind="stable")[:, : min(probes, z.shape[1])]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that can take part: not NULL, not all zero, every component a finite number."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return found.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


@dataclass
class Index:
    """The router, and how many parts a query looks through."""

    router: Router
    probes: int


def fit(vectors: DataFrame, n: int, k: int = 5, s: Settings = Settings()) -> Index:
    """From a sample of n usable vectors (vec_id, v; one at least, of one length) that is bounded by s.sample.

    Nine tenths make the graph, its parts and the router. The others are queries over these: the fewest parts that hold
    s.recall of their k nearest are looked through. In a sample the nearest are farther than among all, so more is found.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(s.seed)), "vec_id").limit(s.sample).toArrow()
    x = _unit(np.array(rows["v"].to_pylist()))
    asks, x = (x[::10], x[np.arange(len(x)) % 10 > 0]) if len(x) >= 100 else (x, x)
    own = replace(s, parts=max(1, min(s.parts, n // 1000, len(x) // 50)))
    graph = neighbour_graph(x, s.neighbours)
    router = Router(x, graph, cut_graph(graph, x, own), own)
    near = np.argsort(-(asks @ x.T), axis=1, kind="stable")[:, :k]
    order = router.parts(asks, own.parts)
    place = np.argsort(order, axis=1)  # of each part in a query's order
    found = np.take_along_axis(place, router.parts(x, 1)[:, 0][near], axis=1).ravel()
    share = np.cumsum(np.bincount(found, minlength=order.shape[1])) / len(found)
    return Index(router, int(np.argmax(share >= min(s.recall, share[-1]))) + 1)


def _route(index, sizes: np.ndarray | None = None, least: int = 0):
    """Adds parts: the likeliest one, or with the parts' sizes those to look through, until they hold `least` vectors."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = pickle.loads(index.value)
        for b in it:
            if not b.num_rows:
                continue
            x = _unit(np.array(b.column("v").to_pylist()))
            if sizes is None:
                parts = own.router.parts(x, 1).tolist()
            else:
                order = own.router.parts(x, len(sizes))
                short = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1)
                parts = [o[:n] for o, n in zip(order.tolist(), np.maximum(own.probes, short + 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(parts, pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    return run


def _nearest(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("vec_id", kind="stable")
        c, ids = _scaled(np.stack(right["v"].to_numpy())), right["vec_id"].to_numpy()
        q, own = _scaled(np.stack(left["v"].to_numpy())), left["vec_id"].to_numpy()
        cn, qn = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        out = []
        for lo in range(0, len(q), 64):
            quick = (q[lo : lo + 64] / qn[lo : lo + 64, None]) @ (c / cn[:, None]).T
            quick[own[lo : lo + 64, None] == ids[None, :]] = -np.inf
            most = min(k, len(ids))
            bar = np.partition(quick, len(ids) - most, axis=1)[:, len(ids) - most] - 1e-9
            for j in range(len(quick)):
                # all that may tie with the last are measured row by row, so that equal vectors get equal scores
                at = np.flatnonzero((quick[j] >= bar[j]) & np.isfinite(quick[j]))
                score = (c[at] * q[lo + j]).sum(axis=1) / (cn[at] * qn[lo + j])
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": own[lo + j], "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat([none, *out])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k nearest found among vectors but its own vec_id.

    Both have vec_id, embedding. Nearness is the cosine in double precision, ties go to the smaller vec_id. Vectors that
    usable() leaves out, and those of another length than most of vectors (of equally many, the longest), take no part,
    nor does a query of another length. Repeated ids are candidates each; of queries with one id the
    least is answered. Every vector
    is indexed. A part's vectors and the queries that look through it are dealt into groups and blocks of bounded size,
    and every group meets every block in a task of its own, so no task grows with a part.
    """
    spark = vectors.sparkSession
    every, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    length = every.groupBy(F.size("v").alias("l")).count().orderBy(F.desc("count"), F.desc("l")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every, asked = every.where(F.size("v") == length["l"]), asked.where(F.size("v") == length["l"])
    index = fit(every, length["count"], k, s)
    sent, routed = spark.sparkContext.broadcast(pickle.dumps(index)), "vec_id long, v array<double>, parts array<int>"
    indexed = every.mapInArrow(_route(sent), routed).select("vec_id", "v", F.element_at("parts", 1).alias("part"))
    held = dict(indexed.groupBy("part").count().collect())  # as many rows as parts
    n = np.array([held.get(p, 0) for p in range(index.router.w.shape[1])])
    asked = asked.mapInArrow(_route(sent, n, k + 1), routed).select("vec_id", "v", F.explode("parts").alias("part"))
    groups = spark.createDataFrame([(p, -(-c // s.group)) for p, c in enumerate(n.tolist()) if c], "part int, _groups int")
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / s.block).cast("int").alias("_blocks"))
    sizes = F.broadcast(groups.join(blocks, "part"))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "part").select("vec_id", "v", "part", deal("_blocks", 4).alias("block"), each("_groups").alias("group"))
    right = indexed.join(sizes, "part").select("vec_id", "v", "part", deal("_groups", 3).alias("group"), each("_blocks").alias("block"))
    keys = ["part", "group", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
