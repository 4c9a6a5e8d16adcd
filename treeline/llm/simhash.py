"""SimHash near-duplicates: shingle fingerprints, BK-tree shards for the links, stars for the components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treeline.llm._common import batches, drop_path, lookup, materialize, texts_of

#: Distinct fingerprints that agree in a key, on average, at most.
BUCKET = 1000
#: Fingerprints that one task takes of a bucket, at least; a larger bucket is cut into shards that meet in pairs.
SHARD = 8192
#: Queries that walk a forest together.
WALK = 4096
#: Rows of whole buckets that make one forest.
FOREST = 100_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned integer; 0 without words.

    A-Z is lowered, words are runs without ASCII white space, and a bit is set if it is set in over half the shingles'
    XXH64. Fewer words than `width` make one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(joined, seed)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip(starts[at:to], starts[at + width : to + width], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes (uint64), as an unsigned integer: a bit is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


class Forest:
    """BK-trees over uint64 values: one tree a group; a node's children are keyed by their Hamming distance to it.

    Built level by level: the first value of each group becomes a node, the others fall into groups by distance.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values, n = values, len(values)
        self.root_of: dict[int, int] | None = None
        rest, key = np.arange(n), groups.astype(np.int64)
        child_key, child = [], []
        self.group_ids, self.roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first_level = True
        while len(rest):
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.ones(len(rest), bool)
            new[1:] = key[1:] != key[:-1]
            heads, at = rest[new], np.cumsum(new) - 1
            if first_level:
                self.group_ids, self.roots, first_level = key[new], heads, False
            else:
                child_key.append(key[new])
                child.append(heads)
            left = ~new
            parent = heads[at[left]]
            rest = rest[left]
            key = parent.astype(np.int64) * 65 + np.bitwise_count(values[rest] ^ values[parent])
        keys = np.concatenate(child_key) if child_key else np.zeros(0, np.int64)
        nodes = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.child_key, self.child = keys[order], nodes[order]

    def search(self, values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of queries, nodes) within the radius, in pieces; only edges within the radius are followed."""
        for at in range(0, len(values), WALK):
            q = np.arange(at, min(at + WALK, len(values)))
            node = self.roots[np.searchsorted(self.group_ids, groups[q])]
            while len(q):
                d = np.bitwise_count(values[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                lo = np.searchsorted(self.child_key, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.child_key, node * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                q = np.repeat(q, n)
                node = self.child[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def local_roots(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For each value, the least position that links within its group lead to."""
    label = np.arange(len(values))
    for q, node in Forest(values, groups).search(values, groups, radius):
        a, b = q[q != node], node[q != node]
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(radius: int):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            groups = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            root = local_roots(values, groups, radius)
            other = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(values[other].view(np.int64)), pa.array(values[root[other]].view(np.int64))], schema=_EDGE)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in it:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "value", "i", "j")], axis=1)
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((keys, fps))
            n += len(fps)
            if n >= FOREST:  # all but the last bucket is whole
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.argmax((keys == keys[-1]).all(axis=1)))
                if cut:
                    yield work([(keys[:cut], fps[:cut])])
                held, n = [(keys[cut:], fps[cut:])], len(fps) - cut
        if n:
            yield work(held)

    return run


def masks(n: int, radius: int) -> list[int]:
    """Bits that a fingerprint's keys keep: of k + radius blocks, every choice of k; at most radius differing bits leave
    one of these choices whole. k grows with the number of fingerprints, so that BUCKET of them share a key on average."""
    k = 1
    while k < 4 and n >> (64 * k // (k + radius)) > BUCKET:
        k += 1
    cuts = [64 * i // (k + radius) for i in range(k + radius + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k)]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp), enough to connect all that chains of links connect.

    Rows meet in a bucket if they agree in the bits of a mask. A bucket of over max(SHARD, 1/1000 of all rows) values, of
    which there are at most 1000 a mask, is cut into shards that meet in pairs, so that no task holds more than two shards.
    """
    n = fps.count()
    most = max(SHARD, n // 1000)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    band = [F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for k, m in enumerate(masks(n, radius))]
    dealt = fps.select("fp", F.explode(F.array(*band)).alias("b")).select("fp", "b.*")
    large = dealt.groupBy("band", "value").count().where(F.col("count") > most).select("band", "value", F.ceil(F.col("count") / most).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int")
    pairs = F.when(F.col("shards").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: F.struct(F.least(s, own).alias("i"), F.greatest(s, own).alias("j")))
    )
    dealt = dealt.join(F.broadcast(large), ["band", "value"], "left").select("fp", "band", "value", F.explode(pairs).alias("p")).select("fp", "band", "value", "p.i", "p.j")
    return dealt.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j", "fp").mapInArrow(_edges(radius), "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches, by alternating large and small stars.

    Each round is written to the shared folder; only counts reach the driver. The edges of a star's hub are dealt by
    salts, so that a component of any size lands in no single task.
    """
    spark = edges.sparkSession

    def least(stars: DataFrame, of: DataFrame, total: int) -> DataFrame:
        """Edges of `of` with m, the least end of u's star in stars, which has `total` edges."""
        low = stars.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return lookup(of, low, "u", "n", total, F.col("v"), how="inner")

    e, path = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before, n = None, e.count()
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        large = least(both, both.where("v > u"), 2 * n).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least(large, large, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e2, path2 = materialize(small, "edges")
        drop_path(spark, path)
        e, path = e2, path2
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before, n = now, now[0]
    raise RuntimeError("components did not settle")


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in it:
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), strict=True):
                f = fingerprint(t)
                yield i, f - (1 << 64) if f >> 63 else f

    return batches(_FP, rows(), 20_000)


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, int]:
    """doc_id and fp of every row; least_id, n_rows and root of every distinct fp; the number of rows."""
    fps, _ = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    uniq, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")), "distinct-fingerprints")
    total = fps.count()
    comp = components(links(uniq.select("fp"), radius))
    return fps, uniq.join(comp, uniq["fp"] == comp["node"], "left").select("fp", "least_id", "n_rows", F.coalesce("root", "fp").alias("root")), total


def simhash_components(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed), component_id of every row of docs (doc_id, text).

    NULL and blank texts have fingerprint 0 and link like any other. Equal rows get equal results. Rows with a NULL
    doc_id keep it; their component's id is the smallest doc_id that is not NULL, or NULL without any. An empty table
    gives an empty one; other columns are not looked at.
    """
    fps, rooted, total = _rooted(docs, radius)
    rooted, _ = materialize(rooted, "rooted")
    ids, _ = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_fps")), "roots")
    distinct = ids.agg(F.coalesce(F.sum("n_fps"), F.lit(0))).first()[0]
    named, _ = materialize(lookup(rooted, ids, "root", "n_fps", distinct, F.col("fp")).select("fp", "n_rows", "component_id"), "components")
    return lookup(fps, named, "fp", "n_rows", total, F.col("doc_id")).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without near copies: of each component, whatever its ids, one row of its smallest doc_id stays.

    NULL ids come last; of rows with equal ids and fingerprints any one stays.
    """

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t) for t in texts_of(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "__tl_key"])

    _, rooted, _ = _rooted(docs, radius)
    keyed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__tl_key", LongType())]))
    return keep_one(keyed, rooted.withColumnRenamed("fp", "key"))


def keep_one(keyed: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of each root of rooted (key, least_id, root; one row a key): that of its smallest least_id, NULL last.

    keyed: rows with doc_id and their key in __tl_key, which the result is without.
    """
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")).alias("w")).select(F.col("w.key").alias("__tl_key"), F.col("w.none").alias("__tl_none"), F.coalesce("w.least_id", F.lit(0)).alias("__tl_id"))
    on = ["__tl_key", "__tl_none", "__tl_id"]  # one exchange serves the join and the choice
    own = keyed.withColumn("__tl_none", F.col("doc_id").isNull()).withColumn("__tl_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    return own.join(first, on, "left_semi").dropDuplicates(on).drop(*on)
