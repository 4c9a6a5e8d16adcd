"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

The model reads a text as its words (runs without ASCII white space, A-Z lowered), a space between, a line feed at the
end. A byte is eight binary decisions; each has a tree of contexts, the up to DEPTH bytes before. Counts of the training
texts give every node a Krichevsky-Trofimov estimate; a node's weighted probability is half its own block probability
plus half the product of its children's, which fixes how much the prediction trusts each depth. Trees, counts and
predictions are tables, so the model grows with the corpus; a block of documents gets the rows that it uses by a join.
The code length per byte is that of the modelled bytes: words, spaces and the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import bounded_batches, give_back, materialize, texts_of

#: Bytes of context; with the byte itself a packed gram takes DEPTH + 1 of a long's eight bytes.
DEPTH = 5
#: Bytes of a file that make one block of documents, about.
BLOCK_BYTES = 16 << 20
#: Depth from which a context's subtree is worked out in one piece: at most 256 ** (DEPTH - SPLIT + 1) grams, a fixed bound.
SPLIT = 3
#: Grams that are worked out together, about.
PIECE = 200_000
_HALF = math.log(0.5)
#: Bytes of text whose grams are held at once, and grams that wait to be merged at most.
SLICE, WAITING = 1 << 20, 1_500_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts, one a byte, in order; where each text's begin). A gram is a byte in its context, packed."""
    pad = b"\n" * DEPTH
    pieces = [b" ".join(w) + b"\n" for w in texts]
    data = np.frombuffer(b"".join(pad + p for p in pieces), np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in pieces], np.int64)
    packed = data.copy()
    for k in range(1, DEPTH + 1):
        packed[k:] |= data[:-k] << np.uint64(8 * k)
    start = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(DEPTH * np.arange(1, len(sizes) + 1), sizes)
    return packed[at], start


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 7; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class _Counts:
    """What one block uses: its grams and words, and how often its training texts have them."""

    def __init__(self):
        self.grams = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.words: Counter = Counter()
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self) -> None:
        """Bring what add() left waiting into the sorted arrays."""
        if self.waiting:
            both, back = np.unique(np.concatenate([self.grams, *(g for g, _ in self.waiting)]), return_inverse=True)
            self.counts = np.bincount(back, np.concatenate([self.counts, *(n for _, n in self.waiting)]), len(both)).astype(np.int64)
            self.grams, self.waiting = both, []

    def add(self, texts: list[bytes], held: list[bool]) -> None:
        split = [words_of(t) for t in texts]
        for w, h in zip(split, held, strict=True):
            if h:
                for x in set(w):
                    if x not in self.words:
                        self.words[x] = 0
                self.words.setdefault(b"\n", 0)
            else:
                self.words.update(w)
                self.words[b"\n"] += 1
        g, start = grams(split)
        train = np.repeat(~np.array(held), np.diff(start, append=len(g)))
        key = np.sort((g << np.uint64(1)) | train)
        first = np.flatnonzero(np.diff(key >> np.uint64(1), prepend=np.uint64(1 << 63)))
        n = np.add.reduceat((key & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        self.waiting.append((key[first] >> np.uint64(1), n))
        if sum(len(g) for g, _ in self.waiting) > WAITING:
            self.merge()


_FACT = pa.schema([("block", pa.int64()), ("g", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block uses. A task reads its splits one after the other, so a split's blocks are complete once another begins."""
    blocks: dict[int, dict[int, _Counts]] = {}
    for b in bounded_batches(it, SLICE):
        rows: dict[tuple[int, int], tuple[list, list]] = {}
        for s, k, t, h in zip(b.column("split").to_pylist(), b.column("block").to_pylist(), texts_of(b.column("text")), b.column("held_out").to_pylist(), strict=True):
            texts, held = rows.setdefault((s, k), ([], []))
            texts.append(t)
            held.append(h)
        last = s
        for (s, k), (texts, held) in rows.items():
            blocks.setdefault(s, {}).setdefault(k, _Counts()).add(texts, held)
        for s in [s for s in blocks if s != last]:
            yield from _facts(blocks.pop(s))
            give_back()
    for found in blocks.values():
        yield from _facts(found)
    blocks.clear()
    give_back()


def _facts(blocks: dict[int, _Counts]) -> Iterator[pa.RecordBatch]:
    for k, c in blocks.items():
        c.merge()
        n = len(c.grams)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(c.grams.view(np.int64)), pa.nulls(n, pa.binary()), pa.array(c.counts)], schema=_FACT)
        n = len(c.words)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.nulls(n, pa.int64()), pa.array(c.words.keys(), pa.binary()), pa.array(c.words.values(), pa.int64())], schema=_FACT)


def _lgamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series, eight steps up."""
    y = x + 8.0
    up = x * (x + 1.0) * (x + 2.0) * (x + 3.0)
    up2 = (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(up) - F.ln(up2)


def _block(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _ln_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_block() for arrays."""

    def lgamma(x: np.ndarray) -> np.ndarray:
        y = x + 8
        series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
        up = x * (x + 1) * (x + 2) * (x + 3)
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(up) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))

    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)


class _Subtrees:
    """The levels DEPTH to SPLIT of all decisions of some grams: counts, trust and how nodes hang together.

    A decision is a context and a node (1 and the bits of the byte so far), packed as context * 256 + node.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        k = np.arange(8, dtype=np.uint64)
        byte, ctx = grams & np.uint64(255), grams >> np.uint64(8)
        node = (byte[:, None] | np.uint64(256)) >> (np.uint64(8) - k)
        self.bit = ((byte[:, None] >> (np.uint64(7) - k)) & np.uint64(1)).astype(bool).ravel()
        keys, self.at = np.unique(((ctx << np.uint64(8))[:, None] | node).ravel(), return_inverse=True)
        n = np.repeat(counts, 8)
        a = np.bincount(self.at, np.where(self.bit, 0, n), len(keys))
        b = np.bincount(self.at, np.where(self.bit, n, 0), len(keys))
        self.levels = [(a, b, np.ones(len(keys)))]  # zeros, ones, trust in a node's own estimate
        self.up: list[np.ndarray] = []
        lw = _ln_block(a, b)
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            keys, up = np.unique(keys & np.uint64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
            a, b, below = (np.bincount(up, x, len(keys)) for x in (a, b, lw))
            own = _HALF + _ln_block(a, b)
            lw = np.logaddexp(own, _HALF + below)
            self.levels.append((a, b, np.exp(own - lw)))
            self.up.append(up)
        self.keys, self.lw = keys, lw

    def scores(self, known: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's byte: the prediction at SPLIT is known + rest * (what the deeper nodes say)."""
        for depth in range(len(self.up) - 1, -1, -1):
            a, b, stop = self.levels[depth]
            known, rest = known[self.up[depth]], rest[self.up[depth]]
            known = known + rest * stop * (b + 0.5) / (a + b + 1)
            rest = rest * (1 - stop)
        one = known[self.at]
        return np.log10(np.where(self.bit, one, 1 - one)).reshape(-1, 8).sum(axis=1)


def _upper(piece: pa.Table) -> pa.Table:
    t = _Subtrees(piece["g"].to_numpy().view(np.uint64), piece["n"].to_numpy())
    a, b, _ = t.levels[-1]
    return pa.table({"ctx": (t.keys >> np.uint64(8)).astype(np.int64), "node": (t.keys & np.uint64(255)).astype(np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64), "lw": t.lw, "stop": t.levels[-1][2]})


def _lower(piece: pa.Table, above: pa.Table) -> pa.Table:
    t = _Subtrees(piece["g"].to_numpy().view(np.uint64), piece["n"].to_numpy())
    key = (above["ctx"].to_numpy().astype(np.uint64) << np.uint64(8)) | above["node"].to_numpy().astype(np.uint64)
    order = np.argsort(key)
    if not (key[order] == t.keys).all():
        raise RuntimeError("a context was not counted")
    return pa.table({"g": piece["g"], "lp": t.scores(above["known"].to_numpy()[order], above["rest"].to_numpy()[order])})


def _then_give_back(work):
    """work, after which a worker keeps no freed memory for the tasks that come after."""

    def upper(piece: pa.Table) -> pa.Table:
        out = work(piece)
        give_back()
        return out

    def lower(piece: pa.Table, above: pa.Table) -> pa.Table:
        out = work(piece, above)
        give_back()
        return out

    return upper if work is _upper else lower


def predictions(counts: DataFrame) -> DataFrame:
    """g, lp: log10 of the probability of each gram's byte in its context. counts: g, n (0 where only seen to be scored).

    Subtrees below SPLIT bytes of context are worked out in pieces, what is above by joins of small tables.
    """
    low = (1 << (8 * SPLIT)) - 1
    pieces = max(1, counts.count() // PIECE)
    deal = lambda ctx: F.pmod(F.xxhash64(ctx.bitwiseAND(low)), F.lit(pieces)).cast("int")
    dealt = counts.select("g", "n", deal(F.shiftrightunsigned("g", 8)).alias("piece"))
    level, _ = materialize(dealt.groupBy("piece").applyInArrow(_then_give_back(_upper), "ctx long, node int, a long, b long, lw double, stop double"), "ctw")
    trees, a, b = [level], F.col("a").cast("double"), F.col("b").cast("double")
    for d in range(SPLIT - 1, -1, -1):
        up = level.groupBy(F.col("ctx").bitwiseAND((1 << (8 * d)) - 1).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        up = up.withColumn("own", _HALF + _block(a, b)).withColumn("other", _HALF + F.col("below"))
        up = up.withColumn("lw", F.greatest("own", "other") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("other")))))
        level, _ = materialize(up.select("ctx", "node", "a", "b", "lw", F.exp(F.col("own") - F.col("lw")).alias("stop")), "ctw")
        trees.append(level)
    trees.reverse()
    kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    # from the root down: the prediction is known + rest * (what the deeper nodes say)
    at = trees[0].select("ctx", "node", (F.col("stop") * kt).alias("known"), (1.0 - F.col("stop")).alias("rest"))
    for d in range(1, SPLIT + 1):
        above = at.select(F.col("ctx").alias("_up"), F.col("node").alias("_node"), F.col("known").alias("_known"), F.col("rest").alias("_rest"))
        joined = trees[d].join(above, (F.col("ctx").bitwiseAND((1 << (8 * (d - 1))) - 1) == F.col("_up")) & (F.col("node") == F.col("_node")))
        at = joined.select("ctx", "node", (F.col("_known") + F.col("_rest") * F.col("stop") * kt).alias("known"), (F.col("_rest") * (1.0 - F.col("stop"))).alias("rest"))
    at = at.withColumn("piece", deal(F.col("ctx")))
    return dealt.groupBy("piece").cogroup(at.groupBy("piece")).applyInArrow(_then_give_back(_lower), "g long, lp double")


class _Lookup:
    """Values of sorted uint64 keys by a hashed place, or by halving where two keys share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.place[self._at(self.keys)] = np.arange(len(keys))

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self._at(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        if len(miss) and (self.keys[at[miss]] != keys[miss]).any():
            raise RuntimeError("a gram was not counted")
        return self.values[at]


def _score(total: int, distinct: int):
    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        is_word = facts["word"].is_valid()
        known = facts.filter(is_word)
        number = {w: k for k, w in enumerate(known["word"].to_pylist())}
        count = known["value"].to_numpy()
        log = np.log10(count + 1) - math.log10(total + distinct + 1)
        tree = facts.filter(facts["g"].is_valid())
        look = _Lookup(tree["g"].to_numpy().view(np.uint64), tree["value"].to_numpy())
        del known, tree
        end = number[b"\n"]
        n_tokens, n_known, base, score, n_bytes = [], [], [], [], []
        for b in bounded_batches(docs.to_batches(), SLICE):
            split = [words_of(t) for t in texts_of(b.column("text"))]
            for w in split:
                at = np.fromiter((*map(number.__getitem__, w), end), np.int64, len(w) + 1)
                n_tokens.append(len(at))
                n_known.append(int((count[at] > 0).sum()))
                base.append(float(log[at].sum()))
            g, start = grams(split)
            score += np.add.reduceat(look(g), start).tolist()
            n_bytes += np.diff(start, append=len(g)).tolist()
        bits = np.array(score, float) / (-math.log10(2) * np.array(n_bytes, float))
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(base), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(bits, pa.float64())})

    return run


_COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes and bits_per_byte (the code
    length of the modelled bytes) of every row of docs (doc_id, text).

    Trained on the rows that held_out() leaves. NULL and empty texts are an end alone; a very long text is one row of its
    block, whole. Rows with a NULL doc_id are trained on and scored like others. Equal texts get equal scores. An empty
    table gives an empty result; without training texts every decision is even. Other columns are not looked at. Input
    that is not plainly read from files is written to the shared folder first, so that its blocks are bounded too.
    """
    spark, key = docs.sparkSession, "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")  # files are split alike in both passes, however many cores there are meanwhile
    try:
        return materialize(_score_all(docs), "scores")[0]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _of_files(df: DataFrame) -> bool:
    """True where df's rows are columns of one table of files, maybe filtered."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def _score_all(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _of_files(own):
        own, _ = materialize(own, "texts")
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    parts = max(1, -(-split // BLOCK_BYTES))
    # a block is a part of a file's split, so counting needs no exchange of texts
    place = F.concat_ws(":", F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    own = own.withColumn("block", F.xxhash64(place)).withColumn("held_out", held_out(F.col("doc_id")))
    of_split = F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split")
    used, _ = materialize(own.select("doc_id", "text", "block", "held_out", of_split).mapInArrow(_count, "block long, g long, word binary, n long"), "used")
    words, _ = materialize(used.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    counted, _ = materialize(used.where("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("n")), "grams")
    lp, _ = materialize(predictions(counted), "predictions")
    no_word, no_gram = F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("g")
    facts = used.where("g IS NOT NULL").join(lp, "g").select("block", "g", no_word, F.col("lp").alias("value")).union(used.where("word IS NOT NULL").join(words, "word").select("block", no_gram, "word", F.col("c").cast("double").alias("value")))
    return own.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(_then_give_back(_score(int(total), int(distinct))), _COLUMNS)
