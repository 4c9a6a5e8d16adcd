"""I-Match fingerprints: terms within an inverse-document-frequency band, hashed over randomised lexicon subsets."""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import bounded_batches, texts_of
from treeline.llm.ordered import bounds, n_parts, with_part

#: Words whose hashes a task remembers before it starts anew, and terms whose counts it holds before it merges them.
REMEMBER, WAITING = 1_000_000, 2_000_000
#: Terms whose signatures are worked out together, at least a text's.
TOGETHER = 6000
#: Bits of a term's hash that number the bucket in which its counts meet.
BUCKET_BITS = 10
_ZERO = np.zeros(1, np.int64)
_BASE = 0xD1342543DE82EF95


@dataclass(frozen=True)
class Settings:
    """least_idf, most_idf: the band, natural logarithms of documents over documents with the term; least_docs: documents
    that a term of the lexicon is in at least; subsets: randomised lexicons; levels: each is halved so often, from the
    whole lexicon on, so that some level of it holds a few terms of a document of any length.

    The terms of a document number t on average, so at most t * e^most_idf terms are in the band, however many documents
    there are: the lexicon's size has that bound.
    """

    least_idf: float = 1.0
    most_idf: float = 9.0
    least_docs: int = 2
    subsets: int = 32
    levels: int = 14
    seed: int = 9


class Terms(dict):
    """word -> its 64-bit hash, remembered; the last bit tells whether the lexicon (sorted hashes with that bit) has it."""

    def __init__(self, lexicon: np.ndarray | None = None):
        super().__init__()
        self.lexicon = memoryview(np.ascontiguousarray(lexicon if lexicon is not None else np.zeros(0, np.uint64)))

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) | 1
        k = bisect.bisect_left(self.lexicon, h)
        if k == len(self.lexicon) or self.lexicon[k] != h:
            h -= 1
        self[word] = h
        return h


def terms_of(text: bytes, memory: Terms) -> np.ndarray:
    """Sorted hashes of a text's distinct words, A-Z lowered."""
    if len(memory) > REMEMBER:
        memory.clear()
    words = set(text.lower().split())
    return np.sort(np.fromiter(map(memory.__getitem__, words), np.uint64, len(words)))


class _Counts:
    """Documents with each term, as sorted arrays."""

    def __init__(self):
        self.terms, self.n, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, terms: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((terms, n))
        if sum(len(t) for t, _ in self.waiting) > max(WAITING, len(self.terms)):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            every = np.concatenate([self.terms, *(t for t, _ in self.waiting)])
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate([self.n, *(n for _, n in self.waiting)])[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            self.terms, self.n, self.waiting = every[first], np.add.reduceat(n, first) if len(first) else n, []


_COUNTS = pa.schema([("bucket", pa.int32()), ("terms", pa.binary()), ("n", pa.binary())])


def lexicon(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The sorted hashes of all terms whose exact document frequency over all docs is within the band.

    Tasks count their own documents; buckets of counts meet by hash and are added up. Only the lexicon, whose size is
    bounded (see Settings), reaches the driver.
    """

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, memory = _Counts(), Terms()
        for b in bounded_batches(it):
            terms = np.concatenate([np.zeros(0, np.uint64), *(terms_of(t, memory) for t in texts_of(b.column("text")))])
            found.add(terms, np.ones(len(terms), np.int64))
        found.merge()
        cut = np.searchsorted(found.terms >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1).astype(np.uint64))
        used = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([found.terms[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary()), pa.array([found.n[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in used], pa.binary())], schema=_COUNTS)

    n = docs.count()
    least, most = max(s.least_docs, math.exp(-s.most_idf) * n), math.exp(-s.least_idf) * n

    def add(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = None, _Counts()

        def out() -> pa.RecordBatch:
            total.merge()
            return pa.RecordBatch.from_arrays([pa.array([total.terms[(total.n >= least) & (total.n <= most)].tobytes()], pa.binary())], names=["terms"])

        for b in it:
            for k, terms, seen in zip(b.column("bucket").to_pylist(), b.column("terms").to_pylist(), b.column("n").to_pylist(), strict=True):
                if k != bucket:
                    if bucket is not None:
                        yield out()
                    bucket, total = k, _Counts()
                total.add(np.frombuffer(terms, np.uint64), np.frombuffer(seen, "<u4").astype(np.int64))
        if bucket is not None:
            yield out()

    summed = docs.select("text").mapInArrow(count, "bucket int, terms binary, n binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "terms binary")
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in summed.collect())])) | np.uint64(1)


class Fingerprints:
    """Fingerprints of texts by a lexicon: subsets x levels signatures of 16 bits each, 0 where no term falls in.

    In subset r, a term belongs to levels 0 to z, z being the leading zero bits of a hash of it and r; the signature of
    a level is a polynomial hash over the sorted distinct terms that belong to it. Two texts agree on a level if the same
    terms fall in it; over all levels, agreements tell their likeness whatever their lengths.
    """

    def __init__(self, lexicon: np.ndarray, s: Settings):
        self.s, self.memory, self.powers = s, Terms(lexicon), np.ones(1, np.uint64)
        self.salts = np.random.default_rng(s.seed).integers(1, 1 << 63, s.subsets, np.int64).astype(np.uint64) | np.uint64(1)

    def of(self, text: bytes) -> np.ndarray:
        """The signatures of one text."""
        return self.of_all([text])[0]

    def of_all(self, texts: list[bytes]) -> np.ndarray:
        """The signatures of texts, [text, subset, level]; so many are worked out together as have TOGETHER terms."""
        out = np.zeros((len(texts), self.s.subsets, self.s.levels), np.uint16)
        held, at, n = [], [], 0
        for k, text in enumerate(texts):
            terms = terms_of(text, self.memory)
            kept = terms[(terms & np.uint64(1)) == 1]
            terms = kept if len(kept) else terms  # a text of nothing but common or rare terms: all of them
            if not len(terms):
                continue
            if held and n + len(terms) > TOGETHER:
                out[at] = self._sign(held)
                held, at, n = [], [], 0
            held.append(terms)
            at.append(k)
            n += len(terms)
        if held:
            out[at] = self._sign(held)
        return out

    def _sign(self, lists: list[np.ndarray]) -> np.ndarray:
        s, sizes, terms = self.s, np.array([len(x) for x in lists]), np.concatenate(lists)
        out = np.zeros((len(lists), s.subsets, s.levels), np.uint16)
        while len(self.powers) < sizes.max():
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(_BASE, len(self.powers), 1 << 64))])
        starts = np.cumsum(sizes) - sizes
        whole = self.powers[np.arange(len(terms)) - np.repeat(starts, sizes)]
        owner = np.repeat(np.arange(len(lists), dtype=np.int64) * s.subsets, sizes)
        for lo in range(0, s.subsets, step := max(1, 32 * TOGETHER // len(terms))):
            salts = self.salts[lo : lo + step]
            mixed = terms[None, :] * salts[:, None]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            value = mixed * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, lo : lo + len(salts), 0] = _short(np.add.reduceat(value * whole, starts, axis=1)).T
            flat, cell = out.reshape(-1, s.levels), None
            mixed, value = mixed.ravel(), value.ravel()
            for level in range(1, s.levels):
                in_it = np.flatnonzero(mixed < np.uint64(1 << (64 - level)))
                if not len(in_it):
                    break
                mixed, value = mixed[in_it], value[in_it]
                cell = owner[in_it % len(terms)] + (lo + in_it // len(terms)) if cell is None else cell[in_it]
                first = np.concatenate([_ZERO, np.flatnonzero(cell[1:] != cell[:-1]) + 1])
                place = np.arange(len(cell)) - np.repeat(first, np.diff(first, append=len(cell)))
                flat[cell[first], level] = _short(np.add.reduceat(value * self.powers[place], first))
        return out

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """From 0 to 1: estimated share of the terms of either that both have.

        With levels an octave apart, the expected number of agreements of a subset is -log2(1 - share).
        """
        if (a == b).all():
            return 1.0
        agree = int(((a == b) & (a > 0)).sum())
        return 1.0 - math.exp(-agree * math.log(2) / self.s.subsets)


def _short(total: np.ndarray) -> np.ndarray:
    return np.maximum(((total * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.uint16), 1)


def spell(signatures: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(signatures.astype("<u2").tobytes()).decode()


def _edit(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text is the text with the last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next row's, by ascending doc_id, then text (NULLs first); the last row's next is the first. NULL is an empty text. A
    fingerprint follows from the text and the lexicon alone, so equal texts have equal ones; all empty texts' are the
    same. A single row is its own next. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, s).tobytes())
    cuts = bounds(docs, n_parts(docs))
    placed = with_part(docs, cuts)
    # the least id of each part: a row a part reaches the driver; its rows are also sent to the part before, as ghosts
    least = {p: (i, n) for p, i, n in placed.groupBy("part").agg(F.min("doc_id"), F.count("*")).collect()}
    parts = sorted(least)
    if not parts:
        return docs.sparkSession.createDataFrame([], _COLUMNS)
    nulls = docs.where("doc_id IS NULL").limit(1).count() > 0  # these are in part 0
    ghosts = [(p, None if p == parts[0] and nulls else least[p][0], parts[k - 1] if k else parts[-1], int(k == 0)) for k, p in enumerate(parts)]
    whose = docs.sparkSession.createDataFrame(ghosts, "_part int, _least long, _to int, _wrap int")
    also = placed.join(F.broadcast(whose), (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_least"))).select("doc_id", "text", F.col("_to").alias("part"), F.lit(True).alias("ghost"))
    every = placed.select("doc_id", "text", "part", F.lit(False).alias("ghost")).union(also)
    dealt = every.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "ghost", "doc_id", "text")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprints(np.frombuffer(sent.value, np.uint64), s)
        before, signed_before = None, None  # the last row that counts, its signatures

        for b in bounded_batches(it):
            found = []  # part, ghost, doc_id, text of the rows that count
            for part, ghost, i, text in zip(*(b.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
                last = found[-1] if found else before
                if ghost and (last is None or last[0] != part or last[1]):
                    continue  # nothing of the part is before it, or the part's next is known already
                found.append((part, ghost, i, text or ""))
            signed = own.of_all([x[3].encode() for x in found])
            pairs = [x for x in zip([before, *found], found) if x[0] is not None and not x[0][1] and x[0][0] == x[1][0]]
            edited = [_edit(x[3], y[3]).encode() for x, y in pairs]
            of = dict(zip(map(id, [before, *found]), [signed_before, *signed], strict=True))
            rows = []
            for (x, y), text, s1 in zip(pairs, edited, own.of_all(edited), strict=True):
                s0, following = of[id(x)], of[id(y)]
                rows.append((x[2], len(x[3]), hashlib.sha256(text).hexdigest(), spell(s0), spell(s1), own.likeness(s0, s1), own.likeness(s0, following)))
            if found:
                before, signed_before = found[-1], signed[-1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return dealt.mapInArrow(run, _COLUMNS)


_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
