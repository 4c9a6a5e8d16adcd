"""SentencePiece encoding and decoding with numpy: words of equal length advance together.

Substring hashes probe the sorted keys of the pieces once for all words of a length. A unigram model's words then take
a Viterbi pass whose vectorised maxima store backpointers. For a BPE model, whose scores only rank merges, the best
path by score is not the model's encoding, so its words take merge steps over the same table: in each, a vectorised
maximum picks every word's best pair.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm._common import bounded_batches, texts_of

NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
SPACE = "▁"
#: Words that a task remembers before it starts anew, and code points from which a word is encoded alone.
REMEMBER, ALONE = 600_000, 64
_BASE = np.uint64(0x100000001B3)


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces of a model file; encodes and decodes. Only models that leave white space as it is are taken."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.unigram, self.prefix, squeeze, charsmap = True, True, True, b""
        for field, value in _wire(data):
            if field == 1:
                p = dict(_wire(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif field == 2:
                self.unigram = dict(_wire(value)).get(3, 1) == 1
            elif field == 3:
                p = dict(_wire(value))
                self.prefix, squeeze, charsmap = bool(p.get(3, 1)), bool(p.get(4, 1)), p.get(2, b"")
        if squeeze or charsmap:
            raise ValueError("models that rewrite the text are not supported")
        own = [k for k, t in enumerate(self.types) if t in (NORMAL, USER)]
        if any(SPACE in self.pieces[k].lstrip(SPACE) for k in own):
            raise ValueError("models with pieces over several words are not supported")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes_at = np.full(256, self.unknown, np.int32)
        for k, t in enumerate(self.types):
            if t == BYTE:
                self.bytes_at[int(self.pieces[k][1:-1], 16)] = k
        self.longest = max(len(self.pieces[k]) for k in own)
        keys = np.array([_key(self.pieces[k]) for k in own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.id_of = {self.pieces[k]: k for k in own}
        by_score = np.argsort(-np.array(self.scores, np.float64), kind="stable")
        self.rank = np.empty(len(self.pieces), np.int32)
        self.rank[by_score] = np.arange(len(self.pieces))
        self.score = np.array(self.scores, np.float64)
        # decoding: the bytes of every piece, and nothing for control pieces
        spelt = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.size = np.array([len(x) for x in spelt], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)

    # --- words -------------------------------------------------------------------------------------------------

    def table(self, codes: np.ndarray) -> np.ndarray:
        """ids[w, i, n]: the piece that is n + 1 code points from i of word w, or -1."""
        words, length = codes.shape
        most = min(length, self.longest)
        found = np.full((words, length, most), -1, np.int32)
        for n in range(1, most + 1):
            key = np.zeros((words, length - n + 1), np.uint64)
            for k in range(n):
                key = key * _BASE + codes[:, k : length - n + 1 + k]
            key = _finish(key, n)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            found[:, : length - n + 1, n - 1] = np.where(hit, self.ids[at], -1)
        return found

    def merge(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """end[w, i]: where the symbol that begins at i ends, or 0 if none does; by merges, best score first, then leftmost."""
        words, length = codes.shape
        none = np.iinfo(np.int32).max
        rank = np.where(found >= 0, self.rank[found], none)
        end = np.broadcast_to(np.arange(1, length + 1), (words, length)).copy()
        live = np.arange(words)
        position = np.arange(length)
        while len(live) and length > 1:
            e = end[live]
            after = np.take_along_axis(e, np.minimum(e, length - 1), axis=1)
            size = after - position
            good = (e > 0) & (e < length) & (size <= rank.shape[2])
            pair = np.where(good, rank[live[:, None], position, np.where(good, size - 1, 0)], none)
            best = pair.argmin(axis=1)
            row = np.arange(len(live))
            go = pair[row, best] < none
            live, best, row = live[go], best[go], row[go]
            middle = e[row, best]
            end[live, best] = end[live, middle]
            end[live, middle] = 0
        return end

    def viterbi(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """end[w, i] as in merge(), by the best sum of scores; a code point that is no piece costs 10 below the least score."""
        words, length = codes.shape
        score = np.where(found >= 0, self.score[found], -np.inf)
        score[:, :, 0] = np.where(found[:, :, 0] >= 0, score[:, :, 0], self.score.min() - 10.0)
        best, back = np.full((words, length + 1), -np.inf), np.zeros((words, length + 1), np.int64)
        best[:, 0] = 0
        for j in range(1, length + 1):
            starts = np.arange(max(0, j - score.shape[2]), j)
            reach = best[:, starts] + score[:, starts, j - 1 - starts]
            at = reach.argmax(axis=1)
            best[:, j], back[:, j] = reach[np.arange(words), at], starts[at]
        end = np.zeros((words, length), np.int64)
        at, rows = np.full(words, length), np.arange(words)
        while len(rows):
            start = back[rows, at[rows]]
            end[rows, start] = at[rows]
            at[rows] = start
            rows = rows[start > 0]
        return end

    def _alone(self, word: str) -> list[int]:
        """Ends of the symbols of one long word: the same merges from a heap."""
        n = len(word)
        end, prev, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and end[i] < n and (k := self.id_of.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (int(self.rank[k]), i, end[i], end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, last = heapq.heappop(heap)
            if dead[i] or end[i] != middle or dead[middle] or end[middle] != last:
                continue
            end[i], dead[middle] = last, True
            if last < n:
                prev[last] = i
            offer(prev[i])
            offer(i)
        return [0 if d else e for e, d in zip(end, dead, strict=True)]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (spaces as U+2581)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, at in by_length.items():
            for lo in range(0, len(at), step := max(1, 400_000 // (max(length, 1) * min(max(length, 1), self.longest)))):
                part = at[lo : lo + step]
                if not length:
                    continue
                if length > ALONE and not self.unigram:
                    for k in part:
                        out[k] = self._spell(words[k], self._alone(words[k]))
                    continue
                codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(part), length)
                found = self.table(codes)
                end = (self.viterbi if self.unigram else self.merge)(codes, found)
                begins = end > 0
                ids = np.take_along_axis(found, np.maximum(end - np.arange(length) - 1, 0)[:, :, None], axis=2)[:, :, 0]
                odd = ((ids < 0) & begins).any(axis=1)
                flat, to = ids[begins], np.concatenate([[0], np.cumsum(begins.sum(axis=1))])
                for j, k in enumerate(part):
                    out[k] = self._spell(words[k], end[j].tolist()) if odd[j] else flat[to[j] : to[j + 1]]
        return out

    def _spell(self, word: str, ends: list[int]) -> np.ndarray:
        """Ids of a word's symbols; those of the bytes of a symbol that is no piece."""
        ids: list[int] = []
        for i, e in enumerate(ends):
            if e:
                got = self.id_of.get(word[i:e])
                ids += [got] if got is not None else [int(self.bytes_at[c]) for c in word[i:e].encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that encoding put before it is taken off."""
        n = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = self.flat[at].tobytes()
        return text[1:] if self.prefix and text[:1] == b" " else text


def _finish(key: np.ndarray, n: int) -> np.ndarray:
    return (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)


def _key(piece: str) -> int:
    key = np.zeros(1, np.uint64)
    for c in piece:
        key = key * _BASE + np.uint64(ord(c))
    return int(_finish(key, len(piece))[0])


def split_words(text: bytes) -> list[bytes]:
    """Cut before every space that follows something else: words with their leading spaces."""
    parts = text.split(b" ")
    if b"" not in parts[1:]:
        return [parts[0], *(b" " + p for p in parts[1:])] if parts[0] else [b" " + p for p in parts[1:]]
    out, spaces = [parts[0]] if parts[0] else [], b""
    for p in parts[1:]:
        spaces += b" "
        if p:
            out.append(spaces + p)
            spaces = b""
    return [*out, spaces] if spaces else out


class Encoder:
    """Encodes texts with a memory of the words met, so that only new words are worked out, a batch of them at once."""

    def __init__(self, model: Model, remember: int = REMEMBER):
        self.model, self.remember = model, remember
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        found = self.model.encode_words([w.decode().replace(" ", SPACE) for w in words])
        need = self.used + sum(map(len, found))
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < len(self.number) + len(words):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        k, sizes = len(self.number), np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(words, range(k, k + len(words)), strict=True))
        self.sizes[k : k + len(words)] = sizes
        self.starts[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : need] = np.concatenate(found)
        self.used = need

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8); none for an empty one. Texts that are longer than memory needs go in one by one."""
        if len(self.number) > self.remember:
            self._forget()
        cut = [split_words((b" " if self.model.prefix else b"") + t.replace(SPACE.encode(), b" ")) if t else [] for t in texts]
        new = list(dict.fromkeys(w for c in cut for w in c if w not in self.number))
        if new:
            self._learn(new)
        out = []
        for c in cut:
            k = np.fromiter(map(self.number.__getitem__, c), np.int64, len(c))
            n = self.sizes[k]
            at = np.repeat(self.starts[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(self.flat[at])
        return out


def _run(model, round_trip: bool):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value)
        encoder = Encoder(own)
        for b in bounded_batches(it, 2 << 20):
            texts = list(texts_of(b.column("text")))
            ids = encoder.encode(texts)
            cols = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            if round_trip:
                cols = [b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                back = [own.decode(x) for x in ids]
                cols += [pa.array([x == t for x, t in zip(back, texts, strict=True)]), pa.array([zlib.crc32(x) for x in back], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_pieces", "ids_crc32", "exact", "decoded_crc32"])
            else:
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids"])

    return run


def _model(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a model file has a fixed size


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs (doc_id, text) by the model file at path on the driver.

    NULL and empty texts have no ids. U+2581 in a text is taken as a space, as the format has no other spelling for it;
    code points without a piece become the pieces of their bytes. Equal rows get equal ids.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(_model(docs, path), False), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), exact (decoding gives the text back), decoded_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_run(_model(docs, path), True), f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, exact boolean, decoded_crc32 long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); NULL ids give NULL, bytes that are not UTF-8 become U+FFFD."""
    model = _model(encoded, path)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value)
        for b in bounded_batches(it):
            texts = [None if x is None else own.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
