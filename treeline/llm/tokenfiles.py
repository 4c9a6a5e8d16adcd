"""Token ids in files: frequency-ranked, one to four bytes an id, lengths in separate control bytes.

A file holds whole documents, in order:

    magic "TLVB1\\n", then little-endian: uint32 header length, header (JSON: n_docs, n_tokens, n_ranked, n_bytes),
    doc_id int64[n_docs], id is NULL uint8[n_docs], tokens of a document uint32[n_docs],
    ranked uint32[n_ranked]: the file's ids, most frequent first, ties to the smaller id,
    control uint8[ceil(n_tokens / 4)]: two bits a token, lowest first: bytes of its rank less one,
    data uint8[n_bytes]: the ranks, little-endian, as many bytes each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm._common import bounded_batches, fresh_path, materialize
from treeline.llm.ordered import n_parts

MAGIC = b"TLVB1\n"
#: Tokens after which a file is closed; one document may exceed it.
FILE_TOKENS = 4 << 20
#: Stretches that a worker remembers before it starts anew.
REMEMBER = 600_000
#: Bytes of text that are encoded together, about; parts of the output at most, each of which may have any number of files.
BATCH_BYTES, MAX_PARTS = 4 << 20, 20_000
#: lengths[c]: of the four tokens of control byte c.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranked, control, data) of uint32 ids."""
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary: counted in a table
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        counts, at = counts[values], None
    else:
        values, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.arange(len(values))
    if at is None:
        by_id = np.zeros(int(values[-1]) + 1, np.uint32)
        by_id[values] = rank
        ranks = by_id[ids]
    else:
        ranks = rank[at]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return values[order].astype(np.uint32), control, data


def unpack(n: int, ranked: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The n ids of pack()'s output: lengths by table, then one gather for each byte place."""
    size = _LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    ranks = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranked[ranks]


def write_file(fs: pafs.FileSystem, path: str, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
    """One file of whole documents: their ids, the tokens of each, all tokens."""
    ranked, control, data = pack(ids)
    head = json.dumps({"n_docs": len(sizes), "n_tokens": len(ids), "n_ranked": len(ranked), "n_bytes": len(data)}).encode()
    with fs.open_output_stream(path) as f:
        f.write(MAGIC + len(head).to_bytes(4, "little") + head)
        f.write(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
        f.write(np.array([i is None for i in doc_ids], np.uint8).tobytes())
        for a in (sizes.astype("<u4"), ranked.astype("<u4"), control, data):
            f.write(a.tobytes())


def read_file(fs: pafs.FileSystem, path: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each, all ids) of a file."""
    with fs.open_input_stream(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        head = json.loads(f.read(int.from_bytes(f.read(4), "little")))
        take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), kind)
        doc_ids, null, sizes = take("<i8", head["n_docs"]), take(np.uint8, head["n_docs"]), take("<u4", head["n_docs"])
        ranked, control, data = take("<u4", head["n_ranked"]), take(np.uint8, -(-head["n_tokens"] // 4)), take(np.uint8, head["n_bytes"])
    return [None if z else int(i) for i, z in zip(doc_ids, null, strict=True)], sizes.astype(np.int64), unpack(head["n_tokens"], ranked, control, data)


# --- encoding -----------------------------------------------------------------------------------------------------


#: White space of any kind, and characters that might count as such: beside these no text is cut by table.
_ODD = "[\\x00-\\x20\\x7f-\\xa0\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}]"
#: Texts in which a space or a line feed stands beside other white space or at an end (but a space at the beginning).
_UNEVEN = f" (?:{_ODD}|\\z)|\\n(?:{_ODD}|\\z)|(?:{_ODD}|\\A)\\n"
_NO_CUT = re.compile(rb" (?=[\x00-\x20\xc2\xe1-\xe3]|\Z)")
#: A space, perhaps, and letters of ASCII or Latin-1: one stretch for the pre-tokenizer, whatever stands around it.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: How byte-level models spell bytes: printable ones as themselves, the others from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: A letter (ASCII, or of Latin-1 but its two signs), then ASCII punctuation to the end; an apostrophe may bind to letters.
_STEM = re.compile(rb"( ?[^\x00-\x20]*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)")


def _cut(text: bytes) -> list[bytes]:
    """Cut before each space that printable ASCII or a letter follows: there every byte-level pre-tokenizer cuts too.

    A byte that could begin other white space than the ASCII kinds is not cut before.
    """
    if not _NO_CUT.search(text):
        first, *rest = text.split(b" ")
        return [first, *(b" " + p for p in rest)] if first else [b" " + p for p in rest]
    out, held = [], b""
    for k, p in enumerate(text.split(b" ")):
        part = b" " + p if k else p
        if not p or p[0] <= 0x20 or p[0] in (0xC2, 0xE1, 0xE2, 0xE3):
            held += part
        elif held:
            out.append(held)
            held = part
        else:
            held = part
    return [*out, held] if held else out


class Encoder:
    """Ids by the tokenizers library, with a memory of the stretches met: only new ones are given to the library."""

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        told = json.loads(tokenizer)
        cut, self.added = told.get("pre_tokenizer") or {}, [t["content"] for t in told.get("added_tokens") or []]
        # only of a byte-level tokenizer is it known where it cuts; its model alone then takes stretches between line feeds
        feed = (told.get("model", {}).get("vocab") or {}).get(_AS_BYTES[10]) if told.get("model", {}).get("type") == "BPE" else None
        self.byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not told.get("normalizer") and feed is not None
        if self.byte_level:
            self.feed, self.model = feed, Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(_AS_BYTES[10], "isolated")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new stretches: the model alone for runs of letters, which are one piece for it; the whole tokenizer else."""
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        known = set(letters)
        other = [w for w in new if w not in known]
        for lo in range(0, len(letters), 50_000):
            some = letters[lo : lo + 50_000]
            spelled = (b"\n".join(some) + b"\n").decode("latin-1").translate(_AS_BYTES)
            ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.feed)
            self._keep(some, np.diff(ends, prepend=-1) - 1, ids[ids != self.feed])
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(other, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _compose(self, new: list[bytes]) -> None:
        """Learn stretches; what ends in ASCII punctuation after a letter is its stem and the punctuation, apart as the
        pre-tokenizer has them, so that a stem is worked out once whatever follows it."""
        parts = {w: m.groups() for w in new if (m := _STEM.fullmatch(w))}
        stems = dict.fromkeys(chain.from_iterable(parts.values()))
        self._learn([w for w in dict.fromkeys([*stems, *(w for w in new if w not in parts)]) if w not in self.number])
        whole = [w for w in parts if w not in self.number]
        if whole:
            pieces = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts[w] for w in whole)), np.int64, 2 * len(whole))
            self._keep(whole, self.sizes[pieces].reshape(-1, 2).sum(axis=1), self._gather(pieces))

    def _gather(self, stretches: np.ndarray) -> np.ndarray:
        """The ids of stretches, one after the other."""
        n = self.sizes[stretches]
        return self.flat[np.repeat(self.starts[stretches] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _keep(self, words: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> None:
        """Store the ids of words, one after the other in flat."""
        k, need = len(self.number), self.used + len(flat)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < k + len(words):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.number.update(zip(words, range(k, k + len(words)), strict=True))
        self.sizes[k : k + len(words)] = sizes
        self.starts[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : need] = flat
        self.used = need

    def _numbers(self, stretches: list[bytes]) -> np.ndarray:
        """Numbers of distinct stretches, learned where they are new."""
        new = [w for w in stretches if w not in self.number]
        if new:
            self._compose(new)
        return np.fromiter(map(self.number.__getitem__, stretches), np.int64, len(stretches))

    def _by_table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(stretches of even texts, how many each text has): Arrow cuts at spaces and line feeds, and numbers what is between."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        firsts = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
        bare = np.zeros(len(at) + 1, bool)  # with no space before: at the beginning, and line feeds and what follows them
        bare[firsts[:-1]] = True
        if b"\n" in words:
            feeds = np.flatnonzero(at == words.index(b"\n"))
            bare[feeds] = bare[feeds + 1] = True
        bare, number = bare[:-1], np.zeros((2, len(words)), np.int64)
        for k, space in enumerate((b" ", b"")):
            used = np.flatnonzero(np.bincount(at[bare == bool(k)], minlength=len(words)))
            number[k, used] = self._numbers([space + words[j] for j in used.tolist()])
        return number[bare.view(np.uint8), at], np.diff(firsts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the tokens of each) of texts (NULL: empty)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if len(self.number) > REMEMBER:
            self._forget()
        whole = pa.array(np.full(len(texts), not self.byte_level))
        for t in self.added if self.byte_level else ():  # the library looks for these before all else
            whole = pc.or_(whole, pc.match_substring(texts, t))
        uneven = pc.or_(whole, pc.match_substring_regex(texts, _UNEVEN))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, odd = whole.to_numpy(zero_copy_only=False), np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist()
        for k, t in zip(odd, texts.take(pa.array(odd, pa.int64())).to_pylist(), strict=True):
            if held[k]:
                out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                cut = _cut(t.encode())
                self._numbers(list(dict.fromkeys(cut)))
                out[k] = self._gather(np.fromiter(map(self.number.__getitem__, cut), np.int64, len(cut)))
        n_ids = np.array([len(x) for x in out], np.int64)
        even = np.flatnonzero(~uneven.to_numpy(zero_copy_only=False))
        if not len(even):
            return np.concatenate(out) if out else np.zeros(0, np.uint32), n_ids
        stretches, n = self._by_table(texts.filter(pc.invert(uneven)))
        ids, ends = self._gather(stretches), np.concatenate([[0], np.cumsum(self.sizes[stretches])])
        n_ids[even] = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])
        if not odd:
            return ids, n_ids
        every, start = np.empty(int(n_ids.sum()), np.uint32), np.cumsum(n_ids) - n_ids
        of_even = np.ones(len(every), bool)
        for k in odd:
            every[start[k] : start[k] + n_ids[k]] = out[k]
            of_even[start[k] : start[k] + n_ids[k]] = False
        every[of_even] = ids
        return every, n_ids


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(tokenizer: bytes) -> Encoder:
    """A worker's encoder of a tokenizer: what one task has learned (REMEMBER bounds it) serves the next."""
    name = hashlib.sha256(tokenizer).digest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tokenizer)
    return _ENCODERS[name]


def _writer(tokenizer, end_id: int, folder: str):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (fs, root) = encoder(tokenizer.value), pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        held_ids, sizes, ids, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held_ids, sizes, ids, n, seq
            name = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tlvb"  # a task that is run again writes other files
            write_file(fs, name, held_ids, np.concatenate(sizes), np.concatenate(ids))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(held_ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})
            held_ids, sizes, ids, n, seq = [], [], [], 0, seq + 1
            return row

        for b in bounded_batches(it, BATCH_BYTES):
            flat, each = own.encode(b.column("text"))
            docs, each, flat = b.column("doc_id").to_pylist(), each + 1, np.insert(flat, np.cumsum(each), end_id)
            while len(each):
                ends = np.cumsum(each)
                k = int(np.searchsorted(ends, FILE_TOKENS - n)) + 1 if n < FILE_TOKENS else 0  # the document that fills the file is in it
                k = min(k, len(each))
                if k:
                    held_ids += docs[:k]
                    sizes.append(each[:k])
                    ids.append(flat[: ends[k - 1]])
                    n += int(ends[k - 1])
                    docs, each, flat = docs[k:], each[k:], flat[ends[k - 1] :]
                if n >= FILE_TOKENS:
                    yield close()
        if held_ids:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: bytes, end_id: int, folder: str) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order (NULLs first; ties by a hash of the text); returns the list of files.

    part, seq, file, n_docs, n_tokens, start: tokens in the files before. Each text's ids are followed by end_id; NULL is
    an empty text. A part is a task's; rows go to parts by range of (doc_id, hash), so many rows of one id, or without
    any, are spread as well. The list counts only what a finished task wrote, so files of lost tasks are never read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = min(n_parts(docs), MAX_PARTS)
    placed = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    files, _ = materialize(placed.mapInArrow(_writer(sent, end_id, folder), "part int, seq int, file string, n_docs long, n_tokens long"), "token-files")
    # one number a part, of which there are at most MAX_PARTS, reaches the driver
    before, total = [], 0
    for p, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before.append((p, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(before, "part int, before long")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inner", inner).join(F.broadcast(offsets), "part").select("part", "seq", "file", "n_docs", "n_tokens", (F.col("before") + F.col("inner")).alias("start"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the listed files, decoded one file at a time."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in it:
            for name, at in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                doc_ids, sizes, ids = read_file(fs, name)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("file", "start").repartition(min(n, 4096)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: bytes, end_id: int = 2) -> DataFrame:
    """Write token files to the shared folder and read every document back from them."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, end_id, folder), folder)
