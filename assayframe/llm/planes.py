"""Token ids in binary files of compressed byte or bit planes.

Documents are encoded in ascending order of their key, each followed by an end
id, and all ids of a range of documents form one stream.  Blocks of ``CHUNK``
ids are transposed: plane k of a block holds byte k (or bit k) of all its ids,
and each plane is compressed with zstandard; planes of zeros take no room.  A
file is::

    magic | planes of chunk 0, 1, ... | documents | chunk index | footer

The documents are keys, null marks and sizes in ids, the chunk index has each
chunk's place, ids, crc32 and plane sizes, and the footer says which range the
file belongs to and how many ids of it stand before (``FOOTER``).  ``span``
reads any span of a file's ids and opens only the chunks that it meets.

Files are written by Spark's writer, a row each, so they come to any store that
Spark can write and only whole; it ends each with a line feed, which is part of
the format.  A range's files are cut at about ``FILE`` bytes, at documents.

Encoding: the tokenizer's file is loaded once a worker.  Where its pieces never
hold white space, the different words of a batch are encoded and put together
again, which gives the same ids as the texts encoded whole; where it also parts
letters from marks and folds capitals, a word is looked up among ``KNOWN``
others without its end marks and capitals.  Otherwise, each text is encoded
whole.

Defined cases: a null text is empty and has the end id only; rows without a key
come first; rows of one key follow the hash of their text; an empty table gives
no document; other columns are ignored, whatever their names.  A text is a unit
that one row holds.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.llm._spark import small_batches

CHUNK, FILE, KNOWN, LONG, TOGETHER = 1 << 16, 8 << 20, 600_000, 64, 4 << 20
MARKS = '.,;:!?%&#*()"$-'
MAGIC = b"IDPLANES"
#: range, file of the range, ids of the range before the file, ids, documents, chunks, ids a chunk, bits a plane, place of the documents, place of the index
FOOTER = struct.Struct("<10Q8s")
ENTRY = struct.Struct("<QII")  # a chunk's place, ids and crc32; the sizes of its planes follow


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, the end id behind each."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), struct.pack("<I", end)
        self.known: dict[str, bytes] = {}
        self.by_word, self.parted, self.folded = self._habits()

    def _habits(self) -> tuple[bool, bool, bool]:
        """Whether pieces never hold white space, whether letters and marks are parted, whether A-Z is folded."""
        cut, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        pieces = lambda t: [(a, b) for _, (a, b) in cut.pre_tokenize_str(t)]
        probe = " a  b\n\nc's 'll 12  ?! "
        by_word = cut is not None and not any(c in " \n" for a, b in pieces(probe) for c in probe[a:b])
        parted = by_word and all(pieces(f"ab{m}{m}") == [(0, 2), (2, 4)] for m in MARKS)
        return by_word, parted, by_word and norm is not None and norm.normalize_str("AbZ") == "abz"

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for lo in range(0, len(texts), 1000) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1000], add_special_tokens=False)]

    def _parts(self, word: str) -> tuple[str, str]:
        """A word without its end marks, folded, and the marks."""
        core = word.rstrip(MARKS) if self.parted else word
        if not core or not core[-1].isalpha():
            core = word
        return (core.lower() if self.folded and core.isascii() else core), word[len(core) :]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        out = list(map(self.known.get, words))
        cut = [(i, *self._parts(words[i])) for i, x in enumerate(out) if x is None]
        every = {x for p in cut for x in p[1:]}
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > KNOWN:  # what is needed now stays
            self.known = {w: self.known[w] for w in every.union(words) if w in self.known}
        self.known.update(zip(new, self._ids(new), strict=True))
        for i, core, marks in cut:
            out[i] = self.known[core] + self.known[marks]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
        return out

    def encoded(self, texts: pa.Array) -> list[bytes]:
        if not self.by_word:
            return [x + self.end for x in self._ids(texts.to_pylist())]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        gc.disable()  # nothing here makes cycles, and collections would visit all that is remembered
        try:
            ids = [*self._words(coded.dictionary.to_pylist()), self.end]
        finally:
            gc.enable()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = np.insert(coded.indices.to_numpy(), at[1:], len(ids) - 1)  # the end id behind each text
        size = np.array([len(x) // 4 for x in ids])
        first, each = np.cumsum(size) - size, size[words]
        kind = np.int32 if (total := int(each.sum())) < 1 << 31 else np.int64
        shift = (first[words] - (np.cumsum(each) - each)).astype(kind)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(total, dtype=kind) + np.repeat(shift, each)].tobytes()
        ends = 4 * np.cumsum(each)[at[1:] + np.arange(len(texts))]
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int) -> Encoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def split_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of ``bits`` (1 or 8) of a block of 32-bit ids, lowest first; zeros as nothing."""
    planes = list(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    if bits == 1:
        planes = [np.packbits((p >> k) & 1) for p in planes for k in range(8)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def joined_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ids of a block again."""
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if bits == 8:
            out[:, k] = np.frombuffer(plane, np.uint8)
        else:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return out.reshape(-1).view("<u4")


class Writer:
    """One range's files, one after the other: ``add`` documents, take what ``ready`` and ``close`` give."""

    def __init__(self, part: int, bits: int = 8, chunk: int = CHUNK):
        self.part, self.bits, self.chunk = part, bits, chunk
        self.press = zstandard.ZstdCompressor(level=3)
        self.file, self.before = 0, 0
        self._fresh()

    def _fresh(self) -> None:
        self.body, self.index, self.size = [MAGIC], [], len(MAGIC)
        self.keys, self.counts, self.waiting, self.held = [], [], [], 0
        self.ids = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.chunk:
            self._pack(False)

    def _pack(self, last: bool) -> None:
        ids = b"".join(self.waiting)
        whole = len(ids) // 4 if last else self.held // self.chunk * self.chunk
        for a in range(0, whole, self.chunk):
            raw = ids[4 * a : 4 * min(a + self.chunk, whole)]
            planes = [self.press.compress(p) if p else b"" for p in split_planes(np.frombuffer(raw, "<u4"), self.bits)]
            self.index.append(ENTRY.pack(self.size, len(raw) // 4, zlib.crc32(raw)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
            self.body += planes
            self.size += sum(map(len, planes))
        self.waiting = [ids[4 * whole :]]
        self.held -= whole

    def full(self) -> bool:
        return self.size >= FILE

    def close(self) -> bytes:
        """The file so far; the next document begins another."""
        self._pack(True)
        marks = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        documents = self.press.compress(keys.tobytes() + marks.tobytes() + np.array(self.counts, "<i8").tobytes())
        index = b"".join(self.index)
        end = FOOTER.pack(self.part, self.file, self.before, self.ids, len(self.keys), len(self.index), self.chunk, self.bits, self.size, self.size + len(documents), MAGIC)
        out = b"".join([*self.body, documents, index, end])
        self.before += self.ids
        self.file += 1
        self._fresh()
        return out


class File:
    """A file's parts; ``data`` may be any buffer that holds it, with or without the last line feed."""

    def __init__(self, data):
        data = memoryview(data)
        foot = len(data) - FOOTER.size - (bytes(data[-1:]) == b"\n" and bytes(data[-9:-1]) == MAGIC)
        (self.part, self.file, self.before, self.ids, self.documents, chunks, self.chunk, self.bits, self._at, at, magic) = FOOTER.unpack_from(data, foot)
        if magic != MAGIC or bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a file of id planes")
        self._data, self._index = data, at
        self._planes = 32 // self.bits
        self._entries = [self._entry(i) for i in range(chunks)]
        self.opened = 0
        self._press = zstandard.ZstdDecompressor()

    def _entry(self, i: int):
        at = self._index + i * (ENTRY.size + 4 * self._planes)
        return (*ENTRY.unpack_from(self._data, at), struct.unpack_from(f"<{self._planes}I", self._data, at + ENTRY.size))

    def sizes(self) -> tuple[list, np.ndarray]:
        """Keys (None where null) and sizes in ids of the documents."""
        raw = self._press.decompress(bytes(self._data[self._at : self._index]), max_output_size=17 * self.documents + 1)
        n = self.documents
        keys, null, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw[9 * n :], "<i8", n)
        return [None if z else int(k) for k, z in zip(keys, null, strict=True)], sizes

    def block(self, i: int) -> bytes:
        """The ids of chunk i, checked."""
        at, n, crc, sizes = self._entries[i]
        self.opened += 1
        planes = []
        for size in sizes:
            planes.append(self._press.decompress(bytes(self._data[at : at + size])) if size else b"")
            at += size
        raw = joined_planes(planes, n, self.bits).tobytes()
        if zlib.crc32(raw) != crc:
            raise ValueError(f"chunk {i} is damaged")
        return raw

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file."""
        first, last = start // self.chunk, -(-stop // self.chunk)
        raw = b"".join(self.block(i) for i in range(first, last))
        return np.frombuffer(raw, "<u4")[start - first * self.chunk : stop - first * self.chunk]

    def rows(self):
        """(key, place in the range, ids) of each document; a few chunks are open at once."""
        keys, sizes = self.sizes()
        held, at, chunk, place = b"", 0, 0, self.before
        for key, n in zip(keys, sizes.tolist(), strict=True):
            parts, size = [], len(held) - at
            while size < 4 * n:
                parts.append(self.block(chunk))
                size += len(parts[-1])
                chunk += 1
            if parts:
                held, at = b"".join([held[at:], *parts]), 0
            yield key, place, held[at : at + 4 * n]
            at += 4 * n
            place += n


def write(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", bits: int = 8) -> None:
    """Encode ``docs(key, text)`` and write the files of their ids to the folder ``path``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that are equal in both may come in any order, so a third key can deal them out
    order = ["key", "h", "m"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches):
        encoder, writer = _encoder(tokenizer, end), Writer(TaskContext.get().partitionId(), bits)
        for b in batches:
            keys, texts = b.column("key").to_pylist(), b.column("text")
            sizes = np.cumsum([0, *pc.binary_length(texts).to_pylist()])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + TOGETHER, side="right")) - 1)
                for k, ids in zip(keys[at:stop], encoder.encoded(texts.slice(at, stop - at)), strict=True):
                    writer.add(k, ids)
                    if writer.full():
                        yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["file"])
                at = stop
        if writer.keys:
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["file"])

    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 1").select("content")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """Each range of the files in ``path``: part, ids, and start (the ids of all ranges before)."""

    def run(batches):
        for b in batches:
            found = [File(x.as_buffer()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f.part for f in found], pa.int64()), pa.array([f.ids for f in found], pa.int64())], ["part", "ids"])

    per = _files(spark, path).mapInArrow(run, "part long, ids long").groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return per.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each
    document in the files in ``path``."""
    small_batches(spark)
    kind = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for x in b.column(0):
                held = File(x.as_buffer())
                rows, size = [], 0
                for k, place, ids in held.rows():
                    rows.append({"key": k, "part": held.part, "place": place, "ids": ids})
                    size += len(ids)
                    if size >= 4 * TOGETHER:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kind)

    rows = _files(spark, path).mapInArrow(run, "key long, part long, place long, ids binary")
    rows = rows.join(F.broadcast(ranges(spark, path).select("part", "start")), "part")
    return rows.select(F.col("key").alias(key), (F.col("start") + F.col("place")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
