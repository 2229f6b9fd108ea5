"""Document fingerprints by Order MinHash.

A text is the sequence of its k-mers (code points), each with its occurrence
number, so that repeats are told apart.  For each of ``SKETCHES`` hash
functions the ``TUPLE`` k-mers of least hash are selected, put back into text
order and hashed together; a 16-bit digest of each tuple makes the signature.
Two signatures agree in a place with a probability that falls with the edit
distance of the texts, moved passages included.

Defined cases: a null text is empty; the empty text has a signature of its own;
a text shorter than k is one k-mer; equal texts have equal signatures; texts of
any length are hashed whole, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm._spark import saved, shuffle_partitions, small_batches
from assayframe.llm._text import mix64

K, SKETCHES, TUPLE, BLOCK = 8, 32, 2, 8192
_rng = np.random.default_rng(77)
_MULT = (_rng.integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _rng.integers(0, 2**32, SKETCHES, dtype=np.uint32)[:, None]
_STEP = _rng.integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = _rng.integers(0, 2**63, TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.arange(SKETCHES)
_SALT = mix64(np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1))
EMPTY = np.zeros(SKETCHES, np.uint16)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmer_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the 8-mers of code points, by doubling."""
    if len(codes) < K:
        codes = np.concatenate([codes, np.full(K - len(codes), 0x110000 + len(codes), np.uint64)])
    h = codes * _STEP[0]
    h = h[:-1] * _STEP[1] + h[1:]
    h ^= h >> np.uint64(32)
    h = h[:-2] * _STEP[2] + h[2:]
    h ^= h >> np.uint64(29)
    return mix64(h[:-4] * _STEP[1] + h[4:])


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each k-mer came before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    fresh = np.ones(len(h), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    at = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def signature(codes: np.ndarray) -> np.ndarray:
    """The SKETCHES 16-bit tuple digests of a text given as code points."""
    if len(codes) == 0:
        return EMPTY
    h = kmer_hashes(codes)
    g = (mix64(h + occurrences(h) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    best = np.full((SKETCHES, TUPLE), 2**33, np.int64)
    place = np.zeros((SKETCHES, TUPLE), np.int64)
    for lo in range(0, len(g), BLOCK):
        v = (g[lo : lo + BLOCK][None, :] ^ _XOR) * _MULT
        for _ in range(min(TUPLE, v.shape[1])):
            p = v.argmin(axis=1)
            x = v[_LANES, p].astype(np.int64)
            v[_LANES, p] = 0xFFFFFFFF
            low = x < best[:, 0]
            mid = ~low & (x < best[:, 1])
            best[low, 1], place[low, 1] = best[low, 0], place[low, 0]
            best[low, 0], place[low, 0] = x[low], p[low] + lo
            best[mid, 1], place[mid, 1] = x[mid], p[mid] + lo
    if len(g) == 1:
        place[:, 1] = place[:, 0]
    place.sort(axis=1)
    t = h[place]
    return (mix64(t[:, 0] * _PAIR[0] + t[:, 1] * _PAIR[1] + _SALT) & np.uint64(0xFFFF)).astype(np.uint16)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common, equally ordered k-mers, 0 to 1.

    A tuple survives when all of its TUPLE k-mers do, so the share of equal
    places is taken to the power 1 / TUPLE.
    """
    return float(np.count_nonzero(a == b) / SKETCHES) ** (1 / TUPLE)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a ``fingerprint`` string."""

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([written(signature(code_points(t or ""))) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _row(doc_id, text, codes, sig, next_codes, next_text, next_sig) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    e = signature(np.concatenate([codes[: len(codes) - half], next_codes[:half]]))
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), written(sig), written(e), likeness(sig, e), likeness(sig, next_sig))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, next in doc_id order.

    The documents are range-partitioned by doc_id and streamed in order; the
    last text of each partition meets the first of the next in a second, small
    step, a join on the partitions' numbers.  Rows of one doc_id follow each
    other by text.  A table of one row is its own next document.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "start", "h", "m"]
    rows = rows.withColumns({"start": F.substring("text", 1, 64), "h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    out_schema = pa.schema([*_OUT, ("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())])

    def run(batches):
        part = TaskContext.get().partitionId()
        last, first, out = None, None, []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = code_points(text)
                now = (doc_id, text, codes, signature(codes))
                if last is None:
                    first = text
                else:
                    out.append((*_row(*last, now[2], text, now[3]), None, None, None))
                last = now
                if len(out) >= 500:
                    yield _batch(out, out_schema)
                    out = []
        if last is not None:
            out.append((last[0], *[None] * 6, part, first, last[1]))
        yield _batch(out, out_schema)

    done = saved(rows.mapInArrow(run, f"{SCHEMA}, part long, first_text string, last_text string"))
    edges = done.where("part IS NOT NULL")
    # numbers only; the texts meet by them
    order = Window.orderBy("part")
    follow = edges.select("part").select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    firsts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    edges = edges.select("part", "doc_id", "last_text").join(follow, "part").join(firsts, "next").select("doc_id", "last_text", "next_text")

    def close(batches):
        schema = pa.schema(_OUT)
        for b in batches:
            out = []
            for doc_id, text, after in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c, n = code_points(text), code_points(after)
                out.append(_row(doc_id, text, c, signature(c), n, after, signature(n)))
            yield _batch(out, schema)

    return done.where("part IS NULL").drop("part", "first_text", "last_text").unionByName(edges.mapInArrow(close, SCHEMA))
