"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (orders 1 to 3 of the lower-cased text)
weighted by term frequency and inverse document frequency.  The document
frequencies are counted over all training documents; the weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of
different texts: of each language the first ``SAMPLE`` by hash, and of those no
further one once ``SAMPLE_CHARS`` characters are reached (one at least).  A
temperature fitted on a fifth of the sample calibrates the scores.

A softmax over the learned languages says nothing of texts in others.  So each
text also gets its ``strangeness``, the mean inverse document frequency of its
n-grams; the sample's calibrating fifth gives the ``limit`` beyond which a text
is in no learned language.

Defined cases: a text that is null or holds no letter (of a Unicode letter
category) is ``und`` with score 0; rows with a null language or text teach
nothing; without anything to learn from every prediction is ``und``; of equal
probabilities the language first in code point order is taken; texts are read
whole; rows that repeat get equal predictions; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm._spark import saved, small_batches
from assayframe.llm._text import row_chunks

BITS, ORDERS = 17, 3
SIZE = 1 << BITS
SAMPLE, SAMPLE_CHARS, EPOCHS = 1000, 8_000_000, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 1e-3, 1e-3, 30.0
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
MARGIN, LEAST_GRAMS = 1.15, 60  # of the limit of strangeness; n-grams below which nothing is called strange


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (SIZE + 1, languages): idf times weight; the last row is zero
    bias: np.ndarray
    temperature: float
    idf: np.ndarray  # (SIZE + 1); the last is zero
    limit: float  # strangeness beyond which a text is in no learned language


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def grams(texts: list[str]):
    """Yield (lo, hi, starts, columns): the feature numbers of texts lo .. hi-1.

    ``columns`` has one array per order, aligned with the code points; SIZE
    stands where an n-gram would leave its text.
    """
    low = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    for lo, hi in row_chunks(at, 1 << 19):
        codes = np.frombuffer("".join(low[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = at[lo : hi + 1] - at[lo]
        ends = starts[1:][np.diff(starts) > 0]
        columns, h = [], np.zeros(len(codes), np.uint64)
        for n in range(ORDERS):
            h = (h[: len(codes) - n] + codes[n:]) * _K[n] if len(codes) > n else h[:0]
            h ^= h >> np.uint64(31)
            ids = np.full(len(codes), SIZE, np.int64)
            ids[: len(h)] = ((h * _K[3]) >> np.uint64(64 - BITS)).astype(np.int64)
            for back in range(1, n + 1):
                edge = ends - back
                ids[edge[edge >= 0]] = SIZE
            columns.append(ids)
        yield lo, hi, starts, columns


def sparse_counts(texts: list[str]):
    """(place, features, how often) of each text."""
    for lo, hi, starts, columns in grams(texts):
        for i in range(hi - lo):
            ids = np.concatenate([c[starts[i] : starts[i + 1]] for c in columns])
            u, n = np.unique(ids[ids < SIZE], return_counts=True)
            yield lo + i, u, n


def sparse_rows(texts: list[str]):
    """(place, features, term frequencies) of each text; the frequencies sum to one."""
    for i, u, n in sparse_counts(texts):
        yield i, u, n / max(1, n.sum())


class Examples:
    """The features of a training sample, as 32-bit numbers in large blocks, which the driver gives back when they go."""

    TOGETHER = 200

    def __init__(self, texts: list[str], idf: np.ndarray):
        self.idf, self.blocks, self.at = idf, [], []
        waiting, size = [], 0
        for _, u, n in sparse_counts(texts):
            self.at.append((len(self.blocks), size, size + len(u)))
            waiting.append(np.array([u, n], np.int32))
            size += len(u)
            if len(waiting) == self.TOGETHER:
                self.blocks.append(np.concatenate(waiting, axis=1))
                waiting, size = [], 0
        self.blocks.append(np.concatenate(waiting, axis=1) if waiting else np.zeros((2, 0), np.int32))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of an example, the bias last."""
        block, lo, hi = self.at[i]
        u, n = self.blocks[block][:, lo:hi].astype(np.int64)
        return np.append(u, SIZE), np.append(n / max(1, n.sum()) * self.idf[u] * SCALE, 1.0)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of ``docs(text)`` each feature occurs; SIZE numbers and the count."""

    small_batches(docs.sparkSession)

    def run(batches):
        seen, rows = np.zeros(SIZE + 1, np.int64), 0
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for _, u, _n in sparse_rows(texts):
                seen[u] += 1
            rows += len(texts)
        seen[SIZE] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["feature", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def training_sample(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str, bool]]:
    """At most ``sample`` different texts of each language, by hash: (text, lang, for calibration).

    Copies of a text are one from the start; no more than ``chars`` characters of
    a language are taken, but for the rest of its last text.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k"))
    kinds = saved(rows.groupBy("lang", "h", "k").agg(F.max(F.char_length("text")).alias("n")))
    # only texts of a hash so low that four times the sample is expected are ranked
    held = {r["lang"]: r["n"] for r in kinds.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language of the model
    if not held:
        return []
    cut = F.create_map(*[F.lit(x) for lang, n in held.items() for x in (lang, min(1_000_003, 4 * sample * 1_000_003 // n + 1))])
    kinds = kinds.where(F.pmod("h", F.lit(1_000_003)) < F.element_at(cut, F.col("lang")))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h", "k")
    first = kinds.withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample)
    behind = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", behind).where(F.col("before") < chars).select("lang", "h", "k")
    picked = rows.join(first, ["lang", "h", "k"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text")).collect()
    picked.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    return [(r["text"], r["lang"], i % 5 == 0) for i, r in enumerate(picked)]


def fit(docs: DataFrame) -> Model:
    """Learn from ``docs(text, lang)``."""
    taught = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    rows = training_sample(taught)
    languages = sorted({r[1] for r in rows})
    k = len(languages)
    if k == 0:
        return Model([], np.zeros((SIZE + 1, 0), np.float32), np.zeros(0), 1.0, np.zeros(SIZE + 1), np.inf)
    df = document_frequencies(taught)
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    made = Examples([r[0] for r in rows], idf)
    number = {x: j for j, x in enumerate(languages)}
    train = [i for i, r in enumerate(rows) if not r[2]] or list(range(len(rows)))
    for _ in range(EPOCHS):
        for i in train:
            u, x = made[i]
            w = weights(u)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[rows[i][1]]] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / ALPHA
            z[u] += g - step * w
            n[u] += g * g
    w = weights(np.arange(SIZE + 1))
    table = np.zeros((SIZE + 1, k), np.float32)
    table[:SIZE] = w[:SIZE] * idf[:, None] * SCALE
    held = [i for i, r in enumerate(rows) if r[2]] or train
    logits = np.array([x @ w[u] for u, x in map(made.__getitem__, held)])
    truth = np.array([number[rows[i][1]] for i in held])
    # the mean idf of a text: its tf times idf, without the scale and the bias feature
    strange = [made[i][1][:-1].sum() / SCALE for i in held if len(rows[i][0]) >= LEAST_GRAMS // ORDERS]
    limit = MARGIN * max(strange) if strange else np.inf
    return Model(languages, table, w[SIZE], _temperature(logits, truth), np.append(idf, 0.0), float(limit))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def probabilities(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities of each language, and the strangeness, of each text."""
    out, strange = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for lo, hi, starts, columns in grams(texts):
        full = np.flatnonzero(np.diff(starts) > 0)
        total, far = np.zeros((hi - lo, len(model.languages))), np.zeros(hi - lo)
        count = np.zeros(hi - lo)
        for c in columns:
            if len(full):
                total[full] += np.add.reduceat(model.table[c], starts[full], axis=0)
                far[full] += np.add.reduceat(model.idf[c], starts[full])
                count[full] += np.add.reduceat((c < SIZE).astype(np.int64), starts[full])
        s = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
        s = np.exp(s - s.max(axis=1, keepdims=True))
        out[lo:hi] = s / s.sum(axis=1, keepdims=True)
        strange[lo:hi] = np.where(count >= LEAST_GRAMS, far / np.maximum(count, 1), 0.0)
    return out, strange


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``docs`` with lang_pred, score and strange (is it in no learned language?); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    # ~1 MB of weights per two languages; the size is fixed by BITS
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            best, score, odd = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            real = [i for i, t in enumerate(texts) if has_letter(t)] if m.languages else []
            p, far = probabilities(m, [texts[i] for i in real]) if real else (np.zeros((0, 1)), np.zeros(0))
            for i, row, f in zip(real, p, far, strict=True):
                j = int(row.argmax())
                best[i], score[i], odd[i] = m.languages[j], float(row[j]), bool(f > m.limit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(odd)], names=[*b.schema.names, "lang_pred", "score", "strange"])

    rest = [c for c in docs.columns if c not in (key, "text", "lang_pred", "score", "strange")]
    kept = docs.select(key, "text", *rest)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept.columns), "lang_pred string", "score double", "strange boolean"])
    return kept.mapInArrow(run, schema)


def held_out(key: Column, modulus: int = 3) -> Column:
    """Whether the CRC-32 of a key, as text, leaves 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 1, F.lit(False))
