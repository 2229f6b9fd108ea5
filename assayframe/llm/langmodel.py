"""Language-model scores from a log-bilinear neural model.

The contexts' vectors of the ``CONTEXT`` tokens before a token, each scaled per
position, are summed to a predicted vector.  Its products with output vectors,
plus biases, are normalised by softmaxes of two levels: first over clusters of
words, the end of a text and ``GROUPS`` groups of rare words, then over the words
of the cluster.  Modelled so are the most frequent words, as many as the largest
power of two of those seen ``LEAST`` times or more allows, ``WORDS`` at most; words of
one ending share clusters.  A rare word is in the group of its ending and there
has its smoothed relative frequency.  So the probabilities of all words, one
unseen word per group included, sum to one.

Training is noise-contrastive estimation in numpy, at both levels: a warm start
on a bounded sample, then one pass over all training texts, dealt by hash to
shards of about ``SHARD_CHARS`` characters and sorted there; every shard goes on
from the warm start with all of its tokens, and the resulting parameters are
averaged by token counts in the order of the shards.  So neither files nor
machines decide what is learned.  Word counts come from all training texts.
Counts of the ``KNOWN`` most frequent words go to the scorers by broadcast
(bounded by that number); all rarer words meet their counts in a join.

Defined cases: a null text is empty; an empty text is its end token alone;
without training texts every class is equally likely; rows that repeat are
scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import saved, shuffle_partitions, small_batches
from assayframe.llm._text import _BYTE, hash_spans, mix64, row_chunks, text_bytes, word_spans

CONTEXT, DIM, GROUPS = 5, 16, 64
WORDS, LEAST = 1 << 13, 8
KNOWN, WARM_CHARS, SHARD_CHARS, PIECE = 1 << 18, 4_000_000, 16_000_000, 512
BATCH, NOISE, INNER, RATE = 4096, 25, 8, 0.1
ROWS = 1024  # scored at once
GUIDE = 2048  # parts of a cluster's share that are looked up
_LOW = np.uint64(GROUPS - 1)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of every word, its group in the lowest bits, and row starts."""
    starts, ends, at = word_spans(data, offsets)
    h = hash_spans(data, starts, ends)
    tail = _BYTE[data[ends - 1]] * np.uint64(31) + np.where(ends - starts > 1, _BYTE[data[np.maximum(ends - 2, 0)]], np.uint64(7))
    group = mix64(tail) & _LOW
    return ((h & ~_LOW) | group).astype(np.int64), at


def chunks_of(column):
    """Yield (first row, word ids, row starts) over a string column."""
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        base = offsets[lo]
        ids, at = word_ids(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        yield lo, ids, at


def word_counts(docs: DataFrame) -> DataFrame:
    """word (id) and n over all of ``docs(text)``, without end tokens."""

    def run(batches):
        held, n = [], 0

        def flush():
            u, c = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            c = np.bincount(c, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            return u, c

        for b in batches:
            for _, ids, _at in chunks_of(b.column(0)):
                if len(ids):
                    u, c = np.unique(ids, return_counts=True)
                    held.append((u, c))
                    n += len(u)
                if n > 4_000_000:
                    held = [flush()]
                    n = len(held[0][0])
                    if n > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["word", "n"])
                        held, n = [], 0
        if held:
            u, c = flush()
            for lo in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 200_000]), pa.array(c[lo : lo + 200_000])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted ids of the most frequent words
    counts: np.ndarray
    slots: np.ndarray  # their places among the modelled words, clusters one after another; -1: not modelled
    width: int  # modelled words of a cluster
    slot_n: np.ndarray  # counts of the modelled words by place
    group_n: np.ndarray  # per group, over words that are not modelled
    group_v: np.ndarray
    tokens: int  # N
    kinds: int  # V
    ends: int

    @cached_property
    def first(self) -> tuple[int, np.ndarray]:
        """Ids are hashes: how far to shift them, and the first word from each of the shifted numbers on."""
        bits = len(self.words).bit_length()
        return 64 - bits, np.searchsorted(self.words, np.arange(-(1 << bits - 1), 1 << bits - 1) << 64 - bits)

    @property
    def modelled(self) -> int:
        return len(self.slot_n)

    @property
    def clusters(self) -> int:
        return self.modelled // self.width

    @property
    def classes(self) -> int:
        """Clusters, then the end of a text, then the groups."""
        return self.clusters + 1 + GROUPS

    @property
    def start(self) -> int:
        """The context before a text; modelled words and groups are the other contexts."""
        return self.modelled + GROUPS


def vocabulary(counts: DataFrame, texts: int, most: int = WORDS) -> Vocabulary:
    """What the scorers need of the ``counts(word, n)`` of ``texts`` texts."""
    level = F.floor(F.log2("n") * 16).cast("int")
    group = F.col("word").bitwiseAND(F.lit(GROUPS - 1)).cast("int")
    sums = counts.groupBy(level.alias("level"), group.alias("g")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    by = {}
    for r in sums:
        by[r["level"]] = by.get(r["level"], 0) + r["v"]
    cut, total = max(by, default=0) + 1, 0
    for k in sorted(by, reverse=True):
        if total + by[k] > KNOWN:
            break
        total, cut = total + by[k], k
    top = counts.where(level >= cut).collect() if total else []  # KNOWN rows at most
    top = sorted(((r["word"], r["n"]) for r in top))
    words, n = np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], np.int64)
    usual = min(most, int(np.count_nonzero(n >= LEAST)))
    power = usual.bit_length() - 1
    chosen = np.lexsort((words, -n))[: 1 << power] if usual else np.zeros(0, np.int64)
    # words of one ending (the lowest bits) stand together
    chosen = chosen[np.lexsort((words[chosen], words[chosen] & (GROUPS - 1)))]
    slots = np.full(len(words), -1, np.int64)
    slots[chosen] = np.arange(len(chosen))
    group_n, group_v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in sums:
        group_n[r["g"]] += r["n"]
        group_v[r["g"]] += r["v"]
    at = words[chosen] & (GROUPS - 1)
    np.subtract.at(group_n, at, n[chosen])
    np.subtract.at(group_v, at, 1)
    width = 1 << (max(power, 0) + 1) // 2
    return Vocabulary(words, n, slots, width, n[chosen], group_n, group_v, int(sum(r["n"] for r in sums)) + texts, int(sum(r["v"] for r in sums)) + (texts > 0), texts)


@dataclass
class Parameters:
    q: np.ndarray  # class vectors
    b: np.ndarray
    qi: np.ndarray  # vectors of the modelled words
    bi: np.ndarray
    r: np.ndarray  # context vectors
    c: np.ndarray  # scale per position and dimension

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.q, self.b, self.qi, self.bi, self.r, self.c

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def of(flat: np.ndarray, v: Vocabulary) -> Parameters:
        shapes = [(v.classes, DIM), (v.classes,), (v.modelled, DIM), (v.modelled,), (v.start + 1, DIM), (CONTEXT, DIM)]
        cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return Parameters(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cut), shapes, strict=True)))


def class_share(v: Vocabulary) -> np.ndarray:
    n = np.concatenate([v.slot_n.reshape(v.clusters, -1).sum(axis=1) if v.modelled else np.zeros(0), [v.ends], v.group_n])
    return (n + 0.5) / (n.sum() + 0.5 * v.classes)


def word_share(v: Vocabulary) -> np.ndarray:
    """Of each modelled word in its cluster."""
    n = (v.slot_n + 0.5).reshape(v.clusters, v.width)
    return (n / n.sum(axis=1, keepdims=True)).ravel()


def initial(v: Vocabulary, seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return Parameters(
        small(v.classes, DIM), np.log(class_share(v)).astype(np.float32), small(v.modelled, DIM), np.log(word_share(v)).astype(np.float32),
        small(v.start + 1, DIM), np.ones((CONTEXT, DIM), np.float32),
    )


def slots_of(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word id (-1: not modelled), and its place in ``v.words`` (-1: not there)."""
    if len(v.words) == 0:
        return np.full(len(ids), -1), np.full(len(ids), -1)
    shift, first = v.first
    last = len(v.words) - 1
    at = np.minimum(first[(ids >> shift) + len(first) // 2], last)
    late = np.flatnonzero(v.words[at] < ids)
    while len(late):
        late = late[at[late] < last]
        at[late] += 1
        late = late[v.words[at[late]] < ids[late]]
    at = np.where(v.words[at] == ids, at, -1)
    return np.where(at >= 0, v.slots[at], -1), at


def sequences(v: Vocabulary, ids: np.ndarray, slots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all rows, with their ends: class, slot and contexts."""
    rows = len(at) - 1
    sizes = np.diff(at) + 1
    stop = np.cumsum(sizes)
    n = int(stop[-1]) if rows else 0
    keep = np.ones(n, bool)
    keep[stop - 1] = False
    group = ids & (GROUPS - 1)
    y, slot, own = np.full(n, v.clusters), np.full(n, -1), np.full(n, v.start)
    y[keep] = np.where(slots >= 0, slots // v.width, v.clusters + 1 + group)
    slot[keep] = slots
    own[keep] = np.where(slots >= 0, slots, v.modelled + group)
    place = np.arange(n) - np.repeat(stop - sizes, sizes)
    before = np.full((n, CONTEXT), v.start, np.int64)
    for j in range(CONTEXT):
        ok = np.flatnonzero(place > j)
        before[ok, j] = own[ok - j - 1]
    return y, slot, before


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _scatter(ids: np.ndarray, columns, rows: int) -> np.ndarray:
    """Rows of gradients added up by id; ``columns`` gives a dimension at a time."""
    out = np.empty((rows, DIM), np.float32)
    for d, x in enumerate(columns):
        out[:, d] = np.bincount(ids, x, rows)
    return out


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes (Adagrad)."""

    def __init__(self, p: Parameters, v: Vocabulary, seed: int):
        self.p, self.v, self.seen = p, v, 0
        self.sq = [np.full_like(x, 1.0) for x in p.parts()]
        self.rng = np.random.default_rng(seed)
        share, inner = class_share(v), word_share(v)
        self.cum, self.log_kp = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.cum_inner, self.log_ki = np.concatenate([[0.0], np.cumsum(inner)]), np.log(INNER * inner).astype(np.float32)
        parts = np.arange(v.clusters * GUIDE + 1) / GUIDE
        low, high = np.searchsorted(self.cum_inner, parts[:-1], "right"), np.searchsorted(self.cum_inner, parts[1:], "left")
        self.guide = np.concatenate([np.where(low == high, low - 1, -1), np.full(GUIDE, -1)]).astype(np.int32)  # -1: parts of several words

    def _others(self, cluster: np.ndarray) -> np.ndarray:
        """Noise words of the same clusters, by their share of them."""
        low = (cluster * self.v.width)[:, None]
        at = (self.cum_inner[low] + self.rng.random((len(cluster), INNER))).ravel()
        other = self.guide.take((at * GUIDE).astype(np.int64))
        several = np.flatnonzero(other < 0)
        other[several] = np.searchsorted(self.cum_inner, at[several], side="right") - 1
        return np.clip(other.reshape(-1, INNER), low, low + self.v.width - 1)

    def learn(self, y: np.ndarray, slot: np.ndarray, before: np.ndarray) -> None:
        for lo in range(0, len(y), BATCH):
            self._step(y[lo : lo + BATCH], slot[lo : lo + BATCH], before[lo : lo + BATCH])
        self.seen += len(y)

    def _step(self, y: np.ndarray, slot: np.ndarray, ctx: np.ndarray) -> None:
        p, n = self.p, len(y)
        # within a text the context at a place is the nearest one so many tokens before: vectors are gathered, and their gradients
        # added up, once a token; near the start of a text or batch once a context
        r, edge = p.r.take(ctx[:, 0], axis=0), ctx[:, -1] == self.v.start
        edge[: CONTEXT - 1] = True
        edge = np.flatnonzero(edge)
        r_edge = p.r[ctx[edge]]
        v = r * p.c[0]
        for j in range(1, min(CONTEXT, n)):
            v[j:] += r[:-j] * p.c[j]
        v[edge] = (r_edge * p.c).sum(axis=1)
        wide = np.ascontiguousarray(v.T, np.float64)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), self.v.classes - 1)
        qy, qn = p.q.take(y, axis=0), p.q[noise]
        gy = _sigmoid(np.einsum("nd,nd->n", v, qy) + p.b[y] - self.log_kp[y]) - 1
        gn = _sigmoid(v @ qn.T + (p.b[noise] - self.log_kp[noise]))
        gv = gy[:, None] * qy + gn @ qn
        gq = _scatter(y, gy * wide, self.v.classes)
        np.add.at(gq, noise, gn.T @ v)
        gb = np.bincount(y, gy, self.v.classes)
        np.add.at(gb, noise, gn.sum(axis=0))
        gqi, gbi = np.zeros((0, DIM), np.float32), np.zeros(0)
        if self.v.modelled:
            m = np.flatnonzero(slot >= 0)
            ids = np.concatenate([slot[m][:, None], self._others(y[m])], axis=1)
            qs = p.qi.take(ids, axis=0)
            g = _sigmoid(np.matvec(qs, v.take(m, axis=0)) + (p.bi - self.log_ki)[ids])
            g[:, 0] -= 1
            gv[m] += np.vecmat(g, qs)
            ids, g = ids.T.ravel(), g.T.astype(np.float64, order="C")
            gqi = _scatter(ids, ((g * x).ravel() for x in wide.take(m, axis=1)), self.v.modelled)
            gbi = np.bincount(ids, g.ravel(), self.v.modelled)
        gv_edge = gv[edge][:, None, :]
        gc, gr_edge = (gv_edge * r_edge).sum(axis=0), (gv_edge * p.c).reshape(-1, DIM)
        gv[edge] = 0
        near = gv * p.c[0]
        gc[0] += np.einsum("nd,nd->d", gv, r)
        for j in range(1, min(CONTEXT, n)):
            near[:-j] += gv[j:] * p.c[j]
            gc[j] += np.einsum("nd,nd->d", gv[j:], r[:-j])
        gr = _scatter(np.concatenate([ctx[:, 0], ctx[edge].ravel()]), np.concatenate([near, gr_edge]).T.astype(np.float64, order="C"), self.v.start + 1)
        for x, g, s in zip(p.parts(), (gq, gb, gqi, gbi, gr, gc), self.sq, strict=True):
            g = g.astype(np.float32, copy=False)
            g *= np.float32(20 / n)
            s += g * g
            g /= np.sqrt(s)
            g *= np.float32(RATE)
            x -= g


def learn_from(t: Trainer, column) -> None:
    for _, ids, at in chunks_of(column):
        t.learn(*sequences(t.v, ids, slots_of(t.v, ids)[0], at))


def warm_sample(docs: DataFrame, chars: int = WARM_CHARS) -> list[str]:
    """Different texts of ``docs(text)`` by hash, of ``chars`` characters together at most; longer ones than an eighth of that teach in the pass only."""
    kinds = docs.where(F.char_length("text").between(1, chars // 8)).select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k"), F.char_length("text").alias("n")).distinct()
    size = kinds.agg(F.sum("n")).first()[0]
    if not size:
        return []
    part = min(1.0, 2 * chars / size)
    some = kinds.where(F.pmod("h", F.lit(1_000_003)) <= int(part * 1_000_003)).collect()  # about 2 * chars characters of texts
    some.sort(key=lambda r: (r["h"], r["k"]))
    total, keys = 0, []
    for r in some:
        total += r["n"]
        if total > chars:
            break
        keys.append((r["h"], r["k"]))
    if not keys:
        return []
    picked = docs.sparkSession.createDataFrame(keys, "h long, k long")
    texts = docs.select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("k")).join(F.broadcast(picked), ["h", "k"])
    return sorted(r[0] for r in texts.groupBy("h", "k").agg(F.min("text").alias("text")).select("text").collect())


def warm_start(docs: DataFrame, v: Vocabulary) -> Parameters:
    """Parameters after training on the warm sample of ``docs(text)``."""
    texts = warm_sample(docs)
    np.random.default_rng(3).shuffle(texts)
    t = Trainer(initial(v), v, 11)
    learn_from(t, pa.array(texts, pa.string()))
    return t.p


def train(docs: DataFrame, v: Vocabulary) -> Parameters:
    """The model of ``docs(text, spread)``; spread is a hash that tells equal texts apart."""
    start = warm_start(docs, v)
    if not v.ends:
        start.b[:] = 0
        return start
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((start.flat(), v))
    size = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))

    def run(batches):
        flat, voc = held.value
        part = TaskContext.get().partitionId()
        t = Trainer(Parameters.of(flat, voc), voc, 101 + part)
        for b in batches:
            learn_from(t, b.column(0))
        if t.seen:
            out = t.p.flat()
            pieces = [out[lo : lo + PIECE].tobytes() for lo in range(0, len(out), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([part] * len(pieces), pa.int64()), pa.array([t.seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["piece", "shard", "seen", "x"])

    def mean(batches):
        piece, total, seen = None, None, 0
        out = []
        for b in batches:
            for k, n, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64) * n
                if k != piece:
                    if piece is not None:
                        out.append((piece, (total / seen).tobytes()))
                    piece, total, seen = k, x, n
                else:
                    total, seen = total + x, seen + n
        if piece is not None:
            out.append((piece, (total / seen).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["piece", "x"])

    dealt = docs.select("text", "spread").repartition(int(shards), "spread").sortWithinPartitions("spread", "text").select("text")
    made = dealt.mapInArrow(run, "piece long, shard long, seen long, x binary").repartition(shuffle_partitions(spark), "piece").sortWithinPartitions("piece", "shard")
    rows = made.mapInArrow(mean, "piece long, x binary").collect()  # the parameters
    held.destroy()
    flat = np.concatenate([np.frombuffer(r["x"], np.float64) for r in sorted(rows, key=lambda r: r["piece"])])
    return Parameters.of(flat, v)


class Scorer:
    """Natural log probabilities of tokens, by batched matrix products."""

    def __init__(self, p: Parameters, v: Vocabulary):
        self.p, self.v = p, v
        self.scaled = p.r[None, :, :] * p.c[:, None, :]
        # biases stand below the vectors, for a last dimension of one
        self.q = np.concatenate([p.q.T, p.b[None]])
        self.qi = np.ascontiguousarray(np.concatenate([p.qi, p.bi[:, None]], axis=1).reshape(v.clusters, v.width, DIM + 1).transpose(0, 2, 1))

    def __call__(self, y: np.ndarray, slot: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.empty(len(y))
        for lo in range(0, len(y), 65536):
            part = slice(lo, lo + 65536)
            out[part] = self._some(y[part], slot[part], before[part])
        return out

    def _some(self, y, slot, ctx):
        v = np.ones((len(y), DIM + 1), np.float32)
        v[:, :DIM] = sum(self.scaled[j].take(ctx[:, j], axis=0) for j in range(CONTEXT))
        out = np.empty(len(y))
        for lo in range(0, len(y), ROWS):
            out[lo : lo + ROWS] = self._own(v[lo : lo + ROWS], self.q, y[lo : lo + ROWS])
        order = np.argsort(y.astype(np.int16), kind="stable")
        ends = np.searchsorted(y[order], np.arange(self.v.clusters + 1))
        own = slot - y * self.v.width
        for k in range(self.v.clusters):
            at = order[ends[k] : ends[k + 1]]
            for lo in range(0, len(at), ROWS):
                a = at[lo : lo + ROWS]
                out[a] += self._own(v.take(a, axis=0), self.qi[k], own[a])
        return out

    @staticmethod
    def _own(v: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = v @ q
        np.clip(s, -60, 60, out=s)
        own = s[np.arange(len(at)), at].astype(np.float64)
        np.exp(s, out=s)
        return own - np.log((s @ np.ones(s.shape[1], np.float32)).astype(np.float64))


def score(docs: DataFrame, train_on: str = "train", key: str = "doc_id") -> DataFrame:
    """Scores of ``docs(key, text, <train_on> boolean)``.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(train_on), F.lit(False)).alias("train"))
    taught = rows.where("train").select("text", F.xxhash64(key, "text").alias("spread"))
    counts = saved(word_counts(taught))
    v = vocabulary(counts, taught.count())
    p = train(taught, v)
    held = docs.sparkSession.sparkContext.broadcast((v, p.flat()))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, uid long, n_tokens long, n_known long, base double, lm double, rare array<long>, times array<long>"

    def run(batches):
        voc, flat = held.value
        scorer = Scorer(Parameters.of(flat, voc), voc)
        known_log = np.log10(voc.counts + 0.5)
        group_log = np.log10(voc.group_n + 0.5 * (voc.group_v + 1))
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column("text")
            for lo, ids, at in chunks_of(texts):
                n = len(at) - 1
                slots, place = slots_of(voc, ids)
                lp = scorer(*sequences(voc, ids, slots, at)) / np.log(10)
                stop = np.cumsum(np.diff(at) + 1)
                lm = np.add.reduceat(lp, stop - np.diff(at) - 1)
                got = np.where(place >= 0, known_log[place] if len(known_log) else 0.0, 0.0)
                # a rare word's share of its group; what its count adds is known here or joined later
                part = np.where(slots < 0, got - group_log[ids & (GROUPS - 1)], 0.0)
                csum = lambda x: np.concatenate([[0.0], np.cumsum(x)])
                rows_of = lambda x: np.array([float(x[a:z].sum()) for a, z in zip(at[:-1], at[1:], strict=True)])
                base, extra, known = rows_of(got), rows_of(part), np.diff(csum(place >= 0)[at]).astype(np.int64)
                rare, times = [], []
                for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    u, c = np.unique(ids[a:z][place[a:z] < 0], return_counts=True)
                    rare.append(u)
                    times.append(c)
                base += np.log10(voc.ends + 0.5)
                known += voc.ends > 0
                for i0 in range(0, n, 2000):
                    i1 = min(n, i0 + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(key).slice(lo + i0, i1 - i0), pa.array([not x for x in b.column("train").slice(lo + i0, i1 - i0).to_pylist()]),
                            pa.array(np.arange(uid, uid + i1 - i0)), pa.array(np.diff(at)[i0:i1] + 1), pa.array(known[i0:i1]), pa.array(base[i0:i1]), pa.array((lm + extra)[i0:i1]),
                            pa.array(rare[i0:i1], pa.list_(pa.int64())), pa.array(times[i0:i1], pa.list_(pa.int64())),
                        ],
                        names=[key, "held_out", "uid", "n_tokens", "n_known", "base", "lm", "rare", "times"],
                    )
                    uid += i1 - i0

    each = saved(rows.mapInArrow(run, schema))
    out = each.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("m"))
    out = out.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"))
    shift = float(np.log10(v.tokens + 0.5 * (v.kinds + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return each.join(out, "uid", "left").select(
        key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * shift).alias("base_score"), (F.col("lm") + logs).alias("score"),
    )
