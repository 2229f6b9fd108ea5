"""Mixing sources to target weights.

Each source is a stream of words, its documents in a fixed order, packed into
blocks of ``block`` words.  The words to take from each source are its share of
all words, at most ``repeats`` times its size; what is cut off there goes to
the others by weight.  Their slots are dealt to output shards of
``shard_slots`` slots: a keyed permutation of all slot numbers cut into shards,
so that a shard's counts of the sources are a multinomial draw conditioned on
each source's total (independent draws would miss the targets of small
sources).  Slot j of a source reads block perm[e](j mod n) in pass e = j div n,
where perm[e] is a pseudorandom permutation of the n block numbers (a Feistel
network with cycle walking).  Slots and packed documents meet in a join on
(source, block).

Equal documents are one row with a count until the pieces are cut, and offsets
in the streams come from prefix sums over two levels of buckets, so neither a
source nor a document that holds a third of all rows gathers anywhere.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, last in order; a source of size 0 has target 0;
rows that repeat are documents of their own (each counts); an empty table gives
an empty mix; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm._spark import WORD, saved
from assayframe.operators.rows import dense_ids

BLOCK, REPEATS, SEED, SHARD_SLOTS, BUCKET_ROWS = 1024, 3, 17, 256, 2000
SPAN = 1000  # buckets of a bucket; copies or slots that are listed together
_M = np.uint64(0xFF51AFD7ED558CCD)


def _rounds(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        f = (right + k) * _M
        f = (f ^ (f >> np.uint64(32))) * _M
        left, right = right, left ^ ((f >> np.uint64(29)) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Image of ``index`` under permutation ``key`` of 0 .. n-1."""
    if n <= 1:
        return np.zeros_like(index)
    half = (int(n - 1).bit_length() + 1) // 2
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)
    x = _rounds(index.astype(np.uint64), half, keys)
    while (out := x >= n).any():
        x[out] = _rounds(x[out], half, keys)
    return x.astype(np.int64)


def position(value: int, n: int, key: int) -> int:
    """The index that ``permuted`` maps to ``value``: the network run backwards."""
    if n <= 1:
        return 0
    half = (int(n - 1).bit_length() + 1) // 2
    mask, mult = (1 << half) - 1, int(_M)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)]
    x = value
    while True:
        left, right = x >> half, x & mask
        for k in reversed(keys):
            f = (left + k) * mult % 2**64
            f = (f ^ (f >> 32)) * mult % 2**64
            left, right = right ^ ((f >> 29) & mask), left
        x = (left << half) | right
        if x < n:
            return x


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Words to take from each source: all sizes shared by weight, none above
    ``repeats`` times its source, the excess reshared by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def source_plan(sized: DataFrame, weights=(1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """One row per source: number, source, source_size, target; see ``targets``.

    Sources are numbered by code point, null last.  The excess of those above
    their limit is shared again, by sums over all sources, until none is above.
    """
    rows = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    rows = rows.withColumn("none", F.col("source").isNull())
    rows = dense_ids(rows, ["none", "source"], "number").drop("none")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
    limit = F.lit(float(repeats)) * F.col("source_size")
    left = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    shares = rows.withColumn("capped", F.lit(False))
    while True:
        state = shares.agg(F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("capped"), limit)).alias("held")).first()
        rest, total = left - (state["held"] or 0.0), state["w"] or 1.0
        over = F.col("capped") | (F.lit(rest) * F.col("weight") / F.lit(total) > limit)
        more = shares.agg(F.count_if(over & ~F.col("capped"))).first()[0]
        if not more:
            target = F.when(F.col("capped"), limit).otherwise(F.lit(rest) * F.col("weight") / F.lit(total))
            return saved(shares.select("number", "source", "source_size", target.alias("target")))
        shares = saved(shares.withColumn("capped", over))


def packed(docs: DataFrame, key: list[str]) -> DataFrame:
    """Different ``docs(key, text, source)`` with copies, size and offset: the words before them in their source."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.select(*key, F.xxhash64("text").alias("hash"), "source", "size")
    sized = saved(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies")))
    buckets = max(1, sized.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(*key, "hash"), F.lit(buckets))
    sized = sized.withColumn("bucket", bucket).withColumn("span", F.floor(F.col("bucket") / SPAN)).withColumn("all", F.col("size") * F.col("copies"))
    before = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = sized.groupBy("source", "span", "bucket").agg(F.sum("all").alias("words"))
    spans = per.groupBy("source", "span").agg(F.sum("words").alias("words"))
    spans = spans.select(F.col("source").alias("s2"), F.col("span").alias("p2"), before(["source"], ["span"], "words").alias("far"))
    per = per.withColumn("near", before(["source", "span"], ["bucket"], "words"))
    per = per.join(spans, per["source"].eqNullSafe(spans["s2"]) & (per["span"] == spans["p2"])).select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("far") + F.col("near")).alias("base"))
    sized = sized.withColumn("within", before(["source", "bucket"], [*key, "hash", "size"], "all"))
    both = sized.join(per, sized["source"].eqNullSafe(per["s"]) & (sized["bucket"] == per["b"]))
    return saved(both.select(*key, "hash", "source", "size", "copies", (F.col("base") + F.col("within")).alias("offset")))


def slots(plan: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: source, shard, place (in its shard), slot, pass, block, words.

    A slot's ``words`` are the first that many of its block.
    """
    rows = plan.where("source_size > 0").withColumn("goal", F.round("target").cast("long")).where("goal > 0")
    n, rest = F.ceil(F.col("source_size") / block), F.col("goal") % F.col("source_size")
    # whole passes, then slots until the words are reached; a short block among them needs one more
    some = F.least(n, F.ceil(rest / block) + F.when(rest > 0, 1).otherwise(0))
    rows = rows.withColumn("count", (F.floor(F.col("goal") / F.col("source_size")) * n + some).cast("long"))
    behind = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    rows = saved(rows.withColumn("base", F.coalesce(F.sum("count").over(behind), F.lit(0))))
    total = rows.agg(F.sum("count")).first()[0] or 0
    step = SPAN * 100
    parts = rows.select("number", "source_size", "goal", "count", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(step).cast("long"))).alias("first"))
    parts = parts.repartition("number", "first")

    def fill(batches):
        for p in batches:
            for number, size, goal, count, base, first in p.itertuples(index=False):
                n, key = -(-size // block), seed * 1_000_003 + number * 1_009
                j = np.arange(first, min(first + step, count), dtype=np.int64)
                turn, at = j // n, j % n
                held = np.zeros_like(j)
                words = np.zeros_like(j)
                for e in np.unique(turn).tolist():
                    m = turn == e
                    held[m] = permuted(at[m], n, key + e)
                    short = n * block - size
                    where = position(n - 1, n, key + e) if short else n
                    size_of = np.where(held[m] == n - 1, block - short, block)
                    before = e * size + at[m] * block - np.where(at[m] > where, short, 0)
                    words[m] = np.clip(goal - before, 0, size_of)
                dealt = permuted(base + j, int(total), seed)
                keep = words > 0
                yield pd.DataFrame({"number": number, "shard": dealt[keep] // shard_slots, "place": dealt[keep] % shard_slots, "slot": j[keep], "pass": turn[keep], "block": held[keep], "words": words[keep]})

    made = parts.mapInPandas(fill, "number long, shard long, place long, slot long, pass long, block long, words long")
    return made.join(plan.select("number", "source"), "number").drop("number")


def mix(docs: DataFrame, key=("doc_id",), weights=(1, 2, 3), block: int = BLOCK, repeats: int = REPEATS, seed: int = SEED, shard_slots: int = SHARD_SLOTS):
    """The mix as pieces of documents, with the packed documents and the plan.

    Pieces: the key, hash, source, size, copy (of equal documents, from 0), shard, place, slot, pass, block, start
    (word of the document, from 0) and words.  A block of the mix is the pieces
    of one slot, in order of ``piece``.
    """
    key = list(key)
    rows = packed(docs, key)
    plan = source_plan(rows, weights, repeats)
    # written, so that its size is known: it grows with the input and must not be taken for small
    table = saved(slots(plan, block, seed, shard_slots))
    end = F.col("offset") + F.col("size") * F.col("copies")
    spread = rows.where("size > 0").select(
        *key, "hash", F.col("source").alias("s"), "size", "offset", end.alias("end"),
        F.floor((end - 1) / block).alias("stop"), F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block), F.lit(SPAN).cast("long"))).alias("lo"),
    )
    spread = spread.withColumn("b", F.explode(F.sequence("lo", F.least(F.col("lo") + SPAN - 1, F.col("stop"))))).drop("lo", "stop")
    met = spread.join(table, spread["s"].eqNullSafe(table["source"]) & (spread["b"] == table["block"]))
    met = met.withColumn("from", F.greatest(F.col("offset"), F.col("b") * block)).withColumn("to", F.least("end", F.col("b") * block + F.col("words"))).where(F.col("to") > F.col("from"))
    # a block holds at most its own number of copies
    first, last = F.floor((F.col("from") - F.col("offset")) / F.col("size")), F.floor((F.col("to") - 1 - F.col("offset")) / F.col("size"))
    met = met.withColumn("copy", F.explode(F.sequence(first, last)))
    own = F.col("offset") + F.col("copy") * F.col("size")
    start, stop = F.greatest(F.col("from"), own), F.least(F.col("to"), own + F.col("size"))
    pieces = met.select(
        *key, "hash", "source", "size", "copy", "shard", "place", "slot", "pass", "block",
        (start - F.col("b") * block).alias("piece"), (start - own).alias("start"), (stop - start).alias("words"),
    )
    return pieces, rows, plan


def each_copy(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies`` as one row a copy, numbered from 0; many copies are spread first."""
    few = rows.where(F.col("copies") <= SPAN).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > SPAN).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(SPAN).cast("long"))))
    many = many.repartition("hash", "lo").withColumn("copy", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + SPAN, F.col("copies")) - 1))).drop("lo")
    return few.unionByName(many)


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    pieces, rows, plan = mix(docs, **options)
    got = pieces.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("h"), F.col("source").alias("of"), F.col("copy").alias("c")).agg(F.sum("words").alias("taken"))
    out = each_copy(rows)
    same = out["doc_id"].eqNullSafe(got["id"]) & (out["hash"] == got["h"]) & out["source"].eqNullSafe(got["of"]) & (out["copy"] == got["c"])
    out = out.join(got, same, "left").drop("source_size")
    p = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = out.join(p, out["source"].eqNullSafe(p["s"]), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
