"""Vectors: pooling, pair features, comparator heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(v, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))


def qe_features(s: Column, m: Column) -> Column:
    """[s, m, s*m, |m-s|]."""
    return F.concat(s, m, F.zip_with(s, m, lambda x, y: x * y), F.zip_with(m, s, lambda x, y: F.abs(x - y)))


def comet_features(s: Column, m: Column, r: Column) -> Column:
    """[r, m, s*m, r*m, |m-s|, |m-r|]."""
    times, apart = (lambda x, y: x * y), (lambda x, y: F.abs(x - y))
    return F.concat(r, m, F.zip_with(s, m, times), F.zip_with(r, m, times), F.zip_with(m, s, apart), F.zip_with(m, r, apart))


def masked_mean(frames: DataFrame, by: str = "id") -> DataFrame:
    """``frames(id, t, vector, mask)``: mean over unmasked frames, at least one counted."""
    cells = frames.select(by, F.posexplode("vector").alias("dim", "x"), F.col("mask").cast("double").alias("w"))
    pooled = cells.groupBy(by, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("x"))
    return pooled.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("vector"))


def attention_pool(frames: DataFrame, query: list[float], by: str = "id") -> DataFrame:
    """Softmax over the frames' products with ``query``, masked frames out, then their weighted sum."""
    scored = frames.where("mask").withColumn("s", dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])))
    top = scored.groupBy(by).agg(F.max("s").alias("top"))
    scored = scored.join(top, by).withColumn("w", F.exp(F.col("s") - F.col("top")))
    cells = scored.select(by, F.posexplode("vector").alias("dim", "x"), "w")
    pooled = cells.groupBy(by, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return pooled.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("vector"))


def mlp(v: Column, layers: list[tuple[list[list[float]], list[float]]], activation: str = "tanh", output_tanh: bool = False) -> Column:
    """A small multi-layer head: each layer is (weights by output, biases)."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    for i, (weights, bias) in enumerate(layers):
        v = F.array(*[dot(v, lit(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])
        if i < len(layers) - 1 or output_tanh:
            v = F.transform(v, F.tanh if activation == "tanh" or i == len(layers) - 1 else (lambda x: F.greatest(x, F.lit(0.0))))
    return v


def comparator_score(a: Column, b: Column, layers, symmetric: bool = True, **options) -> Column:
    """Output 0 of the head on a pair; averaged over both orders if symmetric."""
    one = F.get(mlp(qe_features(a, b), layers, **options), F.lit(0))
    return (one + F.get(mlp(qe_features(b, a), layers, **options), F.lit(0))) / 2 if symmetric else one
