"""Prosody similarity of audio pairs: an encoder, pooling and a comparator head."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    def encode(self, sources: list) -> np.ndarray:
        """One vector for each source; made once per worker."""


def head(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], activation: str = "tanh", output_tanh: bool = False) -> np.ndarray:
    """A multi-layer head over rows of features."""
    for i, (w, b) in enumerate(layers):
        x = x @ np.asarray(w).T + np.asarray(b)
        if i < len(layers) - 1:
            x = np.tanh(x) if activation == "tanh" else np.maximum(x, 0)
    return np.tanh(x) if output_tanh else x


def features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a, b, a * b, np.abs(b - a)], axis=1)


class PairScorer:
    """Scores pairs of sources: both are encoded, the head compares them, in both orders if symmetric."""

    def __init__(self, make_encoder: Callable[[], Encoder], layers, symmetric: bool = True, normalise: bool = False, batch: int = 64, **options):
        self.make, self.layers, self.symmetric, self.normalise, self.batch, self.options = make_encoder, layers, symmetric, normalise, batch, options

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return head(features(a, b), self.layers, **self.options)[:, 0]

    def score(self, pairs: DataFrame, key: str = "pair_id", source: str = "src_audio", target: str = "tgt_audio") -> DataFrame:
        """``key`` and score; models stay in the workers, batches keep memory bounded."""
        kind, me = dict(pairs.dtypes)[key], self

        def run(parts):
            encoder = me.make()

            def vectors(x):
                v = np.asarray(encoder.encode(list(x)), dtype=np.float64)
                return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if me.normalise else v

            for p in parts:
                for lo in range(0, len(p), me.batch):
                    rows = p.iloc[lo : lo + me.batch]
                    a, b = vectors(rows[source]), vectors(rows[target])
                    s = me._compare(a, b)
                    yield pd.DataFrame({key: rows[key], "score": (s + me._compare(b, a)) / 2 if me.symmetric else s})

        return pairs.select(key, source, target).mapInPandas(run, f"`{key}` {kind}, score double")
