"""Audio and speech models: the boundary between tables and signal processing.

Everything here is a typed seam with a stub or a plain implementation: WAV
decoding with the standard library, linear resampling, clips by slices.  Models
are made once per worker by a function that the caller passes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X

RATE = 16_000


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (channels averaged, -1 to 1) and rate of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    else:
        raise ValueError(f"unsupported sample width: {width}")
    return x.reshape(-1, channels).mean(axis=1), rate


def resampled(x: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == target or len(x) == 0:
        return x
    n = max(1, round(len(x) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x).astype(np.float32)


def audio(files: DataFrame, rate: int = RATE, decoders: tuple[Callable[[bytes], tuple[np.ndarray, int]], ...] = (decoded,)) -> DataFrame:
    """``files(path, content)`` as path and samples, mono at ``rate``.

    The decoders are tried in turn; a file that none reads, or without a
    sample, fails the query.
    """

    def read(parts):
        for p in parts:
            out = []
            for path, content in zip(p["path"], p["content"], strict=True):
                why = []
                for decode in decoders:
                    try:
                        x, own = decode(bytes(content))
                        break
                    except Exception as e:  # the next decoder may read it
                        why.append(f"{type(e).__name__}: {e}")
                else:
                    raise ValueError(f"no decoder reads {path}: {'; '.join(why)}")
                if len(x) == 0:
                    raise ValueError(f"empty audio: {path}")
                out.append((path, resampled(x, own, rate)))
            yield pd.DataFrame(out, columns=["path", "samples"])

    return files.select("path", "content").mapInPandas(read, "path string, samples array<float>")


def clip(samples: Column, start_s: Column, duration_s: Column, rate: int = RATE) -> Column:
    """The samples of an interval."""
    return F.slice(samples, F.round(start_s * rate).cast("int") + 1, F.round(duration_s * rate).cast("int"))


class Transcriber(Protocol):
    def transcribe(self, sources: list) -> list[str]:
        """One text for each source; made once per worker."""


class StubTranscriber:
    """Texts that depend on the source alone; for tests and dry runs."""

    def transcribe(self, sources: list) -> list[str]:
        return [f"transcript of {s}" for s in sources]


#: backends by name: functions that make a Transcriber; others are added by ``TRANSCRIBERS[name] = make``
TRANSCRIBERS: dict[str, Callable[[], Transcriber]] = {"stub": StubTranscriber}


def transcripts(rows: DataFrame, backend: str | Callable[[], Transcriber], key: str = "utterance_id", source: str = "audio_path", batch: int = 16) -> DataFrame:
    """``key`` and transcript of every row; an unknown backend is an error."""
    if isinstance(backend, str) and backend not in TRANSCRIBERS:
        raise ValueError(f"unknown backend: {backend}")
    make = TRANSCRIBERS[backend] if isinstance(backend, str) else backend
    kind = dict(rows.dtypes)[key]

    def run(parts):
        model = make()
        for p in parts:
            for lo in range(0, len(p), batch):
                b = p.iloc[lo : lo + batch]
                yield pd.DataFrame({key: b[key], "transcript": model.transcribe(list(b[source]))})

    return rows.select(key, source).mapInPandas(run, f"`{key}` {kind}, transcript string")


def normalised(rows: DataFrame, text: str, out: str, make: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """``rows`` with a normalised text: by the plain rule, or by a normaliser made once per worker."""
    if make is None:
        return rows.withColumn(out, X.asr_text(F.col(text)))
    schema = ", ".join(f"`{n}` {t}" for n, t in [(n, t) for n, t in rows.dtypes if n != out] + [(out, "string")])
    names = [n for n in rows.columns if n != out]

    def run(parts):
        tool = make()
        for p in parts:
            yield p[names].assign(**{out: [tool(x or "") for x in p[text]]})

    return rows.mapInPandas(run, schema)


class LayeredEncoder:
    """An encoder that runs its layers up to ``pick`` only and averages over time.

    ``layers`` are functions on (time, dimension) arrays; those above ``pick``
    are never run and stay in ``layers``.
    """

    def __init__(self, frontend: Callable, layers: list[Callable[[np.ndarray], np.ndarray]], pick: int = 9):
        if not 0 <= pick <= len(layers):
            raise ValueError(f"no layer {pick}")
        self.frontend, self.layers, self.pick = frontend, layers, pick

    def encode(self, sources: list) -> np.ndarray:
        out = []
        for s in sources:
            h = self.frontend(s)
            for layer in self.layers[: self.pick]:
                h = layer(h)
            out.append(h.mean(axis=0))
        return np.stack(out) if out else np.zeros((0, 0))


def placement(devices: list[tuple[str, float]], keep_free: float = 1.0) -> dict[str, float]:
    """Memory (GB) that a model may take on each device(name, total): its total less what is kept free; full ones are left out."""
    return {name: total - keep_free for name, total in devices if total > keep_free}
