"""The judge boundary: requests in, raw answers out.

A ``Judge`` is made once per worker and answers batches; everything behind it
is stateless parsing.  Answers are keyed by (request_id, repeat_index) and
written before they are parsed, so a run that broke off resumes with what is
missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import expressions as X


class Judge(Protocol):
    def answer(self, batch: pd.DataFrame) -> list[str]:
        """One raw text for each row (request_id, prompt, audio_paths, seed, ...)."""


class StubJudge:
    """Answers that depend on the request alone; for tests and dry runs."""

    def answer(self, batch: pd.DataFrame) -> list[str]:
        out = []
        for request_id, seed in zip(batch["request_id"], batch["generation_seed"], strict=True):
            n = int(hashlib.md5(f"{request_id}:{seed}".encode()).hexdigest()[:8], 16)
            out.append((f"Score: {n % 11}", f'{{"score": {n % 11}}}', f"Final score: {n % 11}", "AB"[n % 2])[n % 4])
        return out


def with_repeats(requests: DataFrame, repeats: int = 1, base_seed: int = 0, order: str = "request_id") -> DataFrame:
    """Each request ``repeats`` times, with seed = base + ordinal * repeats + repeat.

    The ordinal is the request's dense place in ``order``, from a range
    partitioning, so no single task numbers all rows.
    """
    from assayframe.operators.rows import dense_ids

    numbered = dense_ids(requests, [order], "_ord")
    out = numbered.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("repeat_count", F.lit(repeats))
    return out.withColumn("generation_seed", F.lit(base_seed) + F.col("_ord") * repeats + F.col("repeat_index")).drop("_ord")


def run(requests: DataFrame, make: Callable[[], Judge], done: DataFrame | None = None) -> DataFrame:
    """Raw answers of the requests that ``done`` doesn't hold yet."""
    if done is not None:
        requests = requests.join(done.select("request_id", "repeat_index"), ["request_id", "repeat_index"], "left_anti")

    def answer(parts):
        judge = make()
        for p in parts:
            yield pd.DataFrame({"request_id": p["request_id"], "repeat_index": p["repeat_index"], "raw_response_text": judge.answer(p)})

    return requests.mapInPandas(answer, "request_id string, repeat_index int, raw_response_text string")


def parsed(answers: DataFrame, low: float, high: float) -> DataFrame:
    """Scalar predictions: raw_parsed_score, raw_parse_error."""
    out = answers.withColumn("raw_parsed_score", X.final_score(F.col("raw_response_text"), low, high))
    return out.withColumn("raw_parse_error", F.when(F.col("raw_parsed_score").isNull(), F.lit("response did not contain a numeric score within scale")))
