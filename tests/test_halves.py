"""Halves drawn over batches: digests, small and large blocks, nulls, rows of any size."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from assayframe.functions import halves


@pytest.mark.parametrize("prefix", [b"", b"13:7", b"13:249", b"x" * 54, b"y" * 80])
def test_digests_are_md5(prefix):
    texts = ["", *[f":{'é' * (i % 5)}{i * 37 % 1003}{'z' * (i % 70)}" for i in range(700)]]
    found = halves.Messages(pa.array(texts).slice(1)).digests(prefix)
    assert ["".join(f"{x:08x}" for x in d) for d in found.T.tolist()] == [hashlib.md5(prefix + t.encode()).hexdigest() for t in texts[1:]]


def by_hand(rows, iterations, most):
    out = {}
    for text, keys, scores in rows:
        n = len(scores)
        for it in range(iterations):
            if n <= most:
                masks = [m for m in range(1 << n) if bin(m).count("1") == n // 2]
                mask = masks[int(hashlib.md5(f"13:{it // 4}{text}".encode()).hexdigest()[8 * (it % 4) :][:8], 16) % len(masks)]
                left, right = [s for j, s in enumerate(scores) if mask >> j & 1], [s for j, s in enumerate(scores) if not mask >> j & 1]
            else:
                order = [scores[j] for j in sorted(range(n), key=lambda j: (hashlib.md5(f"13:{it}{keys[j]}".encode()).hexdigest(), scores[j]))]
                left, right = order[: n // 2], order[n // 2 :]
            if None not in scores:
                key = (it, sum(left) / len(left), sum(right) / len(right))
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize(("most", "cells", "block"), [(4, 1 << 21, 1 << 14), (1, 1 << 21, 50), (16, 1 << 21, 7), (4, 300, 60), (1, 8, 60)])
def test_draws_by_hand(monkeypatch, most, cells, block):
    """Counts that a task can't hold at once go out early; no draw is lost or doubled."""
    monkeypatch.setattr(halves, "CELLS", cells)
    monkeypatch.setattr(halves, "BLOCK", block)
    rng = random.Random(3)
    rows = [(f":{i}", [f":{i}:a{j}" for j in range(n)], [rng.choice([0, 1, 2, 2.5, *([None] if i % 9 == 0 else [])]) for _ in range(n)]) for i in range(200) for n in [rng.choice([2, 3, 4, 6, 7])]]
    rows.append((":x", [":x:same"] * 5, [2, 0, 1, 1, 0]))  # an annotator's votes on a row, five times
    schema = pa.schema({"text": pa.string(), "keys": pa.list_(pa.string()), "scores": pa.list_(pa.float64())})
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[lo : lo + 64]], schema) for lo in range(0, len(rows), 64)]
    got = {}
    for b in halves.draws(11, 13, most)(iter(batches)):
        for r in b.to_pylist():
            key = (r["iteration"], r["x"], r["y"])
            got[key] = got.get(key, 0) + r["w"]
    assert got == by_hand(rows, 11, most)


def test_a_task_gives_few_rows(monkeypatch):
    """What leaves a task grows with the different means, not with rows times iterations."""
    rng = np.random.default_rng(5)
    batch = pa.RecordBatch.from_arrays([pa.array([f":{i}" for i in range(3000)]), pa.nulls(3000, pa.list_(pa.string())), pa.array([rng.integers(0, 3, 4).astype(float).tolist() for _ in range(3000)])], ["text", "keys", "scores"])
    out = list(halves.draws(40, 13, 10)(iter([batch])))
    assert sum(b.num_rows for b in out) <= 40 * 25 and sum(sum(b.column("w").to_pylist()) for b in out) == 3000 * 40
