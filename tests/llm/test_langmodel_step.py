"""A training step against its gradients by definition, and how much it adds up by id."""

import numpy as np
import pytest

from assayframe.llm import langmodel as L


def model(words=256, seed=0):
    rng = np.random.default_rng(seed)
    ids = np.unique(rng.integers(-(2**63), 2**63 - 1, 3 * words))
    n = rng.zipf(1.4, len(ids)).clip(1, 10**6) + L.LEAST
    slots = np.full(len(ids), -1)
    slots[rng.permutation(len(ids))[:words]] = np.arange(words)
    slot_n = np.zeros(words, np.int64)
    slot_n[slots[slots >= 0]] = n[slots >= 0]
    return L.Vocabulary(ids, n, slots, 16, slot_n, rng.integers(1, 900, L.GROUPS), rng.integers(1, 90, L.GROUPS), int(n.sum()), len(ids), 50)


def tokens(v, sizes, seed=1):
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.where(rng.random(at[-1]) < 0.9, rng.choice(v.words, at[-1]), rng.integers(-(2**63), 2**63 - 1, at[-1]))
    return L.sequences(v, ids, L.slots_of(v, ids)[0], at)


def by_definition(t, y, slot, ctx):
    """The parameters after one step, every context and noise word on its own."""
    p, n, rows = [x.astype(float) for x in t.p.parts()], len(y), np.arange(len(y))
    q, b, qi, bi, r, c = p
    share, inner = L.class_share(t.v), L.word_share(t.v)
    rng = np.random.default_rng(7)
    noise = np.minimum(np.searchsorted(np.cumsum(share), rng.random(L.NOISE)), t.v.classes - 1)
    m = np.flatnonzero(slot >= 0)
    cum, low = np.concatenate([[0.0], np.cumsum(inner)]), y[m] * t.v.width
    other = np.searchsorted(cum, cum[low][:, None] + rng.random((len(m), L.INNER)), side="right") - 1
    other = np.clip(other, low[:, None], low[:, None] + t.v.width - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    v = (r[ctx] * c).sum(axis=1)
    g = [np.zeros_like(x) for x in p]
    gv = np.zeros_like(v)
    for at, real in [(y, 1), *[(np.full(n, k), 0) for k in noise]]:
        d = sigmoid((v * q[at]).sum(axis=1) + b[at] - np.log(L.NOISE * share[at])) - real
        gv += d[:, None] * q[at]
        np.add.at(g[0], at, d[:, None] * v)
        np.add.at(g[1], at, d)
    for at, real in [(slot[m], 1), *[(k, 0) for k in other.T]]:
        d = sigmoid((v[m] * qi[at]).sum(axis=1) + bi[at] - np.log(L.INNER * inner[at])) - real
        gv[m] += d[:, None] * qi[at]
        np.add.at(g[2], at, d[:, None] * v[m])
        np.add.at(g[3], at, d)
    for j in range(L.CONTEXT):
        np.add.at(g[4], ctx[rows, j], gv * c[j])
        g[5][j] = (gv * r[ctx[rows, j]]).sum(axis=0)
    return [x - L.RATE * d / np.sqrt(1 + d * d) for x, d in zip(p, (d / n * 20 for d in g), strict=True)]


@pytest.mark.parametrize("sizes", [[400], [0, 1, 2, 0, 5, 6, 7, 100, 3, 30], [1], [0], [3], [0] * 40])
def test_step_by_definition(sizes):
    v = model()
    y, slot, ctx = tokens(v, sizes)
    for lo in (0, len(y) // 3):  # a batch may begin in a text
        t = L.Trainer(L.initial(v), v, 0)
        t.p.c[:] = np.random.default_rng(2).normal(1, 0.3, t.p.c.shape)
        t.rng = np.random.default_rng(7)
        wanted = by_definition(t, y[lo:], slot[lo:], ctx[lo:])
        t._step(y[lo:], slot[lo:], ctx[lo:])
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-5) for a, b in zip(t.p.parts(), wanted, strict=True))


def test_contexts_are_added_up_once_a_token(monkeypatch):
    """Gradients of context vectors: a row a token and a few near the starts of texts, not a row for each of its contexts."""
    v, added, plain = model(), [], L._scatter
    monkeypatch.setattr(L, "_scatter", lambda ids, *rest: added.append(len(ids)) or plain(ids, *rest))
    y, slot, ctx = tokens(v, [300] * 10)
    L.Trainer(L.initial(v), v, 0)._step(y, slot, ctx)
    assert len(added) == 3 and added[-1] < 1.2 * len(y)


@pytest.mark.parametrize("words", [1, 2, 16, 1000])
def test_lookups_are_searches(words):
    rng = np.random.default_rng(words)
    ids = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, words), rng.integers(5, 5 + words, words // 2)]))  # some of one bucket
    v = L.Vocabulary(ids, np.ones(len(ids), int), np.arange(len(ids)), 1, np.ones(len(ids), int), np.zeros(L.GROUPS, int), np.zeros(L.GROUPS, int), 0, 0, 0)
    asked = np.concatenate([ids, ids + 1, ids - 1, [-(2**63), 2**63 - 1, 0, -1], rng.integers(-(2**63), 2**63 - 1, 500)])
    place = {x: i for i, x in enumerate(ids.tolist())}
    slots, at = L.slots_of(v, asked)
    assert at.tolist() == slots.tolist() == [place.get(x, -1) for x in asked.tolist()]
    m = model()
    t, draws = L.Trainer(L.initial(m), m, 3), np.random.default_rng(3)
    cluster = rng.integers(0, m.clusters, 5000)
    u = t.cum_inner[cluster * m.width][:, None] + draws.random((5000, L.INNER))
    wanted = np.clip(np.searchsorted(t.cum_inner, u, side="right") - 1, (cluster * m.width)[:, None], (cluster * m.width + m.width - 1)[:, None])
    assert (t._others(cluster) == wanted).all()
