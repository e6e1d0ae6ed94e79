"""The weak-label model and the stretches of a token by brute force."""

import math
import random

import numpy as np
import pytest

from framelake.llm import quality_classifier as qc
from framelake.llm import secret_scan as ss


def plain_em(votes):
    """Expectation-maximisation over single documents; votes: -1 bad, 0 none, 1 good, per labeller."""
    k = len(votes[0])
    balance = [sum(v == 1 for v in d) - 4 * sum(v == -1 for v in d) for d in votes]
    post = [1 / (1 + math.exp(-max(-20, min(20, b)))) for b in balance]
    for _ in range(qc.EM_ROUNDS):
        good = (sum(post) + 1) / (len(votes) + 2)
        right = []
        for j in range(k):
            row = []
            for label, weights in ((-1, [1 - p for p in post]), (1, post)):
                hit = sum(w for d, w in zip(votes, weights) if d[j] == label)
                miss = sum(w for d, w in zip(votes, weights) if d[j] == -label)
                row.append((hit + 1) / (hit + miss + 2))
            right.append(row)
        new = []
        for d in votes:
            p, q = good, 1 - good
            for j, v in enumerate(d):
                if v == 1:
                    p, q = p * right[j][1], q * (1 - right[j][0])
                elif v == -1:
                    p, q = p * (1 - right[j][1]), q * right[j][0]
            new.append(p / (p + q))
        post = new
    return post, right


def test_labellers_by_brute_force():
    rnd = random.Random(6)
    n = len(qc.LABELLERS)
    truth = [rnd.random() < 0.7 for _ in range(400)]
    skill = [0.55 + 0.05 * j for j in range(n)]
    votes = [[0 if rnd.random() < 0.3 else (1 if t == (rnd.random() < s) else -1) for s in skill] for t in truth]
    codes = [sum((v + 1) * 3 ** (n - 1 - j) for j, v in enumerate(d)) for d in votes]
    patterns = {c: codes.count(c) for c in codes}
    got, report = qc.fit_labellers(patterns)
    want, right = plain_em(votes)
    assert [got[c] for c in codes] == pytest.approx(want, abs=1e-6)
    assert [(r["accuracy_bad"], r["accuracy_good"]) for r in report] == [tuple(pytest.approx(x, abs=1e-6) for x in row) for row in right]
    assert sum((p > 0.5) == t for p, t in zip(want, truth)) > 0.8 * len(truth)


def test_scorer_separates_and_weighs_classes():
    rnd = np.random.default_rng(2)
    x = np.zeros((300, qc.DIMENSIONS), np.float32)
    x[:, :5] = rnd.normal(size=(300, 5))
    target = 1 / (1 + np.exp(-4 * (x[:, 0] - 0.5 * x[:, 1] + 1.5)))  # most are good
    w = qc.fit_scorer(x, target, rounds=400)

    def loss(v):
        v = v.astype(float)
        p = 1 / (1 + np.exp(-np.clip(x.astype(float) @ v[:-1] + v[-1], -30, 30)))
        share = target.mean()
        c = target / (2 * share) + (1 - target) / (2 * (1 - share))
        return -(c * (target * np.log(p) + (1 - target) * np.log(1 - p))).mean() + 1e-4 / 2 * (v ** 2).sum()

    assert loss(w) < loss(np.zeros_like(w)) - 0.1
    for k in (0, 1, 2, qc.DIMENSIONS):  # no single weight is better elsewhere
        for step in (-0.3, 0.3):
            moved = w.astype(float).copy()
            moved[k] += step
            assert loss(moved) > loss(w.astype(float)) - 1e-3


def plain_stretches(code, model):
    def ratio(a, b):
        chain = [ss.EDGE, *code[a:b], ss.EDGE]
        return sum(model[x * ss.SIZE + y] for x, y in zip(chain, chain[1:]))

    def good(a, b):
        return ratio(a, b) >= max(ss.MIN_NATS, ss.MIN_RATIO * (b - a))

    def parts(lo, hi):
        out, k = [], 0
        while k < len(code):
            if ss._CUT[code[k]]:
                k += 1
                continue
            e = k
            while e < len(code) and not ss._CUT[code[e]]:
                e += 1
            if k >= lo and e <= hi:
                out.append((k, e))
            k = e
        return out

    def search(lo, hi):
        if lo >= hi:
            return []
        if good(lo, hi):
            return [(lo, hi)]
        ps = parts(lo, hi)
        if not ps:
            return []
        _, a, b = max((ratio(ps[i][0], ps[j][1]) - ss.MIN_RATIO * (ps[j][1] - ps[i][0]), ps[i][0], ps[j][1]) for i in range(len(ps)) for j in range(i, len(ps)))
        return [(a, b), *search(lo, a), *search(b, hi)] if good(a, b) else [p for p in ps if good(*p)]

    return sorted(search(0, len(code)))


def test_stretches_by_brute_force():
    rnd = np.random.default_rng(9)
    cuts = np.flatnonzero(ss._CUT)
    found = 0
    for _ in range(600):
        model = rnd.normal(1.2, 2.5, ss.SIZE * ss.SIZE)
        n = int(rnd.integers(1, 90))
        code = rnd.integers(0, ss.SIZE - 2, n)
        code[rnd.random(n) < 0.12] = rnd.choice(cuts)
        got = sorted(ss._stretches(code, model))
        assert got == plain_stretches(code.tolist(), model)
        found += len(got)
    assert found > 50
