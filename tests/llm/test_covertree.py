"""Embedding links against brute force."""

import numpy as np
import pytest

import cutline.llm.covertree as C

INF, NAN = float("inf"), float("nan")


def brute(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = [0] * len(good)
    label = list(range(len(good)))
    for p in range(len(good)):
        for q in range(p):
            x, y = good[p][1], good[q][1]
            if len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    n[p] += 1
                    n[q] += 1
                    a, b = label[p], label[q]
                    label = [min(a, b) if z in (a, b) else z for z in label]
    least = {}
    for k, (i, _) in enumerate(good):
        least[label[k]] = min(least.get(label[k], i), i)
    return {(i, n[k], least[label[k]]) for k, (i, _) in enumerate(good)}


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    spread = np.array([0, .02, .05, .1, .15, .2, .3, 1])[rng.integers(0, 8, n)]
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, d)) * spread[:, None]
    return (x * rng.choice([1, 3], n)[:, None]).astype(np.float32)


@pytest.mark.parametrize("seed,n,d", [(0, 900, 6), (1, 500, 64), (2, 300, 2), (3, 2, 3)])
def test_dual_traversal_equals_brute_force(seed, n, d):
    x = C.unit(vectors(seed, n, d))
    w = np.random.default_rng(seed).integers(1, 4, n)
    tree = C.Tree.build(x, 16)
    assert sorted(tree.order.tolist()) == list(range(n))
    for k, kids in enumerate(tree.children):
        own = x[tree.order[tree.start[k]:tree.end[k]]]
        assert C.distance(own @ tree.centre[k]).max() <= tree.radius[k] + 1e-12
        assert not kids or (tree.start[kids[0]], tree.end[kids[-1]]) == (tree.start[k], tree.end[k])
    xo, wo = x[tree.order], w[tree.order]
    near = xo @ xo.T >= .95
    np.fill_diagonal(near, False)
    count, _, label = C.links(tree, xo, wo, tree, xo, wo, True, .95)
    assert (count == near @ wo).all() and (label[np.nonzero(near)[0]] == label[np.nonzero(near)[1]]).all()
    half = n // 2
    ta, tb = C.Tree.build(x[:half], 16), C.Tree.build(x[half:], 16)
    xa, xb, wa, wb = x[:half][ta.order], x[half:][tb.order], w[:half][ta.order], w[half:][tb.order]
    ca, cb, label = C.links(ta, xa, wa, tb, xb, wb, False, .95)
    near = xa @ xb.T >= .95
    assert (ca == near @ wb).all() and (cb == near.T @ wa).all()


@pytest.mark.parametrize("block,n", [(4096, 400), (40, 400)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, n):
    monkeypatch.setattr(C, "BLOCK", block)
    x = vectors(block, n, 5)
    rows = [(k, r.tolist()) for k, r in enumerate(x)] + [(1000 + k, x[7].tolist()) for k in range(30)] + [(2000, x[7].tolist())] * 2
    tight = np.random.default_rng(1).normal(size=5)
    rows += [(3000 + k, (tight + np.random.default_rng(k).normal(size=5) * .01).tolist()) for k in range(200)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 5), (9003, [1.0, None, 0, 0, 0]), (9004, [NAN, 1, 1, 1, 1]), (9005, [INF, 1, 1, 1, 1]), (9006, [1.0, 1.0]), (9007, [1e-30, 1e-30]), (None, x[7].tolist())]
    rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows + odd]
    got = C.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, kept int")).collect()
    assert len(got) == len(rows)
    want = brute(rows, .95) | {(i, 0, i) for i in range(9000, 9006)}
    assert {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(None, None, None)]


def test_tables_without_vectors(spark):
    docs = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in C.near_vectors(docs).collect()} == {(1, 0, 1, True), (None, None, None, None)}
    assert C.near_vectors(docs.where("false")).count() == 0
