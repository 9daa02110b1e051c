"""The n-gram trie against dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import cutline.llm.ngrams as G


def brute(train, texts, order):
    tokens = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()]
    seqs = [["$"] + tokens(t) + ["$"] for t in train]
    one = Counter(w for s in seqs for w in s[1:])
    total, words = sum(one.values()), len(one)
    grams, types = {}, {}
    for n in range(2, order + 1):
        grams[n] = Counter(tuple(s[i - n + 1:i + 1]) for s in seqs for i in range(n - 1, len(s)))
        types[n] = Counter(g[:-1] for g in grams[n])
    seen = lambda g: one[g[0]] if len(g) == 1 else grams[len(g)][g]

    def p(context, w):
        if not context:
            return (one[w] + 1) / (total + words + 1)
        lower = p(context[1:], w)
        n = len(context) + 1
        if not types[n][context]:
            return lower
        c = seen(context)
        return max(grams[n][context + (w,)] - .75, 0) / c + .75 * types[n][context] / c * lower

    out = []
    for t in texts:
        s = ["$"] + tokens(t) + ["$"]
        out.append((len(s) - 1, sum(one[w] > 0 for w in s[1:]), total, sum(math.log10(p((), w)) for w in s[1:]),
                    sum(math.log10(p(tuple(s[max(0, i - order + 1):i]), s[i])) for i in range(1, len(s)))))
    return out


@pytest.mark.parametrize("order,shard", [(2, 1 << 22), (3, 64), (2, 32), (1, 16)])
def test_scores_equal_dictionaries(spark, order, shard):
    rnd = random.Random(order)
    word = lambda: rnd.choice(["The", "cat", "é", "Sat", "on", "mat"] + ["w%d" % i for i in range(30)])
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 40))) for _ in range(80)] + [None, "", "never seen words", "the THE\tthe\n the", "the " * 500]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    trie = G.train(docs.where("doc_id % 3 <> 1"), order, shard)
    got = {r.doc_id: r for r in G.score(docs, trie).collect()}
    want = brute([t for i, t, _ in rows if i % 3 != 1], texts, order)
    for i, (n, known, total, base, full) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, full, abs_tol=2e-3 * n)


def test_frequent_contexts_are_split():
    rule = G.ShardRule(1000, 10 * G.SHARD_TOKENS, 500)
    context = np.repeat(np.arange(1000), 3)
    word = np.tile([0, 250, 499], 1000)
    count = np.where(context == 7, 5 * G.SHARD_TOKENS, 1)
    names = defaultdict(set)
    covered = []
    for name, at in rule.split(context, word, count):
        names[name] |= set(context[at].tolist())
        covered += at.tolist()
    assert sorted(covered) == list(range(3000)) and len([n for n, c in names.items() if c == {7}]) == 3
    assert len([n for n in names if n.startswith("_")]) == 10


def test_packing_round_trip_and_pairs():
    rng = np.random.default_rng(0)
    for top in (0, 1, 255, 256, 70000, 2**40):
        a = rng.integers(0, top + 1, 1000)
        assert (G._unpack(G._pack(a)) == a).all()
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 500)
    want = Counter(zip(a.tolist(), b.tolist()))
    for shift in (0, 2**60):
        x, y, n = G.summed_pairs(a + shift, b + shift)
        assert dict(zip(zip((x - shift).tolist(), (y - shift).tolist()), n.tolist())) == want


def test_empty_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = G.train(docs.where("false"))
    assert [r.score for r in G.score(docs, none).collect()] == [0, 0, 0]
    assert G.score(docs.where("false"), G.train(docs)).count() == 0
