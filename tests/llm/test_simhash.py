"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cutline.llm.simhash import fingerprint, gray_rank, link_blocks, near_duplicates


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(items, near):
    label = {k: k for k, _ in items}
    changed = True
    while changed:
        changed = False
        for a, x in items:
            for b, y in items:
                if label[b] < label[a] and near(x, y):
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "É ß\x0bx\x0cy z", "the cat sat on the mat " * 50, "x " * 40000])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("na,nb,dense", [(1, 1, True), (70, 3, True), (700, 650, False), (700, 700, True)])
def test_blocks_link_like_brute_force(na, nb, dense):
    rng = np.random.default_rng(na + nb)
    centres = rng.integers(-2**63, 2**63 - 1, 20)
    make = lambda n: np.unique(np.bitwise_xor(centres[rng.integers(0, 20, n)], np.left_shift(1, rng.integers(0, 63, n)) if dense else rng.integers(0, 2**40, n)))
    order = lambda x: x[np.argsort([_rank(int(v) & 2**64 - 1) for v in x])]
    fa, fb = order(make(na)), order(make(nb))
    for same in (True, False):
        all_ = fa if same else np.concatenate([fa, fb])
        label = link_blocks(fa, fb, same, 2)
        for i in range(len(all_)):
            d = np.bitwise_count((all_ ^ all_[i]).view(np.uint64)) <= 2
            if not same:
                d[:len(fa) if i < len(fa) else None] &= i >= len(fa)
                d[len(fa):] &= i < len(fa)
            assert (label[d] == label[i]).all() or d.sum() <= (1 if same else 0)


def _rank(v):
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> s
    return v


def test_gray_rank_orders_neighbours(spark):
    from pyspark.sql import functions as F
    codes = [(i, i ^ i >> 1) for i in range(300)]
    rows = spark.createDataFrame(codes, "i long, code long").select("i", (gray_rank(F.col("code"))).alias("r")).orderBy("r").collect()
    assert [r.i for r in rows] == list(range(300))


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rnd.randrange(40)) for _ in range(300)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" tail%d" % (i % 9) if i % 4 else ""), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "  ", None), (203, "Solo", "x"), (203, "Solo", "x"), (None, "Solo", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    items = list({r[0]: (r[0], brute_fingerprint(r[1])) for r in rows if r[0] is not None}.values())
    want = brute_components(items, lambda x, y: (x ^ y).bit_count() <= 2)
    assert {(r.doc_id, r.component_id, r.fingerprint) for r in got} == {(d, want.get(d), f"{brute_fingerprint(t):016x}") for d, t, _ in rows}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
