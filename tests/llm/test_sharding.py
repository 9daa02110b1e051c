"""Best-fit-decreasing sharding: the tree against a plain list, and the laws of the result."""

import random
import zlib
from collections import defaultdict

import pytest

from cutline.llm.sharding import CapacityTree, best_fit, shard


def test_tree_equals_a_sorted_list():
    rnd, tree, plain = random.Random(2), CapacityTree(), []
    for step in range(3000):
        if plain and rnd.random() < .48:
            size = rnd.randrange(0, 60)
            want = min((k for k in plain if k[0] >= size), default=None) if rnd.random() < .8 else max(plain)
            got = tree.take_tightest(size) if want != max(plain) or (want and want[0] >= size and want == min(k for k in plain if k[0] >= size)) else tree.take_widest()
            assert got == want
            if want:
                plain.remove(want)
        else:
            key = (rnd.randrange(0, 60), step)
            plain.append(key)
            tree.add(*key)
    if plain:
        assert tree._root.height <= 1.45 * len(plain).bit_length() + 1


def naive_best_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(bins) if room >= sizes[i] and room > 0]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] -= sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_naive(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(1, 130) for _ in range(400)]
    assert best_fit(sizes, 100) == naive_best_fit(sizes, 100)


def check(rows, source, shards):
    by, text_of = defaultdict(list), defaultdict(set)
    assert len(rows) == len(source)
    for r in rows:
        by[r.shard].append(r)
    for s, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own))) and 0 <= s < shards
    texts = {d: t for d, t in source}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        text_of[data].add(r.shard)
    assert all(len(s) == 1 for s in text_of.values())
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_equal_bytes_and_groups_together(spark):
    rnd = random.Random(5)
    texts = ["é" * rnd.randrange(1, 90) + str(i) for i in range(700)]
    source = [(i, rnd.choice(texts) if i % 3 else texts[i % 700]) for i in range(2000)] + [(5000, None), (5001, "")]
    rows = shard(spark.createDataFrame([(*r, 1) for r in source], "doc_id long, text string, size int"), 8).collect()
    loads = check(rows, source, 8)
    assert max(loads) - min(loads) <= 200


def test_a_group_above_the_fair_share_has_its_own_shard(spark):
    source = [(i, "copy " * 40) for i in range(300)] + [(1000 + i, "t%d" % i * 5) for i in range(900)]
    loads = check(shard(spark.createDataFrame(source, "doc_id long, text string"), 4).collect(), source, 4)
    assert max(loads) == 300 * 201 and max(sorted(loads)[:3]) - min(loads) <= 120


def test_capacity_and_empty_table(spark):
    source = [(i, "x" * (i % 50 + 20)) for i in range(400)]
    docs = spark.createDataFrame([(i, t + str(i)) for i, t in source], "doc_id long, text string")
    by = defaultdict(int)
    for r in shard(docs, None, capacity=5000).collect():
        by[r.shard] += r.size
    assert max(by.values()) <= 5000 and len(by) <= -(-sum(by.values()) // 5000) + 1
    assert shard(docs.where("false")).count() == 0
