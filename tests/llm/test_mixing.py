"""Weighted fair queueing against a plain queue."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from cutline.llm.mixing import mix


def size(text):
    return len((text or "").encode().split())


def plain(rows, epochs=3, share=1.0):
    """Targets source by source, then one queue over all passes."""
    rows = [(d, t, s, size(t), hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()) for d, t, s in rows]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += r[3]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    budget = int(sum(sizes.values()) * share)
    target, left, open_ = {}, float(budget), set(order)
    while open_:
        t = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * t > epochs * sizes[s]}
        for s in full or open_:
            target[s] = float(epochs * sizes[s]) if full else weight[s] * t
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    queue = []
    for s in order:
        upto = 0
        for n, r in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (r[4], r[3]))):
            upto += r[3]
            queue += [((upto + sizes[s] * e) / weight[s], order.index(s), r[4], r[3], n, r[:4]) for e in range(epochs) if r[3]]
    repeats, words = Counter(), 0
    for entry in sorted(queue, key=lambda q: q[:5]):
        words += entry[3]
        if words <= budget:
            repeats[entry[1], entry[4], entry[5]] += 1
    out = []
    for s in order:
        for n, r in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (r[4], r[3]))):
            k = repeats[order.index(s), n, r[:4]]
            out.append((r[0], s, r[3], sizes[s], round(target[s], 6), k, k * r[3]))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.repeats, r.taken) for r in mix(df, **kw).collect()), key=str)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["a", "b", "c", "d", None, "é", "a"])) for i in range(n)]
    rows += [(None, "one two three", "a"), (None, None, None), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (8, "other text of it", "b"), (900, " \t\n", "blank"), (901, None, "null")]
    return rows


@pytest.mark.parametrize("seed,share,bucket_rows", [(1, 1.0, 4096), (2, 0.3, 10), (3, 2.5, 25), (4, 0.0, 10)])
def test_mix_equals_a_plain_queue(spark, seed, share, bucket_rows):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, source string, size int, h string, weight double").repartition(3)
    assert got(df, share=share, bucket_rows=bucket_rows) == plain(rows, share=share)


def test_reruns_and_partitions_agree(spark):
    rows = corpus(5)
    a, b = (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n) for n in (1, 4))
    assert got(a, bucket_rows=10) == got(b, bucket_rows=10)


def test_one_hot_source_a_long_text_and_an_empty_table(spark):
    rows = [(i, "a b c", "hot") for i in range(400)] + [(1000, "word " * 50_000, "long"), (1001, "x", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = got(df, bucket_rows=20)
    assert out == plain(rows) and max(r[5] for r in out) <= 3
    assert got(df.where("false")) == []
    assert got(df.withColumn("text", df.source.substr(100, 1))) == sorted(((d, s, 0, 0, 0.0, 0, 0) for d, _, s in rows), key=str)
