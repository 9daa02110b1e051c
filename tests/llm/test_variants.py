"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

import cutline.llm.variants as V


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(docs, min_length, drop):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop and h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                counts[run] += 1
    return counts


def brute(counts, min_count, factor):
    counts = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus():
    rnd = random.Random(3)
    letters = "abéÿ×"
    docs = []
    for d in range(60):
        text = []
        for _ in range(500):
            word = "".join(rnd.choice(letters[:rnd.choice([2, 3, 5])]) for _ in range(rnd.choice([3, 5, 6, 6, 7, 8])))
            text.append(word.upper().replace("É", "é") if rnd.random() < .1 and "ÿ" not in word else word)
        docs.append((d, rnd.choice([" ", "-", "3"]).join(text)))
    return docs + [(70, None), (71, ""), (None, "abababab " * 40), (5, docs[5][1]), (5, docs[5][1]), (80, "abababa " * 7 + "ababab " * 300 + "abababb" * 9)]


@pytest.mark.parametrize("block,drop", [(1 << 15, 7), (25, 7), (40, None)])
def test_groups_equal_brute_force(spark, monkeypatch, block, drop):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "HELD", 300)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    want = brute(brute_counts(docs, 6, drop), 5, 5)
    assert rows(V.variant_groups(df, drop_every=drop)) == want
    assert len(want) > 100 and sum(w[4] for w in want) > 200 and any(w[1] for w in want)


def test_chains_of_forms(spark):
    counts = [("abcdef", 6), ("abcdeff", 30), ("abcdefff", 150), ("abcdeffff", 750), ("abcdefffff", 749), ("zzzzzz", 5)]
    docs = [(i, f"{w} " * n) for i, (w, n) in enumerate(counts)]
    got = rows(V.variant_groups(spark.createDataFrame(docs, "doc_id int, text string")))
    assert got == brute(Counter(dict(counts)), 5, 5)
    assert got[0][2] == "abcdeffff"


def test_an_empty_table_and_one_word(spark):
    docs = spark.createDataFrame([(1, "single " * 5)], "doc_id long, text string")
    assert V.variant_groups(docs.where("false")).count() == 0
    assert rows(V.variant_groups(docs)) == [("single", None, "single", 5, 0, None)]


@pytest.mark.parametrize("left", [True, False])
def test_search_equals_brute_force(left):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abcÀÿ") for _ in range(rnd.randrange(6, 11))) for _ in range(900)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "a" * 300, "a" * 301})
    half = lambda w: (w[:len(w) // 2], w[len(w) // 2:])
    same = (lambda q, w: w.startswith(half(q)[0]) and one_edit(half(q)[1], w[len(q) // 2:])) if left else (
        lambda q, w: w.endswith(half(q)[1]) and one_edit(half(q)[0], w[:len(w) - len(half(q)[1])]))
    got = {(words[q], words[w]) for q, w in zip(*(x.tolist() for x in V.VocabularyIndex(words).near(words, left)))}
    assert got == {(q, w) for q in words for w in words if same(q, w)}


def test_suffixes_are_in_order():
    rnd = random.Random(2)
    text = V.np.array([rnd.randrange(1, 4) for _ in range(700)] + [2] * 50 + [0])
    assert V.suffix_order(text).tolist() == sorted(range(text.size), key=lambda i: text[i:].tolist())


def test_a_very_long_text(spark):
    text = " ".join(f"{'abcdefgh'[i % 8]}lmnopq" for i in range(100_000)) + " " + "x" * 500
    got = rows(V.variant_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [(r[3], r[4]) for r in got] == [(12_500, 7)] * 8
