"""Benchmark windows in documents against brute force."""

import random
import re

import pytest

import cutline.llm.contamination as C

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    owners = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for p in range(len(own) - size + 1 if own else 0):
            owners.setdefault(tuple(own[p:p + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in owners}:
            for p in range(len(own) - size + 1):
                if tuple(own[p:p + size]) in owners:
                    hit.update(range(p, p + size))
                    found |= owners[tuple(own[p:p + size])]
        out.append((doc, len(own), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def tables(seed, window):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ab", "cd", "é", "7"]) + rnd.choice(["", "x", "ÿ", "Q2"])
    run = lambda n: [word() for _ in range(n)]
    items = [(i, rnd.choice([" ", "-", ". "]).join(run(rnd.choice([1, 2, 3, 4, window - 1, window, 2 * window, 40]) + (i % 3)))) for i in range(12, 40)]
    items = [x for x in items if len(words(x[1])) > 2] + [(50, None), (51, " .!"), (None, " ".join(run(15))), (12, items[0][1]), (12, items[1][1]), (60, items[0][1])]
    docs = []
    for d in range(50):
        own = run(rnd.randrange(0, 40))
        for _ in range(rnd.randrange(0, 4)):
            own += words(rnd.choice(items)[1])[rnd.randrange(0, 2):] + run(rnd.randrange(0, 12))
        docs.append((d, rnd.choice([" ", "\n", "_"]).join(own).upper() if d % 4 == 0 else " ".join(own)))
    return docs + [(70, None), (71, ""), (None, items[0][1]), (3, docs[3][1]), (3, "other " + items[1][1])], items


@pytest.mark.parametrize("window,size", [(10, 1 << 16), (6, 50)])
def test_hits_equal_brute_force(spark, monkeypatch, window, size):
    docs, items = tables(window, window)
    monkeypatch.setattr(C.grouped, "__defaults__", (size,))
    got = C.contamination(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, item string").repartition(3),
                          spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string"), window).collect()
    want = brute(docs, items, window)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == want
    assert all(sum(s.e - s.b for s in r.spans) == r.n_hit and r.contaminated == (r.n_hit > 0) for r in got)
    assert sum(r[2] > 0 for r in want) > 20 and any(r[2] == 0 < r[1] for r in want)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert C.contamination(docs.where("false"), items).count() == 0
    row = C.contamination(docs, items.where("false")).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
    assert C.contamination(docs, items).first().spans == [(1, 2)]


def test_a_very_long_text_and_one_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    long = " ".join(f"x{i % 977}" for i in range(200_000)) + " " + passage
    docs = spark.createDataFrame([(1, long)] + [(i, passage) for i in range(2, 300)], "doc_id long, text string")
    got = {r.doc_id: r for r in C.contamination(docs, spark.createDataFrame([("q", passage)], "item_id string, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].spans) == (200_025, 25, [(200_000, 200_025)])
    assert len(got) == 299 and all(r.n_hit == 25 and r["items"] == ["q"] for r in got.values())
