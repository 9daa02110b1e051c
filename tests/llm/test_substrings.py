"""Substring removal against brute force."""

import random
import tracemalloc

import pytest

import cutline.llm.substrings as S


def brute(rows, window):
    seen = {}
    tokens = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in tokens:
        if d is None:
            continue
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            seen[key] = min(seen.get(key, d), d)
    out = []
    for d, words in tokens:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and seen[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed, window):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["é", "x", "yz", ""]) + str(rnd.randrange(30))
    passages = [[word() for _ in range(rnd.randrange(window, 3 * window))] for _ in range(4)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += [word() for _ in range(rnd.randrange(0, 60))]
            if rnd.random() < .6:
                words += rnd.choice(passages)
        rows.append((d * 3 % 61, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, None), (501, ""), (502, "ha " * 700), (503, "ha " * 900), (504, " ".join(passages[0])), (504, " ".join(passages[0])),
             (505, " ".join(passages[0])), (505, "other " * 60), (None, " ".join(passages[1]))]
    return rows


@pytest.mark.parametrize("window,hot", [(50, 4096), (50, 3), (5, 2), (50, 60), (5, 40)])
def test_removal_equals_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(window + hot, window)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, tid int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(docs, window).collect()]
    assert sorted(got, key=str) == brute(rows, window)


@pytest.mark.parametrize("size", [1, 3000])
def test_small_slices_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(S, "TEXT_BYTES", size)
    monkeypatch.setattr(S, "SORT_BYTES", size)
    rows = corpus(8, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(docs).collect()), key=str) == brute(rows, 50)


def test_the_text_stays_where_nothing_is_removed(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "tail  \n" + passage + "  x"), (3, " a  b\n"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.n_removed) for r in S.cut_repeats(docs).collect()} == {1: (passage, 0), 2: ("tail x", 60), 3: (" a  b\n", 0), 4: (None, 0)}


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x"] * 1000 + words[70_000:70_500]))], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in S.remove_repeats(docs).collect()} == {1: (150_000, 0), 2: (1500, 500)}


def test_equal_windows_have_equal_ranks():
    rnd = random.Random(4)
    words = [rnd.choice([b"a", b"bb", b"\xc3\xa9"]) for _ in range(500)]
    for window in (1, 2, 5, 50):
        _, ranks = S.window_ranks(b"".join(w + b" " for w in words), window)
        keys = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
        assert len(ranks) == len(keys) and len(set(zip(ranks.tolist(), keys))) == len(set(keys)) == len(set(ranks.tolist()))


def test_memory_of_a_million_windows():
    rnd = random.Random(6)
    words = [f"word{rnd.randrange(5000)}".encode() for _ in range(561)]
    packed = [b" ".join(words[k % 7:]) + b" x" * (k % 7) for k in range(2000)]
    table = S.pa.table({"doc_id": S.pa.array(range(2000), S.pa.int64()), "tid": S.pa.array(range(2000), S.pa.int64()), "start": S.pa.array([0] * 2000, S.pa.int32()), "packed": packed})
    S._repeats(table.slice(0, 10), 50)
    tracemalloc.start()
    before = S.pa.total_allocated_bytes()
    found = S._repeats(table, 50)
    peak = tracemalloc.get_traced_memory()[1] + S.pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert found.num_rows > 1900 and peak < 110 * 2000 * 512, peak / 2000 / 512


def test_carried_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "k")], "doc_id long, text string, n_words string")
    assert S.remove_repeats(docs.where("false")).count() == 0
    out = S.remove_repeats(docs.withColumnRenamed("n_words", "source"), carry=("source",)).first()
    assert (out.kept, out.source, out.n_removed) == ("a b", "k", 0)


def test_minimisers_follow_the_words_not_the_place():
    rnd = random.Random(1)
    words = [str(rnd.randrange(10**6)).encode() for _ in range(400)]
    for cut in (0, 1, 57):
        own = words[cut:]
        values = S.minimisers(b" ".join(own), *S.offsets(own), 50, 8)
        if not cut:
            whole = values
            runs = list(S.runs(values))
            assert 8 < len(runs) < 40 and runs[0][0] == 0 and runs[-1][1] == len(values) == 351
        assert (whole[cut:] == values).all() and len(set(values.tolist())) > 5


def test_copies_of_a_run_are_one_run(spark, monkeypatch):
    """Near copies of one text share runs: windows are looked at one by one only in the first document of equal runs."""
    monkeypatch.setattr(S, "HOT", 500)
    base = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(base[:150] + [f"own{d}"] + base[150:])) for d in range(80)]
    counts, written = {}, S.written

    def counted(df, name):
        out = written(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(S, "written", counted)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute(rows, 50)
    assert counts["strings"] < 80 * 40 and counts["windows"] < 80 * 100, counts  # 252 windows a document
