"""Language ID: features against plain counting, machines on known cases, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from cutline.llm.langid import LanguageModel, Tournament, family_of, features, fit_languages, groups_of, identify, train_svm

SF = "/root/testdata/sf0.01"


def test_features_see_letters_only():
    x, has = features(["Straße fährt", "straße  FÄHRT", "1234 !!", "", "a", "straße###fährt"])
    assert has.tolist() == [True, True, False, False, True, True]
    assert np.allclose(x[0], x[1]) and np.allclose(x[0], x[5]) and not x[2].any() and not x[3].any()
    alone, _ = features(["straße fährt"])
    assert np.allclose(alone[0], x[0]) and np.allclose(np.linalg.norm(x[[0, 4]], axis=1), 1)


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    sign = np.where(x[:, 0] + 2 * x[:, 1] > .3, 1.0, -1.0)
    w = train_svm(x, sign)
    assert ((x @ w[:-1] + w[-1] > 0) == (sign > 0)).mean() > .97


def test_families_and_groups():
    assert family_of("en") == family_of("de_AT") != family_of("fr") and family_of("xx") == "only xx"
    assert [s for s in groups_of(["a" * 300, None, "b"], 300)] == [(0, 1), (1, 3)]
    assert Tournament(["en"]).play(np.zeros((2, 3)))[1].tolist() == [1, 1]


def test_nothing_learned_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "", None, "y"), (2, "", None, "y"), (None, "12 !", "de", None)], "doc_id long, text string, lang string, lang_pred string")
    model = fit_languages(docs.where("false"))
    assert isinstance(model, LanguageModel)
    rows = identify(docs, model).collect()
    assert len(rows) == 4 and {r.lang_pred for r in rows} == {"und"} and {r.lang_score for r in rows} == {0.0}
    assert identify(docs.where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry
    rows = {r.doc_id: r for r in entry.queries()["op3_language_id"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert set(rows) == set(truth) and all(rows[d].held_out == (d in set(held)) for d in truth)
    assert np.mean([rows[d].lang_pred == truth[d] for d in held]) > .95
    assert all(0 <= r.score <= 1 for r in rows.values())


@pytest.mark.parametrize("text,label", [("the house is on the hill", "en"), ("das haus ist auf dem berg", "de"), ("la maison est sur la colline", "fr")])
def test_small_texts(spark, text, label):
    rows = [(i, t + " " + str(i), lang) for i in range(30) for t, lang in (("the house is on the hill and the dog", "en"), ("das haus ist auf dem berg und der hund", "de"),
                                                                             ("la maison est sur la colline et le chien", "fr"))]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict([text])[0] == [label]


FOUR, TEN = "en de fr es".split(), "en de nl sv da no is af lb fy".split()


def language_rows(names, n=60):
    """Texts over each language's own letters; some of the first language's words in all of them, as in related languages."""
    rnd, rows = random.Random(7), []
    own = {name: ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for name in names}
    common = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(30)]
    for name in names:
        for _ in range(n):
            rows.append((len(rows), " ".join(rnd.choice(own[name] if rnd.random() < .5 else common) for _ in range(60)), name))
    return rows, own, common


@pytest.mark.parametrize("names", [FOUR, TEN])
def test_clear_texts_stay_and_unclear_ones_go(spark, names):
    from pyspark.sql import functions as F

    import corpus_pipeline as P
    rows, _, _ = language_rows(names)
    rnd = random.Random(9)
    odd = [(9000 + i, " ".join("".join(rnd.choice("qrstuvwxyz") for _ in range(5)) for _ in range(60)), None) for i in range(40)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + odd, schema).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    kept = {r.doc_id for r in P.language_id(spark, docs, "").collect()}
    assert len([r for r in rows if r[0] in kept]) >= .98 * len(rows)
    assert len([r for r in odd if r[0] in kept]) <= 4


def plain_match(t, row):
    """Winner, score and smallest margin of a tournament, machine by machine."""
    if not t.pairs:
        return 0, 1.0
    wins, width, log = [0] * len(t.names), [0.0] * len(t.names), [0.0] * len(t.names)
    for (a, b), w in zip(t.pairs, t.weights):
        m = float(np.dot(row.astype(float), w[:-1].astype(float)) + w[-1])
        wins[a if m >= 0 else b] += 1
        for side, signed in ((a, m), (b, -m)):
            width[side] += signed
            log[side] -= np.log1p(np.exp(-3.0 * signed))
    best = max(range(len(t.names)), key=lambda k: (wins[k], width[k], -k))
    return best, float(np.exp(log[best]))


def test_predictions_equal_a_plain_tournament(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(docs)
    rows = docs.where("doc_id < 200").select("doc_id", "text").collect() + [(9001, None), (9002, " 12 "), (9003, "der die das und " * 30_000)]
    some = spark.createDataFrame([(*r, "en", 5.0) for r in rows], "doc_id long, text string, lang_pred string, lang_score double")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in identify(some, model).collect()}
    for doc, text in rows:
        x, has = features([text or ""])
        if not has[0]:
            assert got[doc] == ("und", 0.0)
            continue
        f, outer = plain_match(model.families, x[0])
        own = model.inside[model.families.names[f]]
        k, inner = plain_match(own, x[0])
        assert got[doc][0] == own.names[k] and abs(got[doc][1] - outer * inner) < 1e-4, doc
