"""Toxicity: features on known texts, held-out quality, odd rows."""

import zlib

import numpy as np

import cutline.llm.toxicity as T

SF = "/root/testdata/sf0.1"


def named(text, lexicon=None):
    return dict(zip(T.NAMES, T.features(text, lexicon or {"idiot": 3.0, "scum": 2.0}), strict=True))


def test_features():
    x = named("You are an IDIOT!!! Such an idiot, scum.")
    assert x["hits"] == 3 and x["distinct_hits"] == 2 and x["weight"] == 8 and x["top_weight"] == 3
    assert x["near_second"] == 1 / 3 and x["caps_words"] == 1 / 8 and x["exclaims"] > 0
    assert named("an 1d10t, an id!ot")["leet_hits"] == 1 and named("an id10t")["leet_hits"] == 1
    assert named("what an i.d.i.o.t he is")["spelled_out"] > 0
    assert named("")["words"] == 0 and len(T.features("é" * 10, {})) == len(T.NAMES)


def test_held_out_quality(spark):
    from cutline.llm.queries import QUERIES
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d].held_out for d in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= .3) for r in rows.values())
    y, s = np.array([labels[d] for d in held]), np.array([rows[d].score for d in held])
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hit = np.array([rows[d].predicted for d in held])
    print("auc", auc, "precision", (hit & y).sum() / max(hit.sum(), 1), "recall", (hit & y).sum() / y.sum())
    assert auc > .75 and (hit & y).sum() / max(hit.sum(), 1) > .6


def test_one_class_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", 2), (2, None, 2), (2, None, 3), (None, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    assert {r.score for r in T.score_toxicity(docs, model).collect()} <= {0.0, 1.0}
    assert T.score_toxicity(docs, T.fit_toxicity(docs, labels.where("false"))).where("score = 0").count() == 4
    assert T.score_toxicity(docs.where("false"), model).count() == 0


def grown(node):
    """A tree of the library's model as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), grown(node.leftChild()), grown(node.rightChild())


def walked(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_scores_equal_trees_and_curve_walked_by_hand(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = T.fit_toxicity(docs, labels)
    trees = [(w, grown(t._call_java("rootNode"))) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    edges, values = model.curve.boundaries.toArray(), model.curve.predictions.toArray()
    rows = docs.where("doc_id < 150").select("doc_id", "text").collect() + [(9001, None), (9002, ""), (9003, "you stupid idiot " * 20_000)]
    some = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, x string, score double")
    got = {r.doc_id: r.score for r in T.score_toxicity(some, model).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        x = T.features(text or "", model.lexicon)
        raw = round(1 / (1 + np.exp(-2 * sum(w * walked(t, x) for w, t in trees))) * T.BINS) / T.BINS
        want = min(max(float(np.interp(raw, edges, values)), 0.0), 1.0)
        near = [min(max(float(np.interp(raw + d / T.BINS, edges, values)), 0.0), 1.0) for d in (-1, 1)]  # a half may round either way
        assert min(abs(got[doc] - v) for v in (want, *near)) < 1e-9, doc


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    assert T.score_toxicity(docs, model).count() == 0
    assert T.score_toxicity(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), model).count() == 2
