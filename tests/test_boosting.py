"""Keyed boosting: losses fall, missing values choose a side, units at once equal units alone, states come back."""

import json

import numpy as np
import pytest

from cutline.plans.boosting import Boosted

P = {"maxIter": 12, "maxDepth": 3, "minInstancesPerNode": 10, "stepSize": 0.2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 900
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = np.where(a > 0.3, 2.0, -1.0) + 0.3 * b
    a = np.where(rng.random(n) < 0.2, np.nan, a)
    y = np.where(np.isnan(a), 5.0, y)
    none = lambda v: None if np.isnan(v) else float(v)
    data = [(int(u), float(v), none(x), float(z), None, i, int(np.digitize(v, [-1, 0, 2, 4]))) for i, (u, v, x, z) in enumerate(zip(rng.integers(0, 3, n), y, a, b))]
    return spark.createDataFrame(data, "unit int, y double, a double, b double, empty double, i int, grade int").repartition(3).cache()


FEATURES = ["a", "b", "empty"]


def test_absolute_loss_falls_and_missing_values_are_not_imputed(rows):
    m = Boosted(FEATURES, "absolute", **P).fit(rows.withColumn("unit", rows.unit * 0))
    curve = [c[0] for c in m.curve]
    assert len(curve) == 13 and all(x >= y - 1e-3 for x, y in zip(curve, curve[1:])) and curve[-1] < 0.35 * curve[0]
    s = m.transform(rows, "s").toPandas()
    assert s[s.a.isna()].s.str[0].mean() > 4 > 2.5 > s[s.a > 0.3].s.str[0].mean() > 1.5
    assert not any((t.feature == 2).any() for t in m.rounds)


@pytest.mark.parametrize("loss,classes,label", [("softmax", 5, "grade"), ("logistic", 1, "up")])
def test_probabilities_sum_to_one_and_the_loss_falls(rows, loss, classes, label):
    x = rows.withColumn("up", (rows.y > 0).cast("int"))
    m = Boosted(FEATURES, loss, classes, **P).fit(x.withColumn("y", x[label]).withColumn("unit", rows.unit * 0))
    curve = [c[0] for c in m.curve]
    assert all(x > y for x, y in zip(curve, curve[1:]))
    p = np.array(m.transform(x, "p").toPandas().p.tolist())
    assert p.shape[1] == max(2, classes) and np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_units_at_once_equal_units_alone(rows):
    allowed = np.array([[1, 1, 1], [0, 1, 1], [1, 0, 1]], bool)
    both = Boosted(FEATURES, "absolute", **P).fit(rows, 3, allowed)
    got = both.transform(rows, "s", "unit").toPandas().set_index("i").s.str[0]
    for u in range(3):
        own = rows.where(rows.unit == u)
        one = Boosted(FEATURES, "absolute", **P).fit(own.withColumn("unit", own.unit * 0), 1, allowed[u:u + 1], both.edges)
        want = one.transform(own, "s").toPandas().set_index("i").s.str[0]
        assert np.allclose(got[want.index], want, atol=1e-2)
    assert not any((t.feature[1] == 0).any() for t in both.rounds)


def test_first_split_equals_brute_force(rows):
    m = Boosted(FEATURES, "logistic", **{**P, "maxIter": 1, "maxDepth": 1}).fit(rows.withColumn("y", (rows.y > 0).cast("int")).withColumn("unit", rows.unit * 0))
    pdf = rows.toPandas()
    y, p = (pdf.y > 0).to_numpy(float), 1 / (1 + np.exp(-m.base[0, 0]))
    g, h, best = p - y, p * (1 - p), (-1, None)
    for f, c in enumerate(FEATURES):
        v = pdf[c].to_numpy(float)
        for k, e in enumerate(m.edges[f]):
            for missing_left in (True, False):
                left = np.where(np.isnan(v), missing_left, v < e)
                if min(left.sum(), (~left).sum()) >= 10:
                    best = max(best, (round(g[left].sum() ** 2 / (h * left.sum()) + g[~left].sum() ** 2 / (h * (~left).sum()), 6), (f, k + 1, missing_left)))
    t = m.rounds[0]
    f, cut, side = best[1]
    assert (t.feature[0, 0, 0], t.cut[0, 0, 0]) == (f, cut) and t.missing_left[0, 0, 0] == side


def test_state_comes_back_and_empty_tables_fit(rows, spark):
    m = Boosted(FEATURES, "absolute", **P).fit(rows.withColumn("unit", rows.unit * 0))
    again = Boosted.from_state(json.loads(json.dumps(m.state())))
    x = rows.toPandas()
    v = x[FEATURES].to_numpy(float)
    assert np.array_equal(m.scores(v, np.zeros(len(x), int)), again.scores(v, np.zeros(len(x), int)))
    empty = Boosted(FEATURES, "absolute", **P).fit(rows.where("false"))
    assert not empty.rounds and empty.transform(rows.limit(2), "s").count() == 2


def test_only_splits_and_leaf_values_reach_the_driver(rows, monkeypatch):
    import pickle
    from pyspark import RDD
    sizes, collect = [], RDD.collect

    def weighed(rdd):
        out = collect(rdd)
        sizes.append(len(pickle.dumps(out)))
        return out
    monkeypatch.setattr(RDD, "collect", weighed)
    m = Boosted(FEATURES, "absolute", **{**P, "maxIter": 1}).fit(rows, 3)
    assert len(m.rounds) == 1 and max(sizes) < 20_000


def test_a_model_without_rows_never_rises(rows):
    m = Boosted(FEATURES, "logistic", **{**P, "maxIter": 1}).fit(rows.where("false"))
    assert m.falls(0)
    assert m.transform(rows.limit(2), "p").first()["p"] == [0.5, 0.5]


def test_a_loss_that_rises_is_a_plain_false():
    """A table of booleans takes no numpy value."""
    from cutline.plans.boosting import Boosted
    model = Boosted(["x"], "absolute")
    model.curve = [np.array([1.0, 2.0]), np.array([1.5, 1.0])]
    assert model.falls(0) is False and model.falls(1) is True
