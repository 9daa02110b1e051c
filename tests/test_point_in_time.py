"""The point-in-time check covers the whole feature registry."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_every_feature_column(spark):
    import __spark_entry__ as entry
    assert "E18_point_in_time_all_columns" in entry.queries()
    from cutline.fixed import FEATURE_GROUPS
    from cutline.queries import evaluation as V
    from cutline.queries.base import Market
    rows = V.point_in_time(Market(spark, SF), tuple(FEATURE_GROUPS), V.E18_ALL, V.E18_TEXT, days=1).collect()
    assert V.E18_DAYS == 8 and {r["column"] for r in rows} == {c for g in FEATURE_GROUPS.values() for c in g} | {"label"}
    assert all(r["violations"] == r["unmatched"] == r["null_mismatch"] == 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_titles_are_worked_once_for_all_sampled_days(spark, monkeypatch):
    from cutline.fixed import FEATURE_GROUPS
    from cutline.operators import textblock as T
    from cutline.queries import evaluation as V
    from cutline.queries.base import Market
    made = []
    whole = T.with_mentions
    monkeypatch.setattr(T, "with_mentions", lambda *a, **k: made.append(1) or whole(*a, **k))
    rows = V.point_in_time(Market(spark, SF), tuple(FEATURE_GROUPS), V.E18_ALL, V.E18_TEXT, days=2).collect()
    assert len(made) == 1 and all(r["violations"] == r["unmatched"] == r["null_mismatch"] == 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_the_text_block_of_a_day_writes_the_titles_it_looks_at(spark, monkeypatch):
    from cutline.operators import textblock as T
    from cutline.queries.base import Market
    from cutline.queries.joins import articles
    m, made, real = Market(spark, SF), [], T.cut_lineage
    day = m.cal.where("widx = 24").first()["target"]
    block = lambda **k: T.text_block(articles(m), m.cal, m.universe, m.aliases, m.lexicon, **k)
    want = {r["symbol"]: r.asDict() for r in block().where(F.col("target") == F.lit(day)).collect()}
    monkeypatch.setattr(T, "cut_lineage", lambda df: made.append(real(df)) or made[-1])
    got = {r["symbol"]: r.asDict() for r in block(targets=[day]).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    titled = [x.agg(F.min("widx")).first()[0] for x in made if "title" in x.columns and os.path.isdir(x.written_at.removeprefix("file:"))]
    assert titled and min(titled) >= 24 - T.NEWS_WINDOW
