"""Order statistics, rolling and recursive operators against numpy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from cutline.operators import indicators as I, series as S
from cutline.operators.ranks import loo_median, quantile_bins, quantiles, rank_pct, value_ranks


def frame(spark, groups):
    rows = [(g, i, None if v is None or np.isnan(v) else float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, i int, v double")


def brute_loo(vs, min_others):
    a = np.array([np.nan if v is None else v for v in vs], float)
    out = []
    for k in range(len(a)):
        rest = np.delete(a, k)
        rest = rest[~np.isnan(rest)]
        out.append(float(np.median(rest)) if len(rest) >= min_others else None)
    return out


values = st.lists(st.one_of(st.none(), st.sampled_from([0.0, -1.5, 1.5, 2.0, 1e-9, 1e6, -3e5]), st.floats(-100, 100)), min_size=1, max_size=9)


@settings(max_examples=8, deadline=None)
@given(st.lists(values, min_size=1, max_size=4))
def test_loo_median_matches_brute_force(spark, groups):
    groups = {f"g{k}": [None if v is None else float(v) for v in vs] for k, vs in enumerate(groups)}
    for others in (1, 3):
        got = {(r["g"], r["i"]): r["m"] for r in loo_median(frame(spark, groups), ["g"], "v", "m", others).collect()}
        for g, vs in groups.items():
            for i, want in enumerate(brute_loo(vs, others)):
                assert got[(g, i)] == pytest.approx(want) if want is not None else got[(g, i)] is None


def test_rank_and_quantiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    vs = np.round(rng.normal(size=400), 1)
    df = frame(spark, {"a": vs, "b": vs[:7]})
    got = rank_pct(df, ["g"], "v", "r").where("g = 'a'").orderBy("i").toPandas()["r"].to_numpy()
    assert np.allclose(got, pd.Series(vs).rank(pct=True))
    q = {r["g"]: r for r in quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.975}).collect()}
    for g, x in (("a", vs), ("b", vs[:7])):
        assert np.allclose([q[g]["lo"], q[g]["mid"], q[g]["hi"]], np.quantile(x, [0.1, 0.5, 0.975]))


def test_one_value_holding_most_rows_is_one_rank_row(spark):
    df = frame(spark, {"a": [0.0] * 500 + [1.0, -1.0]})
    assert value_ranks(df, ["g"], "v").count() == 3


def test_quantile_bins_match_qcut(spark):
    vs = np.random.default_rng(2).integers(0, 6, 200).astype(float)
    got = quantile_bins(frame(spark, {"a": vs}), "v", 4, "b").orderBy("i").toPandas()["b"]
    want = pd.qcut(pd.Series(vs), 4, labels=False, duplicates="drop")
    assert (got.to_numpy() == want.to_numpy()).all()


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("A", 300), ("B", 40), ("C", 9)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(close[i] * 1.01), float(close[i] * 0.98), float(close[i]), float(rng.integers(1, 99))))
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "high", "low", "close", "volume"])
    return pdf, S.series_index(spark.createDataFrame(pdf), ["symbol"], "date")


def by_symbol(df, col):
    p = df.orderBy("symbol", "_i").toPandas()
    return {s: g[col].to_numpy(float) for s, g in p.groupby("symbol")}


def same(a, b):
    return np.allclose(np.asarray(a, float), np.asarray(b, float), equal_nan=True)


def test_series_index_counts_across_blocks(prices):
    pdf, df = prices
    for s, v in by_symbol(df, "_i").items():
        assert (v == np.arange(len(v))).all()


@pytest.mark.parametrize("run_rows", [32, 64, 4096])
def test_split_rolling_equals_unsplit(prices, run_rows):
    pdf, df = prices
    x = S.over_runs(df, ["symbol"], "_i", 19, lambda w: [{"s": S.rolling(w, F.col("close"), 20, "std", 10)}], run_rows)
    assert x.count() == len(pdf)
    for s, v in by_symbol(x, "s").items():
        assert same(v, pdf[pdf.symbol == s].close.rolling(20, min_periods=10).std())


def test_ema_matches_pandas_across_blocks(prices):
    pdf, df = prices
    x = S.ema(df, ["symbol"], "_i", {"fast": ("close", 0, None), "slow": ("close", 0, None), "now": ("close", 0, None)},
              {"fast": 0.4, "slow": 2 / 201, "now": 1.0})
    for col, a in (("fast", 0.4), ("slow", 2 / 201), ("now", 1.0)):
        for s, v in by_symbol(x, col).items():
            assert same(v, pdf[pdf.symbol == s].close.ewm(alpha=a, adjust=False).mean())


def test_ema_goes_missing_after_a_missing_input(spark):
    df = spark.createDataFrame([("A", i, None if i == 3 else 1.0) for i in range(6)], "k string, _i long, v double")
    got = [r["e"] for r in S.ema(df, ["k"], "_i", {"e": ("v", 0, None)}, {"e": 0.5}).orderBy("_i").collect()]
    assert got == [1.0, 1.0, 1.0, None, None, None]


def wilder(x, n):
    out = np.full(len(x), np.nan)
    if len(x) > n:
        out[n] = np.mean(x[1:n + 1])
        for t in range(n + 1, len(x)):
            out[t] = (out[t - 1] * (n - 1) + x[t]) / n
    return out


def test_rsi_and_atr_match_recursion(prices):
    pdf, df = prices
    r = by_symbol(I.rsi(df, ["symbol"], "_i", "close", 14), "rsi")
    a = by_symbol(I.atr(df, ["symbol"], "_i", 14), "atr")
    for s, g in pdf.groupby("symbol"):
        d = np.diff(g.close.to_numpy(), prepend=np.nan)
        up, dn = wilder(np.maximum(d, 0), 14), wilder(np.maximum(-d, 0), 14)
        want = np.where(np.isnan(up), np.nan, np.where(dn > 0, 100 - 100 / (1 + up / np.where(dn > 0, dn, 1)), 100.0))
        assert same(r[s], want)
        pc = g.close.shift()
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1).to_numpy()
        assert same(a[s], wilder(tr, 14))


def test_rsi_without_losses_is_100(spark):
    df = spark.createDataFrame([("A", i, float(i + 1)) for i in range(20)], "k string, _i long, close double")
    got = [r["rsi"] for r in I.rsi(df, ["k"], "_i", "close", 14).orderBy("_i").collect()]
    assert got[:14] == [None] * 14 and got[14:] == [100.0] * 6


def test_macd_bollinger_cross(prices):
    pdf, df = prices
    m = I.macd(df, ["symbol"], "_i", "close")
    b = I.bollinger(df, ["symbol"], "_i", "close", ddof=0)
    g = I.golden_cross(df, ["symbol"], "_i", "close", 5, 20)
    for s, x in pdf.groupby("symbol"):
        line = x.close.ewm(span=12, adjust=False).mean() - x.close.ewm(span=26, adjust=False).mean()
        assert same(by_symbol(m, "hist")[s], line - line.ewm(span=9, adjust=False).mean())
        assert same(by_symbol(b, "sd")[s], x.close.rolling(20).std(ddof=0))
        d = x.close.rolling(5).mean() - x.close.rolling(20).mean()
        want = ((np.sign(d).shift() < 0) & (np.sign(d) > 0)).sum()
        assert g.where(f"symbol = '{s}' and event = 'golden'").count() == want


@pytest.mark.parametrize("alpha", [1e-5, 0.0009, 0.3, 0.97, 0.99, 0.997, 0.9999, 1 - 1e-12, 1.0])
def test_smoothing_keeps_its_whole_history(spark, alpha):
    from pyspark.sql import functions as F

    from cutline.operators.series import ema
    n = 60_000
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), ((F.col("id") * 7919) % 101).cast("double").alias("x"))
    got = ema(rows, ["k"], "i", {"s": ("x", 0, None)}, {"s": alpha}).where("i % 1000 = 999").orderBy("i").collect()
    s, want = 0.0, []
    for i in range(n):
        v = float(i * 7919 % 101)
        s = v if i == 0 else alpha * v + (1 - alpha) * s
        if i % 1000 == 999:
            want.append(s)
    assert all(abs(r.s - w) <= 1e-9 * max(1, abs(w)) for r, w in zip(got, want, strict=True))


def test_ranks_of_narrow_and_tiny_values_spread_over_parts(spark):
    """Values within a hair's breadth share one bucket of the fixed function; their own range splits them."""
    for values in ([1.7e9 + i / 7 for i in range(3000)], [i * 1e-12 for i in range(-500, 500)], [5.0] * 50 + [5.0 + 1e-9 * (i % 40) for i in range(400)]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = {r["v"]: (r["_cnt"], r["_before"], r["_n"]) for r in value_ranks(df, [], "v").collect()}
        ordered = sorted(values)
        assert got == {v: (ordered.count(v), ordered.index(v), len(values)) for v in set(values)}


def test_spearman_with_a_value_that_holds_a_third_of_the_rows(spark):
    from cutline.operators.aggregates import spearman
    g = np.random.default_rng(4)
    x = pd.DataFrame({"a": np.where(g.random(900) < 1 / 3, 0.0, g.integers(0, 50, 900)), "b": g.integers(0, 9, 900).astype(float)})
    x.loc[:9, "b"] = np.nan
    got = spearman(spark.createDataFrame(x).withColumn("b", F.nanvl("b", F.lit(None))), "a", "b").first()
    both = x.dropna()
    want = np.corrcoef(both["a"].rank(), both["b"].rank())[0, 1]
    assert got["n"] == len(both) and abs(got["spearman"] - want) < 1e-12


def test_lineage_cut_goes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from cutline import session
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    x = session.cut_lineage(spark.range(10).withColumn("y", F.lit("a")))
    assert x.count() == 10 and list(tmp_path.rglob("*.parquet")) and x.columns == ["id", "y"]
    session.drop_intermediates(spark)
    assert not list(tmp_path.rglob("*.parquet"))
