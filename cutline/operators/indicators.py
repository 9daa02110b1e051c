"""Technical indicators over one ordered series per key.

Every function takes a table with a zero-based row index (``series_index``) and returns it
with new columns. Rolling ones run on split series, recursive ones on the block scan.
"""

from pyspark.sql import DataFrame, functions as F

from .series import ema, over_runs, rolling, sma, span_to_alpha, true_range, wma


def moving_averages(df: DataFrame, keys, index: str, value: str, sma_n: int, wma_n: int) -> DataFrame:
    return over_runs(df, keys, index, max(sma_n, wma_n) - 1,
                     lambda w: [{f"sma{sma_n}": sma(w, F.col(value), sma_n), f"wma{wma_n}": wma(w, F.col(value), wma_n)}])


def macd(df: DataFrame, keys, index: str, close: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    a = {"_fast": span_to_alpha(fast), "_slow": span_to_alpha(slow)}
    x = ema(df, keys, index, {c: (close, 0, None) for c in a}, a)
    x = x.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    x = ema(x, keys, index, {"signal": ("macd", 0, None)}, {"signal": span_to_alpha(signal)})
    return x.withColumns({"hist": F.col("macd") - F.col("signal"),
                          "macd_over_close": F.try_divide(F.col("macd"), F.col(close))})


def _seed_mean(w, c, index: str, n: int):
    """Mean of rows 1..n, on row n only: the seed of a Wilder average."""
    return F.when(F.col(index) == n, F.avg(c).over(w.rowsBetween(-(n - 1), 0)))


def rsi(df: DataFrame, keys, index: str, close: str, n: int = 14) -> DataFrame:
    def build(w):
        d = F.col(close) - F.lag(close).over(w)
        return [{"_g": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_l": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))},
                {"_gs": _seed_mean(w, F.col("_g"), index, n), "_ls": _seed_mean(w, F.col("_l"), index, n)}]

    x = over_runs(df, keys, index, n, build)
    x = ema(x, keys, index, {"avg_gain": ("_g", n, "_gs"), "avg_loss": ("_l", n, "_ls")},
            {"avg_gain": 1.0 / n, "avg_loss": 1.0 / n})
    rs = F.try_divide(F.col("avg_gain"), F.col("avg_loss"))
    value = F.when(F.col("avg_gain").isNull(), None).when(F.col("avg_loss") > 0, 100.0 - 100.0 / (1.0 + rs)).otherwise(100.0)
    return x.withColumns({"rs": rs, "rsi": value}).drop("_g", "_l", "_gs", "_ls")


def with_true_range(df: DataFrame, keys, index: str, high="high", low="low", close="close") -> DataFrame:
    return over_runs(df, keys, index, 1, lambda w: [{"tr": true_range(w, high, low, close)}])


def atr(df: DataFrame, keys, index: str, n: int = 14, high="high", low="low", close="close") -> DataFrame:
    """Wilder average of the true range, seeded with the mean of rows 1..n."""
    x = over_runs(df, keys, index, n, lambda w: [{"tr": true_range(w, high, low, close)},
                                                 {"_ts": _seed_mean(w, F.col("tr"), index, n)}])
    x = ema(x, keys, index, {"atr": ("tr", n, "_ts")}, {"atr": 1.0 / n})
    return x.withColumn("atr_over_close", F.try_divide(F.col("atr"), F.col(close))).drop("_ts")


def bollinger(df: DataFrame, keys, index: str, close: str, n: int = 20, k: float = 2.0, ddof: int = 1) -> DataFrame:
    def build(w):
        c = F.col(close)
        up, lo, mid = F.col("upper"), F.col("lower"), F.col("middle")
        return [{"middle": sma(w, c, n), "sd": rolling(w, c, n, "std" if ddof == 1 else "pstd", n)},
                {"upper": mid + k * F.col("sd"), "lower": mid - k * F.col("sd")},
                {"pct_b": F.try_divide(c - lo, up - lo), "band_width": F.try_divide(up - lo, mid)}]

    return over_runs(df, keys, index, n - 1, build)


def golden_cross(df: DataFrame, keys, index: str, close: str, fast: int = 50, slow: int = 200) -> DataFrame:
    def build(w):
        now, prev = F.signum("d"), F.lag(F.signum("d")).over(w)
        return [{"d": sma(w, F.col(close), fast) - sma(w, F.col(close), slow)},
                {"event": F.when((prev < 0) & (now > 0), "golden").when((prev > 0) & (now < 0), "dead").otherwise("")}]

    return over_runs(df, keys, index, slow, build)


def volume_features(df: DataFrame, keys, index: str) -> DataFrame:
    """Volume over its 20-row mean (today included, shorter at the start) and range over close."""
    return over_runs(df, keys, index, 19, lambda w: [{
        "vol_ratio": F.try_divide(F.col("volume"), F.avg("volume").over(w.rowsBetween(-19, 0))),
        "range_over_close": F.try_divide(F.col("high") - F.col("low"), F.col("close"))}])


def volume_zscore(df: DataFrame, keys, eps: float = 1e-9) -> DataFrame:
    """Volume against the key's own mean and deviation, as a partial aggregate joined back."""
    s = df.groupBy(*keys).agg(F.avg("volume").alias("_m"), F.stddev_samp("volume").alias("_s"))
    z = (F.col("volume") - F.col("_m")) / (F.col("_s") + eps)
    return df.join(s, list(keys)).withColumn("vol_z", z).drop("_m", "_s")


def pct_changes(df: DataFrame, keys, index: str, close: str, spans=(1, 5)) -> DataFrame:
    return over_runs(df, keys, index, max(spans), lambda w: [
        {f"ret{n}": F.try_divide(F.col(close), F.lag(close, n).over(w)) - 1 for n in spans}])


def premarket_return(price: DataFrame, cal: DataFrame, hours: int = 20) -> DataFrame:
    """(symbol, target): last over first pre-session close of the hours before the cutoff, NULL below
    two bars."""
    spans = cal.select("target", "cutoff", (F.col("cutoff") - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("since"))
    spans = spans.withColumn("day", F.explode(F.sequence(F.to_date("since"), F.to_date("cutoff"))))
    bars = price.where(F.col("session") == "pre").withColumn("day", F.to_date("known_at"))
    hit = bars.join(spans, "day").where((F.col("known_at") >= F.col("since")) & (F.col("known_at") < F.col("cutoff")))
    g = hit.groupBy("symbol", "target").agg(F.max_by("close", "datetime").alias("_l"), F.min_by("close", "datetime").alias("_f"),
                                            F.count(F.lit(1)).alias("_n"))
    return g.select("symbol", "target", F.when(F.col("_n") > 1, F.try_divide("_l", "_f") - 1).alias("pre_ret"))


def indicator_table(daily: DataFrame, price: DataFrame, cal: DataFrame, min_rows: int = 30) -> DataFrame:
    """One indicator row per (symbol, base day) with at least ``min_rows`` closes of history."""
    from .series import series_index
    keys = ["symbol"]
    x = series_index(daily.withColumn("date", F.to_date("date_et")), keys, "date")
    x = pct_changes(x, keys, "_i", "close")
    x = macd(x, keys, "_i", "close").drop("macd", "signal", "macd_over_close")
    x = rsi(x, keys, "_i", "close").drop("avg_gain", "avg_loss", "rs")
    x = bollinger(x, keys, "_i", "close").drop("middle", "sd", "upper", "lower")
    x = volume_features(x, keys, "_i")
    x = x.where(F.col("_i") >= min_rows - 1).join(cal.select("date", "target"), "date")
    x = x.join(premarket_return(price, cal), ["symbol", "target"], "left")
    return x.select("symbol", "date", "target", "ret1", "ret5", F.col("rsi").alias("rsi14"),
                    F.try_divide("hist", "close").alias("macd_hist"), "pct_b", "band_width", "vol_ratio", "pre_ret")
