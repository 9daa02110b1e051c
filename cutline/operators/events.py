"""Event, analyst, news and extended-hours aggregates per (symbol, target)."""

from pyspark.sql import DataFrame, functions as F

from ..fixed import (NEWS_WINDOW, SURP_CLIP, TARGET_CHANGE_CLIP, TONE_TAIL)
from ..functions.scalars import clip, clipped_change
from ..functions.text import norm_title
from .calendar import assign_window, at_cutoff, dense_grid
from .series import over_runs, rolling


def extended_hours(price: DataFrame) -> DataFrame:
    """(symbol, day): last pre-session close known before 09:30, the leaky variant that admits a
    bar known exactly at 09:30, last post-session close. max_by combines map-side, so a symbol
    with very many bars costs one partial row per task."""
    p = price.where(F.col("session") != "regular").withColumn("day", F.to_date("datetime"))
    cut = at_cutoff("day")
    has = F.col("close").isNotNull()

    def last(cond):
        cond = cond & has
        return F.max_by(F.when(cond, F.col("close")), F.when(cond, F.col("datetime")))

    pre = F.col("session") == "pre"
    return p.groupBy("symbol", "day").agg(
        last(pre & (F.col("known_at") < cut)).alias("pre_last"),
        last(pre & (F.col("known_at") <= cut)).alias("pre_last_leak"),
        last(F.col("session") == "post").alias("post_last"))


def last_non_null(df: DataFrame, keys, order: str, cols, tie: str | None = None) -> DataFrame:
    """Each column's own last non-null value by time (columns are picked independently)."""
    key = F.struct(order, tie) if tie else F.col(order)
    return df.groupBy(*keys).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                                            F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols])


def earnings_features(events: DataFrame, cal: DataFrame, bound: float = SURP_CLIP, tie: str | None = None) -> DataFrame:
    diff = F.col("eps_reported") - F.col("eps_estimate")
    e = assign_window(events, cal, "known_at").withColumns({
        "earn": F.lit(1.0), "surp_sign": F.signum(diff), "surp_abs": F.abs(diff),
        "surp_pct_w": clip("surprise_pct", -bound, bound)})
    return last_non_null(e, ["symbol", "target"], "known_at", ["earn", "surp_sign", "surp_abs", "surp_pct_w"], tie)


def analyst_features(actions: DataFrame, cal: DataFrame, with_init: bool = False) -> DataFrame:
    a = assign_window(actions, cal, "known_at")
    cnt = lambda act: F.sum((F.col("action") == act).cast("double"))
    aggs = [F.count(F.lit(1)).cast("double").alias("an_n"), cnt("up").alias("an_up"), cnt("down").alias("an_down")]
    if with_init:
        aggs.append(cnt("init").alias("an_init"))
    aggs.append(F.avg(clipped_change("target_current", "target_prior", TARGET_CHANGE_CLIP)).alias("an_tgt_chg"))
    return a.groupBy("symbol", "target").agg(*aggs)


def tagged(news: DataFrame, universe: DataFrame | None = None, carry=()) -> DataFrame:
    """One row per (article, tagged symbol), restricted to the universe. Filters on ``carry`` columns stay above the tags: pushed below
    them, and below the calendar, they would evaluate a second time what these columns are made of."""
    tags = F.split(F.coalesce("symbols", F.lit("")), ",")
    rows = F.explode(F.transform(tags, lambda s: F.struct(s.alias("symbol"), *[F.col(c).alias(c) for c in carry])))
    n = news.select(*[c for c in news.columns if c not in ("symbol", *carry)], rows.alias("_tag")).select("*", "_tag.*").drop("_tag")
    return n if universe is None else n.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def dedup_first(n: DataFrame, keys, order, keep) -> DataFrame:
    """First row per key as an aggregation: copies collapse before the shuffle."""
    return n.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_f"),
                                F.count(F.lit(1)).alias("copies")).select(*keys, "copies", "_f.*")


def news_dedup(news: DataFrame, cal: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Articles with distinct normalised title per (symbol, target); ``copies`` counts the merged."""
    n = tagged(assign_window(news, cal, "known_at").withColumn("h", F.md5(norm_title("title")))
               .select("symbols", "target", "widx", "h", "known_at", "url", "tone"), universe)
    return dedup_first(n, ["symbol", "target", "widx", "h"], ["known_at", "url"], ["tone"])


def news_features(dedup: DataFrame, tail: float = TONE_TAIL) -> DataFrame:
    t = F.col("tone")
    return dedup.groupBy("symbol", "target").agg(
        F.count(F.lit(1)).cast("double").alias("news_n"), F.avg(t).alias("tone_mean"), F.min(t).alias("tone_min"),
        F.max(t).alias("tone_max"), F.stddev_samp(t).alias("tone_std"),
        F.count_if(t < -tail).cast("double").alias("tone_neg_tail"),
        F.count_if(t > tail).cast("double").alias("tone_pos_tail"),
        F.sum("copies").cast("double").alias("news_raw"))


def abnormal_counts(grid: DataFrame, cols, window: int = NEWS_WINDOW, missing: dict | None = None) -> DataFrame:
    """log1p(x) - log1p(mean of the previous ``window`` cells); needs all of them.
    ``missing`` {out: col}: 1 where the last window+1 cells sum to zero, 0 on the early cells."""
    def build(w):
        prev = w.rowsBetween(-window, -1)
        step = {f"{c}_abn": F.log1p(c) - F.log1p(F.when(F.count(c).over(prev) >= window, F.avg(c).over(prev)))
                for c in cols}
        for out, c in (missing or {}).items():
            step[out] = F.coalesce((rolling(w, F.col(c), window + 1, "sum", window + 1) == 0).cast("double"), F.lit(0.0))
        return [step]

    return over_runs(grid, ["symbol"], "widx", window, build)


def news_block(news: DataFrame, cal: DataFrame, universe: DataFrame) -> DataFrame:
    agg = news_features(news_dedup(news, cal, universe))
    grid = dense_grid(universe, "symbol", cal).join(agg, ["symbol", "target"], "left")
    grid = grid.fillna(0.0, ["news_n", "tone_neg_tail"])
    out = abnormal_counts(grid, ["news_n"], missing={"news_missing": "news_n"})
    return out.select("symbol", "target", "news_n", F.col("news_n_abn").alias("news_abn"), "tone_mean", "tone_min",
                      "tone_max", "tone_neg_tail", "news_missing")
