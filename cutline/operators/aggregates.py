"""Descriptive aggregations."""

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import as_col, is_extreme
from .ranks import quantile_bins, quantiles, value_ranks


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.withColumn("_t", total).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def binned_means(df: DataFrame, x: str, ys, q: int = 10) -> DataFrame:
    """Quantile bins of x: median x, count, mean of each y."""
    b = quantile_bins(df.where(F.col(x).isNotNull()), x, q, "bin")
    mid = quantiles(b, ["bin"], x, {"x_mid": 0.5})
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(y).alias(y) for y in ys]).join(mid, "bin")


def interval_bin(c, edges) -> F.col:
    """Index of the left-closed interval [edge_i, edge_i+1); NULL outside."""
    c = as_col(c)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((c >= float(edges[i])) & (c < float(edges[i + 1])), i).otherwise(out)
    return out


def conditional_tables(df: DataFrame, classes: dict, gap: str = "gap_pct", bins=(0, 0.5, 1.0, 2.5, float("inf"))) -> DataFrame:
    """Outcome by event, |gap| bin and event class, for all of {event: class column} in one pass: a row becomes one per event."""
    each = F.array(*[F.struct(F.lit(n).alias("event"), c.alias("category")) for n, c in classes.items()])
    x = df.select(interval_bin(F.abs(gap), bins).alias("gap_bin"), "ret_pct", "rest", "label", F.inline(each))
    return (x.where(F.col("gap_bin").isNotNull() & F.col("category").isNotNull()).groupBy("event", "gap_bin", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("ret_pct") > 0).cast("double")).alias("up_rate"),
        F.avg(is_extreme("label").cast("double")).alias("M_rate"), F.avg("rest").alias("rest_mean"),
        F.avg("ret_pct").alias("ret_mean")))


def conditional_table(df: DataFrame, category, gap: str = "gap_pct", bins=(0, 0.5, 1.0, 2.5, float("inf"))) -> DataFrame:
    """Outcome by |gap| bin and class of one event."""
    return conditional_tables(df, {"": category}, gap, bins).drop("event")


def pivot_mean_size(df: DataFrame, row: str, col: str, values, y: str) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def symbol_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(is_extreme("label").cast("double")).alias("big_share"),
        F.avg((F.col("label") > 2).cast("double")).alias("up_share"), F.stddev_samp("ret_pct").alias("ret_sd"),
        F.count_if(F.col("label") == 4).alias("n_surge"), F.count_if(F.col("label") == 0).alias("n_crash"))


def correlation(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average-tie ranks. Rows collapse to counted value pairs before they meet the rank tables; the mean rank is
    known, so the centred sums need one pass."""
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
             .agg(F.count(F.lit(1)).alias("_pairs")))

    def ranks(c):
        r = value_ranks(pairs, [], c, copies="_pairs")
        return r.select(c, (F.col("_before") + (F.col("_cnt") + 1) / 2 - (F.col("_n") + 1) / 2).alias(f"_r{c}"))

    x = pairs.join(ranks("_a"), "_a").join(ranks("_b"), "_b")
    w = F.col("_pairs")
    dot = lambda p, q: F.sum(w * F.col(p) * F.col(q))
    return x.agg(F.try_divide(dot("_r_a", "_r_b"), F.sqrt(dot("_r_a", "_r_a")) * F.sqrt(dot("_r_b", "_r_b"))).alias("spearman"), F.coalesce(F.sum(w), F.lit(0).cast("long")).alias("n"))


def majority_vote(df: DataFrame, id_col: str, votes, out: str = "vote") -> DataFrame:
    """Most frequent value, the smallest on ties."""
    x = df.unpivot([id_col], list(votes), "who", "v").where(F.col("v").isNotNull())
    c = x.groupBy(id_col, "v").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy(id_col).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(out))
    return df.join(best, id_col, "left")


def importance_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    q = quantiles(df, [group], value, {"p5": 0.05, "p95": 0.95})
    return df.groupBy(group).agg(F.avg(value).alias("mean_drop"), F.stddev_samp(value).alias("sd")).join(q, group)


def relative_activity(df: DataFrame, key: str, order: str, value: str, n: int = 5) -> DataFrame:
    """Value over the key's own median, then an n-row mean."""
    from .series import over_runs, rolling, series_index
    med = quantiles(df, [key], value, {"_med": 0.5})
    x = df.join(med, key).withColumn("rel", F.try_divide(F.col(value), F.col("_med"))).drop("_med")
    x = series_index(x, [key], order)
    return over_runs(x, [key], "_i", n - 1, lambda w: [{"rel_smooth": rolling(w, F.col("rel"), n, "mean", n)}]).drop("_i")
