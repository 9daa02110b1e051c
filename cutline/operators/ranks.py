"""Exact order statistics per group without sorting any group in one task.

Values are first collapsed to (group, value, count) with map-side combine. Each group is split over
value buckets of a fixed monotone function, and each bucket over equal parts of the range its own values span,
so that narrow distributions spread as well. Bucket and part totals (about ten thousand and one thousand rows at
most) give offsets; inside a part a window finishes the ranks. Both splits are exact functions of the
data, so every evaluation of the plan agrees on them. A single very frequent value is one row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS_PER_UNIT = 256
PARTS = 1024


def value_bucket(v) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1000.0) * BUCKETS_PER_UNIT).cast("int")


def value_ranks(df: DataFrame, keys, value: str, copies: str | None = None) -> DataFrame:
    """One row per (keys, distinct value): _cnt copies, _before smaller values, _n in the group.
    A row counts once, or as often as its column ``copies`` says."""
    keys = list(keys)
    v = F.col(value)
    bucket = [*keys, "_vbucket"]
    counts = (df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
              .groupBy(*keys, v.cast("double").alias(value)).agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("_cnt"))
              .withColumn("_vbucket", value_bucket(F.col(value))))
    ahead = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (counts.groupBy(*bucket).agg(F.sum("_cnt").alias("_vtotal"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
               .select(*bucket, "_lo", "_hi", F.coalesce(F.sum("_vtotal").over(ahead(keys, "_vbucket")), zero).alias("_off"),
                       F.sum("_vtotal").over(W.partitionBy(*keys)).alias("_n")))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    spread = counts.join(offsets, bucket).withColumn("_part", F.floor(share * PARTS).cast("int")).drop("_lo", "_hi")
    parts = spread.groupBy(*bucket, "_part").agg(F.sum("_cnt").alias("_ptotal"))
    parts = parts.select(*bucket, "_part", F.coalesce(F.sum("_ptotal").over(ahead(bucket, "_part")), zero).alias("_poff"))
    inside = F.coalesce(F.sum("_cnt").over(ahead([*bucket, "_part"], value)), zero)
    return (spread.withColumn("_in", inside).join(parts, [*bucket, "_part"])
            .select(*keys, value, "_cnt", (F.col("_off") + F.col("_poff") + F.col("_in")).alias("_before"), "_n"))


def _value_at(value, pos):
    """The value whose run of equal copies covers the zero-based position."""
    return F.max(F.when((F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_cnt")), F.col(value)))


def quantiles(df: DataFrame, keys, value: str, probs: dict, count_as: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles, one column per name in ``probs``."""
    ranks = value_ranks(df, keys, value)
    aggs, out = [F.max("_n").alias("_n")], []
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [_value_at(value, F.floor(h)).alias(f"_lo{i}"), _value_at(value, F.ceil(h)).alias(f"_hi{i}")]
        t = (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * t).alias(name))
    if count_as:
        out.append(F.col("_n").alias(count_as))
    return ranks.groupBy(*keys).agg(*aggs).select(*keys, *out)


def rank_pct(df: DataFrame, keys, value: str, out: str, ranks: DataFrame | None = None) -> DataFrame:
    """Percentile rank over the group's non-null values, ties averaged (adds ``out``)."""
    ranks = value_ranks(df, keys, value) if ranks is None else ranks
    ranks = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"),
                         ((F.col("_before") + (F.col("_cnt") + 1) / 2) / F.col("_n")).alias(out))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)],
                F.col(value).cast("double") == F.col("_v"))
    return df.join(ranks, on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def middle_stats(value: str, when=None) -> dict:
    """Aggregates over value_ranks rows: group size and the four middle order statistics that
    decide every leave-one-out median."""
    n = F.col("_n")
    low, up = F.floor((n - 2) / 2), F.floor((n - 1) / 2)
    pick = lambda c: c if when is None else F.when(when, c)
    at = lambda p: F.max(pick(F.when((F.col("_before") <= p) & (p < F.col("_before") + F.col("_cnt")), F.col(value))))
    return {"n": F.max(pick(n)), "a": at(low), "b": at(low + 1), "c": at(up), "d": at(up + 1)}


def median_from(p: str):
    """Group median from the middle statistics with column prefix p."""
    return (F.col(f"{p}c") + F.when(F.col(f"{p}n") % 2 == 1, F.col(f"{p}c")).otherwise(F.col(f"{p}d"))) / 2


def loo_median_from(p: str, value: str, min_others: int):
    """Median of the other rows. Dropping one copy of a value moves the positions at or after it by
    one, and whether position k lies before the own value is just v[k] < own."""
    own = F.col(value)
    pick = lambda k, nxt: F.when(F.col(p + k) < own, F.col(p + k)).otherwise(F.col(p + nxt))
    valid = own.isNotNull() & ~F.isnan(own)
    enough = F.when(valid, F.col(p + "n") - 1).otherwise(F.col(p + "n")) >= min_others
    return F.when(enough, F.when(valid, (pick("a", "b") + pick("c", "d")) / 2).otherwise(median_from(p)))


def loo_median(df: DataFrame, keys, value: str, out: str, min_others: int = 3, min_rows: int = 0) -> DataFrame:
    """Median of the group's other rows (adds ``out``); NULL below min_others or min_rows."""
    mid = value_ranks(df, keys, value).groupBy(*keys).agg(*[c.alias(f"_m{k}") for k, c in middle_stats(value).items()])
    if min_rows:
        mid = mid.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), list(keys))
    med = loo_median_from("_m", value, min_others)
    if min_rows:
        med = F.when(F.col("_rows") >= min_rows, med)
    return (df.join(mid, list(keys), "left").withColumn(out, med)
            .drop("_rows", *[f"_m{k}" for k in "nabcd"]))


def quantile_bins(df: DataFrame, value: str, q: int, out: str) -> DataFrame:
    """Right-closed quantile bin number 0.. with duplicate edges dropped (adds ``out``)."""
    edges = quantiles(df, [], value, {f"_q{i}": i / q for i in range(q + 1)})
    edges = edges.select(F.array_distinct(F.array(*[f"_q{i}" for i in range(q + 1)])).alias("_edges"))
    x = df.withColumn("_e", edges.scalar())
    above = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return x.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(above - 1, F.lit(0)))).drop("_e")
