"""Seeded samples. Order comes from hashing, so any run and any partitioning draws the same rows."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import hash_int


def stratified_sample(df: DataFrame, stratum, key: str, k: int, seed=0) -> DataFrame:
    """k rows per stratum in hash order. The rank filter lets Spark keep k rows per stratum and task
    before the shuffle, so a stratum with most of the rows stays cheap."""
    strata = [stratum] if isinstance(stratum, str) else list(stratum)
    x = df.withColumn("_h", hash_int(seed, key))
    rank = F.row_number().over(W.partitionBy(*strata).orderBy("_h", key))
    return x.withColumn("_r", rank).where(F.col("_r") <= k).drop("_h", "_r")


def top_per_group(df: DataFrame, keys, order) -> DataFrame:
    """First row per group under the ordering (list of columns, wrapped in desc() where needed)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= 1).drop("_r")


def head_and_tail(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    top = df.orderBy(F.desc(value), tie).limit(n).withColumn("direction", F.lit("up"))
    low = df.orderBy(value, tie).limit(n).withColumn("direction", F.lit("down"))
    return top.unionByName(low)


def four_way_sample(df: DataFrame, key: str, text: str, time: str, want: int, seed=0) -> DataFrame:
    """A quarter each of random, longest, most repeated and most recent rows; duplicates keep the first
    reason in that order, the rest is topped up at random. ``df`` holds one row per key."""
    quarter = -(-want // 4)
    x = df.withColumns({"_h": hash_int(seed, key), "_len": F.length(text), "_t": F.md5(text)})
    rep = x.groupBy("_t").agg(F.count(F.lit(1)).alias("_rep"))
    x = x.join(rep, "_t")
    order = [("random", ["_h", key]), ("longest", [F.desc("_len"), key]),
             ("repeated", [F.desc("_rep"), key]), ("recent", [F.desc(time), key])]
    parts = None
    for i, (why, by) in enumerate(order):
        p = x.orderBy(*by).limit(quarter).select(key, F.lit(i).alias("_p"))
        parts = p if parts is None else parts.unionByName(p)
    picked = parts.groupBy(key).agg(F.min("_p").alias("_p")).orderBy("_p", key).limit(want)
    fill = x.join(picked, key, "left_anti").orderBy("_h", key).select(key, F.lit(4).alias("_p")).limit(want)
    both = picked.unionByName(fill).orderBy("_p", key)
    names = F.array(*[F.lit(w) for w, _ in order], F.lit("fill"))
    top = both.withColumn("_h2", F.when(F.col("_p") == 4, hash_int(seed, key)).otherwise(0)).orderBy("_p", "_h2", key).limit(want)
    return (df.join(top.select(key, F.element_at(names, F.col("_p") + 1).alias("reason")), key))
