"""Permutation importance, partial dependence and stability of fitted candidates."""

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..fixed import FEATURE_GROUPS, RESEARCH_GROUPS
from ..functions.scalars import hash_int, is_extreme
from .scoring import score


def group_of_features(features, extra: dict | None = None) -> dict:
    """Features by the first group that lists them; regime columns and unlisted ones stand alone."""
    named = {c: g for g, cols in reversed({**FEATURE_GROUPS, **RESEARCH_GROUPS, **(extra or {})}.items()) if g != "regime" for c in cols}
    order = dict.fromkeys(named.get(f, f) for f in features)
    return {g: [f for f in features if named.get(f, f) == g] for g in order}


def permuted_days(days: DataFrame, block_days: int, reps: int, seed=0, day: str = "target") -> DataFrame:
    """(rep, day, source): days in blocks, block order shuffled by seeded hash; the i-th day of a block
    reads the i-th day (cyclic) of its partner block. One row per distinct day and rep."""
    w = W.orderBy(day)
    d = days.select(day).distinct().withColumn("_no", F.row_number().over(w) - 1)
    d = d.withColumns({"_b": F.floor(F.col("_no") / block_days).cast("int"), "_i": (F.col("_no") % block_days).cast("int")})
    blocks = d.groupBy("_b").agg(F.count(F.lit(1)).cast("int").alias("_len"))
    r = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    r = r.withColumn("_p", F.row_number().over(W.partitionBy("rep").orderBy(hash_int(seed, "rep", "_b"), "_b")) - 1)
    partner = r.select("rep", F.col("_p").alias("_b"), F.col("_b").alias("_pb"), F.col("_len").alias("_plen"))
    src = d.select(F.col("_b").alias("_pb"), F.col("_i").alias("_si"), F.col(day).alias("source"))
    return (d.join(partner, "_b").withColumn("_si", F.col("_i") % F.col("_plen")).join(src, ["_pb", "_si"])
            .select("rep", day, "source"))


def block_permute(df: DataFrame, cols, mapping: DataFrame, day: str = "target") -> DataFrame:
    """Every row once per rep, with ``cols`` taken from the same symbol on the mapped day (NULL if absent)."""
    cols = list(cols)
    keep = [c for c in df.columns if c not in cols]
    donor = df.select(F.col("symbol"), F.col(day).alias("source"), *cols)
    return df.select(*keep).join(mapping, day).join(donor, ["symbol", "source"], "left").drop("source")


def counterfactual_rows(df: DataFrame, groups: dict, mapping: DataFrame, day: str = "target") -> DataFrame:
    """Every row once per group and rep (columns grp, rep): the group's features are those of the same symbol on the mapped day, all others its own.
    The table is read twice, whatever the number of groups."""
    moved = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    donor = df.select("symbol", F.col(day).alias("source"), *[F.col(c).alias(f"_d_{c}") for c in moved])
    x = df.join(mapping, day).join(donor, ["symbol", "source"], "left").withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups])))
    taken = {c: F.when(F.col("grp").isin(*[g for g, cols in groups.items() if c in cols]), F.col(f"_d_{c}")).otherwise(F.col(c)) for c in moved}
    return x.withColumns(taken).select("grp", "rep", *df.columns)


def permutation_importance(predict, df: DataFrame, groups: dict, reps: int, block_days: int, seed=0) -> DataFrame:
    """(grp, rep, drop): score lost when one feature group is shuffled in day blocks. Groups and reps are a key: one prediction, one count."""
    base = score(predict(df)).select(F.col("score").alias("_base"))
    x = counterfactual_rows(df, groups, permuted_days(df, block_days, reps, seed))
    each = score(predict(x), ["grp", "rep"])
    return each.withColumn("_base", base.scalar()).select("grp", "rep", (F.col("_base") - F.col("score")).alias("drop"))


def group_coverage(df: DataFrame, features, extra: dict | None = None) -> DataFrame:
    """(grp, feature, present): the group of each feature and how many rows have a value, from one aggregate row."""
    groups = group_of_features(features, extra)
    counts = df.agg(*[F.count(c).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("feature"), F.col(c).alias("present")) for g, cols in groups.items() for c in cols])
    return counts.select(F.inline(rows))


def pdp_ice(explain, df: DataFrame, feature: str, n_grid: int = 10) -> DataFrame:
    """Extreme share and mean size of the signal when the feature is set to each grid quantile, overall
    (symbol ALL) and per symbol from one grouped pass."""
    from ..operators.ranks import quantiles
    probs = {f"q{i}": 0.05 + 0.9 * i / (n_grid - 1) for i in range(n_grid)}
    grid = quantiles(df, [], feature, probs).select(F.array_distinct(F.array(*probs)).alias("g"))
    x = df.withColumn("_g", grid.scalar()).withColumn("grid", F.explode("_g")).drop("_g").withColumn(feature, F.col("grid"))
    y = explain(x)
    cell = y.groupBy("grid", "symbol").agg(F.count(F.lit(1)).alias("_n"), F.sum(is_extreme("pred").cast("double")).alias("_x"),
                                          F.sum(F.abs("scaled")).alias("_s"), F.count("scaled").alias("_k"))
    both = cell.withColumn("symbol", F.explode(F.array(F.lit("ALL"), F.col("symbol"))))
    return both.groupBy("grid", "symbol").agg(F.try_divide(F.sum("_x"), F.sum("_n")).alias("pred_extreme"),
                                              F.try_divide(F.sum("_s"), F.sum("_k")).alias("mean_abs_signal"))


def rank_stability(imp: DataFrame, unit="unit", group="grp", value="drop") -> DataFrame:
    """Mean Spearman correlation of group ranks over all pairs of units. Units are fold x draw and
    groups are feature groups: a few dozen rows."""
    m = imp.groupBy(unit, group).agg(F.avg(value).alias("_v"))
    w = W.partitionBy(unit).orderBy("_v")
    ties = F.count(F.lit(1)).over(W.partitionBy(unit, "_v"))
    r = m.withColumn("_r", F.rank().over(w) + (ties - 1) / 2)
    a = r.select(F.col(unit).alias("_ua"), group, F.col("_r").alias("_ra"))
    b = r.select(F.col(unit).alias("_ub"), group, F.col("_r").alias("_rb"))
    pairs = a.join(b, group).where(F.col("_ua") < F.col("_ub"))
    c = pairs.groupBy("_ua", "_ub").agg(F.corr("_ra", "_rb").alias("_c"))
    return c.agg(F.avg("_c").alias("mean_spearman"), F.count(F.lit(1)).alias("pairs"))


def faithfulness(tune_imp: DataFrame, test_imp: DataFrame, group="grp", value="drop") -> DataFrame:
    """Does the top group of the tuning span lose more in the test span than the others on average?"""
    top = (tune_imp.groupBy(group).agg(F.avg(value).alias("_v")).orderBy(F.desc("_v"), group).limit(1)
           .select(F.col(group).alias("top_group")))
    m = test_imp.groupBy(group).agg(F.avg(value).alias("_v")).withColumn("top_group", top.scalar())
    is_top = F.col(group) == F.col("top_group")
    return m.groupBy("top_group").agg(F.max(F.when(is_top, F.col("_v"))).alias("top_drop"),
                                      F.avg(F.when(~is_top, F.col("_v"))).alias("others_mean_drop"))


def term_frequency(tables) -> DataFrame:
    """(term, direction, splits, mean_coef): in how many splits' lists of strongest terms a term stands."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("split", F.lit(i)) for i, t in enumerate(tables)])
    return rows.groupBy("term", "direction").agg(F.count_distinct("split").alias("splits"), F.avg("coef").alias("mean_coef"))
