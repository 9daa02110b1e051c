"""Chance-corrected weighted score and its decompositions, all from 25 counts per group."""

from pyspark.sql import DataFrame, functions as F

from ..fixed import MAGNITUDE, WEIGHT
from ..functions.scalars import hash_int

CELLS = [(i, j) for i in range(5) for j in range(5)]


def confusion(df: DataFrame, keys=(), label: str = "label", pred: str = "pred", weight=None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, label, pred).agg(n.alias("n")).withColumnsRenamed({label: "label", pred: "pred"})


def confusion_grid(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Dense 5x5 table: one aggregate row unfolded, no grid join."""
    cells = df.agg(*[F.count_if((F.col(label) == i) & (F.col(pred) == j)).alias(f"c{i}{j}") for i, j in CELLS])
    rows = F.array(*[F.struct(F.lit(i).alias("label"), F.lit(j).alias("pred"), F.col(f"c{i}{j}").alias("n")) for i, j in CELLS])
    return cells.select(F.inline(rows))


def wide_counts(counts: DataFrame, keys=()) -> DataFrame:
    """(keys, c00..c44, n) from long confusion counts."""
    cell = lambda i, j: F.sum(F.when((F.col("label") == i) & (F.col("pred") == j), F.col("n")).otherwise(0)).alias(f"c{i}{j}")
    return counts.groupBy(*keys).agg(*[cell(i, j) for i, j in CELLS], F.sum("n").alias("n"))


def _sum(terms):
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def _o(i, j):
    return F.col(f"c{i}{j}").cast("double")


def numerator():
    return _sum(_o(i, j) * WEIGHT[i][j] for i, j in CELLS if WEIGHT[i][j])


def denominator():
    row = [_sum(_o(i, j) for j in range(5)) for i in range(5)]
    col = [_sum(_o(i, j) for i in range(5)) for j in range(5)]
    return F.try_divide(_sum(row[i] * col[j] * WEIGHT[i][j] for i, j in CELLS if WEIGHT[i][j]), F.col("n").cast("double"))


def score_from_wide(x: DataFrame, keep=()) -> DataFrame:
    x = x.withColumns({"num": numerator(), "denom": denominator()})
    return x.withColumn("score", F.when(F.col("denom") > 0, 1 - F.col("num") / F.col("denom")))


def score(df: DataFrame, keys=(), label: str = "label", pred: str = "pred") -> DataFrame:
    """Score, accuracy, direction and extreme recall/precision per group."""
    return metrics(df, keys, label, pred).select(*keys, "score", "accuracy", "direction", "big_recall", "big_prec", "n")


def metrics(df: DataFrame, keys=(), label: str = "label", pred: str = "pred") -> DataFrame:
    return metrics_from_wide(wide_counts(confusion(df, keys, label, pred), keys), keys)


def metrics_from_wide(wide: DataFrame, keys=()) -> DataFrame:
    x = score_from_wide(wide)
    n = F.col("n").cast("double")
    share = lambda cells, total: F.try_divide(_sum(_o(i, j) for i, j in cells), total)
    side = lambda k: (k > 2) - (k < 2)
    moved = _sum(_o(i, j) for i, j in CELLS if i != 2)
    big_t = _sum(_o(i, j) for i, j in CELLS if i in (0, 4))
    big_p = _sum(_o(i, j) for i, j in CELLS if j in (0, 4))
    row = lambda i: _sum(_o(i, j) for j in range(5))
    flip = lambda i, j: F.coalesce(F.try_divide(_o(i, j), row(i)), F.lit(0.0))
    return x.select(
        *keys, "score",
        share([(i, i) for i in range(5)], n).alias("accuracy"),
        share([(i, j) for i, j in CELLS if i != 2 and side(i) == side(j)], moved).alias("direction"),
        share([(i, j) for i, j in CELLS if MAGNITUDE[i] == MAGNITUDE[j]], n).alias("magnitude_acc"),
        share([(0, 0), (4, 4)], big_t).alias("big_recall"), share([(0, 0), (4, 4)], big_p).alias("big_prec"),
        (flip(0, 4) + flip(4, 0)).alias("flip_index"), F.try_divide(_o(0, 4) + _o(4, 0), n).alias("flip_rate"),
        F.when(F.col("denom") > 0, 64 * (_o(0, 4) + _o(4, 0)) / F.col("denom")).alias("flip_loss_share"),
        F.try_divide(big_p, n).alias("pred_extreme"), F.try_divide(big_t, n).alias("true_extreme"), "n")


def loss_by_truth(df: DataFrame, keys=(), label: str = "label", pred: str = "pred") -> DataFrame:
    """Share of the lost score per true grade (they add up to 1 - score)."""
    x = score_from_wide(wide_counts(confusion(df, keys, label, pred), keys))
    loss = {f"loss_c{i}": F.when(F.col("denom") > 0, _sum(_o(i, j) * WEIGHT[i][j] for j in range(5)) / F.col("denom")) for i in range(5)}
    return x.select(*keys, "score", *[c.alias(k) for k, c in loss.items()])


def reference_strategies(df: DataFrame, key: str, label: str = "label", seed=0) -> DataFrame:
    """Rows times fixed strategies. The random one draws a grade from the label distribution through a
    hash point on its cumulative shares."""
    y = F.col(label)
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = [F.coalesce(F.sum(F.when(F.col(label) == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(5)]
    total = g.agg(*counts).select(F.array(*[f"n{k}" for k in range(5)])).scalar()
    x = df.withColumn("_c", total)
    point = F.pmod(hash_int(seed, key), F.aggregate("_c", F.lit(0).cast("long"), lambda a, b: a + b))
    cum = [F.aggregate(F.slice("_c", 1, k + 1), F.lit(0).cast("long"), lambda a, b: a + b) for k in range(4)]
    rnd = _sum((point >= c).cast("int") for c in cum).cast("int")
    side = F.when(y < 2, 1).when(y > 2, 3).otherwise(2)
    big = y.isin(0, 4)
    made = {"all_flat": F.lit(2), "all_surge": F.lit(4), "random": rnd, "direction_only": side,
            "extremes_only": F.when(big, y).otherwise(2), "extremes_inverted": F.when(big, 4 - y).otherwise(2), "perfect": y}
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), c.cast("int").alias("pred")) for s, c in made.items()])
    return x.select(key, label, F.inline(rows))


def flat_row_effect(df: DataFrame, key: str, fracs=(0.0, 0.05, 0.1, 0.2, 0.4), seed=0) -> DataFrame:
    """Score when the first share of truly flat rows in hash order is called a surge. Rank thresholds
    come from the split rank tables; each fraction then only adds up counts."""
    from ..operators.ranks import value_ranks
    flat = df.where(F.col("label") == 2).select(key, (hash_int(seed, key) / 2.0 ** 48).alias("_h"))
    ranks = value_ranks(flat, [], "_h").select("_h", F.col("_before").alias("_r"), "_n")
    x = df.join(flat.join(ranks, "_h").drop("_h"), key, "left")
    preds = F.array(*[F.struct(F.lit(float(f)).alias("frac"),
                               F.when(F.col("_r") < F.floor(F.col("_n") * F.lit(float(f))), 4).otherwise(F.col("pred")).alias("_p"))
                      for f in fracs])
    long = x.select("label", F.inline(preds))
    wide = wide_counts(confusion(long, ["frac"], "label", "_p"), ["frac"])
    return score_from_wide(wide).select("frac", "score", "num", "denom")
