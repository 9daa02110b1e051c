"""Output contract and equality of two ways to compute the same panel."""


from pyspark.sql import DataFrame, functions as F


def check_output(pred: DataFrame, expected: DataFrame, keys=("symbol",), label: str = "label") -> DataFrame:
    """Violations by kind: bad labels, repeated keys, missing and extra keys. Empty kinds count zero."""
    keys = list(keys)
    if set(pred.columns) != {*keys, label}:
        raise ValueError(f"columns {pred.columns}, need exactly {[*keys, label]}")
    y = F.col(label)
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(y.isNull() | ~y.isin(0, 1, 2, 3, 4)).alias("_bad"))
    e = expected.select(*keys).distinct().withColumn("_want", F.lit(1))
    x = p.join(e, keys, "full")
    s = x.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_label"), F.count_if(F.col("_n") > 1).alias("duplicate"),
              F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("extra"))
    return s.unpivot([], ["bad_label", "duplicate", "missing", "extra"], "kind", "n")


def compare_panels(a: DataFrame, b: DataFrame, keys, numeric, exact=(), tol: float = 1e-9) -> DataFrame:
    """One row per column: rows only on one side, null-position mismatches, largest difference, violations."""
    keys = list(keys)
    left = a.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"a_{c}") for c in [*numeric, *exact]])
    right = b.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"b_{c}") for c in [*numeric, *exact]])
    x = left.join(right, keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    rows = []
    for c in [*numeric, *exact]:
        u, v = F.col(f"a_{c}"), F.col(f"b_{c}")
        diff = F.abs(u - v) if c in numeric else (~u.eqNullSafe(v)).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count_if(~both).alias("unmatched"),
                             F.count_if(both & (u.isNull() != v.isNull())).alias("null_mismatch"),
                             F.coalesce(F.max(diff), F.lit(0.0)).alias("max_diff"), F.count_if(both & (diff > tol)).alias("violations")))
    return x.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def no_bar_at_cutoff(price: DataFrame, used: DataFrame) -> DataFrame:
    """Bars at or after 09:00 of the target day that a gap computation would have read (must be zero)."""
    late = price.where((F.col("session") == "pre") & (F.hour("datetime") >= 9))
    from ..operators.calendar import at_cutoff
    known = late.where(F.col("known_at") < at_cutoff(F.to_date("datetime")))
    return known.join(used.select("symbol"), "symbol", "left_semi").agg(F.count(F.lit(1)).alias("late_bars"))
