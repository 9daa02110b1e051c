"""Column builders: grades, clipping, null-safe arithmetic, seeded hashing."""

from functools import reduce

from pyspark.sql import Column, functions as F

from ..fixed import FLAT, RET_CUTS, WEIGHT


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_of(c, bounds) -> Column:
    """How many of the ascending bounds are <= the value (left-closed bins); NULL stays NULL."""
    c = as_col(c)
    return reduce(lambda a, b: a + b, [(c >= F.lit(float(b))).cast("int") for b in bounds])


def grade(c, cuts=RET_CUTS) -> Column:
    return bucket_of(c, cuts)


def grade_or_flat(c, bounds) -> Column:
    return F.coalesce(bucket_of(c, bounds), F.lit(FLAT))


def clip(c, lo=None, hi=None) -> Column:
    """Clamp, keeping NULL (greatest/least alone would skip it)."""
    c = as_col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio_change(num, den) -> Column:
    return F.try_divide(as_col(num), as_col(den)) - 1


def clipped_change(num, den, bound) -> Column:
    """clip(num/den - 1, +-bound); a zero denominator gives the limit's bound, 0/0 gives NULL."""
    num, den = as_col(num), as_col(den)
    limit = F.when(num > 0, F.lit(float(bound))).when(num < 0, F.lit(-float(bound)))
    return F.when(den == 0, limit).otherwise(clip(ratio_change(num, den), -bound, bound))


def is_extreme(label) -> Column:
    return as_col(label).isin(0, 4)


def missing_flag(c) -> Column:
    return as_col(c).isNull().cast("double")


def sign_agreement(a, b) -> Column:
    """sign(a)*sign(b) as a number, missing -> 0."""
    return F.coalesce(F.signum(as_col(a)) * F.signum(as_col(b)), F.lit(0.0))


def agreement_class(sign, gap) -> Column:
    """no_event / same_dir / opposite / gap_0."""
    s, g = as_col(sign), as_col(gap)
    prod = F.signum(s) * F.signum(g)
    return (F.when(s.isNull() | (s == 0), "no_event").when(prod > 0, "same_dir")
            .when(prod < 0, "opposite").otherwise("gap_0"))


def hash_int(*cols) -> Column:
    """Seeded, engine-independent 48-bit hash: stands in for random draws."""
    text = F.concat_ws("|", *[as_col(c).cast("string") if not isinstance(c, (int, float)) else F.lit(str(c))
                              for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def argmax_label(cols, names) -> Column:
    """Name of the largest column, first one on ties."""
    arr = F.array(*[as_col(c) for c in cols])
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_max(arr)).cast("int"))


def expected_penalty_label(probs) -> Column:
    """Grade with the smallest expected weighted penalty under the class probabilities."""
    probs = [as_col(p) for p in probs]
    costs = F.array(*[reduce(lambda a, b: a + b, [p * float(WEIGHT[i][j]) for i, p in enumerate(probs)])
                      for j in range(5)])
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def r6(c, digits=6) -> Column:
    """Rounded copy without negative zero, for comparisons between engines."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)
