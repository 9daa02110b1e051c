"""Rolling and recursive operators over one ordered series per key.

No window ever spans a whole series.  ``series_index`` numbers the rows through month
(or caller-given) blocks, ``split_series`` cuts each series into fixed runs of rows and
repeats the last ``reach`` rows of a run at the head of the next, so a rolling frame
finds its past inside its own run.  A key holding a third of all rows becomes many
partitions.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RUN_ROWS = 4096
SCAN_ROWS = 128


def series_index(df: DataFrame, keys, order: str, block: Column | None = None, out: str = "_i",
                 one_per_day: bool = False) -> DataFrame:
    """Zero-based row number per key, from block offsets plus the number inside the block.

    ``one_per_day`` states that (key, order) is one row per trading day: such a series is bounded
    by the calendar (about 250 rows a year) and is numbered by one window."""
    keys = list(keys)
    if one_per_day:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    block = F.trunc(F.col(order).cast("date"), "MM") if block is None else block
    x = df.withColumn("_blk", block)
    w = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, 0)
    offsets = (x.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_bn"))
               .select(*keys, "_blk", (F.sum("_bn").over(w) - F.col("_bn")).alias("_off")))
    inside = W.partitionBy(*keys, "_blk").orderBy(order)
    return (x.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_blk", "_off", "_rn"))


def split_series(df: DataFrame, index: str, reach: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add _run and _halo; rows another run needs as history are repeated there with _halo set."""
    run_rows = max(run_rows, reach)
    run = F.floor(F.col(index) / run_rows)
    late = F.col(index) % run_rows >= run_rows - reach
    runs = F.when(late, F.array(run, run + 1)).otherwise(F.array(run))
    return (df.withColumn("_run", F.explode(runs))
            .withColumn("_halo", F.floor(F.col(index) / run_rows) != F.col("_run")))


def over_runs(df: DataFrame, keys, index: str, reach: int, build, run_rows: int = RUN_ROWS) -> DataFrame:
    """Evaluate window columns on split series. ``build(w)`` gets the ordered window and returns
    a list of dicts {name: column}; later dicts may use earlier names."""
    x = split_series(df, index, reach, run_rows)
    w = W.partitionBy(*keys, "_run").orderBy(index)
    for step in build(w):
        x = x.withColumns(step)
    return x.where(~F.col("_halo")).drop("_run", "_halo")


def rolling(w, c, n: int, how: str, min_periods: int) -> Column:
    """Rolling aggregate of the last n rows, NULLs skipped, NULL below min_periods."""
    f = {"mean": F.avg, "std": F.stddev_samp, "pstd": F.stddev_pop, "sum": F.sum}[how]
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= min_periods, f(c).over(frame))


def sma(w, c, n: int) -> Column:
    return rolling(w, c, n, "mean", n)


def wma(w, c, n: int) -> Column:
    """Linear weights, today's row weighs n."""
    total = sum(((n - i) * (F.lag(c, i).over(w) if i else c) for i in range(1, n)), n * c)
    return total / (n * (n + 1) / 2)


def true_range(w, high, low, close) -> Column:
    prev = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - prev), F.abs(F.col(low) - prev))


def span_to_alpha(n: float) -> float:
    return 2.0 / (n + 1.0)


def alpha_to_span(alpha: float) -> float:
    return 2.0 / alpha - 1.0


def scan_rows(decays) -> int:
    """Rows of a scan block: SCAN_ROWS, or so few that no decay's inverse leaves double range inside a block."""
    return min([SCAN_ROWS, *(max(1, int(300 / -math.log(d))) for d in decays if 0 < d < 1)])


def _carried(blocks: DataFrame, keys: list, end: str, d: float, out: str, rows: int) -> DataFrame:
    """What earlier blocks leave at the start of each block: carry = end + d**rows * carry, over all of them.

    Again a linear recurrence, so blocks form runs inside which powers stay within double range. A run is closed as
    a running sum; the run before it enters by its total. Runs further back weigh less than exp(-300).
    """
    if d <= 0:
        return blocks.withColumn(out, F.coalesce(F.lag(end).over(W.partitionBy(*keys).orderBy("_blk")), F.lit(0.0)))
    rate = -rows * math.log(d)  # decay per block, as an exponent
    size = max(1, int(min(300 / rate, 1 << 40))) if rate > 0 else 1 << 40
    x = blocks.withColumn("_run", F.floor(F.col("_blk") / size)).withColumn("_q", (F.col("_blk") % size).cast("double"))
    v = F.coalesce(end, F.lit(0.0))
    power = lambda e: F.exp(-rate * e)
    inside = W.partitionBy(*keys, "_run").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(v * F.exp(rate * F.col("_q"))).over(inside), F.lit(0.0)) * power(F.col("_q") - 1)
    total = x.groupBy(*keys, (F.col("_run") + 1).alias("_run")).agg(F.sum(v * power(F.lit(float(size - 1)) - F.col("_q"))).alias("_total"))
    x = x.withColumn("_own", own).join(total, [*keys, "_run"], "left")
    return x.withColumn(out, F.col("_own") + F.coalesce("_total", F.lit(0.0)) * power(F.col("_q"))).drop("_run", "_q", "_own", "_total")


def ema(df: DataFrame, keys, index: str, inputs: dict, alphas: dict) -> DataFrame:
    """Recursive smoothing s = a*x + (1-a)*s, all columns of ``inputs`` in one scan.

    inputs: {out: (value column, seed index, seed value column or None)}, alphas: {out: a}.
    Rows before the seed index are NULL; the seed row is the seed value (default: the value).

    The recurrence is linear, so it is evaluated in blocks of at most SCAN_ROWS rows: inside a block as
    a running sum of x scaled by powers of (1-a), across blocks as the same sum over block
    ends.  The closer a is to 1, the shorter the blocks, so that no power overflows.  A missing input makes the
    rest of that series NULL, as the recursion would.
    """
    keys = list(keys)
    rows = scan_rows([1.0 - alphas[out] for out in inputs])
    x = df.withColumn("_blk", F.floor(F.col(index) / rows)).withColumn("_p", F.col(index) % rows)
    run = W.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    ends = []
    for out, (val, seed_at, seed) in inputs.items():
        a, d = alphas[out], 1.0 - alphas[out]
        v = F.col(val).cast("double")
        u = (F.when(F.col(index) < seed_at, F.lit(0.0))
             .when(F.col(index) == seed_at, (F.col(seed) if seed else v) / a).otherwise(v))
        x = x.withColumn(f"_u_{out}", u)
        bad = F.sum(F.when(F.col(f"_u_{out}").isNull() | F.isnan(f"_u_{out}"), 1).otherwise(0)).over(run)
        if d > 0:
            local = F.sum(F.col(f"_u_{out}") * a * F.pow(F.lit(1 / d), F.col("_p"))).over(run) \
                * F.pow(F.lit(d), F.col("_p"))
        else:
            local = F.col(f"_u_{out}") * a
        x = x.withColumn(f"_l_{out}", local).withColumn(f"_x_{out}", bad)
        ends += [F.max_by(f"_l_{out}", index).alias(f"_e_{out}"), F.max(f"_x_{out}").alias(f"_n_{out}")]
    blocks = x.groupBy(*keys, "_blk").agg(*ends)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    for out in inputs:
        blocks = (_carried(blocks, keys, f"_e_{out}", 1.0 - alphas[out], f"_c_{out}", rows)
                  .withColumn(f"_b_{out}", F.coalesce(F.sum(f"_n_{out}").over(before), F.lit(0))))
    x = x.join(blocks.drop(*[f"_e_{o}" for o in inputs], *[f"_n_{o}" for o in inputs]), [*keys, "_blk"])
    for out, (_, seed_at, _) in inputs.items():
        d = 1.0 - alphas[out]
        s = F.col(f"_l_{out}") + F.col(f"_c_{out}") * F.pow(F.lit(d), F.col("_p") + 1)
        ok = (F.col(index) >= seed_at) & (F.col(f"_x_{out}") + F.col(f"_b_{out}") == 0)
        x = x.withColumn(out, F.when(ok, s))
    scratch = [f"_{t}_{o}" for o in inputs for t in ("u", "l", "x", "c", "b")]
    return x.drop("_blk", "_p", *scratch)
