"""Trading calendar, windows of knowability, and assignment of events to them."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed import CUTOFF_INTERVAL
from ..session import cut_lineage


def at_cutoff(day) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    return day.cast("timestamp_ntz") + F.expr(CUTOFF_INTERVAL)


def trading_calendar(daily: DataFrame, date: str = "date_et", start=None) -> DataFrame:
    """(date, target, lo, cutoff, widx): base day, next trading day, window [lo, cutoff), ordinal.

    The window runs over distinct dates only (a few hundred per year), never over rows. The result is
    written once: every raw table is joined to it, and by its file size the planner knows that it can be broadcast.
    """
    w = W.orderBy("date")
    days = daily.select(F.col(date).cast("date").alias("date")).distinct()
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    cal = (days.withColumn("target", F.lead("date").over(w))
           .withColumn("widx", (F.row_number().over(w) - 1).cast("int"))
           .where(F.col("target").isNotNull()))
    return cut_lineage(cal).select("date", "target", at_cutoff("date").alias("lo"), at_cutoff("target").alias("cutoff"), "widx")


def strict_after_calendar(cal: DataFrame) -> DataFrame:
    """Variant whose window starts at the previous cutoff; the first window is dropped."""
    w = W.orderBy("target")
    return cal.withColumn("lo", F.lag("cutoff").over(w)).where(F.col("lo").isNotNull())


def assign_window(events: DataFrame, cal: DataFrame, ts: str, how: str = "inner") -> DataFrame:
    """Give each event the first target whose cutoff is strictly after it (window [lo, cutoff)).

    Each window is spread over its calendar days and joined on the day, the exact bounds stay
    as a residual condition: an equi-join Spark can broadcast or skew-split by measured size
    instead of a nested loop.
    """
    days = (cal.select("date", "target", "lo", "cutoff", "widx",
                       F.explode(F.sequence(F.to_date("lo"), F.to_date("cutoff"))).alias("_day"))
            .withColumnsRenamed({"date": "_wdate"}))
    t = F.col(ts)
    joined = events.withColumn("_eday", F.to_date(t)).join(
        days, (F.col("_eday") == F.col("_day")) & (t >= F.col("lo")) & (t < F.col("cutoff")), how)
    return joined.drop("_eday", "_day", "lo", "cutoff").withColumnRenamed("_wdate", "date")


def dense_grid(keys: DataFrame, key: str, cal: DataFrame) -> DataFrame:
    """Every (key, widx) pair with its target: one row per panel cell.

    The ordinals are generated inside each key's row and matched to the calendar by equality.
    """
    last = cal.agg(F.max("widx")).scalar()
    cells = (keys.select(key).distinct().withColumn("_last", last)
             .select(key, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("widx")))
    return cells.join(cal.select("widx", "target"), "widx")


def window_start(cal: DataFrame, days: int | None = None, hours: int | None = None, since=None) -> DataFrame:
    """Start of the readable span for each target: explicit, hours before cutoff, or n trading
    days counted back including the base day (clamped to the first date)."""
    if since is not None:
        start = F.lit(since).cast("timestamp_ntz")
    elif hours is not None:
        start = F.col("cutoff") - F.make_dt_interval(F.lit(0), F.lit(int(hours)))
    else:
        w = W.orderBy("date")
        first = F.min("date").over(w.rowsBetween(-(int(days) - 1), 0))
        start = first.cast("timestamp_ntz")
    return cal.withColumn("since", start)


def eligible_days(cal: DataFrame, start=None, until=None) -> DataFrame:
    out = cal
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if until is not None:
        out = out.where(F.col("date") < F.lit(until).cast("date"))
    return out
