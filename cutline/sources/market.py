"""Market-shaped tables derived from the star-schema test tables.

Each property is a lazy DataFrame over whole input tables; nothing is subset or cached.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import ratio_change
from ..operators.calendar import trading_calendar
from ..session import cut_lineage, local_table

SYMBOLS = [f"S{i:02d}" for i in range(10)]
ALIASES = {s: [f"Company {chr(65 + i)}"] for i, s in enumerate(SYMBOLS) if i < 8}
LEXICON = {"positive": ["BEATS", "HE", "ON", "AN", "EST"], "negative": ["TRIMS", "THE", "ION", "LA"],
           "uncertainty": ["TALKS", "AND", "ER"]}
CUTS = (-25.0, -6.0, 6.0, 25.0)


def symbol_of(c) -> F.col:
    return F.concat(F.lit("S"), F.lpad((F.col(c) % 10).cast("string"), 2, "0"))


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        """A whole input table."""
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def price(self) -> DataFrame:
        hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
        h = F.hour("datetime")
        return (self.raw("events").groupBy(symbol_of("user_id").alias("symbol"), hour.alias("datetime"))
                .agg(F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).alias("volume"))
                .withColumn("session", F.when(h <= 9, "pre").when(h <= 15, "regular").otherwise("post"))
                .withColumn("known_at", F.col("datetime") + F.when(h == 9, F.expr("INTERVAL '30' MINUTE"))
                            .otherwise(F.expr("INTERVAL '60' MINUTE"))))

    @staticmethod
    def _with_returns(b: DataFrame) -> DataFrame:
        """One row per symbol and day, so the window is bounded by the calendar."""
        prev = F.lag("close").over(W.partitionBy("symbol").orderBy("date_et"))
        return b.withColumns({"prev_close": prev, "ret": ratio_change("close", prev)})

    @cached_property
    def daily(self) -> DataFrame:
        b = self.raw("events").groupBy(symbol_of("user_id").alias("symbol"), F.to_date("ts").alias("date_et")).agg(
            F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.round(F.avg("value"), 6).alias("close"), F.count(F.lit(1)).alias("volume"))
        return self._with_returns(b).withColumn(
            "known_at", F.col("date_et").cast("timestamp_ntz") + F.expr("INTERVAL '16' HOUR"))

    @cached_property
    def daily_w(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        b = (self.raw("lineitem").groupBy(symbol_of("l_suppkey").alias("symbol"),
                                          F.trunc("l_shipdate", "week").alias("date_et"))
             .agg(F.min_by(unit, F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("open"),
                  F.max(unit).alias("high"), F.min(unit).alias("low"),
                  F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"),
                  F.sum("l_quantity").alias("volume")))
        return self._with_returns(b)

    @cached_property
    def cal(self) -> DataFrame:
        return trading_calendar(self.daily)

    @cached_property
    def cal_w(self) -> DataFrame:
        return trading_calendar(self.daily_w)

    @cached_property
    def orders_ev(self) -> DataFrame:
        est = (F.col("o_custkey") % 100) / 10.0
        rep = F.col("o_totalprice") / 50000
        act = (F.when(F.col("o_orderpriority") == "1-URGENT", "up").when(F.col("o_orderpriority") == "5-LOW", "down")
               .when(F.col("o_orderpriority") == "2-HIGH", "init").otherwise("main"))
        return self.raw("orders").select(
            symbol_of("o_custkey").alias("symbol"), F.col("o_orderdate").alias("known_at"), "o_orderkey",
            est.alias("eps_estimate"), rep.alias("eps_reported"),
            ((F.try_divide(rep, est) - 1) * 100).alias("surprise_pct"), act.alias("action"),
            F.col("o_totalprice").alias("target_current"), ((F.col("o_custkey") % 40) * 8000.0).alias("target_prior"))

    @cached_property
    def events_month(self) -> DataFrame:
        """The same events, spread over the month of the hourly bars."""
        at = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
              + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("o_orderkey") * 7919) % 43200).cast("int")))
        return self.orders_ev.withColumn("known_at", at)

    @cached_property
    def news(self) -> DataFrame:
        d = F.col("doc_id")
        one = lambda x: (x % 10).cast("string")
        head = (F.when(d % 5 == 0, F.concat(F.lit("S0"), one(d), F.lit(" beats earnings forecast: ")))
                .when(d % 5 == 1, F.concat(F.lit("$S0"), one(d), F.lit(" and S0"), one(d * 3 + 1), F.lit(" merger talks; ")))
                .when(d % 5 == 2, F.concat(F.lit("Company "), F.chr(65 + d % 10), F.lit(" appoints CEO, ")))
                .when(d % 5 == 3, F.concat(F.lit("Fund trims stake in S0"), one(d * 7 + 3), F.lit(" ")))
                .otherwise(F.lit("")))
        return self.raw("documents").select(
            "doc_id", F.concat(F.lit("S0"), one(d), F.lit(",S0"), one(d * 7 + 3)).alias("symbols"), "source", "lang",
            F.concat(F.lit("u"), d.cast("string")).alias("url"), F.concat(head, F.col("text")).alias("title"),
            ((F.col("n_chars") % 21) - 10).cast("double").alias("tone"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(F.lit(0), F.lit(0), ((d * 7919) % 43200).cast("int"))).alias("known_at"))

    @cached_property
    def forum(self) -> DataFrame:
        tag = F.concat(F.lit("$S0"), (F.col("conv_id") % 10).cast("string"), F.lit(" vs S0"),
                       (F.col("turn") % 10).cast("string"), F.lit(" "))
        return self.raw("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("post_id"), "conv_id", "turn", F.col("role").alias("sub"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
                F.lit(0), F.lit(0), ((F.col("conv_id") * 7919 + F.col("turn") * 37) % 43200).cast("int"))).alias("created_et"),
            F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Thread on $S0"), ((F.col("conv_id") * 3 + 1) % 10).cast("string")))
                   .otherwise("Daily talk")).alias("title"),
            F.when(F.col("conv_id") % 2 == 0, F.concat(tag, F.col("text"))).otherwise(F.col("text")).alias("body"))

    @cached_property
    def universe(self) -> DataFrame:
        return cut_lineage(self.daily.select("symbol").distinct())

    @cached_property
    def universe_w(self) -> DataFrame:
        return cut_lineage(self.daily_w.select("symbol").distinct())

    @cached_property
    def aliases(self) -> DataFrame:
        rows = [(s, n) for s, ns in ALIASES.items() for n in ns]
        return local_table(self.spark, {"symbol": [r[0] for r in rows], "name": [r[1] for r in rows]})

    @cached_property
    def lexicon(self) -> DataFrame:
        rows = [(c, w) for c, ws in LEXICON.items() for w in ws]
        return local_table(self.spark, {"category": [r[0] for r in rows], "word": [r[1] for r in rows]})

    @cached_property
    def patterns(self) -> DataFrame:
        from ..operators.textblock import mention_patterns
        return mention_patterns(self.spark, SYMBOLS, ALIASES)
