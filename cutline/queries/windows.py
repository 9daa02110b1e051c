"""2.5 window functions and indicators."""

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import indicators as I, sequences as Q
from ..operators.events import abnormal_counts, news_block
from ..operators.forum import ewm_abnormal, forum_counts
from ..operators.ranks import loo_median, rank_pct
from ..operators.series import alpha_to_span, ema, over_runs, rolling, series_index, span_to_alpha
from ..plans.panel import daily_block
from .base import R, W, query
from .joins import gap_rows

WS = "WINDOW s AS (PARTITION BY symbol ORDER BY date_et)"


def roll_sql(f, c, n, mp):
    fr = f"OVER (PARTITION BY symbol ORDER BY date_et ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {fr} >= {mp} THEN {f}({c}) {fr} END"


def weekly(m, *cols):
    return series_index(m.daily_w, ["symbol"], "date_et").select("symbol", "date_et", "_i", *cols)


def out(df, *cols, digits=6):
    return df.select("symbol", "date_et", *[r6(c, digits).alias(c) for c in cols])


@query("W1_lead_lag", W("daily_w", body=f"""SELECT symbol, date_et, lead(date_et) OVER s AS next_day, {R('lag(close) OVER s')} AS prev FROM daily_w {WS}"""))
def _(m):
    x = over_runs(weekly(m, "close"), ["symbol"], "_i", 1, lambda w: [{"prev": F.lag("close").over(w)}])
    nxt = weekly(m).select("symbol", F.col("date_et").alias("next_day"), (F.col("_i") - 1).alias("_i"))
    return x.join(nxt, ["symbol", "_i"], "left").select("symbol", "date_et", "next_day", r6("prev").alias("prev"))


@query("W2_rolling_std_mean", W("daily_w", body=f"""SELECT symbol, date_et, {R(roll_sql('stddev_samp', 'ret * 100', 5, 2), 5)} AS vol5,
  {R(roll_sql('stddev_samp', 'ret * 100', 20, 10), 5)} AS vol20, {R(roll_sql('avg', 'ret * 100', 60, 30), 5)} AS mean60 FROM daily_w"""))
def _(m):
    r = F.col("ret") * 100
    x = over_runs(weekly(m, "ret"), ["symbol"], "_i", 59, lambda w: [{
        "vol5": rolling(w, r, 5, "std", 2), "vol20": rolling(w, r, 20, "std", 10), "mean60": rolling(w, r, 60, "mean", 30)}], run_rows=128)
    return x.select("symbol", "date_et", *[r6(c, 5).alias(c) for c in ("vol5", "vol20", "mean60")])


TR = "greatest(high - low, abs(high - prev_close), abs(low - prev_close))"
@query("W3_true_range_mean", W("daily_w", body=f"""SELECT symbol, date_et, {R(roll_sql('avg', f'({TR} / close * 100)', 14, 7))} AS atr14 FROM daily_w"""))
def _(m):
    x = weekly(m, "high", "low", "prev_close", "close").withColumn("_tr", F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))) / F.col("close") * 100)
    return out(over_runs(x, ["symbol"], "_i", 13, lambda w: [{"atr14": rolling(w, F.col("_tr"), 14, "mean", 7)}]), "atr14")


def fold_sql(alpha, value="close", src="daily_w"):
    """Recursive smoothing as a DuckDB list fold over the ordered series."""
    return f"""SELECT symbol, unnest(ds) AS date_et, unnest(sm) AS v FROM (SELECT symbol, ds,
  list_transform(range(1, len(xs) + 1), lambda k: list_reduce(xs[1:k], lambda s, x: {alpha!r} * x + (1 - {alpha!r}) * s)) AS sm
  FROM (SELECT symbol, list({value} ORDER BY date_et) AS xs, list(date_et ORDER BY date_et) AS ds FROM {src} GROUP BY 1))"""


@query("W3_true_range_ewm", W("daily_w", body=f"""SELECT symbol, date_et, {R('v')} AS atr14 FROM (
  {fold_sql(1 / 14, f'{TR} / close')})"""))
def _(m):
    x = weekly(m, "high", "low", "prev_close", "close").withColumn("_tr", F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))) / F.col("close"))
    return out(ema(x, ["symbol"], "_i", {"atr14": ("_tr", 0, None)}, {"atr14": 1 / 14}), "atr14")


@query("W4_big_move_rate", W("daily_w", body=f"""SELECT symbol, date_et, {R(roll_sql('avg', 'CASE WHEN ret IS NOT NULL THEN CAST((ret * 100 < -2.5 OR ret * 100 >= 2.5) AS INT) END', 60, 30))} AS big_rate60 FROM daily_w"""))
def _(m):
    r = F.col("ret") * 100
    b = F.when(r.isNotNull(), ((r < -2.5) | (r >= 2.5)).cast("double"))
    return out(over_runs(weekly(m, "ret"), ["symbol"], "_i", 59, lambda w: [{"big_rate60": rolling(w, b, 60, "mean", 30)}]), "big_rate60")


@query("W5_rolling_beta", W("daily_w", body=f"""SELECT symbol, date_et, {R('coalesce(0.5 * (exm - ex * em) / NULLIF(emm - em * em, 0) + 0.5, 1.0)', 5)} AS beta60 FROM (
  SELECT symbol, date_et, {roll_sql('avg', 'r', 60, 30)} AS ex, {roll_sql('avg', 'mk', 60, 30)} AS em,
  {roll_sql('avg', 'r * mk', 60, 30)} AS exm, {roll_sql('avg', 'mk * mk', 60, 30)} AS emm FROM (
  SELECT d.symbol, d.date_et, d.ret * 100 AS r, (SELECT CASE WHEN count(o.ret) >= 3 THEN median(o.ret * 100) END FROM daily_w o
   WHERE o.date_et = d.date_et AND o.symbol <> d.symbol) AS mk FROM daily_w d))"""))
def _(m):
    return daily_block(m.daily_w).select("symbol", F.col("date").alias("date_et"), r6("beta60", 5).alias("beta60"))


for _name, _others, _rows, _cond in (("W6_loo_median", 3, 0, "count(o.ret) >= 3"),
                                     ("W6_loo_median_exploratory", 1, 3, "(SELECT count(*) FROM daily_w g WHERE g.date_et = d.date_et) >= 3")):
    @query(_name, W("daily_w", body=f"""SELECT d.symbol, d.date_et, {R('m', 8)} AS mkt FROM (SELECT d.symbol, d.date_et,
      (SELECT CASE WHEN {_cond} THEN median(o.ret) END FROM daily_w o WHERE o.date_et = d.date_et AND o.symbol <> d.symbol) AS m FROM daily_w d) d"""))
    def _(m, others=_others, rows=_rows):
        x = loo_median(m.daily_w, ["date_et"], "ret", "mkt", others, rows)
        return x.select("symbol", "date_et", r6("mkt", 8).alias("mkt"))


@query("W7_rank_pct", f"""SELECT event_id, {R('''(rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0)
  / count(*) OVER (PARTITION BY event_type)''', 9)} AS r FROM (SELECT event_id, event_type, round(value, 0) AS v FROM events)""")
def _(m):
    x = m.raw("events").select("event_id", "event_type", F.round("value", 0).alias("v"))
    return rank_pct(x, ["event_type"], "v", "r").select("event_id", r6("r", 9).alias("r"))


@query("W8_pct_changes", W("daily_w", body=f"""SELECT symbol, date_et, {R('close / lag(close, 1) OVER s - 1', 8)} AS ret1, {R('close / lag(close, 5) OVER s - 1', 8)} AS ret5 FROM daily_w {WS}"""))
def _(m):
    x = I.pct_changes(weekly(m, "close"), ["symbol"], "_i", "close")
    return x.select("symbol", "date_et", r6("ret1", 8).alias("ret1"), r6("ret5", 8).alias("ret5"))


NEWS_GRID = """SELECT symbol, widx, target, coalesce(n, 0.0) AS n FROM grid LEFT JOIN (SELECT symbol, target, CAST(count(*) AS DOUBLE) AS n FROM news_u GROUP BY ALL) USING (symbol, target)"""


@query("W9_abnormal_count", W("grid", "news_u", body=f"""SELECT symbol, target, {R('ln(1 + n) - ln(1 + CASE WHEN count(n) OVER w >= 20 THEN avg(n) OVER w END)')} AS news_abn
  FROM ({NEWS_GRID}) WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def _(m):
    return news_block(m.news, m.cal, m.universe).select("symbol", "target", r6("news_abn").alias("news_abn"))


FORUM_T = "SELECT f.*, c.target, c.widx FROM forum f JOIN cal c ON f.created_et >= c.lo AND f.created_et < c.cutoff"


@query("W10_abnormal_count_ewm", W("cal", "forum", body=f"""SELECT sub, target, items, {R('ln(1 + items) - ln(1 + lag(v) OVER (PARTITION BY sub ORDER BY target))')} AS items_abn FROM (
  SELECT sub, unnest(ds) AS target, unnest(xs) AS items, unnest(sm) AS v FROM (SELECT sub, ds, xs,
  list_transform(range(1, len(xs) + 1), lambda k: list_reduce(xs[1:k], lambda s, x: {2 / 21!r} * x + (1 - {2 / 21!r}) * s)) AS sm
  FROM (SELECT sub, list(items ORDER BY target) AS xs, list(target ORDER BY target) AS ds FROM (SELECT g.sub, g.target, CAST(coalesce(n, 0) AS DOUBLE) AS items
   FROM (SELECT DISTINCT role AS sub, target FROM conversations, cal) g LEFT JOIN (SELECT sub, target, count(*) AS n FROM ({FORUM_T}) GROUP BY ALL) USING (sub, target)) GROUP BY 1)))"""))
def _(m):
    _, act = forum_counts(m.forum, m.cal, m.universe)
    return ewm_abnormal(act, "sub", "items", m.cal).select("sub", "target", "items", r6("items_abn").alias("items_abn"))


@query("W11_coverage_missing", W("grid", "news_u", body=f"""SELECT symbol, target, CASE WHEN count(n) OVER w >= 21 AND sum(n) OVER w = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS news_missing
  FROM (SELECT symbol, widx, target, CASE WHEN symbol IN ('S02', 'S03') THEN 0.0 ELSE n END AS n FROM ({NEWS_GRID}))
  WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS 20 PRECEDING)"""))
def _(m):
    x = news_block(m.news.where("true"), m.cal, m.universe).join(m.cal.select("target", "widx"), "target")
    x = x.select("symbol", "target", "widx", F.when(F.col("symbol").isin("S02", "S03"), 0.0).otherwise(F.col("news_n")).alias("n"))
    return abnormal_counts(x, ["n"], missing={"news_missing": "n"}).select("symbol", "target", "news_missing")


@query("W12_ema_wilder", W("daily_w", body=f"""SELECT a.symbol, a.date_et, {R('a.v')} AS ema12, {R('b.v')} AS wilder14 FROM ({fold_sql(span_to_alpha(12))}) a
  JOIN ({fold_sql(1 / 14)}) b USING (symbol, date_et)"""))
def _(m):
    assert abs(alpha_to_span(span_to_alpha(12)) - 12) < 1e-12
    x = ema(weekly(m, "close"), ["symbol"], "_i", {"ema12": ("close", 0, None), "wilder14": ("close", 0, None)},
            {"ema12": span_to_alpha(12), "wilder14": 1 / 14})
    return out(x, "ema12", "wilder14")


@query("W13_sma", W("daily_w", body=f"SELECT symbol, date_et, {R(roll_sql('avg', 'close', 20, 20), 9)} AS sma20 FROM daily_w"))
def _(m):
    return out(I.moving_averages(weekly(m, "close"), ["symbol"], "_i", "close", 20, 2), "sma20", digits=9)


@query("W14_wma", W("daily_w", body="SELECT symbol, date_et, " + R("(" + " + ".join(f"{10 - i} * lag(close, {i}) OVER s" for i in range(10)) + ") / 55.0") + f" AS wma10 FROM daily_w {WS}"))
def _(m):
    return out(I.moving_averages(weekly(m, "close"), ["symbol"], "_i", "close", 2, 10), "wma10")


@query("W15_macd", W("daily_w", body=f"""SELECT s.symbol, s.date_et, {R('l.v')} AS macd, {R('s.v')} AS signal, {R('l.v - s.v')} AS hist, {R('l.v / close', 8)} AS macd_over_close FROM (
  WITH line AS (SELECT f.symbol, f.date_et, f.v - g.v AS v FROM ({fold_sql(2 / 13)}) f JOIN ({fold_sql(2 / 27)}) g USING (symbol, date_et))
  SELECT symbol, date_et, v FROM ({fold_sql(2 / 10, 'v', 'line')})) s
  JOIN (SELECT f.symbol, f.date_et, f.v - g.v AS v FROM ({fold_sql(2 / 13)}) f JOIN ({fold_sql(2 / 27)}) g USING (symbol, date_et)) l USING (symbol, date_et)
  JOIN daily_w USING (symbol, date_et)"""))
def _(m):
    x = I.macd(weekly(m, "close"), ["symbol"], "_i", "close")
    return x.select("symbol", "date_et", *[r6(c).alias(c) for c in ("macd", "signal", "hist")], r6("macd_over_close", 8).alias("macd_over_close"))


def wilder_sql(expr, n=14):
    """Wilder average seeded on row n with the mean of rows 1..n (row 0 has no move)."""
    return f"""SELECT symbol, unnest(ds[{n + 1}:]) AS date_et, unnest(list_transform(range(1, len(ys) + 1), lambda k:
  list_reduce(ys[1:k], lambda s, x: (s * {n - 1} + x) / {n}))) AS v FROM (SELECT symbol, ds, [list_avg(xs[2:{n + 1}])] || xs[{n + 2}:] AS ys
  FROM (SELECT symbol, list({expr} ORDER BY date_et) AS xs, list(date_et ORDER BY date_et) AS ds FROM daily_w GROUP BY 1) WHERE len(xs) > {n})"""


@query("W16_rsi", W("daily_w", body=f"""SELECT d.symbol, d.date_et, {R('g.v', 5)} AS avg_gain, {R('l.v', 5)} AS avg_loss,
  {R('CASE WHEN g.v IS NULL THEN NULL WHEN l.v > 0 THEN 100.0 - 100.0 / (1.0 + g.v / l.v) ELSE 100.0 END', 5)} AS rsi FROM daily_w d
  LEFT JOIN ({wilder_sql('coalesce(greatest(close - prev_close, 0), 0)')}) g USING (symbol, date_et)
  LEFT JOIN ({wilder_sql('coalesce(greatest(prev_close - close, 0), 0)')}) l USING (symbol, date_et)"""))
def _(m):
    x = I.rsi(weekly(m, "close"), ["symbol"], "_i", "close")
    return x.select("symbol", "date_et", r6("avg_gain", 5).alias("avg_gain"), r6("avg_loss", 5).alias("avg_loss"), r6("rsi", 5).alias("rsi"))


@query("W17_true_range", W("daily_w", body=f"SELECT symbol, date_et, {R(TR, 8)} AS tr FROM daily_w"))
def _(m):
    return out(I.with_true_range(weekly(m, "high", "low", "close"), ["symbol"], "_i"), "tr", digits=8)


@query("W18_atr", W("daily_w", body=f"""SELECT d.symbol, d.date_et, {R('a.v')} AS atr, {R('a.v / close', 8)} AS atr_over_close FROM daily_w d
  LEFT JOIN ({wilder_sql(TR)}) a USING (symbol, date_et)"""))
def _(m):
    x = I.atr(weekly(m, "high", "low", "close"), ["symbol"], "_i")
    return x.select("symbol", "date_et", r6("atr").alias("atr"), r6("atr_over_close", 8).alias("atr_over_close"))


@query("W19_bollinger", W("daily_w", body=f"""SELECT symbol, date_et, {R('mid', 9)} AS middle, {R('sd', 5)} AS sd, {R('mid + 2 * sd', 5)} AS upper, {R('mid - 2 * sd', 5)} AS lower,
  {R('(close - (mid - 2 * sd)) / NULLIF(4 * sd, 0)', 5)} AS pct_b, {R('4 * sd / NULLIF(mid, 0)', 5)} AS band_width FROM (
  SELECT *, {roll_sql('avg', 'close', 20, 20)} AS mid, {roll_sql('stddev_samp', 'close', 20, 20)} AS sd FROM daily_w)"""))
def _(m):
    x = I.bollinger(weekly(m, "close"), ["symbol"], "_i", "close")
    return x.select("symbol", "date_et", r6("middle", 9).alias("middle"), *[r6(c, 5).alias(c) for c in ("sd", "upper", "lower", "pct_b", "band_width")])


@query("W20_golden_cross", W("daily_w", body=f"""SELECT symbol, date_et, {R('d', 10)} AS d, CASE WHEN lag(sign(d)) OVER s < 0 AND sign(d) > 0 THEN 'golden'
  WHEN lag(sign(d)) OVER s > 0 AND sign(d) < 0 THEN 'dead' ELSE '' END AS event FROM (
  SELECT symbol, date_et, {roll_sql('avg', 'close', 10, 10)} - {roll_sql('avg', 'close', 40, 40)} AS d FROM daily_w) {WS}"""))
def _(m):
    x = I.golden_cross(weekly(m, "close"), ["symbol"], "_i", "close", 10, 40)
    return x.select("symbol", "date_et", r6("d", 10).alias("d"), "event")


@query("W21_volume_features", W("daily_w", body=f"""SELECT symbol, date_et, {R('volume / avg(volume) OVER (PARTITION BY symbol ORDER BY date_et ROWS 19 PRECEDING)')} AS vol_ratio,
  {R('(high - low) / close')} AS range_over_close, {R('(volume - avg(volume) OVER (PARTITION BY symbol)) / (stddev_samp(volume) OVER (PARTITION BY symbol) + 1e-9)', 5)} AS vol_z FROM daily_w"""))
def _(m):
    x = I.volume_zscore(I.volume_features(weekly(m, "volume", "high", "low", "close"), ["symbol"], "_i"), ["symbol"])
    return x.select("symbol", "date_et", r6("vol_ratio").alias("vol_ratio"), r6("range_over_close").alias("range_over_close"), r6("vol_z", 5).alias("vol_z"))


@query("W22_relative_activity", W("daily_w", body=f"""SELECT symbol, date_et, {R('rel')} AS rel, {R(roll_sql('avg', 'rel', 5, 5))} AS rel_smooth FROM (
  SELECT symbol, date_et, volume / NULLIF(median(volume) OVER (PARTITION BY symbol), 0) AS rel FROM daily_w)"""))
def _(m):
    from ..operators.aggregates import relative_activity
    return out(relative_activity(m.daily_w.select("symbol", "date_et", "volume"), "symbol", "date_et", "volume"), "rel", "rel_smooth")


@query("W23_premarket_return", W("bars", "cal", body=f"""SELECT symbol, target, {R('CASE WHEN n > 1 THEN l / NULLIF(f, 0) - 1 END')} AS pre_ret FROM (
  SELECT symbol, target, max_by(close, datetime) AS l, min_by(close, datetime) AS f, count(*) AS n FROM bars b JOIN cal c
  ON b.session = 'pre' AND b.known_at >= c.cutoff - INTERVAL 20 HOUR AND b.known_at < c.cutoff GROUP BY ALL)"""))
def _(m):
    return I.premarket_return(m.price, m.cal).select("symbol", "target", r6("pre_ret").alias("pre_ret"))


SEQ = ("SELECT symbol, date_et, i, " + ", ".join(f"CAST(CAST({e} AS FLOAT) AS DOUBLE) AS c{k}" for k, e in enumerate(
    ["close / prev_close - 1", "open / prev_close - 1", "high / prev_close - 1", "low / prev_close - 1", "ln(1 + volume)"], 1)) + " FROM daily_w")


#: Digits a channel's sums are compared with: four returns and a logarithm of the volume.
SEQ_DIGITS = (7, 7, 7, 7, 5)
#: The 20 rows before each row as a list of channel lists.
SEQ_LIST = f"SELECT symbol, date_et, i, list([c1, c2, c3, c4, c5]) OVER (PARTITION BY symbol ORDER BY date_et ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS xs FROM ({SEQ})"


def weighted_sums_sql(cell: str, prefix: str, n: int = 20, digits=SEQ_DIGITS) -> str:
    """Per channel the sum of a cell (of position k and channel c) weighted by its position: every position counts, and counts differently."""
    return ", ".join(R(f"list_sum(list_transform(range(1, {n + 1}), lambda k: k * ({cell.format(c=c)})))", d) + f" AS {prefix}{c}" for c, d in enumerate(digits, 1))


def weighted_sums(seq, prefix: str, digits=SEQ_DIGITS) -> list:
    add = lambda ch: F.aggregate(F.transform(seq, lambda r, i: r[ch].cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return [r6(add(c), d).alias(f"{prefix}{c + 1}") for c, d in enumerate(digits)]


@query("W24_sequence_windows", W("daily_w", body=f"""SELECT symbol, date_et AS target, {R("len(xs) * 5")} AS n, {weighted_sums_sql('xs[k][{c}]', 'wsum')} FROM ({SEQ_LIST}) WHERE i >= 21"""))
def _(m):
    x = Q.sequence_windows(m.daily_w)
    n = F.aggregate("sequence", F.lit(0), lambda a, r: a + F.size(r))
    return x.select("symbol", "target", r6(n).alias("n"), *weighted_sums("sequence", "wsum"))


@query("W24_padded_windows", W("daily_w", body=f"""SELECT symbol, date_et AS date, CAST(20 AS BIGINT) AS n, {weighted_sums_sql('CASE WHEN k > 20 - len(xs) THEN xs[k - 20 + len(xs)][{c}] ELSE 0 END', 'wsum')} FROM (
  SELECT symbol, date_et, list([coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0), coalesce(c4, 0), coalesce(c5, 0)]) OVER (PARTITION BY symbol ORDER BY date_et ROWS 19 PRECEDING) AS xs FROM ({SEQ}))"""))
def _(m):
    x = Q.padded_windows(m.daily_w)
    return x.select("symbol", "date", F.size("sequence").cast("long").alias("n"), *weighted_sums("sequence", "wsum"))


@query("W25_window_index", W("cal_w", "ev_t", body="SELECT o_orderkey, widx FROM ev_t"))
def _(m):
    from ..operators.calendar import assign_window
    return assign_window(m.orders_ev, m.cal_w, "known_at").select("o_orderkey", "widx")


TREND = "(" + " + ".join(f"xs[greatest(1, least(20, k + ({d})))][{{c}}]" for d in range(-2, 3)) + ") / 5"


@query("W26_trend_remainder", W("daily_w", body=f"""SELECT symbol, date_et AS target, {weighted_sums_sql(TREND, 'trend', digits=(5,) * 5)}, {weighted_sums_sql('xs[k][{c}] - ' + TREND, 'rest', digits=(5,) * 5)} FROM ({SEQ_LIST}) WHERE i >= 21"""))
def _(m):
    x = Q.trend_remainder(Q.sequence_windows(m.daily_w), "sequence")
    return x.select("symbol", "target", *weighted_sums("trend", "trend", (5,) * 5), *weighted_sums("remainder", "rest", (5,) * 5))


@query("W27_remainder_return", W("panel", "ext", body=f"""SELECT p.symbol, p.target, {R('p.rest')} AS rest, {R('q.post_last / p.close_d0 - 1')} AS post_ret,
  {R('e.pre_last / NULLIF(q.post_last, 0) - 1')} AS pre_ret FROM panel p LEFT JOIN ext e ON e.symbol = p.symbol AND e.day = p.target
  LEFT JOIN ext q ON q.symbol = p.symbol AND q.day = p.date"""))
def _(m):
    from ..plans.panel import exploratory_panel
    from ..sources.market import CUTS
    x = exploratory_panel({"daily": m.daily, "price": m.price}, m.cal, CUTS)
    x = x.select("symbol", "target", r6("post_ret").alias("post_ret"), r6("pre_ret").alias("pre_ret"))
    from ..plans.panel import label_panel
    lp = label_panel(gap_rows(m), m.daily, CUTS).select("symbol", "target", r6("rest").alias("rest"))
    return x.join(lp, ["symbol", "target"])


@query("W28_holm", """SELECT l_shipmode, p, round(max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, l_shipmode ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS p_holm FROM (
  SELECT l_shipmode, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, l_shipmode) AS rn FROM (
  SELECT l_returnflag || l_linestatus || l_linenumber AS l_shipmode, round(CAST(avg(l_discount) AS DOUBLE) / 4, 9) AS p FROM lineitem GROUP BY 1))""")
def _(m):
    from ..plans.compare import holm
    li = m.raw("lineitem")
    p = li.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("l_shipmode")).agg(
        F.round(F.avg("l_discount") / 4, 9).alias("p"))
    return holm(p, "p", "l_shipmode").withColumn("p_holm", r6("p_holm", 9))
