"""2.2 projections, filters, predicates."""

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators.calendar import eligible_days
from ..operators.events import extended_hours
from ..plans.panel import complete_columns, development_rows, groups_of, resolve_features, tables_of
from ..sources import tables as S
from ..sources.market import CUTS
from .base import R, W, clip_sql, grade_sql, query


@query("P1_symbol_membership", W("bars", body="SELECT symbol, count(*) AS n FROM bars WHERE symbol IN ('S02', 'S05') GROUP BY 1"))
def _(m):
    want = m.daily.where(F.col("symbol").isin("S02", "S05")).select("symbol")
    return S.symbol_filter(m.price, want).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("P2_tag_membership", W("news", body="""SELECT doc_id, symbols FROM news
  WHERE list_has_any(string_split(symbols, ','), ['S03', 'S04'])"""))
def _(m):
    return S.symbol_filter(m.news, ["S03", "S04"]).select("doc_id", "symbols")


@query("P3_development_rows", W("daily", body=f"SELECT symbol, date_et, {R('close')} AS close FROM daily WHERE date_et < DATE '2024-01-20'"))
def _(m):
    return development_rows(m.daily, "2024-01-20", "date_et").select("symbol", "date_et", C.r6("close").alias("close"))


@query("P4_fold_rows", W("daily", body="""SELECT CASE WHEN date_et < DATE '2024-01-20' - 3 THEN 'train' ELSE 'test' END AS part, symbol, date_et
  FROM daily WHERE date_et < DATE '2024-01-20' - 3 OR (date_et >= DATE '2024-01-20' AND date_et < DATE '2024-01-28')"""))
def _(m):
    from ..plans.splits import fold_rows
    return fold_rows(m.daily, "date_et", "2024-01-20", "2024-01-28", 3).select("part", "symbol", "date_et")


@query("P5_session_prices", W("ext", body=f"SELECT symbol, day, {R('pre_last')} AS pre_last, {R('post_last')} AS post_last FROM ext"))
def _(m):
    return extended_hours(m.price).select("symbol", "day", C.r6("pre_last").alias("pre_last"), C.r6("post_last").alias("post_last"))


@query("P6_leaky_session_price", W("ext", body=f"""SELECT symbol, day, {R('pre_last_leak')} AS pre_last_leak,
  pre_last_leak IS DISTINCT FROM pre_last AS differs FROM ext"""))
def _(m):
    return extended_hours(m.price).select("symbol", "day", C.r6("pre_last_leak").alias("pre_last_leak"),
                                          (~F.col("pre_last").eqNullSafe(F.col("pre_last_leak"))).alias("differs"))


@query("P7_required_columns", W("daily_w", body="SELECT symbol, count(*) AS n FROM daily_w WHERE ret IS NOT NULL AND prev_close IS NOT NULL GROUP BY 1"))
def _(m):
    return m.daily_w.dropna(subset=["ret", "prev_close"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("P9_infinite_to_missing", W("ev", body=f"""SELECT o_orderkey, CASE WHEN eps_estimate <> 0 THEN eps_reported / eps_estimate END AS x FROM ev"""))
def _(m):
    raw = F.when(F.col("eps_estimate") == 0, F.lit(float("inf"))).otherwise(F.try_divide("eps_reported", "eps_estimate"))
    return m.orders_ev.select("o_orderkey", C.finite(raw).alias("x"))


@query("P10_fill_rules", W("ext", body=f"""SELECT symbol, day, {R('coalesce(pre_last, 0)')} AS pre_last, {R('coalesce(post_last, 0)')} AS post_last,
  coalesce({grade_sql('pre_last', (10, 40, 60, 90))}, 2) AS g FROM ext"""))
def _(m):
    return extended_hours(m.price).select(
        "symbol", "day", C.r6(F.coalesce("pre_last", F.lit(0.0))).alias("pre_last"),
        C.r6(F.coalesce("post_last", F.lit(0.0))).alias("post_last"), C.grade_or_flat("pre_last", (10, 40, 60, 90)).alias("g"))


@query("P11_clip_winsorise", W("ev", body=f"""SELECT o_orderkey, {clip_sql('surprise_pct', -50, 50)} AS surp,
  {("CASE WHEN target_prior = 0 THEN CASE WHEN target_current > 0 THEN 0.5 WHEN target_current < 0 THEN -0.5 END ELSE "
     + clip_sql('(target_current / NULLIF(target_prior, 0) - 1)', -0.5, 0.5) + " END")} AS tgt,
  greatest(abs(eps_reported - 1), 0.5) AS floored FROM ev"""))
def _(m):
    return m.orders_ev.select(
        "o_orderkey", C.clip("surprise_pct", -50, 50).alias("surp"),
        C.clipped_change("target_current", "target_prior", 0.5).alias("tgt"),
        C.clip(F.abs(F.col("eps_reported") - 1), lo=0.5).alias("floored"))


@query("P12_feature_resolution", W("peer", body=f"SELECT symbol, target, {R('vol20')} AS vol20, {R('gap_pct')} AS gap_pct, {R('gap_rank')} AS gap_rank FROM peer"))
def _(m):
    from ..plans.panel import build_panel
    cols = resolve_features(["vol20", "core", "gap_pct"])
    assert tables_of(groups_of(cols)) == {"daily", "price"}
    p = build_panel({"daily": m.daily, "price": m.price}, m.cal, m.universe, groups_of(cols))
    return p.select("symbol", "target", *[C.r6(c).alias(c) for c in cols])


@query("P14_agreement_class", W("gap", "tags", body="""SELECT symbol, target, CASE WHEN s IS NULL OR s = 0 THEN 'no_event' WHEN s * sign(gap_pct) > 0 THEN 'same_dir'
  WHEN s * sign(gap_pct) < 0 THEN 'opposite' ELSE 'gap_0' END AS cls FROM (SELECT g.symbol, g.target, g.gap_pct, sign(t.tone) AS s
  FROM gap g LEFT JOIN (SELECT symbol, target, sum(tone) AS tone FROM tags GROUP BY ALL) t USING (symbol, target))"""))
def _(m):
    g, t = _gap_and_tone(m)
    return g.join(t, ["symbol", "target"], "left").select("symbol", "target", C.agreement_class("tone", "gap_pct").alias("cls"))


def _gap_and_tone(m):
    from ..operators.calendar import assign_window
    from ..operators.events import tagged
    from ..plans.panel import daily_block, with_gap
    close = m.daily.select("symbol", F.col("date_et").alias("date"), F.col("close").alias("close_d0"))
    g = with_gap(close.join(m.cal.select("date", "target"), "date"), extended_hours(m.price))
    t = tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", "tone"), m.universe)
    return g, t.groupBy("symbol", "target").agg(F.sum("tone").alias("tone"))


@query("P15_sign_agreement", W("gap", "tags", body="""SELECT symbol, target, coalesce(CAST(sign(tone) * sign(gap_pct) AS DOUBLE), 0.0) AS agree
  FROM gap LEFT JOIN (SELECT symbol, target, sum(tone) AS tone FROM tags GROUP BY ALL) USING (symbol, target)"""))
def _(m):
    g, t = _gap_and_tone(m)
    return g.join(t, ["symbol", "target"], "left").select(
        "symbol", "target", (C.sign_agreement("tone", "gap_pct") + 0.0).alias("agree"))


@query("P16_missing_flags", W("ext", body="SELECT symbol, day, CAST(pre_last IS NULL AS DOUBLE) AS pre_missing, CAST(post_last IS NULL AS DOUBLE) AS post_missing FROM ext"))
def _(m):
    return extended_hours(m.price).select("symbol", "day", C.missing_flag("pre_last").alias("pre_missing"),
                                          C.missing_flag("post_last").alias("post_missing"))


@query("P17_stable_columns", W("gap", body=f"""SELECT symbol, target, date, {R('close_d0')} AS close_d0, gap_fallback, gap_missing,
  {R('gap_pct')} AS gap_pct, CAST(NULL AS DOUBLE) AS gap_rank, CAST(NULL AS DOUBLE) AS novelty_r1 FROM gap"""))
def _(m):
    x = complete_columns(_gap_and_tone(m)[0], {"core", "txt_novelty"})
    return x.withColumns({"close_d0": C.r6("close_d0"), "gap_pct": C.r6("gap_pct")})


@query("P18_label_table", W("daily", body=f"""SELECT symbol, date_et AS date, {R('prev_close')} AS prev_close, {R('close')} AS close,
  {R('ret * 100')} AS ret_pct, {grade_sql('(ret * 100)', CUTS)} AS label FROM daily WHERE ret IS NOT NULL AND date_et >= DATE '2024-01-05'"""))
def _(m):
    x = S.label_table(m.daily, CUTS, since="2024-01-05")
    return x.withColumns({c: C.r6(c) for c in ("prev_close", "close", "ret_pct")})


@query("P19_trading_days", W("cal", body="SELECT date, target, cutoff FROM cal WHERE date >= DATE '2024-01-08'"))
def _(m):
    return eligible_days(m.cal, start="2024-01-08").select("date", "target", "cutoff")


@query("P20_gap_arithmetic", W("panel", body=f"""SELECT symbol, target, {R('gap_pct')} AS gap_pct, {R('zgap')} AS zgap, {R('resid_gap')} AS resid_gap,
  gap_fallback, gap_missing FROM panel"""))
def _(m):
    from .joins import core_panel
    return core_panel(m).select("symbol", "target", *[C.r6(c).alias(c) for c in ("gap_pct", "zgap", "resid_gap")],
                                "gap_fallback", "gap_missing")


@query("P21_truth_of_target", W("daily", body=f"""SELECT symbol, {R('ret * 100')} AS ret_pct, {grade_sql('(ret * 100)', CUTS)} AS label
  FROM daily WHERE ret IS NOT NULL AND date_et = DATE '2024-01-11'"""))
def _(m):
    x = S.label_table(m.daily, CUTS, "2024-01-11", "2024-01-12")
    return x.select("symbol", C.r6("ret_pct").alias("ret_pct"), "label")
