"""2.4 aggregations."""

from pyspark.sql import Window as SW, functions as F

from ..fixed import EVENT_RX
from ..functions import scalars as C
from ..operators import aggregates as A, textblock as T
from ..operators.calendar import assign_window
from ..operators.events import analyst_features, earnings_features, news_dedup, news_features, tagged
from ..operators.forum import forum_counts
from ..operators.ranks import quantiles
from ..plans.panel import label_panel
from ..session import cut_lineage
from ..sources.market import CUTS
from .base import R, W, clip_sql, grade_sql, query
from .joins import articles, core_panel, gap_rows

cnt = lambda: F.count(F.lit(1))
r6 = C.r6


@query("A1_last_by_time", W("bars", body=f"SELECT symbol, CAST(datetime AS DATE) AS day, {R('max_by(close, datetime)')} AS last_close FROM bars GROUP BY ALL"))
def _(m):
    return m.price.groupBy("symbol", F.to_date("datetime").alias("day")).agg(r6(F.max_by("close", "datetime")).alias("last_close"))


LASTS = ", ".join(f"max_by({c}, (known_at, o_orderkey)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("surprise_pct", "eps_estimate", "thin"))


@query("A2_last_non_null_per_column", W("ev_t", body=f"""SELECT symbol, target, surprise_pct, {R('eps_estimate')} AS eps_estimate, {R('thin', 2)} AS thin FROM (
  SELECT symbol, target, {LASTS} FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN target_current END AS thin FROM ev_t) GROUP BY ALL)"""))
def _(m):
    from ..operators.events import last_non_null
    e = assign_window(m.orders_ev, m.cal_w, "known_at").withColumn("thin", F.when(F.col("o_orderkey") % 3 == 0, F.col("target_current")))
    x = last_non_null(e, ["symbol", "target"], "known_at", ["surprise_pct", "eps_estimate", "thin"], "o_orderkey")
    return x.select("symbol", "target", "surprise_pct", r6("eps_estimate").alias("eps_estimate"), r6("thin", 2).alias("thin"))


@query("A3_earnings_features", W("ev_t", body=f"""SELECT symbol, target, 1.0::DOUBLE AS earn, CAST(max_by(sign(d), k) AS DOUBLE) AS surp_sign, max_by(abs(d), k) AS surp_abs,
  {"max_by(" + clip_sql('surprise_pct', -50, 50) + ", k) FILTER (surprise_pct IS NOT NULL)"} AS surp_pct_w
  FROM (SELECT *, eps_reported - eps_estimate AS d, (known_at, o_orderkey) AS k FROM ev_t) GROUP BY ALL"""))
def _(m):
    return earnings_features(m.orders_ev, m.cal_w, tie="o_orderkey")


TGT = ("CASE WHEN target_prior = 0 THEN CASE WHEN target_current > 0 THEN 0.5 WHEN target_current < 0 THEN -0.5 END ELSE "
       + clip_sql("(target_current / NULLIF(target_prior, 0) - 1)", -0.5, 0.5) + " END")


@query("A4_analyst_features", W("ev_t", body=f"""SELECT symbol, target, CAST(count(*) AS DOUBLE) AS an_n, CAST(count(*) FILTER (action = 'up') AS DOUBLE) AS an_up,
  CAST(count(*) FILTER (action = 'down') AS DOUBLE) AS an_down, CAST(count(*) FILTER (action = 'init') AS DOUBLE) AS an_init,
  {R(f'avg({TGT})', 4)} AS an_tgt_chg FROM ev_t GROUP BY symbol, target"""))
def _(m):
    return analyst_features(m.orders_ev, m.cal_w, with_init=True).withColumn("an_tgt_chg", r6("an_tgt_chg", 4))


NEWS_AGG = f"""count(*)::DOUBLE AS news_n, {R('avg(tone)')} AS tone_mean, min(tone) AS tone_min, max(tone) AS tone_max, {R('stddev_samp(tone)')} AS tone_std,
  CAST(count(*) FILTER (tone < -5) AS DOUBLE) AS tone_neg_tail, CAST(count(*) FILTER (tone > 5) AS DOUBLE) AS tone_pos_tail, CAST(sum(copies) AS DOUBLE) AS news_raw"""


@query("A5_news_features", W("news_u", body=f"SELECT symbol, target, {NEWS_AGG} FROM news_u GROUP BY symbol, target"))
def _(m):
    x = news_features(news_dedup(m.news, m.cal, m.universe))
    return x.withColumns({"tone_mean": r6("tone_mean"), "tone_std": r6("tone_std")})


@query("A6_dedup_keep_first", W("news_u", body="SELECT symbol, target, h, tone, copies FROM news_u"))
def _(m):
    return news_dedup(m.news, m.cal, m.universe).select("symbol", "target", "h", "tone", "copies")


@query("A7_story_clusters", W("clu", body="SELECT symbol, widx, ckey, rel, copies FROM clu"))
def _(m):
    return T.clusters(articles(m)).select("symbol", "widx", "ckey", "rel", "copies")


CLU = ", ".join(f"CAST(count(*) FILTER (rel >= {i}) AS DOUBLE) AS n_clu_r{i}, CAST(count(*) FILTER (rel >= {i} AND is_first) AS DOUBLE) AS n_first_r{i}" for i in range(3))


@query("A8_cluster_counts", W("clu", body=f"SELECT symbol, widx, {CLU} FROM clu GROUP BY symbol, widx"))
def _(m):
    return T.cluster_counts(T.clusters(articles(m)))


@query("A9_distinct_sources", W("arts", body="SELECT symbol, widx, count(DISTINCT source) AS n_src FROM arts WHERE is_template = 0 AND rel >= 1 GROUP BY ALL"))
def _(m):
    return (articles(m).where("is_template = 0 AND rel >= 1").groupBy("symbol", "widx").agg(F.count_distinct("source").alias("n_src")))


@query("A10_template_share", W("arts", body=f"SELECT symbol, widx, {R('avg(is_template)')} AS share FROM arts GROUP BY symbol, widx"))
def _(m):
    return articles(m).groupBy("symbol", "widx").agg(r6(F.avg("is_template")).alias("share"))


@query("A11_cluster_representatives", W("reps", body=f"SELECT symbol, widx, ckey, title_id, known_at, {R('tone')} AS tone, md5(title) AS title_md5 FROM reps"))
def _(m):
    return T.representatives(articles(m)).select("symbol", "widx", "ckey", "title_id", "known_at", r6("tone").alias("tone"), F.md5("title").alias("title_md5"))


LEXQ = """SELECT title_id, CASE WHEN n > 0 THEN net / n END AS lm_net, CASE WHEN n > 0 THEN unc / n END AS lm_unc FROM (
  SELECT title_id, len(w) AS n, list_sum(list_transform(range(1, len(w) + 1), lambda i: CASE
    WHEN list_contains(pos, w[i]) THEN CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], neg) THEN -1 ELSE 1 END WHEN list_contains(ngt, w[i]) THEN -1 ELSE 0 END))::DOUBLE AS net,
   list_sum(list_transform(w, lambda x: CAST(list_contains(unc, x) AS INT)))::DOUBLE AS unc
  FROM (SELECT title_id, list_transform(regexp_extract_all(any_value(title), '[A-Za-z]+'), lambda x: upper(x)) AS w FROM reps GROUP BY 1),
  (SELECT list(word) FILTER (category = 'positive') AS pos, list(word) FILTER (category = 'negative') AS ngt, list(word) FILTER (category = 'uncertainty') AS unc,
   ['NO', 'NOT', 'NEVER', 'WITHOUT', 'NEITHER', 'NOR', 'NONE', 'CANNOT', 'NOBODY', 'NOTHING'] AS neg FROM lexicon))"""
EVS = ", ".join("max(CAST(regexp_matches(lower(title), '" + rx.replace("'", "''") + f"') AS DOUBLE)) AS ev_{e}_r1" for e, rx in EVENT_RX.items())


@query("A12_representative_features", W("reps", "lexicon", body=f"""SELECT symbol, widx, {R('avg(tone)')} AS tone_mean_r1, {R('avg(CAST(tone < 0 AS INT))')} AS tone_neg_share_r1,
  {R('stddev_samp(tone)')} AS tone_sd_r1, {R('avg(lm_net)', 8)} AS lm_net_r1, {R('avg(CAST(lm_net < 0 AS INT))')} AS lm_neg_share_r1, {R('avg(lm_unc)', 8)} AS lm_unc_r1,
  count(*)::DOUBLE AS n_scored_r1, {EVS} FROM reps LEFT JOIN ({LEXQ}) USING (title_id) GROUP BY symbol, widx"""))
def _(m):
    reps = cut_lineage(T.representatives(articles(m)))
    sc = T.lexicon_scores(reps.groupBy("title_id").agg(F.min("title").alias("title")), m.lexicon)
    x = T.representative_features(reps, sc)
    return x.withColumns({c: r6(c) for c in ("tone_mean_r1", "tone_neg_share_r1", "tone_sd_r1", "lm_neg_share_r1")}
                         | {c: r6(c, 8) for c in ("lm_net_r1", "lm_unc_r1")})


@query("A13_joined_titles", W("reps", body="SELECT symbol, widx, md5(string_agg(title, ' || ' ORDER BY known_at, ckey)) AS joined_md5 FROM reps GROUP BY 1, 2"))
def _(m):
    return T.joined_titles(T.representatives(articles(m))).select("symbol", "widx", F.md5("titles_r1").alias("joined_md5"))


@query("A14_max_over_flags", W("reps", body=f"""SELECT symbol, widx, greatest({', '.join(f'ev_{e}_r1' for e in EVENT_RX)}) AS ev_any FROM (SELECT symbol, widx, {EVS} FROM reps GROUP BY 1, 2)"""))
def _(m):
    x = T.representative_features(T.representatives(articles(m)), None)
    return x.select("symbol", "widx", F.greatest(*[F.col(f"ev_{e}_r1") for e in EVENT_RX]).alias("ev_any"))


@query("A15_market_regime", W("regime", body=f"""SELECT target, {R('reg_med_vol20', 5)} AS reg_med_vol20, {R('reg_med_absgap')} AS reg_med_absgap, {R('reg_gap_disp', 5)} AS reg_gap_disp,
  {R('reg_mkt_gap')} AS reg_mkt_gap, {R('reg_big_ratio')} AS reg_big_ratio FROM regime"""))
def _(m):
    x = core_panel(m).groupBy("target").agg(*[F.max(c).alias(c) for c in ("reg_med_vol20", "reg_med_absgap", "reg_gap_disp", "reg_mkt_gap", "reg_big_ratio")])
    return x.select("target", r6("reg_med_vol20", 5).alias("reg_med_vol20"), r6("reg_gap_disp", 5).alias("reg_gap_disp"),
                    *[r6(c).alias(c) for c in ("reg_med_absgap", "reg_mkt_gap", "reg_big_ratio")])


FT = "(SELECT f.*, c.target, c.widx FROM forum f JOIN cal c ON f.created_et >= c.lo AND f.created_et < c.cutoff)"
FM = (f"(SELECT t.post_id, t.target, t.sub, u.symbol FROM {FT} t, universe u WHERE regexp_matches(concat_ws(' ', t.title, t.body), '\\b' || u.symbol || '\\b'))")


@query("A16_forum_mentions", W("forum", "cal", "universe", body=f"SELECT symbol, target, sub, count(*) AS mentions FROM {FM} GROUP BY 1, 2, 3"))
def _(m):
    return forum_counts(m.forum, m.cal, m.universe)[0]


@query("A16_forum_activity", W("forum", "cal", body=f"SELECT sub, target, count(*) AS items FROM {FT} GROUP BY 1, 2"))
def _(m):
    return forum_counts(m.forum, m.cal, m.universe)[1]


@query("A17_mentions_rolled_up", W("forum", "cal", "universe", body=f"SELECT symbol, target, CAST(count(*) AS BIGINT) AS mentions FROM {FM} GROUP BY 1, 2"))
def _(m):
    return forum_counts(m.forum, m.cal, m.universe)[0].groupBy("symbol", "target").agg(F.sum("mentions").alias("mentions"))


@query("A18_activity_pivot", W("forum", "cal", body=f"""SELECT target, max(items) FILTER (sub = 'user') AS act_user, max(items) FILTER (sub = 'assistant') AS act_assistant,
  max(items) FILTER (sub = 'system') AS act_system FROM (SELECT sub, target, count(*) AS items FROM {FT} GROUP BY 1, 2) GROUP BY 1"""))
def _(m):
    act = forum_counts(m.forum, m.cal, m.universe)[1]
    w = act.groupBy("target").pivot("sub", ["user", "assistant", "system"]).agg(F.max("items"))
    return w.withColumnsRenamed({s: f"act_{s}" for s in ("user", "assistant", "system")})


WL = f"(SELECT *, ret * 100 AS ret_pct, {grade_sql('(ret * 100)', CUTS)} AS label FROM daily_w WHERE ret IS NOT NULL)"


def weekly_labels(m):
    return m.daily_w.where("ret IS NOT NULL").withColumn("ret_pct", F.col("ret") * 100).withColumn("label", C.grade("ret_pct", CUTS))


@query("A19_label_distribution", W("daily_w", body=f"SELECT label, count(*) AS n, {R('count(*) / (SELECT count(*) FROM daily_w WHERE ret IS NOT NULL)')} AS share FROM {WL} GROUP BY 1"))
def _(m):
    return A.label_distribution(weekly_labels(m)).withColumn("share", r6("share"))


PRED = f"coalesce({grade_sql('(-lag(ret) OVER (PARTITION BY symbol ORDER BY date_et) * 100)', CUTS)}, 2)"


@query("A20_confusion_grid", W("daily_w", body=f"""SELECT g.label, g.pred, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(5)) AS label) a(label), (SELECT unnest(range(5)) AS pred) b(pred), (SELECT 1) x
  , LATERAL (SELECT a.label::INT AS label, b.pred::INT AS pred) g LEFT JOIN (SELECT label, pred, count(*) AS n FROM (SELECT label, {PRED} AS pred FROM {WL}) GROUP BY 1, 2) c
  ON c.label = g.label AND c.pred = g.pred"""))
def _(m):
    from ..plans.scoring import confusion_grid
    return confusion_grid(weekly_predictions(m))


def weekly_predictions(m):
    """Reversal guess: the grade of minus the previous return (one row per symbol and week)."""
    w = SW.partitionBy("symbol").orderBy("date_et")
    return weekly_labels(m).withColumn("pred", C.grade_or_flat(-F.lag("ret").over(w) * 100, CUTS))


@query("A21_confusion_per_day", W("daily_w", body=f"SELECT date_et, label, pred, count(*) AS n FROM (SELECT date_et, label, {PRED} AS pred FROM {WL}) GROUP BY 1, 2, 3"))
def _(m):
    from ..plans.scoring import confusion
    return confusion(weekly_predictions(m), ["date_et"])


@query("A22_conditional_table", W("panel", "news_u", body=f"""SELECT gap_bin, category, count(*) AS n, {R('avg(CAST(ret_pct > 0 AS INT))')} AS up_rate, {R('avg(CAST(label IN (0, 4) AS INT))')} AS M_rate,
  {R('avg(rest)')} AS rest_mean, {R('avg(ret_pct)', 5)} AS ret_mean FROM (SELECT p.*, CASE WHEN abs(gap_pct) < 10 THEN 0 WHEN abs(gap_pct) < 30 THEN 1 WHEN gap_pct IS NOT NULL THEN 2 END AS gap_bin,
  CASE WHEN t IS NULL OR t = 0 THEN 'no_event' WHEN sign(t) * sign(gap_pct) > 0 THEN 'same_dir' WHEN sign(t) * sign(gap_pct) < 0 THEN 'opposite' ELSE 'gap_0' END AS category
  FROM panel p LEFT JOIN (SELECT symbol, target, avg(tone) AS t FROM news_u GROUP BY 1, 2) USING (symbol, target)) WHERE gap_bin IS NOT NULL GROUP BY 1, 2"""))
def _(m):
    from ..plans.events import event_class
    x = label_panel(gap_rows(m), m.daily, CUTS).join(news_features(news_dedup(m.news, m.cal, m.universe)), ["symbol", "target"], "left")
    t = A.conditional_table(x, event_class("news_tone_vs_gap"), bins=(0, 10, 30, float("inf")))
    return t.withColumns({c: r6(c) for c in ("up_rate", "M_rate", "rest_mean")} | {"ret_mean": r6("ret_mean", 5)})


QB = "(SELECT *, CASE " + " ".join(f"WHEN x <= e[{i}] THEN {i - 2}" for i in range(2, 12)) + " END AS bin FROM (SELECT ret_pct AS x, volume AS y, (SELECT quantile_cont(ret * 100, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FROM daily_w WHERE ret IS NOT NULL) AS e FROM " + WL + "))"


@query("A23_quantile_binned_means", W("daily_w", body=f"SELECT bin, count(*) AS n, {R('avg(y)')} AS volume, {R('median(x)')} AS x_mid FROM {QB} GROUP BY bin"))
def _(m):
    x = A.binned_means(weekly_labels(m), "ret_pct", ["volume"])
    return x.select("bin", "n", r6("volume").alias("volume"), r6("x_mid").alias("x_mid"))


@query("A24_two_way_pivot", W("daily_w", body=f"""SELECT symbol, {', '.join(f"{R(f'avg(volume) FILTER (label = {k})')} AS mean{k}, count(volume) FILTER (label = {k}) AS n{k}" for k in range(5))} FROM {WL} GROUP BY 1"""))
def _(m):
    x = A.pivot_mean_size(weekly_labels(m), "symbol", "label", range(5), "volume")
    return x.select("symbol", *[r6(f"{k}_mean").alias(f"mean{k}") for k in range(5)], *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"n{k}") for k in range(5)])


@query("A25_symbol_profile", W("daily_w", body=f"""SELECT symbol, count(*) AS n, {R('avg(CAST(label IN (0, 4) AS INT))')} AS big_share, {R('avg(CAST(label > 2 AS INT))')} AS up_share,
  {R('stddev_samp(ret_pct)', 5)} AS ret_sd, count(*) FILTER (label = 4) AS n_surge, count(*) FILTER (label = 0) AS n_crash FROM {WL} GROUP BY 1"""))
def _(m):
    x = A.symbol_profile(weekly_labels(m))
    return x.withColumns({"big_share": r6("big_share"), "up_share": r6("up_share"), "ret_sd": r6("ret_sd", 5)})


@query("A26_event_study", W("daily_w", "ev_t", body=f"""SELECT coalesce(es, 'none') AS event, sign(ret)::INT AS side, count(*) AS n, {R('avg(ret_pct)', 5)} AS ret_mean FROM {WL} d LEFT JOIN (
  SELECT symbol, target, CASE WHEN count(*) FILTER (action = 'up') > count(*) FILTER (action = 'down') THEN 'up' WHEN count(*) FILTER (action = 'down') > count(*) FILTER (action = 'up') THEN 'down' ELSE 'even' END AS es
  FROM ev_t GROUP BY 1, 2) e ON e.symbol = d.symbol AND e.target = d.date_et GROUP BY 1, 2"""))
def _(m):
    an = analyst_features(m.orders_ev, m.cal_w)
    es = F.when(F.col("an_up") > F.col("an_down"), "up").when(F.col("an_down") > F.col("an_up"), "down").otherwise("even")
    x = weekly_labels(m).join(an.select("symbol", F.col("target").alias("date_et"), es.alias("event")), ["symbol", "date_et"], "left")
    return (x.groupBy(F.coalesce("event", F.lit("none")).alias("event"), F.signum("ret").cast("int").alias("side"))
            .agg(cnt().alias("n"), r6(F.avg("ret_pct"), 5).alias("ret_mean")))


@query("A27_gap_bin_persistence", W("panel", body=f"""SELECT CASE WHEN abs(gap_pct) < 10 THEN 0 WHEN abs(gap_pct) < 30 THEN 1 ELSE 2 END AS bin, count(*) AS n, {R('avg(rest)')} AS rest_mean,
  {R('avg(CAST(sign(gap_pct) = sign(ret_pct) AS INT))')} AS same_sign, {R('avg(CAST(label IN (0, 4) AS INT))')} AS big_share FROM panel WHERE gap_pct IS NOT NULL GROUP BY 1"""))
def _(m):
    x = label_panel(gap_rows(m), m.daily, CUTS).where("gap_pct IS NOT NULL")
    return (x.groupBy(A.interval_bin(F.abs("gap_pct"), (0, 10, 30, float("inf"))).alias("bin"))
            .agg(cnt().alias("n"), r6(F.avg("rest")).alias("rest_mean"),
                 r6(F.avg((F.signum("gap_pct") == F.signum("ret_pct")).cast("double"))).alias("same_sign"),
                 r6(F.avg(C.is_extreme("label").cast("double"))).alias("big_share")))


@query("A28_dedup_retention", W("news_u", body=f"SELECT symbol, {R('count(*) / sum(copies)')} AS kept FROM news_u GROUP BY 1"))
def _(m):
    return news_dedup(m.news, m.cal, m.universe).groupBy("symbol").agg(r6(cnt() / F.sum("copies")).alias("kept"))


@query("A29_volume_profile", W("tags", "grid", body=f"""SELECT symbol, CAST(sum(n) AS BIGINT) AS n, {R('sum(txt) / sum(n)')} AS text_share, {R('avg(n)')} AS per_day, {R('max(n) / NULLIF(median(n), 0)')} AS peak FROM (
  SELECT symbol, target, coalesce(n, 0) AS n, coalesce(txt, 0) AS txt FROM grid LEFT JOIN (SELECT symbol, target, count(*) AS n, count(*) FILTER (length(title) > 500) AS txt FROM tags GROUP BY 1, 2) USING (symbol, target)) GROUP BY 1"""))
def _(m):
    from ..operators.calendar import dense_grid
    t = tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", (F.length("title") > 500).cast("int").alias("long")))
    d = t.groupBy("symbol", "target").agg(cnt().alias("n"), F.sum("long").alias("txt"))
    g = cut_lineage(dense_grid(m.universe, "symbol", m.cal).join(d, ["symbol", "target"], "left").fillna(0, ["n", "txt"]))
    med = quantiles(g, ["symbol"], "n", {"med": 0.5})
    return (g.groupBy("symbol").agg(F.sum("n").alias("n"), r6(F.sum("txt") / F.sum("n")).alias("text_share"), r6(F.avg("n")).alias("per_day"), F.max("n").alias("_mx"))
            .join(med, "symbol").withColumn("peak", r6(F.try_divide("_mx", "med"))).drop("_mx", "med"))


@query("A30_time_rollups", W("news", "forum", body=f"""SELECT 'day' AS kind, strftime(known_at, '%Y-%m-%d') AS bucket, count(*) AS n, {R('avg(tone)')} AS mean FROM news GROUP BY 2
  UNION ALL SELECT 'hour', lpad(CAST(hour(created_et) AS VARCHAR), 2, '0'), count(*), {R('avg(length(body))')} FROM forum GROUP BY 2"""))
def _(m):
    a = m.news.groupBy(F.date_format("known_at", "yyyy-MM-dd").alias("bucket")).agg(cnt().alias("n"), r6(F.avg("tone")).alias("mean"))
    b = m.forum.groupBy(F.lpad(F.hour("created_et").cast("string"), 2, "0").alias("bucket")).agg(cnt().alias("n"), r6(F.avg(F.length("body"))).alias("mean"))
    return a.withColumn("kind", F.lit("day")).unionByName(b.withColumn("kind", F.lit("hour")))


@query("A30_monthly_returns", W("daily_w", body=f"SELECT CAST(date_trunc('month', date_et) AS DATE) AS month, count(ret) AS n, {R('avg(ret * 100)', 5)} AS mean FROM daily_w GROUP BY 1"))
def _(m):
    return m.daily_w.groupBy(F.trunc("date_et", "MM").alias("month")).agg(F.count("ret").alias("n"), r6(F.avg(F.col("ret") * 100), 5).alias("mean"))


@query("A31_table_profile", W("bars", "forum", body=f"""SELECT 'price' AS name, session AS part, count(*) AS n, {R('avg(volume)')} AS mean FROM bars GROUP BY 2
  UNION ALL SELECT 'forum', sub, count(*), {R('avg(turn)')} FROM forum GROUP BY 2"""))
def _(m):
    a = m.price.groupBy(F.col("session").alias("part")).agg(cnt().alias("n"), r6(F.avg("volume")).alias("mean")).withColumn("name", F.lit("price"))
    b = m.forum.groupBy(F.col("sub").alias("part")).agg(cnt().alias("n"), r6(F.avg("turn")).alias("mean")).withColumn("name", F.lit("forum"))
    return a.unionByName(b)


VOTES = "(SELECT doc_id, quality AS v1, toxic AS v2, (quality + toxic) % 2 AS v3 FROM labels)"


def votes(m):
    return m.raw("labels").select("doc_id", F.col("quality").alias("v1"), F.col("toxic").alias("v2"), ((F.col("quality") + F.col("toxic")) % 2).alias("v3"))


@query("A34_importance_summary", f"SELECT l_returnflag AS grp, {R('avg(l_discount)')} AS mean_drop, {R('stddev_samp(l_discount)')} AS sd, {R('quantile_cont(l_extendedprice, .05)', 4)} AS p5, {R('quantile_cont(l_extendedprice, .95)', 4)} AS p95 FROM lineitem GROUP BY 1")
def _(m):
    li = m.raw("lineitem").withColumnRenamed("l_returnflag", "grp")
    a = A.importance_summary(li, "grp", "l_extendedprice").select("grp", r6("p5", 4).alias("p5"), r6("p95", 4).alias("p95"))
    return li.groupBy("grp").agg(r6(F.avg("l_discount")).alias("mean_drop"), r6(F.stddev_samp("l_discount")).alias("sd")).join(a, "grp")


@query("A35_majority_vote", f"SELECT doc_id, CASE WHEN v1 + v2 + v3 >= 2 THEN 1 ELSE 0 END AS vote FROM {VOTES}")
def _(m):
    return A.majority_vote(votes(m), "doc_id", ["v1", "v2", "v3"]).select("doc_id", "vote")


@query("A36_agreement_rates", f"""SELECT {R('avg(CAST(v1 = v2 AS INT))')} AS agree12, {R('avg(CAST(v1 = vote AS INT))')} AS accuracy, {R('avg(CAST(vote = 1 AS INT)) FILTER (v1 = 1)')} AS prec,
  {R('avg(CAST(v1 = 1 AS INT)) FILTER (vote = 1)')} AS recall1, {R('avg(CAST(v1 = 0 AS INT)) FILTER (vote = 0)')} AS recall0, {R('avg(vote)')} AS share1
  FROM (SELECT *, CASE WHEN v1 + v2 + v3 >= 2 THEN 1 ELSE 0 END AS vote FROM {VOTES})""")
def _(m):
    from ..plans.annotation import agreement, class_metrics
    x = A.majority_vote(votes(m), "doc_id", ["v1", "v2", "v3"])
    return x.agg(r6(agreement("v1", "v2")).alias("agree12"), *[r6(c).alias(k) for k, c in class_metrics("v1", "vote").items()])


ANN = """(SELECT doc_id, symbol, target, json_object('earnings_result', CASE doc_id % 3 WHEN 0 THEN 'beat' WHEN 1 THEN 'miss' ELSE 'none' END,
  'guidance_action', CASE doc_id % 4 WHEN 0 THEN 'raise' WHEN 1 THEN 'cut' ELSE 'none' END, 'analyst_action', 'none', 'severity', doc_id % 4, 'unexpectedness', doc_id % 3) AS record FROM tags)"""


def annotations(m):
    d = F.col("doc_id")
    rec = F.to_json(F.struct(
        F.when(d % 3 == 0, "beat").when(d % 3 == 1, "miss").otherwise("none").alias("earnings_result"),
        F.when(d % 4 == 0, "raise").when(d % 4 == 1, "cut").otherwise("none").alias("guidance_action"),
        F.lit("none").alias("analyst_action"), (d % 4).cast("int").alias("severity"), (d % 3).cast("int").alias("unexpectedness")))
    n = assign_window(m.news, m.cal, "known_at").select("doc_id", "symbols", "target", rec.alias("record"))
    return tagged(n, m.universe).drop("symbols")


SIGN = "(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)"


@query("A37_annotation_features", W("tags", body=f"""SELECT symbol, target, CAST(sign(sum(sign({SIGN}))) AS DOUBLE) + 0.0 AS sign, {R('avg(doc_id % 4)')} AS severity, {R('avg(doc_id % 3)')} AS unexpected, count(*) AS n FROM tags GROUP BY 1, 2"""))
def _(m):
    from ..plans.annotation import news_annotation_features
    x = news_annotation_features(annotations(m), "record")
    return x.select("symbol", "target", (F.col("sign") + 0.0).alias("sign"), r6("severity").alias("severity"), r6("unexpected").alias("unexpected"), "n")


@query("A37_forum_stance_features", W("forum", "cal", "universe", body=f"""SELECT symbol, target, {R("avg(CASE length(post_id) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END)")} AS bull,
  {R('avg(length(body) % 5)')} AS hype, count(*) AS n FROM (SELECT m.*, f.body FROM {FM} m JOIN forum f USING (post_id)) GROUP BY 1, 2"""))
def _(m):
    from ..operators.forum import mentioned_symbols
    from ..plans.annotation import forum_annotation_features
    p = assign_window(m.forum, m.cal, "created_et")
    k = F.length("post_id") % 3
    rec = F.to_json(F.struct(F.when(k == 0, "bullish").when(k == 1, "bearish").otherwise("neutral").alias("stance"), (F.length("body") % 5).alias("hype_intensity"),
                             F.lit(True).alias("speculation"), F.lit(False).alias("short_squeeze"), F.lit(False).alias("event_reaction"), F.lit(0).alias("disagreement")))
    x = mentioned_symbols(p.withColumn("record", rec), m.universe, ["post_id", "target", "record"])
    return forum_annotation_features(x, "record").select("symbol", "target", r6("bull").alias("bull"), r6("hype").alias("hype"), "n")


@query("A38_group_mean_vectors", f"""SELECT label, pos::INT AS pos, {R('avg(v)')} AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2""")
def _(m):
    from ..plans.vectors import mean_vector
    x = mean_vector(m.raw("embeddings"), ["label"], "embedding")
    return x.select("label", F.posexplode("mean").alias("pos", "mean"), "n").withColumn("mean", r6("mean"))


@query("A39_correlations", f"""SELECT l_returnflag AS grp, {R('corr(l_quantity, l_extendedprice)')} AS pearson, count(*) AS n FROM lineitem GROUP BY 1""")
def _(m):
    return A.correlation(m.raw("lineitem").withColumnRenamed("l_returnflag", "grp"), "l_quantity", "l_extendedprice", ["grp"]).withColumn("pearson", r6("pearson"))


RK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query("A39_spearman", f"SELECT {R('corr(a, b)')} AS spearman, count(*) AS n FROM (SELECT {RK.format('l_quantity')} AS a, {RK.format('l_extendedprice')} AS b FROM lineitem)")
def _(m):
    return A.spearman(m.raw("lineitem"), "l_quantity", "l_extendedprice").withColumn("spearman", r6("spearman"))
