"""2.14 composite jobs, and the registry-driven rest."""

from pyspark.sql import functions as F

from ..fixed import EVENT_AGREEMENT, EVENT_QUARTILES, EVENT_RULES, EVENT_RX, FEATURE_GROUPS, RESEARCH_GROUPS
from ..functions import scalars as C
from ..operators import sequences as Q
from ..operators.aggregates import conditional_tables, majority_vote
from ..operators.calendar import assign_window
from ..operators.events import analyst_features, earnings_features, news_dedup, news_features, tagged
from ..operators.forum import activity_columns, ewm_abnormal, forum_counts
from ..plans import annotation as N, experiments as E
from ..plans.events import EVENTS, event_class, with_quartiles
from ..plans.panel import (attach_research, build_panel, daily_block, exploratory_panel, label_panel, one_target,
                           score_features, universe_panel)
from ..session import cut_lineage
from ..sources.market import ALIASES, CUTS, SYMBOLS
from .aggregates import EVS, FM, FT, LEXQ, WL
from .base import R, W, block_sql, clip_sql, cte, grade_sql, query
from .joins import articles, gap_rows
from .models import labelled_sequences, ml_panel
from .rules import KG, k_spec, weighted_score_sql
from .scans import SCORES_SQL, scores_of
from .sorts import H
from .text import ANON, NT, OWN, OWN_ROWS, TIDY
from .windows import SEQ_LIST, fold_sql, roll_sql, weighted_sums, weighted_sums_sql

r6 = C.r6
ALL = ("core", "scale", "cross", "event", "analyst", "news", "regime")


def all_tables(m):
    return {"daily": m.daily, "price": m.price, "earnings": m.events_month, "analyst": m.events_month, "news": m.news}


BLK = ("vol5", "vol20", "atr14", "big_rate60", "beta60")


@query("B1_daily_block", W("blk", body=f"SELECT symbol, date, {R('close_d0')} AS close_d0, {', '.join(R(c, 4) + f' AS {c}' for c in BLK)} FROM blk"))
def _(m):
    return daily_block(m.daily).select("symbol", "date", r6("close_d0").alias("close_d0"), *[r6(c, 4).alias(c) for c in BLK])


NUMS = {"gap_pct": 6, "gap_rank": 6, "vol5": 4, "vol20": 4, "atr14": 4, "zgap": 5, "mkt_gap": 6, "resid_gap": 4, "beta60": 4, "reg_med_vol20": 4,
        "reg_med_absgap": 6, "reg_gap_disp": 4, "reg_mkt_gap": 6, "reg_big_ratio": 6}
rnd = lambda df, cols: df.withColumns({c: r6(c, d) for c, d in cols.items()})
TGT = ("CASE WHEN target_prior = 0 THEN CASE WHEN target_current > 0 THEN 0.5 WHEN target_current < 0 THEN -0.5 END ELSE "
       + clip_sql("(target_current / NULLIF(target_prior, 0) - 1)", -0.5, 0.5) + " END")
EV_M = f"""(SELECT symbol, target, CAST(max_by(sign(d), k) AS DOUBLE) AS surp_sign, max_by(abs(d), k) AS surp_abs, max_by({clip_sql('surprise_pct', -50, 50)}, k) FILTER (surprise_pct IS NOT NULL) AS surp_pct_w,
  count(*)::DOUBLE AS an_n, (count(*) FILTER (action = 'up'))::DOUBLE AS an_up, (count(*) FILTER (action = 'down'))::DOUBLE AS an_down, avg({TGT}) AS an_tgt_chg
  FROM (SELECT *, eps_reported - eps_estimate AS d, (known_at, o_orderkey) AS k FROM ev_mt) GROUP BY symbol, target)"""


@query("B2_full_panel", W("peer", "regime", "ev_mt", "news_u", "grid", body=f"""SELECT p.symbol, p.target, {', '.join(R(('r.' if c.startswith('reg_') else 'p.gap_pct - p.beta60 * p.mkt_gap' if c == 'resid_gap' else 'p.') + (c if c != 'resid_gap' else ''), d) + f' AS {c}' for c, d in NUMS.items())},
  CASE WHEN e.an_n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS earn, e.surp_sign, e.surp_abs, e.surp_pct_w, coalesce(an_n, 0.0) AS an_n, coalesce(an_up, 0.0) AS an_up, coalesce(an_down, 0.0) AS an_down, {R('an_tgt_chg', 4)} AS an_tgt_chg,
  coalesce(CAST(sign(coalesce(an_up, 0) - coalesce(an_down, 0)) * sign(p.gap_pct) AS DOUBLE), 0.0) + 0.0 AS an_gap_agree,
  news_n, {R('news_abn')} AS news_abn, {R('tone_mean')} AS tone_mean, tone_min, tone_max, tone_neg_tail, news_missing FROM peer p LEFT JOIN regime r ON r.target = p.target
  LEFT JOIN {EV_M} e ON e.symbol = p.symbol AND e.target = p.target LEFT JOIN (SELECT symbol, target, n AS news_n, tone_mean, tone_min, tone_max, coalesce(neg, 0.0) AS tone_neg_tail,
   ln(1 + n) - ln(1 + CASE WHEN count(n) OVER w >= 20 THEN avg(n) OVER w END) AS news_abn, CASE WHEN count(n) OVER v >= 21 AND sum(n) OVER v = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS news_missing
   FROM (SELECT g.symbol, g.widx, g.target, coalesce(n, 0.0) AS n, tone_mean, tone_min, tone_max, neg FROM grid g LEFT JOIN (SELECT symbol, target, count(*)::DOUBLE AS n, avg(tone) AS tone_mean, min(tone) AS tone_min, max(tone) AS tone_max,
     (count(*) FILTER (tone < -5))::DOUBLE AS neg FROM news_u GROUP BY 1, 2) USING (symbol, target))
   WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY widx ROWS 20 PRECEDING)) n ON n.symbol = p.symbol AND n.target = p.target"""))
def _(m):
    x = rnd(build_panel(all_tables(m), m.cal, m.universe, ALL, tie="o_orderkey"), NUMS | {"an_tgt_chg": 4, "news_abn": 6, "tone_mean": 6})
    return x.select("symbol", "target", *NUMS, "earn", "surp_sign", "surp_abs", "surp_pct_w", "an_n", "an_up", "an_down", "an_tgt_chg",
                    (F.col("an_gap_agree") + 0.0).alias("an_gap_agree"), "news_n", "news_abn", "tone_mean", "tone_min", "tone_max", "tone_neg_tail", "news_missing")


def abnormal_sql(c: str) -> str:
    return f"ln(1 + {c}) - ln(1 + CASE WHEN count({c}) OVER w >= 20 THEN avg({c}) OVER w END)"


COUNTED = [f"n_{k}_r{r}" for r in range(3) for k in ("clu", "first")]
SCORED = ("tone_mean_r1", "tone_neg_share_r1", "tone_sd_r1", "lm_net_r1", "lm_neg_share_r1", "lm_unc_r1")
cte("sims", f"""SELECT a.symbol, a.widx, a.ckey, sum(a.x * b.x) AS sim FROM nv a JOIN nv b ON a.symbol = b.symbol AND a.w = b.w AND b.widx < a.widx AND b.widx >= a.widx - 20
  GROUP BY a.symbol, a.widx, a.ckey, b.widx, b.ckey""", "nv")
cte("nv", "SELECT symbol, widx, ckey, w, tf / sqrt(sum(tf * tf) OVER (PARTITION BY symbol, widx, ckey)) AS x FROM tf", "tf")
cte("tf", f"SELECT symbol, widx, ckey, w, count(*)::DOUBLE AS tf FROM (SELECT symbol, widx, ckey, unnest({NT}) AS w FROM reps) GROUP BY ALL", "reps")
cte("nov", "SELECT symbol, widx, max(1 - coalesce(best, 0)) AS novelty_r1 FROM (SELECT r.symbol, r.widx, r.ckey, (SELECT max(sim) FROM sims s WHERE s.symbol = r.symbol AND s.widx = r.widx AND s.ckey = r.ckey) AS best FROM reps r) GROUP BY 1, 2", "reps", "sims")
cte("scored", f"""SELECT symbol, widx, avg(tone) AS tone_mean_r1, avg(CAST(tone < 0 AS INT)) AS tone_neg_share_r1, stddev_samp(tone) AS tone_sd_r1, avg(lm_net) AS lm_net_r1, avg(CAST(lm_net < 0 AS INT)) AS lm_neg_share_r1,
  avg(lm_unc) AS lm_unc_r1, count(*)::DOUBLE AS n_scored_r1, {EVS}, md5(string_agg(title, ' || ' ORDER BY known_at, ckey)) AS joined FROM reps LEFT JOIN ({LEXQ}) USING (title_id) GROUP BY symbol, widx""", "reps", "lexicon")
cte("txt", f"""SELECT *, {', '.join(f'{abnormal_sql(c)} AS {c}_abn' for c in COUNTED)} FROM (SELECT g.symbol, g.target, g.widx, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in COUNTED)}, coalesce(src, 0.0) AS n_src_r1, share AS tmpl_share_r0,
   {', '.join(SCORED)}, coalesce(n_scored_r1, 0.0) AS n_scored_r1, {', '.join(f'ev_{e}_r1' for e in EVENT_RX)}, greatest({', '.join(f'ev_{e}_r1' for e in EVENT_RX)}) AS ev_any_r1, novelty_r1, coalesce(joined, md5('')) AS joined,
   CAST(g.symbol IN ('S08', 'S09') AS DOUBLE) AS alias_missing FROM grid g
   LEFT JOIN (SELECT symbol, widx, {', '.join(f"(count(*) FILTER (rel >= {c[-1]}{' AND is_first' if 'first' in c else ''}))::DOUBLE AS {c}" for c in COUNTED)} FROM clu GROUP BY 1, 2) c USING (symbol, widx)
   LEFT JOIN (SELECT symbol, widx, avg(is_template) AS share FROM arts GROUP BY 1, 2) t USING (symbol, widx)
   LEFT JOIN (SELECT symbol, widx, CAST(count(DISTINCT source) AS DOUBLE) AS src FROM arts WHERE rel >= 1 AND is_template = 0 GROUP BY 1, 2) s USING (symbol, widx)
   LEFT JOIN scored USING (symbol, widx) LEFT JOIN nov USING (symbol, widx)) WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", "grid", "clu", "arts", "scored", "nov")
TEXT_GROUPS = ("txt_count", "txt_tone_gdelt", "txt_tone_lm", "txt_novelty", "txt_event", "txt_meta", "txt_text")
TEXT_COLUMNS = [c for g in TEXT_GROUPS for c in FEATURE_GROUPS[g] if c != "titles_r1"]


def text_of(m):
    return {"articles": articles(m), "aliased": m.aliases, "lexicon": m.lexicon}


@query("B2_text_panel", W("peer", "txt", body=f"""SELECT p.symbol, p.target, {', '.join(R('p.' + c) + f' AS {c}' for c in ('close_d0', 'gap_pct', 'gap_rank'))},
  {', '.join(R('t.' + c, 8 if c.startswith(('lm_', 'novelty')) else 6) + f' AS {c}' for c in TEXT_COLUMNS)}, coalesce(t.joined, md5('')) AS titles_md5 FROM peer p LEFT JOIN txt t USING (symbol, target)"""))
def _(m):
    x = build_panel(all_tables(m), m.cal, m.universe, ("core", *TEXT_GROUPS), text=text_of(m))
    return x.select("symbol", "target", *[r6(c).alias(c) for c in ("close_d0", "gap_pct", "gap_rank")],
                    *[r6(c, 8 if c.startswith(("lm_", "novelty")) else 6).alias(c) for c in TEXT_COLUMNS], F.md5("titles_r1").alias("titles_md5"))


MEMB = "(SELECT symbol, 'u0' AS universe_id FROM universe WHERE symbol <= 'S06' UNION ALL SELECT symbol, 'u1' FROM universe WHERE symbol >= 'S03')"
NEWS_DAY = "(SELECT symbol, target, count(*)::DOUBLE AS news_n, avg(tone) AS tone_mean FROM news_u GROUP BY 1, 2)"
TONE_DAY = "(SELECT symbol, target, avg(tone) AS tone_mean_r1, count(*)::DOUBLE AS n_scored_r1 FROM reps GROUP BY 1, 2)"
LOO_G = "(SELECT CASE WHEN count(o.gap_pct) >= 3 THEN median(o.gap_pct) END FROM g o WHERE o.target = d.target AND o.universe_id = d.universe_id AND o.symbol <> d.symbol)"
MATRIX_GROUPS = ("event", "analyst", "news", "txt_tone_gdelt", "txt_meta")


@query("B3_universe_panels", W("gap", "universe", "daily", "ev_mt", "news_u", "reps", "tags", body=f"""WITH g AS (SELECT gap.*, universe_id FROM gap JOIN {MEMB} USING (symbol))
  SELECT w.*, {grade_sql('(l.ret * 100)', CUTS)} AS label, CASE WHEN e.an_n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS earn, e.surp_pct_w, coalesce(an_n, 0.0) AS an_n, coalesce(an_up, 0.0) AS an_up, {R('an_tgt_chg', 4)} AS an_tgt_chg,
    coalesce(news_n, 0.0) AS news_n, {R('tone_mean')} AS tone_mean, {R('tone_mean_r1')} AS tone_mean_r1, coalesce(n_scored_r1, 0.0) AS n_scored_r1, fb_net_r1
  FROM (SELECT d.symbol, d.target, d.universe_id, {R(LOO_G)} AS mkt_gap,
  {R('CASE WHEN gap_pct IS NOT NULL THEN (rank() OVER (PARTITION BY universe_id, target ORDER BY gap_pct) + (count(*) OVER (PARTITION BY universe_id, target, gap_pct) - 1) / 2.0) / count(gap_pct) OVER (PARTITION BY universe_id, target) END')} AS gap_rank,
  {R('median(gap_pct) OVER (PARTITION BY universe_id, target)')} AS reg_mkt_gap FROM g d) w JOIN daily l ON l.symbol = w.symbol AND l.date_et = w.target AND l.ret IS NOT NULL
  LEFT JOIN {EV_M} e ON e.symbol = w.symbol AND e.target = w.target LEFT JOIN {NEWS_DAY} n ON n.symbol = w.symbol AND n.target = w.target LEFT JOIN {TONE_DAY} t ON t.symbol = w.symbol AND t.target = w.target
  LEFT JOIN (SELECT symbol, target, {R('avg(p_pos - p_neg)')} AS fb_net_r1 FROM tags JOIN ({SCORES_SQL}) ON doc_id = title_id GROUP BY 1, 2) f ON f.symbol = w.symbol AND f.target = w.target"""))
def _(m):
    u = m.universe
    memb = (u.where("symbol <= 'S06'").withColumn("universe_id", F.lit("u0"))
            .unionByName(u.where("symbol >= 'S03'").withColumn("universe_id", F.lit("u1"))))
    n = tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", F.col("doc_id").alias("title_id")), m.universe)
    research = {"blocks": {"finbert": (score_features(n, scores_of(m)), ["symbol", "target"])}, "expected": {"finbert": ["fb_net_r1"]}}
    x = universe_panel(all_tables(m), m.cal, memb, cuts=CUTS, groups=MATRIX_GROUPS, text=text_of(m), tie="o_orderkey", research=research)
    x = rnd(x, {"mkt_gap": 6, "gap_rank": 6, "reg_mkt_gap": 6, "an_tgt_chg": 4, "tone_mean": 6, "tone_mean_r1": 6, "fb_net_r1": 6})
    return x.select("symbol", "target", "universe_id", "mkt_gap", "gap_rank", "reg_mkt_gap", "label", "earn", "surp_pct_w", "an_n", "an_up", "an_tgt_chg",
                    "news_n", "tone_mean", "tone_mean_r1", "n_scored_r1", "fb_net_r1")


LOO_U = "(SELECT CASE WHEN count(o.r) >= 3 THEN median(o.r) END FROM u o WHERE o.date_et = d.date_et AND o.universe_id = d.universe_id AND o.symbol <> d.symbol)"


@query("B3_universe_beta", W("daily_w", body=f"""WITH u AS (SELECT w.*, w.ret * 100 AS r, universe_id FROM daily_w w JOIN (SELECT DISTINCT symbol, 'u0' AS universe_id FROM daily_w WHERE symbol <= 'S06'
  UNION ALL SELECT DISTINCT symbol, 'u1' FROM daily_w WHERE symbol >= 'S03') USING (symbol)),
  m AS (SELECT d.universe_id || '/' || d.symbol AS symbol, date_et, close, high, low, prev_close, r, {LOO_U} AS m FROM u d)
  SELECT symbol AS member, date, {R('vol20')} AS vol20, {R('beta60')} AS beta60 FROM ({block_sql('m')})"""))
def _(m):
    s = m.daily_w.select("symbol").distinct()
    memb = s.where("symbol <= 'S06'").withColumn("universe_id", F.lit("u0")).unionByName(s.where("symbol >= 'S03'").withColumn("universe_id", F.lit("u1")))
    x = daily_block(m.daily_w.join(memb, "symbol"), within=("universe_id",))
    return x.select(F.concat_ws("/", "universe_id", "symbol").alias("member"), "date", r6("vol20").alias("vol20"), r6("beta60").alias("beta60"))


@query("B4_one_target_panel", W("peer", body=f"SELECT symbol, target, {R('gap_pct')} AS gap_pct, {R('gap_rank')} AS gap_rank, {R('mkt_gap')} AS mkt_gap FROM peer WHERE target = DATE '2024-01-24'"))
def _(m):
    x = one_target(build_panel({"daily": m.daily, "price": m.price}, m.cal, m.universe, ("core", "cross")), "2024-01-24")
    return x.select("symbol", "target", *[r6(c).alias(c) for c in ("gap_pct", "gap_rank", "mkt_gap")])


cte("de", """SELECT d.*, (SELECT CASE WHEN (SELECT count(*) FROM daily g WHERE g.date_et = d.date_et) >= 3 THEN median(o.ret) END FROM daily o WHERE o.date_et = d.date_et AND o.symbol <> d.symbol) AS mk,
  greatest(high - low, abs(high - prev_close), abs(low - prev_close)) / close AS tr, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date_et) - 1 AS ret5 FROM daily d""", "daily")


B5_SQL = f"""SELECT * FROM (WITH f AS (SELECT *, {roll_sql('stddev_samp', 'ret', 5, 2)} AS vol5, {roll_sql('stddev_samp', 'ret', 20, 10)} AS vol20,
   ({roll_sql('avg', 'ret * mk', 60, 30)} - {roll_sql('avg', 'ret', 60, 30)} * {roll_sql('avg', 'mk', 60, 30)}) / NULLIF({roll_sql('avg', 'mk * mk', 60, 30)} - {roll_sql('avg', 'mk', 60, 30)} * {roll_sql('avg', 'mk', 60, 30)}, 0) AS beta60 FROM de),
  a AS (SELECT symbol, date_et, v AS atr14 FROM ({fold_sql(1 / 14, 'tr', 'de')})),
  p AS (SELECT f.symbol, c.target, f.vol5, f.vol20, f.ret5, f.beta60, a.atr14, t.ret * 100 AS ret_pct, {grade_sql('(t.ret * 100)', CUTS)} AS label, e.pre_last / f.close - 1 AS gap, e.pre_last_leak / f.close - 1 AS gap_leak, q.post_last / f.close - 1 AS post_ret
   FROM f JOIN a USING (symbol, date_et) JOIN cal c ON c.date = f.date_et JOIN daily t ON t.symbol = f.symbol AND t.date_et = c.target AND t.ret IS NOT NULL LEFT JOIN ext e ON e.symbol = f.symbol AND e.day = c.target LEFT JOIN ext q ON q.symbol = f.symbol AND q.day = c.date)
  SELECT symbol, target, {R('vol5', 5)} AS vol5, {R('vol20', 5)} AS vol20, {R('ret5')} AS ret5, {R('atr14')} AS atr14, {R('ret_pct', 5)} AS ret_pct, label, {R('gap')} AS gap, {R('gap_leak')} AS gap_leak, {R('post_ret')} AS post_ret,
   {R('gap / NULLIF(vol20, 0)', 4)} AS zgap, {R('mg')} AS mkt_gap, {R('gap - coalesce(beta60, 1) * mg')} AS resid_gap FROM (SELECT p.*, (SELECT CASE WHEN (SELECT count(*) FROM p g WHERE g.target = p.target) >= 3 THEN median(o.gap) END FROM p o WHERE o.target = p.target AND o.symbol <> p.symbol) AS mg FROM p))"""


@query("B5_exploratory_panel", W("de", "cal", "ext", body=B5_SQL))
def _(m):
    x = exploratory_panel({"daily": m.daily, "price": m.price}, m.cal, CUTS)
    cols = {"vol5": 5, "vol20": 5, "ret5": 6, "atr14": 6, "ret_pct": 5, "gap": 6, "gap_leak": 6, "post_ret": 6, "zgap": 4, "mkt_gap": 6, "resid_gap": 6}
    return rnd(x, cols).select("symbol", "target", "label", *cols)


def ewm_sql(counts: str, key: str) -> str:
    """(key, target, items, abn): counts (key, target, n) on the dense grid, today's against the day before's smoothing."""
    return f"""SELECT {key}, target, items, ln(1 + items) - ln(1 + lag(v) OVER (PARTITION BY {key} ORDER BY target)) AS abn FROM (SELECT {key}, unnest(ds) AS target, unnest(xs) AS items, unnest(sm) AS v FROM (SELECT {key}, ds, xs,
  list_transform(range(1, len(xs) + 1), lambda k: list_reduce(xs[1:k], lambda s, x: {2 / 21!r} * x + (1 - {2 / 21!r}) * s)) AS sm FROM (SELECT {key}, list(items ORDER BY target) AS xs, list(target ORDER BY target) AS ds FROM (
  SELECT g.{key}, g.target, CAST(coalesce(n, 0) AS DOUBLE) AS items FROM (SELECT DISTINCT c.{key}, cal.target FROM ({counts}) c, cal) g LEFT JOIN ({counts}) USING ({key}, target)) GROUP BY 1)))"""


B5_BLOCKS = {"surp_sign": 6, "surp_abs": 6, "surp_pct_w": 6, "an_tgt_chg": 4, "tone_mean": 6, "tone_min": 6, "tone_max": 6, "tone_std": 6, "tone_neg_tail": 6, "tone_pos_tail": 6, "news_n": 6, "news_n_abn": 6,
             "mentions": 6, "mentions_abn": 6, "act_user_abn": 6, "act_assistant_abn": 6, "act_system_abn": 6}
B5_ZEROS = ("earn", "an_n", "an_up", "an_down", "an_init", "news_raw")
cte("b5", B5_SQL, "de", "cal", "ext")


@query("B5_enriched_exploratory_panel", W("b5", "ev_mt", "news_u", "cal", "forum", "universe", body=f"""SELECT b.symbol, b.target, b.gap, b.label, {', '.join(R(c, d) + f' AS {c}' for c, d in B5_BLOCKS.items())}, CASE WHEN e.an_n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS earn,
  coalesce(an_n, 0.0) AS an_n, coalesce(an_up, 0.0) AS an_up, coalesce(an_down, 0.0) AS an_down, coalesce(an_init, 0.0) AS an_init, coalesce(news_raw, 0.0) AS news_raw FROM b5 b
  LEFT JOIN {EV_M} e USING (symbol, target) LEFT JOIN (SELECT symbol, target, (count(*) FILTER (action = 'init'))::DOUBLE AS an_init FROM ev_mt GROUP BY 1, 2) i USING (symbol, target)
  LEFT JOIN (SELECT symbol, target, avg(tone) AS tone_mean, min(tone) AS tone_min, max(tone) AS tone_max, stddev_samp(tone) AS tone_std, (count(*) FILTER (tone < -5))::DOUBLE AS tone_neg_tail, (count(*) FILTER (tone > 5))::DOUBLE AS tone_pos_tail,
    sum(copies)::DOUBLE AS news_raw FROM news_u GROUP BY 1, 2) n USING (symbol, target)
  LEFT JOIN (SELECT symbol, target, items AS news_n, abn AS news_n_abn FROM ({ewm_sql('SELECT symbol, target, count(*) AS n FROM news_u GROUP BY 1, 2', 'symbol')})) na USING (symbol, target)
  LEFT JOIN (SELECT symbol, target, items AS mentions, abn AS mentions_abn FROM ({ewm_sql(f'SELECT symbol, target, count(*) AS n FROM {FM} GROUP BY 1, 2', 'symbol')})) ma USING (symbol, target)
  LEFT JOIN (SELECT target, {', '.join(f"max(abn) FILTER (sub = '{s}') AS act_{s}_abn" for s in ('user', 'assistant', 'system'))} FROM ({ewm_sql(f'SELECT sub, target, count(*) AS n FROM {FT} GROUP BY 1, 2', 'sub')}) GROUP BY 1) act USING (target)"""))
def _(m):
    x = exploratory_panel({"daily": m.daily, "price": m.price}, m.cal, CUTS)
    men, act = forum_counts(m.forum, m.cal, m.universe)
    tot = men.groupBy("symbol", "target").agg(F.sum("mentions").alias("mentions"))
    news = news_features(news_dedup(m.news, m.cal, m.universe))
    keys = ["symbol", "target"]
    x = (x.join(earnings_features(m.events_month, m.cal, tie="o_orderkey"), keys, "left").join(analyst_features(m.events_month, m.cal, True), keys, "left")
         .join(news.drop("news_n"), keys, "left").join(ewm_abnormal(news.select("symbol", "target", "news_n"), "symbol", "news_n", m.cal), keys, "left")
         .join(ewm_abnormal(tot, "symbol", "mentions", m.cal), keys, "left")
         .join(activity_columns(ewm_abnormal(act, "sub", "items", m.cal), ["user", "assistant", "system"]), "target", "left"))
    x = x.fillna(0, list(B5_ZEROS))
    return x.select("symbol", "target", r6("gap").alias("gap"), "label", *[r6(c, d).alias(c) for c, d in B5_BLOCKS.items()], *B5_ZEROS)


@query("B6_research_columns", W("gap", "tags", body=f"""SELECT g.symbol, g.target, fb_net_r1, fb_n_r1, CAST(NULL AS DOUBLE) AS ann_sign FROM gap g LEFT JOIN (SELECT symbol, target, {R('avg(p_pos - p_neg)')} AS fb_net_r1, count(*) AS fb_n_r1
  FROM tags JOIN ({SCORES_SQL}) ON doc_id = title_id GROUP BY 1, 2) f USING (symbol, target)"""))
def _(m):
    n = tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", F.col("doc_id").alias("title_id")), m.universe)
    fb = score_features(n, scores_of(m))
    x = attach_research(gap_rows(m).select("symbol", "target"), {"finbert": (fb, ["symbol", "target"])}, {"finbert": ["fb_net_r1", "fb_n_r1"], "annotations": ["ann_sign"]})
    return x.withColumn("fb_net_r1", r6("fb_net_r1"))


#: What stands in for outside annotators here: answers that follow from the very text they are shown, so masked and unmasked titles are answered apart.
MASKED = TIDY.replace("{0}", ANON)
TARGET_MASKED = TIDY.replace("{0}", "regexp_replace(regexp_replace(title, p, '[TARGET]', 'g'), '" + "|".join(OWN[s] for s in ALIASES) + "', '[OTHER]', 'g')")
CLASSES = ("negative", "neutral", "positive")
VOTE_SQL = lambda i: f"['negative', 'neutral', 'positive'][{H(repr(str(i)), 'masked')} % 3 + 1]"


@query("B7_annotation_quality", W("arts", body=f"""SELECT rel, count(*) AS n, {R('avg(CAST(v1 = v2 AS INT))')} AS agreement, {R('avg(CAST(pol = silver AS INT))')} AS accuracy, {R("avg(CAST(pol = 'positive' AS INT)) FILTER (silver = 'positive')")} AS recall_positive,
  {R("avg(CAST(pol = 'negative' AS INT)) FILTER (silver = 'negative')")} AS recall_negative, {R("avg(CAST(silver = 'positive' AS INT))")} AS share_positive FROM (
  SELECT *, CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' ELSE 'neutral' END AS pol, CASE WHEN v1 = v2 OR v1 = v3 THEN v1 WHEN v2 = v3 THEN v2 ELSE least(v1, v2, v3) END AS silver FROM (
  SELECT *, {', '.join(f'{VOTE_SQL(i)} AS v{i}' for i in (1, 2, 3))} FROM (SELECT rel, tone, {TARGET_MASKED} AS masked FROM (SELECT * FROM (SELECT title_id, symbol, rel, min(title) AS title, avg(tone) AS tone FROM arts WHERE is_template = 0 GROUP BY 1, 2, 3)
   QUALIFY row_number() OVER (PARTITION BY rel ORDER BY {H("'7'", 'title_id', 'symbol')}, title_id, symbol) <= 40) JOIN (VALUES {OWN_ROWS}) t(s, p) ON s = symbol))) GROUP BY 1"""))
def _(m):
    """A sample of titles per relevance tier, masked for their company, answered three times; tone against the majority."""
    from pyspark.sql import Window as SW
    from ..plans.anonymise import anonymise_target
    a = articles(m).where("is_template = 0").groupBy("title_id", "symbol", "rel").agg(F.min("title").alias("title"), F.avg("tone").alias("tone"))
    w = SW.partitionBy("rel").orderBy(C.hash_int(7, "title_id", "symbol"), "title_id", "symbol")
    a = a.withColumn("_r", F.row_number().over(w)).where("_r <= 40").drop("_r")
    x = anonymise_target(a, "title", "symbol", SYMBOLS, ALIASES)
    names = F.array(*[F.lit(c) for c in CLASSES])
    x = x.withColumns({f"v{i}": F.get(names, (C.hash_int(i, "masked") % 3).cast("int")) for i in (1, 2, 3)}).withColumn("id", F.concat_ws("|", "title_id", "symbol", F.col("rel").cast("string")))
    x = majority_vote(x, "id", ["v1", "v2", "v3"], "silver").withColumn("pol", N.polarity("tone", 1, -1))
    mt = N.class_metrics("pol", "silver", ("negative", "positive"))
    return x.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), r6(N.agreement("v1", "v2")).alias("agreement"), r6(mt["accuracy"]).alias("accuracy"), r6(mt["recallpositive"]).alias("recall_positive"),
                                r6(mt["recallnegative"]).alias("recall_negative"), r6(mt["sharepositive"]).alias("share_positive"))


GUESSES = lambda h: f"CASE {h} % 4 WHEN 0 THEN 2023 WHEN 1 THEN NULL ELSE 2024 END AS gy, {h} % 3 + 1 AS gm"


@query("B8_placebo_hit_rates", W("arts", body=f"""SELECT variant, count(*) AS n, {R('avg(CAST(gy = year(known_at) AS INT))')} AS year_acc, {R('avg(CAST(gy = year(known_at) AND gm = month(known_at) AS INT))')} AS year_month_acc FROM (
  SELECT variant, known_at, {GUESSES(H('shown'))} FROM (SELECT known_at, unnest(['raw', 'anon']) AS variant, unnest([title, {MASKED}]) AS shown FROM (SELECT title_id, min(title) AS title, min(known_at) AS known_at FROM arts WHERE is_template = 0 AND rel >= 1 GROUP BY 1
   QUALIFY row_number() OVER (ORDER BY {H("'5'", 'title_id')}, title_id) <= 100))) WHERE gy IS NOT NULL GROUP BY 1"""))
def _(m):
    """A sample of distinct titles, shown as they are and masked, and the dates guessed from what is shown."""
    from ..sources.tables import hash_sample
    from ..plans.anonymise import anonymise
    t = articles(m).where("is_template = 0 AND rel >= 1").groupBy("title_id").agg(F.min("title").alias("title"), F.min("known_at").alias("known_at"))
    t = hash_sample(t, "title_id", 100, 5)
    shown = F.array(F.struct(F.lit("raw").alias("variant"), F.col("title").alias("shown")), F.struct(F.lit("anon").alias("variant"), anonymise("title", ALIASES).alias("shown")))
    x = t.select("known_at", F.inline(shown))
    h = C.hash_int("shown")
    year = F.when(h % 4 == 0, 2023).when(h % 4 != 1, 2024)
    return N.placebo_rates(x.withColumns({"gy": year, "gm": h % 3 + 1}), "known_at", "gy", "gm")


SIGN_OF = lambda h: f"sign(CASE {h} % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + CASE ({h} // 3) % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)"
cte("anns", f"""SELECT symbol, target, sign(sum({SIGN_OF('hr')})) AS raw, sign(sum({SIGN_OF('ha')})) AS anon, avg((hr // 12) % 4) AS sev_raw, avg((ha // 12) % 4) AS sev_anon, count(*) AS n
  FROM (SELECT symbol, target, {H('title')} AS hr, {H(MASKED)} AS ha FROM tags) GROUP BY 1, 2""", "tags")


def annotation_signs(m):
    """Annotation features of the records of the titles as they are and of the masked titles."""
    from ..plans.anonymise import anonymise
    n = assign_window(m.news, m.cal, "known_at").select("symbols", "target", "title", anonymise("title", ALIASES).alias("masked"))
    # a record takes its answers from one hash, made once per title
    n = n.select("symbols", "target", C.hash_int("title").alias("raw"), C.hash_int("masked").alias("anon"))

    def record(c):
        h = F.col(c)
        pick = lambda v, up, down: F.when(v == 0, up).when(v == 1, down).otherwise("none")
        part = lambda size: F.floor(h / size)
        return F.to_json(F.struct(pick(h % 3, "beat", "miss").alias("earnings_result"), pick(part(3) % 4, "raise", "cut").alias("guidance_action"), F.lit("none").alias("analyst_action"),
                                  (part(12) % 4).cast("int").alias("severity"), (part(48) % 3).cast("int").alias("unexpectedness")))
    each = lambda v: tagged(n.select("symbols", "target", v), m.universe, carry=(v,)).select("symbol", "target", record(v).alias(v))
    return tuple(N.news_annotation_features(each(v), v) for v in ("raw", "anon"))


@query("B9_variant_errors", W("anns", body=f"SELECT {R('avg(abs(raw - anon))')} AS mae_sign, {R('avg(abs(sev_raw - sev_anon))')} AS mae_severity, count(*) AS n FROM anns"))
def _(m):
    from ..operators.joins import join_variants
    raw, anon = (x.select("symbol", "target", "sign", "severity") for x in annotation_signs(m))
    x = N.variant_error(join_variants(raw, anon, ["symbol", "target"], "_raw", "_anon"), [("sign_raw", "sign_anon"), ("severity_raw", "severity_anon")])
    return x.select(r6("mae_sign_raw").alias("mae_sign"), r6("mae_severity_raw").alias("mae_severity"), "n")


@query("B9_variant_comparison", W("anns", "panel", body=f"""SELECT (sign(v.raw) * sign(gap_pct))::INT AS agree, count(*) AS n, {R('avg(rest)')} AS rest_mean, {R('avg(CAST(v.raw = v.anon AS INT))')} AS sign_agreement FROM anns v JOIN panel p USING (symbol, target) GROUP BY 1"""))
def _(m):
    from ..operators.joins import join_variants
    raw, anon = (x.select("symbol", "target", "sign") for x in annotation_signs(m))
    x = join_variants(raw, anon, ["symbol", "target"], "_raw", "_anon").join(label_panel(gap_rows(m), m.daily, CUTS), ["symbol", "target"])
    return N.variant_summary(x, "sign_raw", "sign_anon", "gap_pct", "rest")


@query("B10_labelled_sequences", W("daily_w", body=f"""SELECT symbol, target, label, {weighted_sums_sql('xs[k][{c}]', 'wsum')} FROM (
  SELECT symbol, date_et AS target, i, xs FROM ({SEQ_LIST})) JOIN (SELECT symbol, date_et AS target, label FROM {WL}) USING (symbol, target) WHERE i >= 21"""))
def _(m):
    return labelled_sequences(m).select("symbol", "target", "label", *weighted_sums("sequence", "wsum"))


@query("P8_finite_windows", W("daily_w", body=f"""SELECT symbol, count(*) AS n FROM daily_w WHERE i >= 21 GROUP BY 1"""))
def _(m):
    return Q.sequence_windows(m.daily_w).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


EVENT_GROUPS = ("core", "event", "analyst", "news", "txt_count", "txt_tone_gdelt", "txt_tone_lm", "txt_novelty", "txt_event", "txt_meta")


def event_panel(m):
    """Labelled panel with every column the event classes read; research columns come attached by their registry names."""
    x = build_panel(all_tables(m), m.cal, m.universe, EVENT_GROUPS, text=text_of(m), tie="o_orderkey")
    men, _ = forum_counts(m.forum, m.cal, m.universe)
    tot = men.groupBy("symbol", "target").agg(F.sum("mentions").alias("mentions"))
    keys = ["symbol", "target"]
    raw, anon = annotation_signs(m)
    n = tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", F.col("doc_id").alias("title_id")), m.universe)
    named = lambda t, v: t.select(*keys, F.col("sign").alias(f"llm_{v}_sign"))
    blocks = {"reddit": (ewm_abnormal(tot, "symbol", "mentions", m.cal), keys), "news_llm_anon": (named(anon, "anon"), keys),
              "news_llm_raw": (named(raw, "raw"), keys), "finbert": (score_features(n, scores_of(m)), keys)}
    x = attach_research(x, blocks, {k: RESEARCH_GROUPS[k] for k in blocks})
    x = cut_lineage(label_panel(x, m.daily, CUTS))
    return with_quartiles(with_quartiles(x, "news_abn"), "mentions_abn")


def quartile_sql(c: str, names) -> str:
    bin_ = f"greatest(len(list_filter({c}_e, lambda e: e < {c})) - 1, 0)"
    return f"coalesce([{', '.join(repr(n) for n in names)}][CASE WHEN {c} IS NOT NULL THEN {bin_} END + 1], 'nan')"


def event_sql(name: str) -> str:
    if name in EVENT_RULES:
        *rules, rest = EVENT_RULES[name]
        return "CASE " + " ".join(f"WHEN {c.replace('7D', '7').replace('4D', '4')} THEN '{n}'" for c, n in rules) + f" ELSE '{rest}' END"
    if name in EVENT_QUARTILES:
        return quartile_sql(EVENT_QUARTILES[name][0], EVENT_QUARTILES[name][1:])
    c = EVENT_AGREEMENT[name]
    return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN 'no_event' WHEN sign({c}) * sign(gap_pct) > 0 THEN 'same_dir' WHEN sign({c}) * sign(gap_pct) < 0 THEN 'opposite' ELSE 'gap_0' END"


#: Smoothed forum mentions of a symbol, the day before's smoothing against today's count.
cte("mabn", f"SELECT symbol, target, abn AS mentions_abn FROM ({ewm_sql(f'SELECT symbol, target, count(*) AS n FROM {FM} GROUP BY 1, 2', 'symbol')})", "forum", "cal", "universe")
cte("evp0", f"""SELECT p.symbol, p.target, p.gap_pct, p.ret_pct, p.label, p.rest, CASE WHEN e.an_n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS earn, surp_sign, coalesce(an_up, 0.0) AS an_up, coalesce(an_down, 0.0) AS an_down, tone_mean, news_abn, mentions_abn,
   t.* EXCLUDE (symbol, target, widx), llm_raw_sign, llm_anon_sign, fb_net_r1 FROM panel p LEFT JOIN {EV_M} e USING (symbol, target) LEFT JOIN txt t USING (symbol, target) LEFT JOIN mabn USING (symbol, target)
   LEFT JOIN (SELECT symbol, target, avg(tone) AS tone_mean FROM news_u GROUP BY 1, 2) n USING (symbol, target)
   LEFT JOIN (SELECT symbol, target, {abnormal_sql('n')} AS news_abn FROM (SELECT g.*, coalesce(n, 0.0) AS n FROM grid g LEFT JOIN (SELECT symbol, target, count(*)::DOUBLE AS n FROM news_u GROUP BY 1, 2) USING (symbol, target))
     WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) na USING (symbol, target)
   LEFT JOIN (SELECT symbol, target, raw AS llm_raw_sign, anon AS llm_anon_sign FROM anns) a USING (symbol, target)
   LEFT JOIN (SELECT symbol, target, avg(p_pos - p_neg) AS fb_net_r1 FROM tags JOIN ({SCORES_SQL}) ON doc_id = title_id GROUP BY 1, 2) f USING (symbol, target)""", "panel", "ev_mt", "txt", "mabn", "news_u", "grid", "tags", "anns")
cte("evp", "SELECT *, " + ", ".join(f"list_sort(list_distinct((SELECT quantile_cont({c}, [0, 0.25, 0.5, 0.75, 1]) FROM evp0 WHERE {c} IS NOT NULL))) AS {c}_e" for c in ("news_abn", "mentions_abn")) + " FROM evp0", "evp0")
EVENT_ROWS = "SELECT *, unnest([" + ", ".join(f"struct_pack(event := '{n}', category := {event_sql(n)})" for n in EVENTS) + "], recursive := true) FROM evp"


@query("P13_event_classes", W("evp", body=f"SELECT symbol, target, event, category FROM ({EVENT_ROWS})"))
def _(m):
    rows = F.array(*[F.struct(F.lit(n).alias("event"), event_class(n).alias("category")) for n in EVENTS])
    return event_panel(m).select("symbol", "target", F.inline(rows))


@query("P13_event_classes_core", W("panel", "ev_mt", body=f"""SELECT p.symbol, p.target, CASE WHEN an_up > an_down THEN 'upgrade' WHEN an_down > an_up THEN 'downgrade' ELSE 'none' END AS analyst,
  CASE WHEN e.an_n > 0 THEN CASE WHEN surp_sign > 0 THEN 'beat' ELSE 'miss_or_meet' END ELSE 'none' END AS earnings FROM panel p LEFT JOIN {EV_M} e USING (symbol, target)"""))
def _(m):
    x = build_panel(all_tables(m), m.cal, m.universe, ("core", "event", "analyst"), tie="o_orderkey")
    x = label_panel(x, m.daily, CUTS)
    return x.select("symbol", "target", event_class("analyst").alias("analyst"), event_class("earnings").alias("earnings"))


@query("A22_all_conditional_tables", W("evp", body=f"""SELECT event, gap_bin, category, count(*) AS n, {R('avg(CAST(ret_pct > 0 AS INT))')} AS up_rate, {R('avg(CAST(label IN (0, 4) AS INT))')} AS M_rate, {R('avg(rest)')} AS rest_mean, {R('avg(ret_pct)', 5)} AS ret_mean
  FROM (SELECT *, CASE WHEN abs(gap_pct) < 10 THEN 0 WHEN abs(gap_pct) < 30 THEN 1 WHEN gap_pct IS NOT NULL THEN 2 END AS gap_bin FROM ({EVENT_ROWS})) WHERE gap_bin IS NOT NULL GROUP BY 1, 2, 3"""))
def _(m):
    t = conditional_tables(event_panel(m), {n: event_class(n) for n in EVENTS}, bins=(0, 10, 30, float("inf")))
    return t.withColumns({c: r6(c) for c in ("up_rate", "M_rate", "rest_mean")} | {"ret_mean": r6("ret_mean", 5)})


FOLDS = [{"name": "a", "start": "2024-01-12", "end": "2024-01-18"}, {"name": "b", "start": "2024-01-18", "end": "2024-01-24"}, {"name": "c", "start": "2024-01-24", "end": "2024-01-31"}]
#: One searched candidate per block: price, cross, event, news, text.
MATRIX = {"k": "gap_pct", "cross": "mkt_gap", "event": "surp_pct_w", "news": "tone_mean", "text": "tone_mean_r1"}
K_AT = "coalesce(CAST(s >= -25.0::DOUBLE / k AS INT) + CAST(s >= -6.0::DOUBLE / k AS INT) + CAST(s >= 6.0::DOUBLE / k AS INT) + CAST(s >= 25.0::DOUBLE / k AS INT), 2)"
DRAWN = lambda what: H("'1'", f"'{what}'", "CAST(draw AS VARCHAR)", "symbol")
SIGNALS_SQL = "unnest([" + ", ".join(f"struct_pack(candidate := '{n}', s := {c}::DOUBLE)" for n, c in MATRIX.items()) + "], recursive := true)"


@query("E11_experiment_matrix", W("gap", "universe", "daily", "ev_mt", "news_u", "reps", body=f"""WITH x AS (SELECT symbol, draw FROM universe, (SELECT unnest([0, 1, 2]) AS draw)),
  u AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {DRAWN('unseen')}, symbol) AS r FROM x),
  sn AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY {DRAWN('seen')}, symbol) AS rs, row_number() OVER (PARTITION BY draw ORDER BY {DRAWN('part')}, symbol) AS rp FROM u WHERE r > 2),
  memb AS (SELECT symbol, 'test-' || draw AS universe_id, draw, 'test' AS side, false AS seen FROM u WHERE r <= 2 UNION ALL SELECT symbol, 'test-' || draw, draw, 'test', true FROM sn WHERE rs <= 3
    UNION ALL SELECT symbol, 'train-' || draw || '-' || ntile((SELECT ceil((count(*) - 2) / 4.0) FROM universe)::INT) OVER (PARTITION BY draw ORDER BY rp), draw, 'train', true FROM sn),
  g AS (SELECT gap.symbol, gap.target, gap_pct, universe_id FROM gap JOIN (SELECT DISTINCT symbol, universe_id FROM memb) USING (symbol)),
  mg AS (SELECT d.*, {LOO_G} AS mkt_gap FROM g d),
  p AS (SELECT mg.symbol, mg.target, m.draw, m.side, m.seen, {grade_sql('(l.ret * 100)', CUTS)} AS label, gap_pct, mkt_gap, surp_pct_w, tone_mean, tone_mean_r1 FROM mg JOIN memb m ON m.symbol = mg.symbol AND m.universe_id = mg.universe_id
    JOIN daily l ON l.symbol = mg.symbol AND l.date_et = mg.target AND l.ret IS NOT NULL LEFT JOIN {EV_M} e ON e.symbol = mg.symbol AND e.target = mg.target
    LEFT JOIN {NEWS_DAY} n ON n.symbol = mg.symbol AND n.target = mg.target LEFT JOIN {TONE_DAY} t ON t.symbol = mg.symbol AND t.target = mg.target),
  sig AS (SELECT symbol, target, draw, side, seen, label, {SIGNALS_SQL} FROM p),
  folds(fold, lo, hi) AS (VALUES {', '.join(f"('{f['name']}', DATE '{f['start']}', DATE '{f['end']}')" for f in FOLDS)}),
  src AS (SELECT draw, fold, candidate, k, label, {K_AT} AS pred FROM sig, folds, {KG} WHERE side = 'train' AND target < lo - INTERVAL 2 DAY),
  best AS (SELECT draw, fold, candidate, k FROM ({weighted_score_sql('SELECT * FROM src', 'draw, fold, candidate, k')}) QUALIFY row_number() OVER (PARTITION BY draw, fold, candidate ORDER BY round(score, 12) DESC NULLS LAST, k) = 1)
  SELECT fold, draw::INT AS draw, candidate, symbol, target, seen, label, {K_AT} AS pred FROM sig JOIN folds ON side = 'test' AND target >= lo AND target < hi JOIN best USING (draw, fold, candidate)
  UNION ALL SELECT fold, draw::INT, 'identity', symbol, target, seen, label, coalesce({grade_sql('gap_pct', CUTS)}, 2) FROM p JOIN folds ON side = 'test' AND target >= lo AND target < hi"""))
def _(m):
    from ..plans.splits import universe_draws
    draws = universe_draws(m.universe, 3, 2, 3, 4, 1)
    specs = [{**k_spec(), "name": n, "signal": {"type": "gap", "params": {"col": c}}} for n, c in MATRIX.items()]
    specs.append({**k_spec(), "name": "identity", "decision": {"type": "identity", "params": {"cuts": CUTS}}})
    return E.run_matrix(all_tables(m), m.cal, draws, FOLDS, specs, 2.5, CUTS, embargo_days=2, groups=MATRIX_GROUPS, text=text_of(m), tie="o_orderkey")


LADDER = {"scale": ["vol5", "atr14"], "cross": ["mkt_gap", "resid_gap"]}


def thirteen_splits(m):
    """Three walk-forward folds, five sets of held symbols, and the same sets on later days."""
    from ..plans.splits import symbol_holdout, time_symbol_holdout, walk_forward
    p = ml_panel(m)
    sets = lambda x, kind: x.withColumn("split", F.concat(F.lit(kind), F.col("set_id").cast("string"))).drop("set_id")
    x = walk_forward(p, "target", ["2024-01-14", "2024-01-19", "2024-01-24"], 5, 2).withColumnRenamed("fold", "split")
    return cut_lineage(x.unionByName(sets(symbol_holdout(p, 5, 3), "symbols")).unionByName(sets(time_symbol_holdout(p, "target", "2024-01-18", 5, 3, 2), "both")))


@query("E12_feature_group_deltas")
def _(m):
    spec = {"name": "r", "signal": {"type": "regress"}, "decision": {"type": "k", "params": {"cuts": CUTS}}}
    return E.delta_table(thirteen_splits(m), ["gap_pct"], LADDER, spec)


@query("E12_ladder_losses", f"""SELECT split, grp, kind, 20 AS rounds, true AS falls, true AS own_features_only FROM (SELECT unnest(['2024-01-14', '2024-01-19', '2024-01-24'] || list_transform(range(5), lambda i: 'symbols' || i) || list_transform(range(5), lambda i: 'both' || i)) AS split),
  (VALUES ('base', 'base'), {', '.join(f"('{g}', '{k}')" for g in LADDER for k in ('solo', 'with_base', 'cumulative'))}) t(grp, kind)""")
def _(m):
    """Every rung of every split: the training loss never rises, and its trees use the rung's features alone."""
    spec = {"name": "r", "signal": {"type": "regress", "params": {"maxIter": 20}}, "decision": {"type": "k", "params": {"cuts": CUTS}}}
    tagged, rungs = thirteen_splits(m), E.rungs_of(["gap_pct"], LADDER)
    _, model = E.ladder(tagged, ["gap_pct"], LADDER, spec)
    names = [r[0] for r in tagged.select("split").distinct().orderBy("split").collect()]
    rows = []
    for u in range(len(names) * len(rungs)):
        g, kind, cols = rungs[u % len(rungs)]
        used = {model.features[f] for t in model.rounds for f in t.feature[u].ravel().tolist() if f >= 0}
        rows.append((names[u // len(rungs)], g, kind, len(model.rounds), model.falls(u), used <= set(cols)))
    return m.spark.createDataFrame(rows, "split string, grp string, kind string, rounds int, falls boolean, own_features_only boolean")


@query("E12_group_selection", f"""SELECT l_linenumber AS grp, {R('avg(d)', 8)} AS mean_d, {R('avg(CAST(d > 0 AS INT))')} AS positive_share, avg(d) > 0 AND avg(CAST(d > 0 AS INT)) > 0.5 AS keep FROM (SELECT l_linenumber, l_discount - 0.05 AS d FROM lineitem) GROUP BY 1""")
def _(m):
    x = m.raw("lineitem").select(F.col("l_linenumber").alias("grp"), (F.col("l_discount") - 0.05).alias("d_score"))
    return E.group_selection(x).withColumns({"mean_d": r6("mean_d", 8), "positive_share": r6("positive_share")})
