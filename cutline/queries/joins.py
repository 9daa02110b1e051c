"""2.3 joins."""

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators.calendar import assign_window, dense_grid, strict_after_calendar
from ..operators.events import extended_hours, tagged
from ..operators.textblock import article_table, clusters
from ..plans.panel import build_panel, label_panel, with_gap
from ..sources import tables as S
from ..sources.market import CUTS
from .base import R, W, grade_sql, query


def core_panel(m, groups=("core", "scale", "cross", "regime")):
    p = build_panel({"daily": m.daily, "price": m.price, "news": m.news}, m.cal, m.universe, groups)
    return label_panel(p, m.daily, CUTS)


def gap_rows(m):
    close = m.daily.select("symbol", F.col("date_et").alias("date"), F.col("close").alias("close_d0"))
    return with_gap(close.join(m.cal.select("date", "target"), "date"), extended_hours(m.price))


@query("J1_window_assign", W("ev_t", body="SELECT o_orderkey, known_at, target, widx FROM ev_t"))
def _(m):
    return assign_window(m.orders_ev, m.cal_w, "known_at").select("o_orderkey", "known_at", "target", "widx")


@query("J1_window_assign_news", W("news", "cal", body="SELECT n.doc_id, c.target FROM news n JOIN cal c ON n.known_at >= c.lo AND n.known_at < c.cutoff"))
def _(m):
    return assign_window(m.news, m.cal, "known_at").select("doc_id", "target")


@query("J2_window_assign_strict_after", W("news", "cal2", body="SELECT n.doc_id, c.target FROM news n JOIN cal2 c ON n.known_at >= c.lo AND n.known_at < c.cutoff"))
def _(m):
    return assign_window(m.news, strict_after_calendar(m.cal), "known_at").select("doc_id", "target")


@query("J3_calendar_join", W("daily", "cal", body=f"SELECT d.symbol, c.date, c.target, {R('d.close')} AS close FROM daily d JOIN cal c ON d.date_et = c.date"))
def _(m):
    return (m.daily.withColumnRenamed("date_et", "date").join(m.cal, "date")
            .select("symbol", "date", "target", C.r6("close").alias("close")))


@query("J4_extended_hours_lookup", W("daily", "cal", "ext", body=f"""SELECT d.symbol, c.target, {R('p.pre_last')} AS pre, {R('q.post_last')} AS post
  FROM daily d JOIN cal c ON d.date_et = c.date LEFT JOIN ext p ON p.symbol = d.symbol AND p.day = c.target
  LEFT JOIN ext q ON q.symbol = d.symbol AND q.day = c.date"""))
def _(m):
    ext = extended_hours(m.price)
    x = m.daily.select("symbol", F.col("date_et").alias("date")).join(m.cal.select("date", "target"), "date")
    return (x.join(ext.select("symbol", F.col("day").alias("target"), C.r6("pre_last").alias("pre")), ["symbol", "target"], "left")
            .join(ext.select("symbol", F.col("day").alias("date"), C.r6("post_last").alias("post")), ["symbol", "date"], "left")
            .select("symbol", "target", "pre", "post"))


@query("J5_coalesce_price", W("gap", body=f"SELECT symbol, target, {R('gap_pct')} AS gap_pct, gap_fallback, gap_missing FROM gap"))
def _(m):
    return gap_rows(m).select("symbol", "target", C.r6("gap_pct").alias("gap_pct"), "gap_fallback", "gap_missing")


@query("J6_left_event_blocks", W("cal_w", "daily_w", "ev_t", body="""SELECT d.symbol, c.target, coalesce(e.n, 0) AS n FROM daily_w d
  JOIN cal_w c ON d.date_et = c.date LEFT JOIN (SELECT symbol, target, count(*) AS n FROM ev_t GROUP BY ALL) e
  ON e.symbol = d.symbol AND e.target = c.target"""))
def _(m):
    e = assign_window(m.orders_ev, m.cal_w, "known_at").groupBy("symbol", "target").agg(F.count(F.lit(1)).alias("n"))
    x = m.daily_w.select("symbol", F.col("date_et").alias("date")).join(m.cal_w, "date")
    return x.join(e, ["symbol", "target"], "left").fillna(0, ["n"]).select("symbol", "target", "n")


@query("J7_label_join", W("panel", body=f"SELECT symbol, date, target, {R('ret_pct')} AS ret_pct, label, {R('rest')} AS rest FROM panel"))
def _(m):
    x = label_panel(gap_rows(m), m.daily, CUTS)
    return x.select("symbol", "date", "target", C.r6("ret_pct").alias("ret_pct"), "label", C.r6("rest").alias("rest"))


@query("J8_market_value_back", W("gap", body=f"""SELECT symbol, target, {R('avg(gap_pct) OVER (PARTITION BY target)')} AS mkt,
  count(gap_pct) OVER (PARTITION BY target) AS n FROM gap"""))
def _(m):
    g = gap_rows(m)
    day = g.groupBy("target").agg(C.r6(F.avg("gap_pct")).alias("mkt"), F.count("gap_pct").alias("n"))
    return g.select("symbol", "target").join(day, "target")


@query("J9_dense_grid", W("grid", "tags", body="""SELECT g.symbol, g.target, coalesce(t.n, 0) AS n, t.tone FROM grid g LEFT JOIN
  (SELECT symbol, target, count(*) AS n, max(tone) AS tone FROM tags GROUP BY ALL) t USING (symbol, target)"""))
def _(m):
    t = (tagged(assign_window(m.news, m.cal, "known_at").select("symbols", "target", "tone"))
         .groupBy("symbol", "target").agg(F.count(F.lit(1)).alias("n"), F.max("tone").alias("tone")))
    return (dense_grid(m.universe, "symbol", m.cal).join(t, ["symbol", "target"], "left").fillna(0, ["n"])
            .select("symbol", "target", "n", "tone"))


def articles(m):
    return article_table(m.news, m.cal, m.universe, m.patterns)


@query("J10_first_seen_stories", W("arts", body="""SELECT c.symbol, c.widx, c.ckey, NOT EXISTS (SELECT 1 FROM arts p WHERE p.is_template = 0
  AND p.symbol = c.symbol AND p.ckey = c.ckey AND p.widx < c.widx AND p.widx >= c.widx - 5) AS is_first
  FROM (SELECT DISTINCT symbol, widx, ckey FROM arts WHERE is_template = 0) c"""))
def _(m):
    return clusters(articles(m)).select("symbol", "widx", "ckey", "is_first")


@query("J11_score_join", f"""SELECT d.doc_id, {R('p_pos - p_neg')} AS net FROM documents d JOIN (
  SELECT vec_id AS title_id, a / (a + b + c) AS p_pos, b / (a + b + c) AS p_neg FROM (SELECT vec_id, CAST(abs(embedding[1]) AS DOUBLE) + 0.001 AS a,
  CAST(abs(embedding[2]) AS DOUBLE) + 0.001 AS b, CAST(abs(embedding[3]) AS DOUBLE) + 0.001 AS c FROM embeddings)) s ON d.doc_id = s.title_id""")
def _(m):
    from .scans import scores_of
    d = m.raw("documents").select("doc_id")
    return (d.join(scores_of(m), d["doc_id"] == F.col("title_id"))
            .select("doc_id", C.r6(F.col("p_pos") - F.col("p_neg")).alias("net")))


@query("J12_prediction_truth", W("gap", "daily", body=f"""SELECT g.symbol, g.target, {grade_sql('(d.ret * 100)', CUTS)} AS label,
  coalesce({grade_sql('g.gap_pct', CUTS)}, 2) AS label_pred FROM gap g JOIN daily d ON d.symbol = g.symbol AND d.date_et = g.target WHERE d.ret IS NOT NULL"""))
def _(m):
    pred = gap_rows(m).select("symbol", "target", C.grade_or_flat("gap_pct", CUTS).alias("label_pred"))
    truth = S.label_table(m.daily, CUTS).select("symbol", F.col("date").alias("target"), "label")
    return truth.join(pred, ["symbol", "target"])


@query("J13_one_to_one_join", W("daily_w", body=f"""SELECT a.symbol, a.date_et, {R('a.close')} AS close, {R('b.ret * 100')} AS ret_pct
  FROM daily_w a JOIN daily_w b ON a.symbol = b.symbol AND a.date_et = b.date_et WHERE b.ret IS NOT NULL"""))
def _(m):
    from ..operators.joins import one_to_one
    lab = S.label_table(m.daily_w).select("symbol", F.col("date").alias("date_et"), C.r6("ret_pct").alias("ret_pct"))
    return one_to_one(m.daily_w.select("symbol", "date_et", C.r6("close").alias("close")), lab, ["symbol", "date_et"])


@query("J16_variant_join", "SELECT a.doc_id, a.quality AS quality_anon, b.toxic AS quality_raw FROM labels a JOIN labels b USING (doc_id)")
def _(m):
    from ..operators.joins import join_variants
    lab = m.raw("labels")
    return join_variants(lab.select("doc_id", "quality"), lab.select("doc_id", F.col("toxic").alias("quality")), ["doc_id"], "_anon", "_raw")


@query("J17_pending_work", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(m):
    d = m.raw("documents").select("doc_id", "lang")
    done = d.join(m.raw("labels").select("doc_id"), "doc_id", "left_semi")
    return S.pending_inputs(d, done, ["doc_id", "lang"]).select("doc_id", "lang")


@query("J18_coverage", """SELECT doc_id AS key, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(m):
    from ..operators.joins import coverage
    return coverage(m.raw("documents").select(F.col("doc_id").alias("key")), m.raw("labels").select(F.col("doc_id").alias("key")), ["key"])


@query("J19_threshold_grid", W("panel", body=f"""SELECT k, label, {grade_sql('(gap_pct * 1.0)', (0,)).replace('0.0', '0.0')} AS side, count(*) AS n
  FROM panel, (SELECT unnest([1.0, 2.0, 4.0]) AS k) WHERE abs(gap_pct) >= 25 / k GROUP BY ALL"""))
def _(m):
    x = label_panel(gap_rows(m), m.daily, CUTS).withColumn("side", (F.col("gap_pct") >= 0).cast("int"))
    ks = [1.0, 2.0, 4.0]
    hits = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.abs("gap_pct") >= 25 / k)
    return (x.groupBy("label", "side", hits.alias("ks")).agg(F.count(F.lit(1)).alias("_n"))
            .select("label", "side", F.explode("ks").alias("k"), "_n").groupBy("k", "label", "side").agg(F.sum("_n").alias("n")))
