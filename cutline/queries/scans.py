"""2.1 scans, sources and sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators.calendar import assign_window, window_start
from ..operators.textblock import article_table, representatives
from ..sources import sinks, tables as S
from ..sources.market import CUTS
from .base import R, W, grade_sql, query

LO, HI = "2024-01-05 09:30:00", "2024-01-20 09:30:00"


def scratch(m, name):
    """Folder for tables written by a query: the shared checkpoint folder when the session names one."""
    shared = m.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared.rstrip('/')}/cutline-{name}-{uuid.uuid4().hex}"
    if not m.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return os.path.join(tempfile.mkdtemp(prefix="cutline-"), name)


@query("S1_asof_scan", f"""SELECT event_id, user_id, ts, value FROM events
  WHERE ts >= TIMESTAMP '{LO}' AND ts < TIMESTAMP '{HI}'""")
def _(m):
    return S.asof(m.raw("events"), LO, HI, columns=["event_id", "user_id", "value"], clock="ts")


@query("S1_asof_symbols", W("daily", body=f"""SELECT symbol, date_et, known_at, {R('close')} AS close FROM daily
  WHERE known_at >= TIMESTAMP '{LO}' AND known_at < TIMESTAMP '{HI}' AND symbol IN ('S01', 'S03')"""))
def _(m):
    x = S.asof(m.daily, LO, HI, ["S03", "S01"], ["symbol", "date_et", "close"])
    return x.withColumn("close", r6("close"))


@query("S2_window_start", W("cal", body="""SELECT target, d5, h20 FROM (SELECT target,
  CAST(min(date) OVER (ORDER BY date ROWS 4 PRECEDING) AS TIMESTAMP) AS d5, cutoff - INTERVAL 20 HOUR AS h20 FROM cal)"""))
def _(m):
    a = window_start(m.cal, days=5).select("target", F.col("since").alias("d5"))
    return a.join(window_start(m.cal, hours=20).select("target", F.col("since").alias("h20")), "target")


@query("S3_news_light_view", W("news", body=f"""SELECT known_at, symbols, source, url, tone, md5(title) AS title_md5 FROM news
  WHERE known_at >= TIMESTAMP '{LO}' AND known_at < TIMESTAMP '{HI}'"""))
def _(m):
    return S.news_view(m.news, LO, HI).withColumn("title_md5", F.md5("title")).drop("title")


@query("S4_day_bundle_counts", W("daily", "bars", "news", "forum", body=f"""
  SELECT 'daily' AS name, count(*) AS n FROM daily WHERE known_at >= TIMESTAMP '{LO}' AND known_at < TIMESTAMP '{HI}' AND symbol = 'S02'
  UNION ALL SELECT 'price', count(*) FROM bars WHERE known_at >= TIMESTAMP '{LO}' AND known_at < TIMESTAMP '{HI}' AND symbol = 'S02'
  UNION ALL SELECT 'news', count(*) FROM news WHERE known_at >= TIMESTAMP '{LO}' AND known_at < TIMESTAMP '{HI}'
     AND list_contains(string_split(symbols, ','), 'S02')
  UNION ALL SELECT 'forum:user', count(*) FROM forum WHERE sub = 'user' AND created_et >= TIMESTAMP '{LO}' AND created_et < TIMESTAMP '{HI}'"""))
def _(m):
    b = S.day_bundle({"daily": m.daily, "price": m.price, "news": m.news, "forum": m.forum}, None, HI, LO, ["S02"],
                     forums=["user"])
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in b.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _forum_folder(m):
    """Write the posts once as <sub>.<kind>.parquet folders, the layout the forum scan reads."""
    root = scratch(m, "forum")
    f = m.forum
    for sub in ("user", "assistant", "system"):
        one = f.where(F.col("sub") == sub)
        one.where("turn = 0").select("created_et", "title", "body").write.parquet(f"{root}/{sub}.posts.parquet")
        one.where("turn > 0").select("created_et", "body").write.parquet(f"{root}/{sub}.comments.parquet")
    return root


@query("S5_forum_scan_both", W("forum", body=f"""SELECT sub, CASE WHEN turn = 0 THEN 'posts' ELSE 'comments' END AS kind,
  count(*) AS n, sum(length(body))::BIGINT AS chars, min(created_et) AS first FROM forum
  WHERE created_et >= TIMESTAMP '{LO}' GROUP BY 1, 2"""))
def _(m):
    x = S.forum_scan(m.spark, _forum_folder(m), "both", since=LO)
    return x.groupBy("sub", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"),
                                        F.min("created_et").alias("first"))


@query("S6_forum_names", "SELECT DISTINCT role AS sub FROM conversations")
def _(m):
    x = S.forum_scan(m.spark, _forum_folder(m), "both")
    return x.select("sub").distinct()


@query("S7_universe_json", W("daily", body="SELECT DISTINCT symbol FROM daily"))
def _(m):
    path = scratch(m, "symbols")
    (m.daily.select("symbol").distinct().groupBy(F.lit("all").alias("g")).agg(F.sort_array(F.collect_set("symbol")).alias("s"))
     .select(F.to_json(F.map_from_arrays(F.array("g"), F.array("s"))).alias("value")).write.text(path))
    return S.universe(m.spark, m.daily, json_path=path)


@query("S7_universe_from_data", W("daily", body="SELECT DISTINCT symbol FROM daily WHERE ret IS NOT NULL"))
def _(m):
    return S.universe(m.spark, S.label_table(m.daily))


@query("S8_full_history_columns", W("daily", "bars", "ev", body=f"""
  SELECT 'daily' AS name, count(*) AS n, {R('sum(close)', 3)} AS total FROM daily
  UNION ALL SELECT 'price', count(*), {R('sum(close)', 3)} FROM bars
  UNION ALL SELECT 'earnings', count(*), {R('sum(eps_reported)', 3)} FROM ev"""))
def _(m):
    one = lambda df, n, c: df.select(c).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), r6(F.sum(c), 3).alias("total"))
    return (one(m.daily, "daily", "close").unionByName(one(m.price, "price", "close"))
            .unionByName(one(m.orders_ev, "earnings", "eps_reported")))


@query("S9_early_cut_news_scan", W("tags", body="""SELECT symbol, count(*) AS n, count(DISTINCT h) AS titles FROM tags
  WHERE known_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1"""))
def _(m):
    from ..functions.text import title_id
    n = (S.asof(m.news, "2024-01-10 00:00:00").select("known_at", "symbols", title_id("title").alias("h")))
    n = assign_window(n, m.cal, "known_at").withColumn("symbol", F.explode(F.split("symbols", ",")))
    return (n.join(m.universe, "symbol", "left_semi").groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("titles")))


@query("S10_lexicon_csv", """SELECT * FROM (
  SELECT 'positive' AS category, upper(p_brand) AS word FROM part GROUP BY 2 HAVING count(*) % 2 = 0
  UNION ALL SELECT 'negative', upper(p_brand) FROM part GROUP BY 2 HAVING count(*) % 2 = 1
  UNION ALL SELECT 'uncertainty', upper(p_brand) FROM part GROUP BY 2 HAVING max(p_size) >= 49)""")
def _(m):
    path = scratch(m, "lexicon")
    g = m.raw("part").groupBy(F.col("p_brand").alias("Word")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, 2009).otherwise(0).alias("Positive"),
        F.when(F.count(F.lit(1)) % 2 == 1, 2009).otherwise(0).alias("Negative"),
        F.when(F.max("p_size") >= 49, 2011).otherwise(0).alias("Uncertainty"))
    sinks.write_csv(g, path)
    return S.lexicon_csv(m.spark, path)


@query("S11_alias_json", """SELECT n_name AS symbol, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, lower(n_name) FROM nation""")
def _(m):
    path = scratch(m, "alias")
    n = m.raw("nation").join(m.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("n_name").agg(F.array(F.first("r_name"), F.lower(F.first("n_name"))).alias("names"))
    notes = m.spark.createDataFrame([("_note", ["not a symbol"])], "n_name string, names array<string>")
    (rows.unionByName(notes).groupBy(F.lit(1).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "names"))).alias("mp"))
     .select(F.to_json("mp").alias("value")).write.text(path))
    return S.alias_json(m.spark, path)


def scores_of(m):
    """External score table: three non-negative numbers per title that sum to one."""
    e = m.raw("embeddings")
    a = [F.abs(F.col("embedding")[i]).cast("double") + 0.001 for i in range(3)]
    tot = a[0] + a[1] + a[2]
    return e.select(F.col("vec_id").alias("title_id"), "label", "embedding", (a[0] / tot).alias("p_pos"),
                    (a[1] / tot).alias("p_neg"), (a[2] / tot).alias("p_neu"))


SCORES_SQL = """SELECT vec_id AS title_id, label, a / (a + b + c) AS p_pos, b / (a + b + c) AS p_neg, c / (a + b + c) AS p_neu FROM (
  SELECT vec_id, label, CAST(abs(embedding[1]) AS DOUBLE) + 0.001 AS a, CAST(abs(embedding[2]) AS DOUBLE) + 0.001 AS b,
  CAST(abs(embedding[3]) AS DOUBLE) + 0.001 AS c FROM embeddings)"""


@query("S12_score_contract", f"""SELECT count(*) AS n, {R('max(abs(p_pos + p_neg + p_neu - 1))')} AS max_off,
  count(*) FILTER (abs(p_pos + p_neg + p_neu - 1) > 1e-3) AS violations FROM ({SCORES_SQL})""")
def _(m):
    return S.check_scores(scores_of(m)).withColumn("max_off", r6("max_off"))


@query("S13_representative_titles", W("reps", body="SELECT title_id, md5(min(title)) AS title_md5 FROM reps GROUP BY 1"))
def _(m):
    t = S.representative_titles(representatives(article_table(m.news, m.cal, m.universe, m.patterns)))
    return t.select("title_id", F.md5("title").alias("title_md5"))


@query("S14_parquet_sink_partitioned", W("daily", body=f"SELECT symbol, count(*) AS n, {R('sum(close)', 3)} AS total FROM daily GROUP BY 1"))
def _(m):
    path = scratch(m, "panel")
    sinks.write_parquet(m.daily, path, ["symbol"])
    return m.spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("close"), 3).alias("total"))


@query("S15_csv_sink", W("daily", body=f"SELECT symbol, CAST(count(*) AS BIGINT) AS n, {R('max(close)')} AS top FROM daily GROUP BY 1"))
def _(m):
    path = scratch(m, "report")
    sinks.write_csv(m.daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.max("close")).alias("top")), path, True)
    return m.spark.read.schema("symbol string, n long, top double").csv(path, header=True)


@query("S16_jsonl_sink", W("daily", body=f"SELECT symbol, date_et, {R('close')} AS close FROM daily"))
def _(m):
    path = scratch(m, "rows")
    sinks.write_jsonl(m.daily.select("symbol", "date_et", r6("close").alias("close")), path)
    return m.spark.read.schema("symbol string, date_et date, close double").json(path)


@query("S17_reuse_intermediate", W("bars", body=f"SELECT session, count(*) AS n, {R('avg(close)')} AS mean FROM bars GROUP BY 1"))
def _(m):
    path = scratch(m, "bars")
    build = lambda: m.price
    sinks.reuse(m.spark, path, build)
    x = sinks.reuse(m.spark, path, lambda: (_ for _ in ()).throw(RuntimeError("must be read back")))
    return x.groupBy("session").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("close")).alias("mean"))


@query("S18_rule_save_restore", W("daily", body=f"""SELECT symbol, date_et, {grade_sql('(ret * 100)', [-25 / 1.5, -6 / 1.5, 6 / 1.5, 25 / 1.5])} AS pred
  FROM daily WHERE ret IS NOT NULL"""))
def _(m):
    from ..functions.scalars import grade
    path = scratch(m, "rule")
    sinks.save_rule(m.spark, {"bounds": [c / 1.5 for c in CUTS]}, path)
    b = sinks.load_rule(m.spark, path)["bounds"]
    return m.daily.where("ret IS NOT NULL").select("symbol", "date_et", grade(F.col("ret") * 100, b).alias("pred"))
