"""2.6 sorts, top-k, sampling and 2.7 set operations."""

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.text import numbers_not_in
from ..operators import sampling as P
from ..operators.calendar import assign_window
from ..plans import splits as L
from ..sources import tables as S
from .base import R, W, query
from .joins import articles, gap_rows

H = lambda *parts: "CAST('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 12) AS BIGINT)"


@query("K1_canonical_order", W("gap", body=f"SELECT target, symbol, {R('gap_pct')} AS gap_pct FROM gap ORDER BY target, symbol"))
def _(m):
    return gap_rows(m).select("target", "symbol", C.r6("gap_pct").alias("gap_pct")).orderBy("target", "symbol")


@query("K2_top_cluster_per_day", W("arts", body="""SELECT symbol, target, ckey, dups FROM (SELECT symbol, target, ckey, count(*) AS dups, min(known_at) AS first FROM arts
  WHERE rel >= 1 AND is_template = 0 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY symbol, target ORDER BY dups DESC, first, ckey) = 1"""))
def _(m):
    c = articles(m).where("rel >= 1 AND is_template = 0").groupBy("symbol", "target", "ckey").agg(F.count(F.lit(1)).alias("dups"), F.min("known_at").alias("first"))
    return P.top_per_group(c, ["symbol", "target"], [F.desc("dups"), "first", "ckey"]).select("symbol", "target", "ckey", "dups")


@query("K3_head_and_tail", """SELECT * FROM (SELECT p_brand AS term, sum(p_size)::BIGINT AS coef, 'up' AS direction FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
  UNION ALL SELECT * FROM (SELECT p_brand, sum(p_size)::BIGINT, 'down' FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5)""")
def _(m):
    t = m.raw("part").groupBy(F.col("p_brand").alias("term")).agg(F.sum("p_size").alias("coef"))
    return P.head_and_tail(t, "coef", "term", 5)


@query("K4_stratified_sample", W("arts", body=f"""SELECT rel, symbol, title_id FROM (SELECT rel, symbol, title_id, min(known_at) AS k FROM arts WHERE is_template = 0 GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY rel ORDER BY {H("'7'", "symbol || title_id")}, symbol || title_id) <= 40"""))
def _(m):
    a = articles(m).where("is_template = 0").select("rel", "symbol", "title_id").distinct().withColumn("item", F.concat("symbol", "title_id"))
    return P.stratified_sample(a, "rel", "item", 40, 7).drop("item")


FORUM1 = f"""SELECT f.post_id, f.body, f.created_et FROM forum f JOIN cal c ON f.created_et >= c.lo AND f.created_et < c.cutoff"""


@query("K5_four_way_sample", W("forum", "cal", body=f"""SELECT post_id, reason FROM (WITH x AS (SELECT *, {H("'3'", 'post_id')} AS h, length(body) AS len, count(*) OVER (PARTITION BY md5(body)) AS rep FROM ({FORUM1})),
  parts AS (SELECT * FROM (SELECT post_id, 0 AS p FROM x ORDER BY h, post_id LIMIT 10) UNION ALL SELECT * FROM (SELECT post_id, 1 FROM x ORDER BY len DESC, post_id LIMIT 10)
   UNION ALL SELECT * FROM (SELECT post_id, 2 FROM x ORDER BY rep DESC, post_id LIMIT 10) UNION ALL SELECT * FROM (SELECT post_id, 3 FROM x ORDER BY created_et DESC, post_id LIMIT 10)),
  picked AS (SELECT post_id, min(p) AS p FROM parts GROUP BY 1),
  fill AS (SELECT post_id, 4 AS p, h FROM x WHERE post_id NOT IN (SELECT post_id FROM picked) ORDER BY h, post_id LIMIT 40),
  al AS (SELECT post_id, p, 0 AS h FROM picked UNION ALL SELECT post_id, p, h FROM fill)
  SELECT post_id, ['random', 'longest', 'repeated', 'recent', 'fill'][p + 1] AS reason FROM al ORDER BY p, h, post_id LIMIT 40)"""))
def _(m):
    f = assign_window(m.forum, m.cal, "created_et").select("post_id", "body", "created_et")
    return P.four_way_sample(f, "post_id", "body", "created_et", 40, 3).select("post_id", "reason")


@query("K6_random_days", W("cal", body=f"SELECT target FROM cal ORDER BY {H("'11'", 'CAST(target AS VARCHAR)')}, target LIMIT 8"))
def _(m):
    return S.hash_sample(m.cal.select("target"), "target", 8, 11)


@query("K7_placebo_titles", W("arts", body=f"""SELECT title_id FROM (SELECT DISTINCT title_id FROM arts WHERE rel >= 1 AND is_template = 0) ORDER BY {H("'5'", 'title_id')}, title_id LIMIT 100"""))
def _(m):
    t = articles(m).where("rel >= 1 AND is_template = 0").select("title_id").distinct()
    return S.hash_sample(t, "title_id", 100, 5)


@query("K8_universe_draws", f"""WITH x AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, draw FROM supplier, (SELECT unnest([0, 1, 2]) AS draw)),
  u AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {H("'9'", "'unseen'", 'CAST(draw AS VARCHAR)', 'symbol')}, symbol) AS r FROM x),
  s AS (SELECT draw, symbol, row_number() OVER (PARTITION BY draw ORDER BY {H("'9'", "'seen'", 'CAST(draw AS VARCHAR)', 'symbol')}, symbol) AS rs,
    row_number() OVER (PARTITION BY draw ORDER BY {H("'9'", "'part'", 'CAST(draw AS VARCHAR)', 'symbol')}, symbol) AS rp, count(*) OVER (PARTITION BY draw) AS n FROM u WHERE r > 10)
  SELECT draw, symbol, 'unseen' AS role, -1 AS universe FROM u WHERE r <= 10 UNION ALL SELECT draw, symbol, 'seen_test', -1 FROM s WHERE rs <= 10
  UNION ALL SELECT draw, symbol, 'train', g::INT FROM (SELECT draw, symbol, ntile(greatest(1, (SELECT ceil((count(*) - 10) / 20.0) FROM supplier)::INT)) OVER (PARTITION BY draw ORDER BY rp) - 1 AS g FROM s)""")
def _(m):
    sup = m.raw("supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return L.universe_draws(sup, 3, 10, 10, 20, 9)


@query("U1_union_tagged", """SELECT role AS kind, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1""")
def _(m):
    c = m.raw("conversations")
    a = c.where("role = 'user'").select("conv_id", F.lit("user").alias("kind"))
    b = c.where("role = 'assistant'").select("conv_id", "turn", F.lit("assistant").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("U2_symbol_set_difference", "SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(m):
    o = m.raw("orders")
    all_, urgent = o.select(F.col("o_custkey").alias("symbol")), o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("symbol"))
    return all_.distinct().join(urgent, "symbol", "left_anti")


@query("U3_dedup_on_keys", W("arts", body="SELECT symbol, title_id, min(known_at) AS known_at FROM arts WHERE is_template = 0 GROUP BY 1, 2"))
def _(m):
    from ..operators.events import dedup_first
    a = articles(m).where("is_template = 0")
    return dedup_first(a.withColumn("k", F.col("known_at")), ["symbol", "title_id"], ["known_at", "tkey"], ["known_at"]).drop("copies")


NUM = "regexp_extract_all({0}, '[-+−]?\\d+(?:[.,]\\d+)*%?')"
NRM = "list_transform({0}, lambda x: regexp_replace(regexp_replace(replace(replace(x, '−', '-'), ',', ''), '%+$', ''), '^\\++', ''))"


@query("U4_numbers_not_in_prompt", f"""SELECT conv_id, turn, len(b) AS n_numbers, len(list_filter(range(1, len(b) + 1), lambda i: NOT list_contains(pa, nb[i]))) AS n_new FROM (
  SELECT conv_id, turn, {NUM.replace('{0}', 't')} AS b, {NRM.replace('{0}', NUM.replace('{0}', 't'))} AS nb, {NRM.replace('{0}', NUM.replace('{0}', 'p'))} AS pa FROM (
  SELECT conv_id, turn, turn || ' of 3.5% ' || text AS t, '12 and ' || conv_id || ' +3.5' AS p FROM conversations))""")
def _(m):
    c = m.raw("conversations")
    t = F.concat(F.col("turn").cast("string"), F.lit(" of 3.5% "), F.col("text"))
    p = F.concat(F.lit("12 and "), F.col("conv_id").cast("string"), F.lit(" +3.5"))
    from ..fixed import NUMBER_RX
    from ..functions.text import tokens
    x = numbers_not_in(c.select("conv_id", "turn", t.alias("t"), p.alias("p")), "p", "t", "new")
    return x.select("conv_id", "turn", F.size(tokens("t", NUMBER_RX)).cast("long").alias("n_numbers"), F.size("new").cast("long").alias("n_new"))
