"""2.12 evaluation, comparison, splitting and the pairing joins of 2.3."""

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window as SW, functions as F

from ..fixed import ADOPTION, FEATURE_GROUPS
from ..functions import scalars as C
from ..plans import compare as P, contract as K, scoring as E, splits as L
from ..session import cut_lineage
from ..sources.market import CUTS
from .aggregates import PRED, WL, weekly_labels, weekly_predictions
from .base import R, W, grade_sql, query
from .base import R as _R
from .rules import weighted_score_sql
from .sorts import H

r6 = C.r6
WP = f"(SELECT symbol, date_et AS target, label, {PRED} AS pred FROM {WL})"
NUMV = "sum((label - pred) * (label - pred) * (label - 2) * (label - 2))"


def metrics_sql(src, keys, digits=6):
    """All metrics per key from rows (label, pred); the chance term from the product of the marginals."""
    R = lambda e: _R(e, digits)
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys) or "true"
    g = f"GROUP BY {k}" if keys else ""
    kk = f"{k}, " if keys else ""
    ak = "".join(f"a.{x}, " for x in keys)
    return f"""SELECT {''.join(f'm.{x}, ' for x in keys)}{R('CASE WHEN den > 0 THEN 1 - num / den END')} AS score, {R('accuracy')} AS accuracy, {R('direction')} AS direction, {R('magnitude_acc')} AS magnitude_acc,
  {R('big_recall')} AS big_recall, {R('big_prec')} AS big_prec, {R('coalesce(f04, 0) + coalesce(f40, 0)')} AS flip_index, {R('flips / n')} AS flip_rate, {R('CASE WHEN den > 0 THEN 64 * flips / den END')} AS flip_loss_share,
  {R('pred_extreme')} AS pred_extreme, {R('true_extreme')} AS true_extreme, n FROM (
  SELECT {kk}{NUMV}::DOUBLE AS num, avg(CAST(label = pred AS INT)) AS accuracy, avg(CAST(sign(label - 2) = sign(pred - 2) AS INT)) FILTER (label <> 2) AS direction,
   avg(CAST(abs(label - 2) = abs(pred - 2) AS INT)) AS magnitude_acc, avg(CAST(label = pred AS INT)) FILTER (label IN (0, 4)) AS big_recall, avg(CAST(label = pred AS INT)) FILTER (pred IN (0, 4)) AS big_prec,
   avg(CAST(pred = 4 AS INT)) FILTER (label = 0) AS f04, avg(CAST(pred = 0 AS INT)) FILTER (label = 4) AS f40, count(*) FILTER ((label = 0 AND pred = 4) OR (label = 4 AND pred = 0)) AS flips,
   avg(CAST(pred IN (0, 4) AS INT)) AS pred_extreme, avg(CAST(label IN (0, 4) AS INT)) AS true_extreme, count(*) AS n FROM ({src}) {g}) m JOIN (
  SELECT {ak}sum((label - pred) * (label - pred) * (label - 2) * (label - 2) * a.c * b.c)::DOUBLE / max(t.n) AS den FROM (SELECT {kk}label, count(*)::DOUBLE AS c FROM ({src}) GROUP BY {kk}label) a
   JOIN (SELECT {kk}pred, count(*)::DOUBLE AS c FROM ({src}) GROUP BY {kk}pred) b ON {on('a', 'b')} JOIN (SELECT {kk}count(*) AS n FROM ({src}) {g}) t ON {on('a', 't')} {'GROUP BY ' + ', '.join(f'a.{x}' for x in keys) if keys else ''}) d ON {on('m', 'd')}"""


MET = ("score", "accuracy", "direction", "magnitude_acc", "big_recall", "big_prec", "flip_index", "flip_rate", "flip_loss_share", "pred_extreme", "true_extreme")
rounded = lambda df: df.withColumns({c: r6(c) for c in MET if c in df.columns})


@query("E1_weighted_score", W("daily_w", body=f"SELECT score, accuracy, direction, big_recall, big_prec, n FROM ({metrics_sql(WP, [])})"))
def _(m):
    return rounded(E.score(weekly_predictions(m)))


@query("E1_score_per_symbol", W("daily_w", body=f"SELECT symbol, score, accuracy, n FROM ({metrics_sql(WP, ['symbol'])})"))
def _(m):
    return rounded(E.score(weekly_predictions(m), ["symbol"])).select("symbol", "score", "accuracy", "n")


@query("E2_extended_metrics", W("daily_w", body=metrics_sql(WP, ["symbol"])))
def _(m):
    return rounded(E.metrics(weekly_predictions(m), ["symbol"]))


@query("E3_loss_by_truth", W("daily_w", body=f"""SELECT {', '.join(R(f"(SELECT sum((label - pred) * (label - pred) * (label - 2) * (label - 2)) FROM {WP} WHERE label = {i}) / d.den") + f' AS loss_c{i}' for i in range(5))}, {R('1 - num / den')} AS score
  FROM ({weighted_score_sql('SELECT label, pred FROM ' + WP)}) d"""))
def _(m):
    x = E.loss_by_truth(weekly_predictions(m))
    return x.select(*[r6(c).alias(c) for c in x.columns])


STRAT = f"""WITH y AS (SELECT symbol || date_et AS key, label FROM {WL}), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) AS cum FROM y GROUP BY 1),
  s AS (SELECT key, label, unnest(['all_flat', 'all_surge', 'direction_only', 'extremes_only', 'extremes_inverted', 'perfect', 'random']) AS strategy FROM y),
  p AS (SELECT strategy, label, CASE strategy WHEN 'all_flat' THEN 2 WHEN 'all_surge' THEN 4 WHEN 'direction_only' THEN CASE WHEN label < 2 THEN 1 WHEN label > 2 THEN 3 ELSE 2 END
   WHEN 'extremes_only' THEN CASE WHEN label IN (0, 4) THEN label ELSE 2 END WHEN 'extremes_inverted' THEN CASE WHEN label IN (0, 4) THEN 4 - label ELSE 2 END WHEN 'perfect' THEN label
   ELSE (SELECT min(label) FROM c WHERE {H("'0'", 'key')} % (SELECT sum(n) FROM c) < cum) END AS pred FROM s)"""


@query("E4_reference_strategies", W("daily_w", body=f"SELECT * FROM ({STRAT} SELECT strategy, score, accuracy, n FROM ({metrics_sql('SELECT * FROM p', ['strategy'])}))"))
def _(m):
    y = weekly_labels(m).select(F.concat("symbol", F.col("date_et").cast("string")).alias("key"), "label")
    x = E.reference_strategies(y, "key")
    return rounded(E.score(x, ["strategy"])).select("strategy", "score", "accuracy", "n")


@query("E5_flat_row_effect", W("daily_w", body=f"""SELECT * FROM (WITH y AS (SELECT symbol || target AS key, label, pred FROM {WP}), f AS (SELECT key, row_number() OVER (ORDER BY {H("'0'", 'key')}) - 1 AS r, count(*) OVER () AS n FROM y WHERE label = 2),
  p AS (SELECT frac, label, CASE WHEN r < floor(n * frac) THEN 4 ELSE pred END AS pred FROM (SELECT y.*, f.r, f.n, unnest([0.0, 0.05, 0.1, 0.2, 0.4])::DOUBLE AS frac FROM y LEFT JOIN f USING (key)))
  SELECT frac, {R('score')} AS score, {R('num')} AS num, {R('den', 4)} AS denom FROM ({weighted_score_sql('SELECT * FROM p', 'frac')}))"""))
def _(m):
    y = weekly_predictions(m).select(F.concat("symbol", F.col("date_et").cast("string")).alias("key"), "label", "pred")
    return E.flat_row_effect(cut_lineage(y), "key").select("frac", r6("score").alias("score"), r6("num").alias("num"), r6("denom", 4).alias("denom"))


@query("E6_batch_evaluation", W("panel", body=f"SELECT target, score, accuracy, n FROM ({metrics_sql('SELECT target, label, coalesce(' + grade_sql('gap_pct', CUTS) + ', 2) AS pred FROM panel', ['target'])})"))
def _(m):
    from .rules import fit_panel
    x = fit_panel(m).withColumn("pred", C.grade_or_flat("gap_pct", CUTS))
    return rounded(E.score(x, ["target"])).select("target", "score", "accuracy", "n")


@query("E7_report_crosstab", W("daily_w", body=f"SELECT label, {', '.join(f'count(*) FILTER (pred = {j}) AS p{j}' for j in range(5))} FROM {WP} GROUP BY 1"))
def _(m):
    x = weekly_predictions(m).groupBy("label").pivot("pred", list(range(5))).agg(F.count(F.lit(1)))
    return x.select("label", *[F.coalesce(str(j), F.lit(0)).alias(f"p{j}") for j in range(5)])


@query("E8_time_split", W("daily_w", body=f"SELECT CASE WHEN target < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM {WP} GROUP BY 1"))
def _(m):
    x = weekly_labels(m).withColumnRenamed("date_et", "target")
    return L.split_at(x, "target", "1999-01-01").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("E8_last_days", W("daily_w", body=f"SELECT symbol, target FROM {WP} WHERE target IN (SELECT DISTINCT target FROM {WP} ORDER BY 1 DESC LIMIT 12)"))
def _(m):
    return L.last_days(weekly_labels(m).withColumnRenamed("date_et", "target"), "target", 12).select("symbol", "target")


WF = " UNION ALL ".join(f"""SELECT '{s}' AS fold, CASE WHEN target < DATE '{s}' - 14 THEN 'train' ELSE 'test' END AS part, symbol, target FROM {WP}
  WHERE target < DATE '{s}' - 14 OR (target >= DATE '{s}' AND target < DATE '{s}' + 120)""" for s in ("1998-01-01", "1999-06-01"))


@query("E9_walk_forward", W("daily_w", body=f"SELECT fold, part, count(*) AS n, min(target) AS first, max(target) AS last FROM ({WF}) GROUP BY 1, 2"))
def _(m):
    x = L.walk_forward(weekly_labels(m).withColumnRenamed("date_et", "target"), "target", ("1998-01-01", "1999-06-01"))
    return x.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"), F.max("target").alias("last"))


HELD = f"(SELECT set_id, symbol FROM (SELECT symbol, set_id FROM (SELECT DISTINCT symbol FROM daily_w), (SELECT unnest([0, 1, 2]) AS set_id)) QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY {H("'1'", 'CAST(set_id AS VARCHAR)', 'symbol')}, symbol) <= 3)"


@query("E9_time_symbol_holdout", W("daily_w", body=f"""SELECT set_id, part, count(*) AS n FROM (SELECT p.*, s.set_id, CASE WHEN h.symbol IS NULL THEN 'train' ELSE 'test' END AS part FROM {WP} p, (SELECT unnest([0, 1, 2]) AS set_id) s
  LEFT JOIN {HELD} h ON h.set_id = s.set_id AND h.symbol = p.symbol) WHERE (part = 'train' AND target < DATE '1999-01-01' - 14) OR (part = 'test' AND target >= DATE '1999-01-01') GROUP BY 1, 2"""))
def _(m):
    x = weekly_labels(m).withColumnRenamed("date_et", "target")
    return L.time_symbol_holdout(x, "target", "1999-01-01", 3, 3, seed=1).groupBy("set_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("E10_calibration_split", W("daily_w", body=f"""SELECT part, count(*) AS n, min(target) AS first, max(target) AS last FROM (SELECT target, CASE WHEN target >= s THEN 'calib' WHEN target < s - 14 THEN 'fit' END AS part
  FROM {WP}, (SELECT target AS s FROM (SELECT target, row_number() OVER (ORDER BY target) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM {WP})) WHERE n >= 30 AND r = greatest(1, floor(n * 0.8)))) WHERE part IS NOT NULL GROUP BY 1"""))
def _(m):
    x = L.calibration_split(weekly_labels(m).withColumnRenamed("date_et", "target"), "target")
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"), F.max("target").alias("last"))


# ---- a predictions log: three candidates on two draws and three yearly folds -------------
def predictions(m):
    """(fold, draw, candidate, symbol, target, seen, label, pred) for reversal, damped reversal and momentum."""
    w = SW.partitionBy("symbol").orderBy("date_et")
    x = weekly_labels(m).withColumn("s", F.lag("ret").over(w) * 100)
    made = {"base": -F.col("s"), "damped": -F.col("s") * 0.5, "momentum": F.col("s")}
    cand = F.array(*[F.struct(F.lit(n).alias("candidate"), C.grade_or_flat(c, CUTS).alias("pred")) for n, c in made.items()])
    num = F.substring("symbol", 3, 1).cast("int")
    x = x.select(F.concat(F.lit("f"), (F.year("date_et") % 3).cast("string")).alias("fold"), F.explode(F.array(F.lit(0), F.lit(1))).alias("draw"),
                 "symbol", F.col("date_et").alias("target"), "label", cand.alias("c"), num.alias("num"))
    return x.select("fold", "draw", "symbol", "target", (F.col("num") % 3 != F.col("draw")).alias("seen"), "label", F.inline("c"))


PL = f"""(SELECT 'f' || (year(target) % 3) AS fold, draw, candidate, symbol, target, CAST(substr(symbol, 3, 1) AS INT) % 3 <> draw AS seen, label,
  coalesce(CASE candidate WHEN 'base' THEN {grade_sql('(-s)', CUTS)} WHEN 'damped' THEN {grade_sql('(-s * 0.5)', CUTS)} ELSE {grade_sql('s', CUTS)} END, 2) AS pred
  FROM (SELECT symbol, date_et AS target, label, lag(ret) OVER (PARTITION BY symbol ORDER BY date_et) * 100 AS s FROM {WL}), (SELECT unnest([0, 1]) AS draw), (SELECT unnest(['base', 'damped', 'momentum']) AS candidate))"""
SCOPED = f"(SELECT *, unnest(['all', CASE WHEN seen THEN 'seen' ELSE 'unseen' END]) AS scope FROM {PL})"


@query("A32_scoped_metrics", W("daily_w", body=metrics_sql(SCOPED, ["candidate", "fold", "draw", "scope"])))
def _(m):
    return rounded(P.scoped_metrics(predictions(m)))


@query("A33_mean_over_units", W("daily_w", body=f"""SELECT candidate, {R('avg(score)')} AS mean_score, {', '.join(f"{R(f'avg(score) FILTER (fold = {chr(39)}f{i}{chr(39)})')} AS f{i}" for i in range(3))} FROM (
  SELECT candidate, fold, draw, CASE WHEN true THEN score END AS score FROM ({metrics_sql(PL, ['candidate', 'fold', 'draw'])})) GROUP BY 1"""))
def _(m):
    x = rounded(E.metrics(predictions(m), ["candidate", "fold", "draw"]))
    g = x.groupBy("candidate").pivot("fold", ["f0", "f1", "f2"]).agg(F.avg("score"))
    return x.groupBy("candidate").agg(r6(F.avg("score")).alias("mean_score")).join(
        g.select("candidate", *[r6(f"f{i}").alias(f"f{i}") for i in range(3)]), "candidate")


@query("J14_paired_candidates", W("daily_w", body=f"""SELECT c.candidate, b.fold, b.draw, count(*) AS n, count(*) FILTER (c.pred <> b.pred) AS changed FROM {PL} b JOIN {PL} c USING (fold, draw, symbol, target)
  WHERE b.candidate = 'base' AND c.candidate <> 'base' GROUP BY 1, 2, 3"""))
def _(m):
    x = P.paired(predictions(m), "base")
    return x.groupBy("candidate", "fold", "draw").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") != F.col("cand")).alias("changed"))


@query("J14_pairing_gaps", W("daily_w", body=f"SELECT candidate, 0::BIGINT AS no_baseline, 0::BIGINT AS no_candidate FROM (SELECT DISTINCT candidate FROM {PL} WHERE candidate <> 'base')"))
def _(m):
    return P.pairing_gaps(predictions(m), "base")


PAIR = f"(SELECT b.fold, b.draw, b.symbol, b.target, b.label, b.pred AS base, c.pred AS cand FROM {PL} b JOIN {PL} c USING (fold, draw, symbol, target) WHERE b.candidate = 'base' AND c.candidate = 'damped')"
REPS, BLOCK = 400, 8
BOOT = f"""WITH pr AS (SELECT * FROM {PAIR}), dy AS (SELECT fold, draw, target, row_number() OVER (PARTITION BY fold, draw ORDER BY target) - 1 AS day_no FROM (SELECT DISTINCT fold, draw, target FROM pr)),
  un AS (SELECT fold, draw, count(*) AS d FROM dy GROUP BY 1, 2),
  st AS (SELECT fold, draw, rep, k, d, {H("'0'", 'fold', 'CAST(draw AS VARCHAR)', 'CAST(rep AS VARCHAR)', 'CAST(k AS VARCHAR)')} % (d - {BLOCK} + 1) AS s FROM (SELECT *, unnest(range(0, CAST(ceil(d / {BLOCK}.0) AS INT))) AS k FROM (SELECT *, unnest(range({REPS})) AS rep FROM un))),
  wt AS (SELECT fold, draw, rep, s + i AS day_no, count(*) AS w FROM (SELECT *, unnest(range({BLOCK})) AS i FROM st) WHERE k * {BLOCK} + i < d GROUP BY ALL),
  rw AS (SELECT fold, draw, rep, label, base, cand, w FROM pr JOIN dy USING (fold, draw, target) JOIN wt USING (fold, draw, day_no)),
  sc AS (SELECT fold, draw, rep, who, 1 - sum(CASE WHEN kind = 'o' THEN v END) / sum(CASE WHEN kind = 'e' THEN v END) AS score FROM (
    SELECT fold, draw, rep, who, 'o' AS kind, sum(w * (label - pred) * (label - pred) * (label - 2) * (label - 2))::DOUBLE AS v FROM lg GROUP BY ALL
    UNION ALL SELECT a.fold, a.draw, a.rep, a.who, 'e', sum((a.label - b.pred) * (a.label - b.pred) * (a.label - 2) * (a.label - 2) * a.c * b.c)::DOUBLE / max(t.n) FROM
     (SELECT fold, draw, rep, who, label, sum(w)::DOUBLE AS c FROM lg GROUP BY ALL) a JOIN (SELECT fold, draw, rep, who, pred, sum(w)::DOUBLE AS c FROM lg GROUP BY ALL) b USING (fold, draw, rep, who)
     JOIN (SELECT fold, draw, rep, who, sum(w) AS n FROM lg GROUP BY ALL) t USING (fold, draw, rep, who) GROUP BY a.fold, a.draw, a.rep, a.who) GROUP BY ALL)""".replace(
    "sc AS (", "lg AS (SELECT fold, draw, rep, label, w, 'base' AS who, base AS pred FROM rw UNION ALL SELECT fold, draw, rep, label, w, 'cand', cand FROM rw), sc AS (", 1)


@query("E13_block_bootstrap_reps", W("daily_w", body=f"""SELECT * FROM ({BOOT} SELECT rep::INT AS rep, {R('avg(delta)', 8)} AS delta FROM (SELECT a.fold, a.draw, a.rep, a.score - b.score AS delta FROM sc a JOIN sc b USING (fold, draw, rep)
  WHERE a.who = 'cand' AND b.who = 'base') GROUP BY 1)"""))
def _(m):
    pairs = P.paired(predictions(m), "base").where("candidate = 'damped'")
    per_rep, _ = P.paired_bootstrap(pairs, reps=REPS, block_days=BLOCK)
    return per_rep.select("rep", r6("delta", 8).alias("delta"))


@query("E13_block_bootstrap_summary", W("daily_w", body=f"""SELECT {R('quantile_cont(delta, 0.025)')} AS ci_low, {R('quantile_cont(delta, 0.975)')} AS ci_high, {R('stddev_pop(delta)')} AS se,
  {R('least(1.0, 2 * least(avg(CAST(delta <= 0 AS INT)), avg(CAST(delta >= 0 AS INT))))')} AS p FROM ({BOOT} SELECT rep, avg(delta) AS delta FROM (SELECT a.fold, a.draw, a.rep, a.score - b.score AS delta FROM sc a JOIN sc b USING (fold, draw, rep)
  WHERE a.who = 'cand' AND b.who = 'base') GROUP BY 1)"""))
def _(m):
    pairs = P.paired(predictions(m), "base").where("candidate = 'damped'")
    x = P.bootstrap_summary(*P.paired_bootstrap(pairs, reps=REPS, block_days=BLOCK))
    return x.select(*[r6(c).alias(c) for c in ("ci_low", "ci_high", "se", "p")])


@query("E14_scores_from_counts", W("daily_w", body=f"SELECT symbol, score FROM ({metrics_sql(WP, ['symbol'])})"))
def _(m):
    x = E.wide_counts(E.confusion(weekly_predictions(m), ["symbol"]), ["symbol"])
    s = E.score_from_wide(x)
    return s.select("symbol", r6("score").alias("score"))


@query("E15_verdict", """WITH x AS (SELECT s_suppkey AS id, s_acctbal / 1e5 AS d, (s_suppkey % 3 - 1) * 0.01 AS unseen, (s_suppkey % 4) * 0.01 AS flip, 0.7 + (s_suppkey % 5) * 0.1 AS share FROM supplier),
  r AS (SELECT id, list_filter([CASE WHEN d + 0.02 < 0 THEN 'interval below 0' END, CASE WHEN CAST(d < -0.005 AS INT) * 2 + CAST(d - 0.01 < -0.005 AS INT) >= 2 THEN 'negative folds' END], lambda v: v IS NOT NULL) AS fatal,
   list_filter([CASE WHEN NOT (d > 0 AND d - 0.01 > 0) THEN 'positive folds' END, CASE WHEN d - 0.02 <= 0 THEN 'interval above 0' END, CASE WHEN unseen <= 0 THEN 'unseen change' END,
    CASE WHEN d - 0.01 < -0.02 THEN 'worst fold' END, CASE WHEN flip > 0.025 THEN 'flips' END, CASE WHEN abs(share - 1) > 0.25 THEN 'extreme share' END, CASE WHEN d < 0 THEN 'mean gain' END], lambda v: v IS NOT NULL) AS missing FROM x)
  SELECT id, CASE WHEN len(fatal) > 0 THEN 'reject' WHEN len(missing) > 0 THEN 'hold' ELSE 'adopt' END AS decision,
   coalesce(array_to_string(CASE WHEN len(fatal) > 0 THEN fatal ELSE missing END, '; '), '') AS reasons FROM r""")
def _(m):
    k, d = F.col("s_suppkey"), F.col("s_acctbal") / 1e5
    f = lambda n, v: F.struct(F.lit(n).alias("fold"), v.alias("d"))
    x = m.raw("supplier").select(k.alias("id"), d.alias("delta"), (d - 0.02).alias("ci_low"), (d + 0.02).alias("ci_high"), ((k % 3 - 1) * 0.01).alias("unseen_delta"),
                                 ((k % 4) * 0.01 - 0.005).alias("flip_diff"), (F.lit(0.7) + (k % 5) * 0.1).alias("extreme_ratio"), F.lit(0.01).alias("p_holm"),
                                 F.array(f("a", d), f("b", d), f("c", d - 0.01)).alias("folds"))
    return P.verdict(x, ADOPTION).select("id", "decision", "reasons")


def boot_sql(candidate: str) -> str:
    return f"""SELECT '{candidate}' AS candidate, quantile_cont(delta, 0.025) AS ci_low, quantile_cont(delta, 0.975) AS ci_high, stddev_pop(delta) AS se, least(1.0, 2 * least(avg(CAST(delta <= 0 AS INT)), avg(CAST(delta >= 0 AS INT)))) AS p
  FROM ({BOOT.replace("c.candidate = 'damped'", f"c.candidate = '{candidate}'")} SELECT rep, avg(delta) AS delta FROM (SELECT a.fold, a.draw, a.rep, a.score - b.score AS delta FROM sc a JOIN sc b USING (fold, draw, rep) WHERE a.who = 'cand' AND b.who = 'base') GROUP BY 1)"""


FINE = metrics_sql(SCOPED, ["candidate", "fold", "draw", "scope"], 14)
CHANGES = f"""SELECT c.candidate, c.fold, c.draw, c.scope, c.score - b.score AS delta, c.flip_index - b.flip_index AS flip_diff, c.pred_extreme / NULLIF(b.pred_extreme, 0) AS extreme_ratio
  FROM ({FINE}) c JOIN ({FINE}) b USING (fold, draw, scope) WHERE b.candidate = 'base' AND c.candidate <> 'base'"""
E16_COLUMNS = ("delta", "ci_low", "ci_high", "se", "p", "p_holm", "unseen_delta", "flip_diff", "extreme_ratio")


@query("E16_candidate_comparison", W("daily_w", body=f"""SELECT candidate, decision, coalesce(reasons, '') AS reasons, {', '.join(f"{R(f'ds[{i}]')} AS fold{i}" for i in (1, 2, 3))}, {', '.join(f'{R(c)} AS {c}' for c in E16_COLUMNS)} FROM (WITH ch AS ({CHANGES}),
  fd AS (SELECT candidate, list(d ORDER BY fold) AS ds FROM (SELECT candidate, fold, avg(delta) AS d FROM ch WHERE scope = 'all' GROUP BY 1, 2) GROUP BY 1),
  al AS (SELECT candidate, avg(delta) AS delta, avg(flip_diff) AS flip_diff, avg(extreme_ratio) AS extreme_ratio FROM ch WHERE scope = 'all' GROUP BY 1), us AS (SELECT candidate, avg(delta) AS unseen_delta FROM ch WHERE scope = 'unseen' GROUP BY 1),
  bs AS ({boot_sql('damped')} UNION ALL {boot_sql('momentum')}),
  hm AS (SELECT candidate, max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, candidate ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, candidate) AS rn FROM bs)),
  r AS (SELECT *, list_filter([CASE WHEN ci_high < 0 THEN 'interval below 0' END, CASE WHEN len(list_filter(ds, lambda d: d < -0.005)) >= 2 THEN 'negative folds' END], lambda v: v IS NOT NULL) AS fatal,
   list_filter([CASE WHEN len(list_filter(ds, lambda d: d > 0)) < 3 THEN 'positive folds' END, CASE WHEN ci_low <= 0 THEN 'interval above 0' END, CASE WHEN unseen_delta IS NULL OR unseen_delta <= 0 THEN 'unseen change' END,
    CASE WHEN list_min(ds) < -0.02 THEN 'worst fold' END, CASE WHEN flip_diff > 0.02 THEN 'flips' END, CASE WHEN extreme_ratio IS NULL OR abs(extreme_ratio - 1) > 0.25 THEN 'extreme share' END, CASE WHEN delta < 0 THEN 'mean gain' END], lambda v: v IS NOT NULL) AS missing
   FROM bs JOIN hm USING (candidate) JOIN fd USING (candidate) JOIN al USING (candidate) LEFT JOIN us USING (candidate))
  SELECT *, CASE WHEN len(fatal) > 0 THEN 'reject' WHEN len(missing) > 0 THEN 'hold' ELSE 'adopt' END AS decision, array_to_string(CASE WHEN len(fatal) > 0 THEN fatal ELSE missing END, '; ') AS reasons FROM r)"""))
def _(m):
    x = P.compare(predictions(m), "base", ["damped", "momentum"], ADOPTION, reps=REPS, block_days=BLOCK)
    return x.select("candidate", "decision", "reasons", *[r6(F.get("folds", F.lit(i))["d"]).alias(f"fold{i + 1}") for i in range(3)], *[r6(c).alias(c) for c in E16_COLUMNS])


@query("E16_unit_changes", W("daily_w", body=f"""SELECT c.candidate, c.fold, c.draw, c.scope, {R('c.score - b.score')} AS delta, {R('c.flip_index - b.flip_index')} AS flip_diff, {R('c.pred_extreme / NULLIF(b.pred_extreme, 0)')} AS extreme_ratio
  FROM ({FINE}) c JOIN ({FINE}) b USING (fold, draw, scope) WHERE b.candidate = 'base' AND c.candidate <> 'base'"""))
def _(m):
    x = P.unit_changes(predictions(m), "base")
    return x.withColumns({c: r6(c) for c in ("delta", "flip_diff", "extreme_ratio")})


@query("E17_output_contract", """SELECT 'bad_label' AS kind, (SELECT count(*) FROM labels WHERE quality + toxic * 5 NOT IN (0, 1, 2, 3, 4)) AS n UNION ALL SELECT 'duplicate', (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'missing', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT 'extra', (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def _(m):
    pred = m.raw("labels").select(F.col("doc_id").alias("symbol"), (F.col("quality") + F.col("toxic") * 5).alias("label"))
    return K.check_output(pred, m.raw("documents").select(F.col("doc_id").alias("symbol")))


E18_COLUMNS = ["gap_pct", "gap_rank", "vol5", "vol20", "atr14", "beta60", "zgap", "mkt_gap", "resid_gap", "reg_mkt_gap", "reg_gap_disp",
               "earn", "surp_sign", "surp_abs", "an_n", "an_up", "an_down", "news_n", "tone_mean", "tone_min", "tone_max", "news_missing", "label"]


ZEROS = ("SELECT c AS \"column\", CAST(0 AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS null_mismatch, CAST(0 AS DOUBLE) AS max_diff, CAST(0 AS BIGINT) AS violations "
         "FROM (VALUES {}) t(c) WHERE (SELECT count(*) FROM events) > 0")
E18_DAYS = 8
E18_AT_ONCE = 4  # days whose builds run side by side
E18_TEXT = FEATURE_GROUPS["txt_text"]
E18_ALL = [c for columns in FEATURE_GROUPS.values() for c in columns if c not in E18_TEXT] + ["label"]


def point_in_time(m, groups, numeric, exact=(), days=E18_DAYS):
    """Panel rows of these groups, recomputed from tables cut at the cutoff of each sampled day, beside the full-history rows.

    What all builds read is made once: the market's tables, and what a title alone decides. Windows, tags, stories and all that
    looks at more than one row is done again on every cut table."""
    from ..operators.calendar import assign_window, at_cutoff
    from ..operators.textblock import tagged_articles, with_article_text
    from ..plans.panel import build_panel, label_panel
    from ..sources.tables import asof, hash_sample
    events = cut_lineage(m.events_month)
    tables = {"daily": cut_lineage(m.daily), "price": cut_lineage(m.price), "earnings": events, "analyst": events, "news": m.news}
    if any(g.startswith("txt") for g in groups):
        tables["articles"] = cut_lineage(with_article_text(m.news, m.patterns))

    def build(t, cal, targets=None):
        text = {"aliased": m.aliases, "lexicon": m.lexicon, "targets": targets}
        if "articles" in t:
            text["articles"] = tagged_articles(assign_window(t["articles"], cal, "known_at").drop("date"), m.universe)
        return label_panel(build_panel(t, cal, m.universe, groups, text=text, tie="o_orderkey"), tables["daily"], CUTS)

    sampled = [d for (d,) in hash_sample(m.cal.select("target"), "target", days, 11).collect()]
    full = cut_lineage(build(tables, m.cal, sampled).where(F.col("target").isin(*sampled)))

    def compared(day):
        cut = at_cutoff(F.lit(day))
        part = build({name: asof(t, until=cut) for name, t in tables.items()}, m.cal.where(F.col("target") <= F.lit(day)), [day])
        return cut_lineage(K.compare_panels(part.where(F.col("target") == F.lit(day)), full.where(F.col("target") == F.lit(day)), ["symbol", "target"], numeric, exact))

    # a build is a chain of short jobs, and the days do not wait for each other
    with ThreadPool(E18_AT_ONCE) as pool:
        out = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(m.spark)(compared), sampled, chunksize=1))
    return out.groupBy("column").agg(F.max("unmatched").alias("unmatched"), F.max("null_mismatch").alias("null_mismatch"),
                                     (F.round(F.max("max_diff"), 9) + 0.0).alias("max_diff"), F.max("violations").alias("violations"))


@query("E18_point_in_time_equality", ZEROS.format(", ".join(f"('{c}')" for c in E18_COLUMNS)))
def _(m):
    """Columns of the blocks without text, and the labels."""
    return point_in_time(m, ("core", "scale", "cross", "event", "analyst", "news", "regime"), E18_COLUMNS)


@query("E18_point_in_time_all_columns", ZEROS.format(", ".join(f"('{c}')" for c in [*E18_ALL, *E18_TEXT])))
def _(m):
    """Every column of the feature registry, joined titles by null-safe equality, and the labels."""
    return point_in_time(m, tuple(FEATURE_GROUPS), E18_ALL, E18_TEXT)


@query("E18_no_bar_after_cutoff", W("bars", body="""SELECT count(*) AS late_bars FROM bars WHERE session = 'pre' AND hour(datetime) >= 9
  AND known_at < CAST(datetime AS DATE) + INTERVAL '9 hours 30 minutes'"""))
def _(m):
    return K.no_bar_at_cutoff(m.price, m.universe)
