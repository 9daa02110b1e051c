"""2.11 decision rules, objectives, regimes."""

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators.ranks import quantiles
from ..plans import regimes as G, rules as D
from ..plans.model import Candidate, default_candidate, fit_blend, predict_universe
from ..plans.scoring import score
from ..session import cut_lineage
from ..sources.market import CUTS
from .aggregates import WL, weekly_labels
from .base import R, W, grade_sql, query
from .joins import core_panel, gap_rows

r6 = C.r6


def weighted_score_sql(src, keys=""):
    """Score of rows (label, pred) per key as SQL, from the weighted confusion."""
    k, kk = (f"{keys}, ", f"{keys}") if keys else ("", "")
    part = f"PARTITION BY {kk}" if kk else ""
    return f"""SELECT {k}1 - num / NULLIF(den, 0) AS score, num, den FROM (SELECT {k}sum(w * n) AS num, sum(w * CAST(rt AS DOUBLE) * ct / tot) AS den FROM (
    SELECT {', '.join('g.' + x.strip() for x in kk.split(',')) + ', ' if kk else ''}g.i, g.j, (g.i - g.j) * (g.i - g.j) * (g.i - 2) * (g.i - 2) AS w, coalesce(c.n, 0) AS n,
      sum(coalesce(c.n, 0)) OVER (PARTITION BY {k.replace(keys, ', '.join('g.' + x.strip() for x in kk.split(','))) if kk else ''}g.i) AS rt,
      sum(coalesce(c.n, 0)) OVER (PARTITION BY {k.replace(keys, ', '.join('g.' + x.strip() for x in kk.split(','))) if kk else ''}g.j) AS ct,
      sum(coalesce(c.n, 0)) OVER ({part.replace(keys, ', '.join('g.' + x.strip() for x in kk.split(','))) if kk else ''}) AS tot
    FROM (SELECT {k}i, j FROM (SELECT DISTINCT {kk if kk else '1 AS one'} FROM ({src})), range(5) a(i), range(5) b(j)) g
    LEFT JOIN (SELECT {k}label, pred, count(*) AS n FROM ({src}) GROUP BY ALL) c ON c.label = g.i AND c.pred = g.j {''.join(f' AND c.{x.strip()} = g.{x.strip()}' for x in kk.split(',')) if kk else ''})
    {'GROUP BY ' + kk if kk else ''})"""


KG = "(SELECT unnest(list_transform(range(2, 33), lambda i: i * 0.25::DOUBLE)) AS k)"
KSRC = f"SELECT k, label, coalesce(CAST(gap_pct >= -25.0::DOUBLE / k AS INT) + CAST(gap_pct >= -6.0::DOUBLE / k AS INT) + CAST(gap_pct >= 6.0::DOUBLE / k AS INT) + CAST(gap_pct >= 25.0::DOUBLE / k AS INT), 2) AS pred FROM panel, {KG}"


def fit_panel(m):
    from ..plans.panel import label_panel
    return label_panel(gap_rows(m), m.daily, CUTS)


@query("D1_flat_and_identity", W("panel", body=f"SELECT symbol, target, 2 AS flat, coalesce({grade_sql('gap_pct', CUTS)}, 2) AS identity FROM panel"))
def _(m):
    p = fit_panel(m)
    flat, ident = D.fit_rule("flat", p, "gap_pct"), D.fit_rule("identity", p, "gap_pct", cfg={"cuts": CUTS})
    return p.select("symbol", "target", flat.apply("gap_pct").alias("flat"), ident.apply("gap_pct").alias("identity"))


@query("D2_k_rule_scores", W("panel", body=f"SELECT k, {R('score')} AS score FROM ({weighted_score_sql(KSRC, 'k')})"))
def _(m):
    return D.k_rule_scores(fit_panel(m), "gap_pct", cuts=CUTS).select("k", r6("score").alias("score"))


@query("D2_best_k", W("panel", body=f"SELECT k, {R('score')} AS score FROM ({weighted_score_sql(KSRC, 'k')}) ORDER BY score DESC NULLS LAST, k LIMIT 1"))
def _(m):
    return D.best_k(D.k_rule_scores(fit_panel(m), "gap_pct", cuts=CUTS)).select("k", r6("score").alias("score"))


@query("D2_fitted_k_predictions", W("panel", body=f"""SELECT p.symbol, p.target, p.label, coalesce(CAST(gap_pct >= -25.0 / k AS INT) + CAST(gap_pct >= -6.0 / k AS INT) + CAST(gap_pct >= 6.0 / k AS INT) + CAST(gap_pct >= 25.0 / k AS INT), 2) AS pred
  FROM panel p, (SELECT k FROM ({weighted_score_sql(KSRC, 'k')}) ORDER BY score DESC NULLS LAST, k LIMIT 1)"""))
def _(m):
    p = cut_lineage(fit_panel(m))
    rule = D.fit_rule("k", p, "gap_pct", cfg={"cuts": CUTS})
    return p.select("symbol", "target", "label", rule.apply("gap_pct").alias("pred"))


def weekly_signal(m):
    """Minus the previous weekly return in percent, with the label of the week."""
    from pyspark.sql import Window as SW
    w = SW.partitionBy("symbol").orderBy("date_et")
    return weekly_labels(m).withColumn("signal", -F.lag("ret").over(w) * 100).withColumnRenamed("date_et", "target")


SIG = f"(SELECT label, date_et AS target, -lag(ret) OVER (PARTITION BY symbol ORDER BY date_et) * 100 AS s FROM {WL})"
BP = "coalesce(CAST(s >= -b AS INT) + CAST(s >= -a AS INT) + CAST(s >= a AS INT) + CAST(s >= b AS INT), 2)"


@query("D3_histogram_counts", W("daily_w", body=f"SELECT label, CASE WHEN s IS NULL THEN -1 ELSE len(list_filter([-25.0, -6.0, 6.0, 25.0], lambda e: e <= s))::INT END AS bucket, count(*) AS n FROM {SIG} GROUP BY 1, 2"))
def _(m):
    h = D.histogram(weekly_signal(m), "signal", "label", CUTS)
    import numpy as np
    counts = np.diff(h.cum[0], axis=-1)
    rows = [(i, b, int(counts[i, b])) for i in range(5) for b in range(5) if counts[i, b]]
    rows += [(i, -1, int(n)) for i, n in enumerate(h.missing[0]) if n]
    return m.spark.createDataFrame(rows, "label int, bucket int, n long")


@query("D4_sym2_rule", W("daily_w", body=f"""SELECT {R('a', 5)} AS a, {R('b', 5)} AS b FROM (WITH q AS (SELECT DISTINCT unnest(quantile_cont(abs(s), [.1, .2, .3, .4, .5, .6, .7, .8, .9])) AS v FROM {SIG} WHERE s IS NOT NULL),
  src AS (SELECT x.v AS a, y.v AS b, label, {BP.replace('-b', '-y.v').replace('-a', '-x.v').replace('>= a', '>= x.v').replace('>= b', '>= y.v')} AS pred FROM {SIG}, q x, q y WHERE x.v < y.v)
  SELECT a, b, score FROM ({weighted_score_sql('SELECT * FROM src', 'a, b')}) ORDER BY score DESC, a, b LIMIT 1)"""))
def _(m):
    r = D.fit_rule("sym2", cut_lineage(weekly_signal(m)), "signal", cfg={"q_grid": [i / 10 for i in range(1, 10)]})
    return m.spark.createDataFrame([(float(r.bounds[2]), float(r.bounds[3]))], "a double, b double").select(r6("a", 5).alias("a"), r6("b", 5).alias("b"))


@query("D5_asym_rule", W("daily_w", body=f"""SELECT ku AS k_up, kd AS k_dn FROM (WITH g AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS k),
  src AS (SELECT x.k AS ku, y.k AS kd, label, coalesce(CAST(s >= -25.0::DOUBLE / y.k AS INT) + CAST(s >= -6.0::DOUBLE / y.k AS INT) + CAST(s >= 6.0::DOUBLE / x.k AS INT) + CAST(s >= 25.0::DOUBLE / x.k AS INT), 2) AS pred FROM {SIG}, g x, g y)
  SELECT ku, kd, score FROM ({weighted_score_sql('SELECT * FROM src', 'ku, kd')}) ORDER BY score DESC, ku, kd LIMIT 1)"""))
def _(m):
    r = D.fit_rule("asym", weekly_signal(m), "signal", cfg={"k_grid": (0.5, 3.0, 0.5), "cuts": CUTS})
    return m.spark.createDataFrame([(r.params["k_up"], r.params["k_dn"])], "k_up double, k_dn double")


@query("D6_four_threshold_rule", "SELECT true AS not_below_asym, 0::BIGINT AS better_moves, true AS ascending")
def _(m):
    """The rule stands where no single bound can move to a better allowed value; every move is scored apart, by the grouped metric."""
    p = cut_lineage(weekly_signal(m))
    cfg = {"cuts": CUTS, "n_q": 24, "n_pass": 20}
    r, start = D.fit_rule("4t", p, "signal", cfg=cfg), D.fit_rule("asym", p, "signal", cfg=cfg)
    edges = quantiles(p, [], "signal", {f"q{i}": 0.005 + 0.99 * i / 23 for i in range(24)}).first()
    moves = [("fitted", r.bounds), ("asym", start.bounds)]
    for k in range(4):
        low, high = [float("-inf"), *r.bounds][k], [*r.bounds, float("inf")][k + 1]
        moves += [(f"{k}:{e}", (*r.bounds[:k], e, *r.bounds[k + 1:])) for e in edges if low < e < high]
    each = F.array(*[F.struct(F.lit(n).alias("move"), C.grade_or_flat("signal", b).alias("pred")) for n, b in moves])
    s = score(p.select("label", F.inline(each)), ["move"]).select("move", F.round("score", 12).alias("score"))
    of = lambda n: F.max(F.when(F.col("move") == n, F.col("score")))
    both = s.agg(of("fitted").alias("f"), of("asym").alias("a"), F.collect_list("score").alias("all"))
    return both.select((F.col("f") >= F.col("a")).alias("not_below_asym"), F.size(F.filter("all", lambda v: v > F.col("f"))).cast("long").alias("better_moves"),
                       F.lit(list(r.bounds) == sorted(r.bounds)).alias("ascending"))


DQ = "SELECT unnest(quantile_cont({0}, list_transform(range(1, 20), lambda i: i / 20.0::DOUBLE))) AS v FROM heads"


@query("D7_decomp_rule", W("daily_w", body=f"""SELECT {R('t_move', 5)} AS t_move, {R('t_ext', 5)} AS t_ext, c, {R('score')} AS score FROM (WITH
  heads AS (SELECT label, 1 - exp(-abs(s) / 20) AS pm, 1 - exp(-abs(s) / 60) AS pe, 1 / (1 + exp(-s / 30)) AS pu FROM {SIG} WHERE s IS NOT NULL),
  tm AS (SELECT DISTINCT v FROM ({DQ.format('pm')})), te AS (SELECT DISTINCT v FROM ({DQ.format('pe')})), cs AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.3])::DOUBLE AS c),
  src AS (SELECT tm.v AS t_move, te.v AS t_ext, c, label, CASE WHEN pm < tm.v THEN 2 ELSE 2 + (CASE WHEN pu >= 0.5 THEN 1 ELSE -1 END) * (1 + CAST(pe >= te.v AND abs(pu - 0.5) >= c AS INT)) END AS pred FROM heads, tm, te, cs)
  SELECT t_move, t_ext, c, score FROM ({weighted_score_sql('SELECT * FROM src', 't_move, t_ext, c')}) ORDER BY round(score, 12) DESC, t_move, t_ext, c LIMIT 1)"""))
def _(m):
    p = cut_lineage(weekly_signal(m).withColumns({
        "p_move": 1 - F.exp(-F.abs("signal") / 20), "p_ext": 1 - F.exp(-F.abs("signal") / 60),
        "p_up": 1 / (1 + F.exp(-F.col("signal") / 30))}).where("signal IS NOT NULL"))
    r = D.fit_rule("decomp", p, ("p_move", "p_ext", "p_up"), cfg={"conf_gate": True})
    x = p.withColumn("pred", r.apply(("p_move", "p_ext", "p_up")))
    return score(x).select(r6(F.lit(r.t_move), 5).alias("t_move"), r6(F.lit(r.t_ext), 5).alias("t_ext"), F.lit(float(r.c)).alias("c"), r6("score").alias("score"))


CHUNK = "(SELECT *, CAST(target >= (SELECT d FROM days WHERE r = floor(n * 1 / 3.0)) AS INT) + CAST(target >= (SELECT d FROM days WHERE r = floor(n * 2 / 3.0)) AS INT) AS chunk FROM sig)"


@query("D8_objective_by_chunk", W("daily_w", body=f"""SELECT chunk, {R('score')} AS score FROM (WITH sig AS (SELECT * FROM {SIG}), days AS (SELECT target AS d, row_number() OVER (ORDER BY target) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM sig)),
  src AS (SELECT chunk, label, coalesce({grade_sql('s', CUTS)}, 2) AS pred FROM {CHUNK}) SELECT * FROM ({weighted_score_sql('SELECT * FROM src', 'chunk')}))"""))
def _(m):
    p = weekly_signal(m)
    x = p.withColumns({"chunk": D.Objective("mean", n_chunks=3).chunk(p, "target"), "pred": C.grade_or_flat("signal", CUTS)})
    return score(x, ["chunk"]).select("chunk", r6("score").alias("score"))


KP = "coalesce(CAST(s >= -25.0::DOUBLE / k AS INT) + CAST(s >= -6.0::DOUBLE / k AS INT) + CAST(s >= 6.0::DOUBLE / k AS INT) + CAST(s >= 25.0::DOUBLE / k AS INT), 2)"


@query("D8_objective_selects_k", W("daily_w", body=f"""SELECT criterion, k FROM (WITH sig AS (SELECT * FROM {SIG}), days AS (SELECT target AS d, row_number() OVER (ORDER BY target) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT target FROM sig)),
  src AS (SELECT k, chunk, label, {KP} AS pred FROM {CHUNK}, {KG}), parts AS ({weighted_score_sql('SELECT * FROM src', 'k, chunk')}),
  vals AS (SELECT 'pooled' AS criterion, k, score AS v FROM ({weighted_score_sql('SELECT k, label, pred FROM src', 'k')}) UNION ALL SELECT 'mean', k, avg(score) FROM parts GROUP BY k
    UNION ALL SELECT 'mean_sd', k, avg(score) - stddev_pop(score) FROM parts GROUP BY k UNION ALL SELECT 'min', k, min(score) FROM parts GROUP BY k)
  SELECT criterion, k FROM vals QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY round(v, 12) DESC NULLS LAST, k) = 1)"""))
def _(m):
    p = cut_lineage(weekly_signal(m))
    rows = [(c, D.fit_rule("k", p, "signal", obj=D.Objective(c), cfg={"cuts": CUTS}, day="target").params["k"])
            for c in ("pooled", "mean", "mean_sd", "min")]
    return m.spark.createDataFrame(rows, "criterion string, k double")


WV = f"(SELECT label, s, r FROM (SELECT label, -lag(ret) OVER w * 100 AS s, CASE WHEN count(ret) OVER v >= 10 THEN round(stddev_samp(ret * 100) OVER v, 4) END AS r FROM {WL} WINDOW w AS (PARTITION BY symbol ORDER BY date_et), v AS (PARTITION BY symbol ORDER BY date_et ROWS 19 PRECEDING)))"


def weekly_regime(m):
    from pyspark.sql import Window as SW
    from ..operators.series import rolling
    w = SW.partitionBy("symbol").orderBy("target")
    x = weekly_signal(m)
    return x.withColumn("r", F.round(rolling(w, F.col("ret") * 100, 20, "std", 10), 4))


@query("R1_tercile_edges", W("daily_w", body=f"""SELECT {R('quantile_cont(r, 1 / 3.0::DOUBLE)', 5)} AS e1, {R('quantile_cont(r, 2 / 3.0::DOUBLE)', 5)} AS e2, {R('(SELECT median(r) FROM ' + WV + ')', 5)} AS med FROM (SELECT DISTINCT r FROM {WV} WHERE r IS NOT NULL)"""))
def _(m):
    p = cut_lineage(weekly_regime(m))
    rule = D.fit_rule("identity", p, "signal", cfg={"cuts": CUTS})
    g = G.fit_tercile(p, "signal", "r", "label", rule, D.Objective(), {}, None)
    return m.spark.createDataFrame([(*g.edges, g.median)], "e1 double, e2 double, med double").select(*[r6(c, 5).alias(c) for c in ("e1", "e2", "med")])


@query("R1_tercile_scaling", W("daily_w", body=f"""SELECT lo, hi FROM (WITH x AS (SELECT * FROM {WV}), e AS (SELECT quantile_cont(r, 1 / 3.0::DOUBLE) AS e1, quantile_cont(r, 2 / 3.0::DOUBLE) AS e2 FROM (SELECT DISTINCT r FROM x WHERE r IS NOT NULL)),
  md AS (SELECT median(r) AS med FROM x), f AS (SELECT unnest([0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6])::DOUBLE AS f),
  src AS (SELECT a.f AS lo, b.f AS hi, label, s * CASE WHEN coalesce(r, med) >= e2 THEN b.f WHEN coalesce(r, med) >= e1 THEN 1.0::DOUBLE ELSE a.f END AS s FROM x, e, md, f a, f b),
  p AS (SELECT lo, hi, label, coalesce({grade_sql('s', CUTS)}, 2) AS pred FROM src)
  SELECT lo, hi, score FROM ({weighted_score_sql('SELECT * FROM p', 'lo, hi')}) ORDER BY score DESC, lo, hi LIMIT 1)"""))
def _(m):
    p = cut_lineage(weekly_regime(m))
    rule = D.fit_rule("identity", p, "signal", cfg={"cuts": CUTS})
    g = G.fit_tercile(p, "signal", "r", "label", rule, D.Objective(), {}, None)
    return m.spark.createDataFrame([(g.f[0], g.f[2])], "lo double, hi double")


@query("R2_linear_scaling", W("daily_w", body=f"""SELECT alpha, {R('med', 5)} AS med FROM (WITH x AS (SELECT * FROM {WV}), e AS (SELECT quantile_cont(r, 0.25) AS q1, median(r) AS med, quantile_cont(r, 0.75) AS q3 FROM (SELECT DISTINCT r FROM x WHERE r IS NOT NULL)),
  a AS (SELECT unnest(list_transform(range(-10, 11), lambda i: i / 10.0::DOUBLE)) AS alpha),
  src AS (SELECT alpha, med, label, s * greatest(least(exp(alpha * coalesce((r - med) / (q3 - q1), 0.0)), 2.0), 0.5) AS s FROM x, e, a), p AS (SELECT alpha, med, label, coalesce({grade_sql('s', CUTS)}, 2) AS pred FROM src)
  SELECT alpha, med, score FROM ({weighted_score_sql('SELECT * FROM p', 'alpha, med')}) ORDER BY score DESC, alpha LIMIT 1)"""))
def _(m):
    p = cut_lineage(weekly_regime(m))
    rule = D.fit_rule("identity", p, "signal", cfg={"cuts": CUTS})
    g = G.fit_linear(p, "signal", "r", "label", rule, D.Objective(), {}, None)
    return m.spark.createDataFrame([(g.alpha, g.med)], "alpha double, med double").withColumn("med", r6("med", 5))


@query("R3_no_regime", W("panel", body=f"SELECT symbol, target, {R('gap_pct')} AS scaled FROM panel"))
def _(m):
    return fit_panel(m).select("symbol", "target", r6(F.col("gap_pct") * G.NoRegime().factor()).alias("scaled"))


def k_spec(**more):
    return {"name": "k", "signal": {"type": "gap"}, "decision": {"type": "k", "params": {"cuts": CUTS}}, **more}


REG = "reg_med_absgap"
R5_GRADE = lambda s, k: "coalesce(" + " + ".join(f"CAST({s} >= {c}::DOUBLE / {k} AS INT)" for c in CUTS) + ", 2)"
R5_K = lambda rows: f"(SELECT k FROM ({weighted_score_sql(f'SELECT k, label, {R5_GRADE("gap_pct", "k")} AS pred FROM {rows}, {KG}', 'k')}) ORDER BY round(score, 12) DESC NULLS LAST, k LIMIT 1)"
R5_LATE = "(SELECT * FROM panel WHERE date_diff('day', DATE '1970-01-01', target) > (SELECT quantile_cont(d, 0.8) FROM (SELECT DISTINCT date_diff('day', DATE '1970-01-01', target)::DOUBLE AS d FROM panel)))"
R5_LO_HI = f"""SELECT lo, hi, score FROM ({weighted_score_sql(f'''SELECT a.f AS lo, b.f AS hi, label, {R5_GRADE(f"gap_pct * CASE WHEN coalesce({REG}, med) >= e2 THEN b.f WHEN coalesce({REG}, med) >= e1 THEN 1.0::DOUBLE ELSE a.f END", "k")} AS pred FROM panel, best, e, md, f a, f b''', 'lo, hi')}) ORDER BY round(score, 12) DESC, lo, hi LIMIT 1"""
R5_ALPHA = f"""SELECT alpha, score FROM ({weighted_score_sql(f'''SELECT alpha, label, {R5_GRADE(f"gap_pct * greatest(least(exp(alpha * coalesce(({REG} - m) / (q3 - q1), 0.0)), 2.0), 0.5)", "k")} AS pred FROM panel, best, e, al''', 'alpha')}) ORDER BY round(score, 12) DESC, alpha LIMIT 1"""


@query("R5_time_ordered_fit", W("panel", body=f"""SELECT * FROM (WITH best AS {R5_K('panel')}, late AS {R5_K(R5_LATE)}, md AS (SELECT median({REG}) AS med FROM panel),
  e AS (SELECT quantile_cont({REG}, 1 / 3.0::DOUBLE) AS e1, quantile_cont({REG}, 2 / 3.0::DOUBLE) AS e2, quantile_cont({REG}, 0.25) AS q1, median({REG}) AS m, quantile_cont({REG}, 0.75) AS q3 FROM (SELECT DISTINCT {REG} FROM panel WHERE {REG} IS NOT NULL)),
  f AS (SELECT unnest([0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6])::DOUBLE AS f), al AS (SELECT unnest(list_transform(range(-10, 11), lambda i: i / 10.0::DOUBLE)) AS alpha), lh AS ({R5_LO_HI}), aa AS ({R5_ALPHA})
  SELECT 'k' AS candidate, k, NULL::DOUBLE AS e1, NULL::DOUBLE AS e2, NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS med, NULL::DOUBLE AS alpha FROM best UNION ALL SELECT 'k_tuned_late', k, NULL, NULL, NULL, NULL, NULL, NULL FROM late
  UNION ALL SELECT 'tercile', k, {R('e1')}, {R('e2')}, lo, hi, {R('med')}, NULL FROM best, e, lh, md UNION ALL SELECT 'linear', k, NULL, NULL, NULL, NULL, {R('m')}, alpha FROM best, e, aa)"""))
def _(m):
    p = cut_lineage(core_panel(m, ("core", "scale", "cross", "regime")))
    rows = []
    for name, spec in {"k": k_spec(), "k_tuned_late": k_spec(tune_on="time"), "tercile": k_spec(regime={"type": "tercile", "params": {"var": REG}}),
                       "linear": k_spec(regime={"type": "linear", "params": {"var": REG}})}.items():
        c = Candidate(spec).fit(p)
        s = c.regime.state()
        e, f = s.get("edges", (None, None)), s.get("f", (None, None, None))
        rows.append((name, float(c.rule.params["k"]), *e, f[0], f[2], s.get("median", s.get("med")), s.get("alpha")))
    x = m.spark.createDataFrame(rows, "candidate string, k double, e1 double, e2 double, low double, high double, med double, alpha double")
    return x.withColumns({c: r6(c) for c in ("e1", "e2", "med")})


@query("R6_fitted_predictions", W("panel", "grid", body=f"""SELECT g.symbol, g.target, coalesce(CASE WHEN gap_pct IS NULL THEN 2 ELSE CAST(gap_pct >= -25.0 / 5.25 AS INT) + CAST(gap_pct >= -6.0 / 5.25 AS INT) + CAST(gap_pct >= 6.0 / 5.25 AS INT) + CAST(gap_pct >= 25.0 / 5.25 AS INT) END, 2) AS label
  FROM grid g LEFT JOIN panel p USING (symbol, target)"""))
def _(m):
    from ..operators.calendar import dense_grid
    return predict_universe(default_candidate(CUTS), fit_panel(m), dense_grid(m.universe, "symbol", m.cal).select("symbol", "target"))


M10_ROWS = f"(SELECT symbol, date_et AS target, label, ret * 100 AS y, -lag(ret) OVER (PARTITION BY symbol ORDER BY date_et) * 100 AS s FROM {WL})"
M10_DAY = "date_diff('day', DATE '1970-01-01', target)"


@query("M10_residual_blend", W("daily_w", body=f"""SELECT alpha, k, {R('score')} AS score FROM (WITH a AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha), x AS (SELECT * FROM {M10_ROWS}),
  edge AS (SELECT quantile_cont(d, 0.5) AS e FROM (SELECT DISTINCT {M10_DAY}::DOUBLE AS d FROM x)), fitted AS (SELECT symbol, avg(y - s) AS r FROM x, edge WHERE {M10_DAY} <= e GROUP BY 1),
  mixed AS (SELECT alpha, label, s + alpha * coalesce(r, 0.0) AS s FROM x LEFT JOIN fitted USING (symbol), edge, a WHERE {M10_DAY} > e), src AS (SELECT alpha, k, label, {KP} AS pred FROM mixed, {KG})
  SELECT alpha, k, score FROM ({weighted_score_sql('SELECT * FROM src', 'alpha, k')}) ORDER BY round(score, 12) DESC, alpha, k LIMIT 1)"""))
def _(m):
    """The residual is fitted: what each symbol's move left over the signal on average in the earlier half. It is blended in on the later half."""
    p = cut_lineage(weekly_signal(m))
    d = F.unix_date("target").cast("double")
    edge = quantiles(p.select(d.alias("d")).distinct(), [], "d", {"e": 0.5}).first()["e"]
    fitted = p.where(d <= edge).groupBy("symbol").agg(F.avg(F.col("ret") * 100 - F.col("signal")).alias("resid"))
    late = cut_lineage(p.where(d > edge).join(fitted, "symbol", "left"))
    a, rule, val = fit_blend(late, "signal", "resid", cfg={"cuts": CUTS})
    return m.spark.createDataFrame([(a, rule.params["k"], val)], "alpha double, k double, score double").withColumn("score", r6(F.nanvl("score", F.lit(None).cast("double"))))
