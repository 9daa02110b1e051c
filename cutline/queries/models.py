"""2.10 models and 2.13 explanation."""

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators.ranks import quantiles
from ..operators import indicators as I, sequences as Q, textblock as T
from ..operators.termweights import Terms, title_terms
from ..plans import explain as X, signals as G
from ..plans.model import Candidate, default_candidate
from ..plans.panel import label_panel
from ..plans.scoring import score
from ..session import cut_lineage
from ..sources.market import CUTS
from .aggregates import WL, weekly_labels
from .base import R, W, grade_sql, query
from .joins import articles, core_panel, gap_rows
from .rules import k_spec, weighted_score_sql
from .sorts import H
from .windows import SEQ_LIST, fold_sql, roll_sql, wilder_sql

r6 = C.r6
FEATS = ["gap_pct", "gap_rank", "vol5", "zgap", "mkt_gap", "resid_gap"]


def ml_panel(m):
    return cut_lineage(core_panel(m, ("core", "scale", "cross", "regime")).where("label IS NOT NULL"))


@query("M1_column_signal", W("panel", body=f"SELECT symbol, target, {R('gap_pct')} AS signal FROM panel"))
def _(m):
    from .rules import fit_panel
    return G.ColumnSignal().transform(fit_panel(m)).select("symbol", "target", r6("signal").alias("signal"))


@query("M2_absolute_error_regression", W("panel", body="SELECT 150 AS rounds, true AS falls, true AS graded, count(*) AS n FROM panel WHERE label IS NOT NULL"))
def _(m):
    """All rounds are grown, the training loss never rises, and every row gets a grade; nothing is imputed."""
    p = ml_panel(m)
    spec = {"name": "regress", "signal": {"type": "regress", "features": FEATS}, "decision": {"type": "k", "params": {"cuts": CUTS}}}
    c = Candidate(spec).fit(p)
    model = c.signal.model
    return c.predict(p).agg(F.lit(len(model.rounds)).alias("rounds"), F.lit(model.falls(0)).alias("falls"), F.bool_and(F.col("pred").between(0, 4)).alias("graded"), F.count(F.lit(1)).alias("n"))


@query("M3_five_class_signal", W("panel", body="SELECT symbol, target, label, true AS sums_to_one, true AS inside, true AS falls FROM panel WHERE label IS NOT NULL"))
def _(m):
    """Five positive probabilities of sum one, the signal between the outer class centres, and a softmax loss that falls each round."""
    from ..fixed import CLASS_CENTERS
    p = ml_panel(m)
    s = G.Classify5Signal(FEATS).fit(p)
    x = s.transform(s.probabilities(p).withColumnRenamed("probs", "five"))
    total = F.aggregate("five", F.lit(0.0), lambda a, v: a + v)
    return x.select("symbol", "target", "label", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.col("signal").between(min(CLASS_CENTERS), max(CLASS_CENTERS)).alias("inside"), F.lit(s.model.falls(0)).alias("falls"))


M4_ROWS = W("panel", body="SELECT symbol, target, label, true AS inside, true AS falls FROM panel WHERE label IS NOT NULL")


def heads_checked(m, params=None):
    p = ml_panel(m)
    s = G.DecompSignal(FEATS, params).fit(p)
    inside = [F.col(c).between(0.0, 1.0) for c in ("p_move", "p_ext", "p_up")]
    return s.transform(p).select("symbol", "target", "label", (inside[0] & inside[1] & inside[2]).alias("inside"), F.lit(all(h.falls(0) for h in s.heads.values())).alias("falls"))


@query("M4_decomposition_heads", M4_ROWS)
def _(m):
    return heads_checked(m)


@query("M4_decomposition_multiclass", M4_ROWS)
def _(m):
    return heads_checked(m, {"magnitude": "multiclass"})


def text_panel(m):
    """Labelled rows, and the titles of their representative articles."""
    return cut_lineage(label_panel(gap_rows(m), m.daily, CUTS)), cut_lineage(T.representatives(articles(m)).select("symbol", "target", "known_at", "ckey", "title"))


def counted(titles, model):
    """The terms of the joined titles of each row, counted once for all that read them."""
    t = title_terms(titles, model.vectorizer, model.words(titles.sparkSession))
    return Terms(t.keys, t.held, cut_lineage(t.counts))


def text_model(m, name):
    words = [r["word"] for r in m.lexicon.select("word").distinct().collect()] if name == "lm_vocab" else None
    limits = {} if name in ("tfidf_df", "hashing", "lm_vocab") else {"min_df": 2}
    return G.BigMoveModel("text", vectorizer=name, vocabulary=words, **limits)


for _name in G.VECTORISERS:
    @query("M5_text_big_move_model" if _name == "count_uni" else f"M5_text_{_name}")
    def _(m, name=_name):
        p, titles = text_panel(m)
        model = text_model(m, name)
        terms = counted(titles, model)
        return model.fit(p, terms=terms).transform(p, terms=terms).groupBy("label").agg(F.count("p_big").alias("scored"), F.count(F.lit(1)).alias("n"), F.avg("p_big").alias("mean_p"))


@query("M5_column_big_move_model")
def _(m):
    p = ml_panel(m)
    model = G.BigMoveModel("columns", FEATS).fit(p)
    return model.transform(p).groupBy("label").agg(F.count("p_big").alias("scored"), F.avg("p_big").alias("mean_p"))


@query("R4_text_regime")
def _(m):
    p, titles = text_panel(m)
    spec = k_spec(regime={"type": "textclf", "params": {"input": "text", "vectorizer": "count_uni", "min_df": 2}})
    terms = counted(titles, G.BigMoveModel(vectorizer="count_uni"))
    c = Candidate(spec).fit(p, terms)
    return score(c.predict(p, terms)).withColumn("regime", F.lit(str(c.regime.state())))


@query("S18_learned_save_restore", W("panel", body="SELECT unnest(['regress', 'textclf']) AS candidate, 0::BIGINT AS differing, count(*) AS n FROM panel WHERE label IS NOT NULL"))
def _(m):
    """Predictions of candidates with learned parts before saving and after loading."""
    from .scans import scratch
    regress = {"signal": {"type": "regress", "features": FEATS, "params": {"maxIter": 10, "minInstancesPerNode": 5}}, "decision": {"type": "k", "params": {"cuts": CUTS}}}
    text = k_spec(regime={"type": "textclf", "params": {"input": "text", "vectorizer": "tfidf_uni", "min_df": 2}})
    out = None
    p, titles = text_panel(m)
    terms = counted(titles, G.BigMoveModel(vectorizer="tfidf_uni"))
    for name, spec, rows, own in (("regress", regress, ml_panel(m), None), ("textclf", text, p.where("label IS NOT NULL"), terms)):
        path = scratch(m, f"candidate_{name}")
        c = Candidate(spec).fit(rows, own)
        c.save(m.spark, path)
        key = ["symbol", "target"]
        again = Candidate.load(m.spark, path).predict(rows, own).select(*key, F.col("pred").alias("again"))
        x = c.predict(rows, own).select(*key, "pred").join(again, key).agg(F.lit(name).alias("candidate"), F.count_if(~F.col("pred").eqNullSafe(F.col("again"))).alias("differing"), F.count(F.lit(1)).alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


IND = ["ret1", "ret5", "rsi14", "macd_hist", "pct_b", "band_width", "vol_ratio"]


def indicators(m):
    lab = weekly_labels(m).select("symbol", F.col("date_et").alias("target"), "label", "ret_pct")
    return cut_lineage(I.indicator_table(m.daily_w, m.price, m.cal_w).join(lab, ["symbol", "target"]))


@query("M6_forest_baseline", f"SELECT unnest([{', '.join(repr(c) for c in IND)}]) AS feature, true AS not_negative, 1.0::DOUBLE AS total")
def _(m):
    """The importances of the forest's eight inputs but the always missing one: none negative, together one."""
    x = indicators(m)
    imp = G.forest_importances(m.spark, G.forest_baseline(x, IND), IND)
    total = imp.agg(F.sum("importance")).scalar()
    return imp.withColumn("_t", total).select("feature", (F.col("importance") >= 0).alias("not_negative"), r6("_t").alias("total"))


@query("M7_indicator_table", W("daily_w", "cal_w", body=f"""SELECT d.symbol, d.date_et AS date, c.target, {R('ret1', 8)} AS ret1, {R('ret5', 8)} AS ret5, {R('CASE WHEN g.v IS NULL THEN NULL WHEN l.v > 0 THEN 100.0 - 100.0 / (1.0 + g.v / l.v) ELSE 100.0 END')} AS rsi14,
  {R('(ln.v - sg.v) / d.close', 8)} AS macd_hist, {R('(d.close - (mid - 2 * sd)) / NULLIF(4 * sd, 0)', 5)} AS pct_b, {R('4 * sd / NULLIF(mid, 0)', 5)} AS band_width, {R('volume / v20')} AS vol_ratio, CAST(NULL AS DOUBLE) AS pre_ret FROM (
  SELECT *, close / lag(close, 1) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, {roll_sql('avg', 'close', 20, 20)} AS mid, {roll_sql('stddev_samp', 'close', 20, 20)} AS sd,
   avg(volume) OVER (PARTITION BY symbol ORDER BY date_et ROWS 19 PRECEDING) AS v20 FROM daily_w WINDOW w AS (PARTITION BY symbol ORDER BY date_et)) d JOIN cal_w c ON c.date = d.date_et
  LEFT JOIN ({wilder_sql('coalesce(greatest(close - prev_close, 0), 0)')}) g ON g.symbol = d.symbol AND g.date_et = d.date_et
  LEFT JOIN ({wilder_sql('coalesce(greatest(prev_close - close, 0), 0)')}) l ON l.symbol = d.symbol AND l.date_et = d.date_et
  JOIN (SELECT f.symbol, f.date_et, f.v - s.v AS v FROM ({fold_sql(2 / 13)}) f JOIN ({fold_sql(2 / 27)}) s USING (symbol, date_et)) ln ON ln.symbol = d.symbol AND ln.date_et = d.date_et
  JOIN (WITH line AS (SELECT f.symbol, f.date_et, f.v - s.v AS v FROM ({fold_sql(2 / 13)}) f JOIN ({fold_sql(2 / 27)}) s USING (symbol, date_et)) SELECT symbol, date_et, v FROM ({fold_sql(2 / 10, 'v', 'line')})) sg
   ON sg.symbol = d.symbol AND sg.date_et = d.date_et WHERE d.i >= 29"""))
def _(m):
    x = I.indicator_table(m.daily_w, m.price, m.cal_w)
    return x.withColumns({c: r6(c, 8) for c in ("ret1", "ret5", "macd_hist")} | {c: r6(c, 5) for c in ("pct_b", "band_width")} | {c: r6(c) for c in ("rsi14", "vol_ratio", "pre_ret")})


@query("M8_persistence_baseline", W("daily_w", body=f"""SELECT symbol, date, label, coalesce({grade_sql('p', CUTS)}, 2) AS pred FROM (SELECT symbol, date_et AS date, label, lag(ret_pct) OVER (PARTITION BY symbol ORDER BY date_et) AS p FROM {WL})"""))
def _(m):
    x = weekly_labels(m).withColumnRenamed("date_et", "date")
    return G.persistence(x, CUTS).select("symbol", "date", "label", "pred")


@query("M9_sequence_standardisation", W("daily_w", body=f"""SELECT pos, {R('mean', 5)} AS mean, {R('sd', 5)} AS sd, {R('min((x - mean) / sd)', 4)} AS z_low, {R('max((x - mean) / sd)', 4)} AS z_high, {R('avg((x - mean) / sd * (x - mean) / sd)', 4)} AS z_square FROM (
  SELECT pos, x, avg(x) OVER (PARTITION BY pos) AS mean, greatest(stddev_pop(x) OVER (PARTITION BY pos), 1e-6) AS sd FROM (
  SELECT ((k - 1) * 5 + c - 1)::INT AS pos, xs[k][c] AS x FROM ({SEQ_LIST}), (SELECT unnest(range(1, 21)) AS k), (SELECT unnest(range(1, 6)) AS c) WHERE i >= 21)) GROUP BY pos, mean, sd"""))
def _(m):
    x = cut_lineage(Q.flat_features(Q.sequence_windows(m.daily_w), "sequence"))
    stats = cut_lineage(Q.position_stats(x, "flat"))
    z = Q.standardise(x, "flat", stats).select(F.posexplode("z").alias("pos", "z"))
    each = z.groupBy("pos").agg(r6(F.min("z"), 4).alias("z_low"), r6(F.max("z"), 4).alias("z_high"), r6(F.avg(F.col("z") * F.col("z")), 4).alias("z_square"))
    return stats.select("pos", r6("mean", 5).alias("mean"), r6("sd", 5).alias("sd")).join(each, "pos")


def labelled_sequences(m):
    from ..operators.joins import one_to_one
    lab = weekly_labels(m).select("symbol", F.col("date_et").alias("target"), "label", "ret_pct")
    return one_to_one(Q.sequence_windows(m.daily_w), lab, ["symbol", "target"])


#: A network or linear model with a constant per class can always do as well as the class shares, so its training loss is at most their entropy.
M11_ROWS = W("daily_w", body=f"SELECT count(*) AS n, true AS sums_to_one, true AS at_most_entropy FROM (SELECT i FROM ({SEQ_LIST}) JOIN (SELECT symbol AS s2, date_et AS d2 FROM {WL}) ON symbol = s2 AND date_et = d2 WHERE i >= 21)")


def classifier_checked(scored):
    from pyspark.ml.functions import vector_to_array
    p = scored.select("label", vector_to_array("probability").alias("p"))
    share = p.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    entropy = share.agg(F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).scalar()
    own = -F.log(F.greatest(F.get("p", F.col("label")), F.lit(1e-300)))
    total = F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-6
    x = p.agg(F.count(F.lit(1)).alias("n"), F.bool_and(total).alias("sums_to_one"), F.avg(own).alias("_loss")).withColumn("_e", entropy)
    return x.select("n", "sums_to_one", (F.col("_loss") <= F.col("_e") + 1e-6).alias("at_most_entropy"))


@query("M11_sequence_classifier", M11_ROWS)
def _(m):
    from pyspark.ml.functions import array_to_vector
    x = Q.trend_remainder(labelled_sequences(m), "sequence")
    x = x.withColumn("flat", F.concat(F.flatten("trend"), F.flatten("remainder")))
    x = cut_lineage(x.select("symbol", "target", "label", "flat"))
    x = Q.standardise(x, "flat", Q.position_stats(x, "flat")).withColumn("v", array_to_vector("z"))
    return classifier_checked(G.sequence_classifier(x, "v", 200).transform(x))


@query("M11_linear_sequence_classifier", M11_ROWS)
def _(m):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    x = cut_lineage(Q.flat_features(labelled_sequences(m), "sequence").select("symbol", "target", "label", "flat"))
    x = Q.standardise(x, "flat", Q.position_stats(x, "flat")).withColumns({"v": array_to_vector("z"), "_y": F.col("label").cast("double")})
    return classifier_checked(LogisticRegression(featuresCol="v", labelCol="_y", family="multinomial").fit(x).transform(x))


# ---- explanation ------------------------------------------------------------------------
PERM = f"""WITH
  dd AS (SELECT target, CAST(floor(r / 5.0) AS INT) AS b, r % 5 AS i FROM (SELECT target, row_number() OVER (ORDER BY target) - 1 AS r FROM (SELECT DISTINCT target FROM panel))),
  bl AS (SELECT b, count(*) AS len FROM dd GROUP BY 1), rp AS (SELECT b, len, rep FROM bl, (SELECT unnest(range(4)) AS rep)),
  pm AS (SELECT rep, b AS pb, len, row_number() OVER (PARTITION BY rep ORDER BY {H("'0'", 'CAST(rep AS VARCHAR)', 'CAST(b AS VARCHAR)')}, b) - 1 AS b FROM rp)
  SELECT pm.rep::INT AS rep, dd.target, s.target AS source FROM dd JOIN pm ON pm.b = dd.b JOIN dd s ON s.b = pm.pb AND s.i = dd.i % pm.len"""


@query("J15_block_permutation", W("panel", body=f"""SELECT p.symbol, p.target, m.rep, {R('q.gap_pct')} AS gap_pct FROM panel p JOIN ({PERM}) m ON m.target = p.target
  LEFT JOIN panel q ON q.symbol = p.symbol AND q.target = m.source"""))
def _(m):
    from .rules import fit_panel
    p = cut_lineage(fit_panel(m))
    x = X.block_permute(p, ["gap_pct"], X.permuted_days(p, 5, 4))
    return x.select("symbol", "target", "rep", r6("gap_pct").alias("gap_pct"))


X1_FEATURES = ["gap_pct", "gap_rank", "vol5", "vol20", "mkt_gap", "resid_gap", "beta60", "reg_med_absgap", "reg_big_ratio"]
X1_GROUPS = {"core": X1_FEATURES[:2], "scale": X1_FEATURES[2:4], "cross": X1_FEATURES[4:7], **{c: [c] for c in X1_FEATURES[7:]}}
X1_ROWS = ", ".join(f"struct_pack(grp := '{g}', feature := '{c}', present := count({c}))" for g, cols in X1_GROUPS.items() for c in cols)


@query("X1_feature_groups", W("panel", body=f"SELECT unnest(r, recursive := true) FROM (SELECT [{X1_ROWS}] AS r FROM panel)"))
def _(m):
    return X.group_coverage(core_panel(m), X1_FEATURES)


#: The gap rule with a scaling by the market's median gap: what the explanation queries explain.
X_EDGES, X_FACTORS, X_MEDIAN = (8.0, 12.0), (0.7, 1.0, 1.4), 10.0


def scaled_gap_rule():
    from ..plans.regimes import TercileRegime
    c = default_candidate(CUTS)
    c.regime = TercileRegime("reg_med_absgap", X_EDGES, X_FACTORS, X_MEDIAN)
    return c


def scaled_sql(gap: str, r: str) -> str:
    return f"({gap} * CASE WHEN coalesce({r}, {X_MEDIAN}) >= {X_EDGES[1]} THEN {X_FACTORS[2]}::DOUBLE WHEN coalesce({r}, {X_MEDIAN}) >= {X_EDGES[0]} THEN 1.0::DOUBLE ELSE {X_FACTORS[0]}::DOUBLE END)"


GAP_RULE = "coalesce(" + " + ".join(f"CAST(s >= {c}::DOUBLE / 5.25 AS INT)" for c in CUTS) + ", 2)"
PLAIN_ROWS = f"SELECT 1 AS one, label, {GAP_RULE} AS pred FROM (SELECT label, {scaled_sql('gap_pct', 'reg_med_absgap')} AS s FROM panel)"


@query("X2_permutation_importance", W("panel", body=f"""SELECT grp, rep, {R('base - score')} AS drop FROM (WITH pm AS ({PERM}),
  x AS (SELECT grp, rep, label, CASE grp WHEN 'core' THEN {scaled_sql('q.gap_pct', 'p.reg_med_absgap')} WHEN 'reg_med_absgap' THEN {scaled_sql('p.gap_pct', 'q.reg_med_absgap')} ELSE {scaled_sql('p.gap_pct', 'p.reg_med_absgap')} END AS s
   FROM panel p JOIN pm USING (target) LEFT JOIN (SELECT symbol, target AS source, gap_pct, reg_med_absgap FROM panel) q USING (symbol, source), (SELECT unnest(['core', 'reg_med_absgap', 'scale']) AS grp))
  SELECT grp, rep, score, (SELECT score FROM ({weighted_score_sql(PLAIN_ROWS, 'one')})) AS base FROM ({weighted_score_sql(f'SELECT grp, rep, label, {GAP_RULE} AS pred FROM x', 'grp, rep')}))"""))
def _(m):
    groups = X.group_of_features(["gap_pct", "reg_med_absgap", "vol20"])
    return X.permutation_importance(scaled_gap_rule().predict, ml_panel(m), groups, 4, 5).withColumn("drop", r6("drop"))


@query("X3_partial_dependence", W("panel", body=f"""SELECT {R('grid')} AS grid, symbol, {R('avg(CAST(pred IN (0, 4) AS INT))')} AS pred_extreme, {R('avg(abs(s))')} AS mean_abs_signal FROM (SELECT grid, s, {GAP_RULE} AS pred, unnest(['ALL', symbol]) AS symbol FROM (
  SELECT symbol, grid, {scaled_sql('gap_pct', 'grid')} AS s FROM panel, (SELECT DISTINCT unnest(quantile_cont(reg_med_absgap, [{', '.join(repr(0.05 + 0.9 * i / 9) for i in range(10))}])) AS grid FROM panel))) GROUP BY ALL"""))
def _(m):
    x = X.pdp_ice(scaled_gap_rule().explain, ml_panel(m), "reg_med_absgap", 10)
    return x.select(*[r6(c).alias(c) for c in ("grid", "pred_extreme", "mean_abs_signal")], "symbol")


@query("X4_text_terms")
def _(m):
    p, titles = text_panel(m)
    model = text_model(m, "count_uni")
    return model.fit(p, terms=counted(titles, model)).terms(m.spark, 10)


@query("X4_term_frequency")
def _(m):
    """How many of the splits (up to the first third, the second, and all days) a term is among the strongest of."""
    p, titles = text_panel(m)
    terms = counted(titles, text_model(m, "count_uni"))
    days = p.select(F.unix_date("target").cast("double").alias("d")).distinct()
    edges = quantiles(days, [], "d", {"a": 1 / 3, "b": 2 / 3, "c": 1.0}).first()
    fitted = [text_model(m, "count_uni").fit(p.where(F.unix_date("target") <= e), terms=terms).terms(m.spark, 25) for e in edges]
    return X.term_frequency(fitted)


@query("X5_row_decomposition", W("panel", body=f"""SELECT symbol, target, {R('gap_pct')} AS signal, 1.0::DOUBLE AS factor, {R('gap_pct')} AS scaled, CASE WHEN gap_pct IS NULL THEN 2 ELSE {grade_sql('gap_pct', [c / 5.25 for c in CUTS])} END AS pred FROM panel"""))
def _(m):
    from .rules import fit_panel
    x = default_candidate(CUTS).explain(fit_panel(m))
    return x.select("symbol", "target", r6("signal").alias("signal"), "factor", r6("scaled").alias("scaled"), "pred")


IMP = "(SELECT l_linestatus || l_returnflag AS unit, l_linenumber AS grp, l_discount * l_quantity AS drop FROM lineitem)"


@query("X6_rank_stability", f"""SELECT {R('avg(c)')} AS mean_spearman, count(*) AS pairs FROM (SELECT a.unit AS u, b.unit AS v, corr(a.r, b.r) AS c FROM (SELECT unit, grp, rank() OVER (PARTITION BY unit ORDER BY avg("drop")) AS r FROM {IMP} GROUP BY 1, 2) a
  JOIN (SELECT unit, grp, rank() OVER (PARTITION BY unit ORDER BY avg("drop")) AS r FROM {IMP} GROUP BY 1, 2) b ON a.grp = b.grp AND a.unit < b.unit GROUP BY 1, 2)""")
def _(m):
    li = m.raw("lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("unit"), F.col("l_linenumber").alias("grp"), (F.col("l_discount") * F.col("l_quantity")).alias("drop"))
    return X.rank_stability(li).withColumn("mean_spearman", r6("mean_spearman"))


@query("X6_faithfulness", f"""SELECT top AS top_group, {R('(SELECT avg("drop") FROM ' + IMP + " WHERE unit LIKE 'F%' AND grp = top)")} AS top_drop,
  {R('(SELECT avg(v) FROM (SELECT grp, avg("drop") AS v FROM ' + IMP + " WHERE unit LIKE 'F%' GROUP BY 1) WHERE grp <> top)")} AS others_mean_drop
  FROM (SELECT grp AS top FROM {IMP} WHERE unit LIKE 'O%' GROUP BY 1 ORDER BY avg("drop") DESC, grp LIMIT 1)""")
def _(m):
    li = m.raw("lineitem").select("l_linestatus", F.col("l_linenumber").alias("grp"), (F.col("l_discount") * F.col("l_quantity")).alias("drop"))
    x = X.faithfulness(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"))
    return x.withColumns({"top_drop": r6("top_drop"), "others_mean_drop": r6("others_mean_drop")})
