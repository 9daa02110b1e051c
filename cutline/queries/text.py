"""2.8 scalar functions and 2.9 text vectors."""

from pyspark.sql import functions as F

from ..fixed import CASHTAG_RX, DATE_RX, EVENT_RX, TEMPLATE_RX, WEIGHT
from ..functions import scalars as C, text as X
from ..operators import textblock as T
from ..operators.forum import mentioned_symbols
from ..operators.termweights import term_weights
from ..session import cut_lineage
from ..sources.market import ALIASES, CUTS, SYMBOLS
from .aggregates import LEXQ, annotations
from .base import CKEY, CLEAN, NORM, R, W, grade_sql, query
from .joins import articles
from .scans import SCORES_SQL, scores_of

r6 = C.r6


@query("F1_return_grade", W("daily_w", body=f"SELECT symbol, date_et, {grade_sql('round(ret * 100, 1)', (-2.5, -0.6, 0.6, 2.5))} AS g FROM daily_w"))
def _(m):
    return m.daily_w.select("symbol", "date_et", C.grade(F.round(F.col("ret") * 100, 1)).alias("g"))


@query("F2_bounds_grade", W("daily_w", body=f"SELECT symbol, date_et, coalesce({grade_sql('(ret * 100)', CUTS)}, 2) AS g FROM daily_w"))
def _(m):
    return m.daily_w.select("symbol", "date_et", C.grade_or_flat(F.col("ret") * 100, CUTS).alias("g"))


@query("F3_normalised_title", f"SELECT doc_id, {NORM.replace('{0}', 'text')} AS norm FROM documents")
def _(m):
    return m.raw("documents").select("doc_id", X.norm_title("text").alias("norm"))


@query("F4_title_id", f"SELECT doc_id, md5({NORM.replace('{0}', 'text')}) AS title_id FROM documents")
def _(m):
    return m.raw("documents").select("doc_id", X.title_id("text").alias("title_id"))


@query("F5_clean_title", f"""SELECT page_id, md5({CLEAN.replace('{0}', "replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')")}) AS clean_md5 FROM pages""")
def _(m):
    return m.raw("pages").select("page_id", F.md5(X.clean_title("html")).alias("clean_md5"))


@query("F6_cluster_key", f"SELECT doc_id, md5({CKEY.replace('{0}', 'text')}) AS ckey FROM documents")
def _(m):
    return m.raw("documents").select("doc_id", X.cluster_key("text").alias("ckey"))


@query("F7_template_flag", W("news", body=f"SELECT doc_id, CAST(regexp_matches(title, '(?i){TEMPLATE_RX}') AS INT) AS is_template FROM news"))
def _(m):
    return m.news.select("doc_id", X.is_template("title").alias("is_template"))


EV = ", ".join(f"CAST(regexp_matches(lower(title), '{rx}') AS DOUBLE) AS ev_{e}" for e, rx in EVENT_RX.items())


@query("F8_event_flags", W("news", body=f"SELECT doc_id, {EV} FROM news"))
def _(m):
    return m.news.select("doc_id", *[c.alias(k) for k, c in X.event_flags("title").items()])


@query("F9_company_mentions", W("ment", body="SELECT tkey, symbol AS mentioned FROM ment"))
def _(m):
    from ..operators.calendar import assign_window
    n = assign_window(m.news, m.cal, "known_at").select(X.clean_title("title").alias("title"))
    n = T.with_mentions(n, "title", m.patterns)
    return n.select(F.md5("title").alias("tkey"), F.explode("mentioned").alias("mentioned")).distinct()


@query("F10_relevance_tier", W("arts", body="SELECT symbol, known_at, tkey, rel, n_entities::INT AS n_entities FROM arts"))
def _(m):
    return articles(m).select("symbol", "known_at", "tkey", "rel", "n_entities")


@query("F11_lexicon_scores", W("reps", "lexicon", body=f"SELECT title_id, {R('lm_net', 9)} AS lm_net, {R('lm_unc', 9)} AS lm_unc FROM ({LEXQ})"))
def _(m):
    reps = cut_lineage(T.representatives(articles(m))).groupBy("title_id").agg(F.min("title").alias("title"))
    return T.lexicon_scores(reps, m.lexicon).select("title_id", r6("lm_net", 9).alias("lm_net"), r6("lm_unc", 9).alias("lm_unc"))


@query("F11_lexicon_scores_documents", W("lexicon", body="""SELECT doc_id, CASE WHEN len(w) > 0 THEN
   round(list_sum(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(pos, w[i]) THEN
     CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], neg) THEN -1 ELSE 1 END WHEN list_contains(ngt, w[i]) THEN -1 ELSE 0 END))::DOUBLE / len(w), 9) + 0.0 END AS lm_net
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: upper(x)) AS w FROM documents),
  (SELECT list(word) FILTER (category = 'positive') AS pos, list(word) FILTER (category = 'negative') AS ngt,
   ['NO', 'NOT', 'NEVER', 'WITHOUT', 'NEITHER', 'NOR', 'NONE', 'CANNOT', 'NOBODY', 'NOTHING'] AS neg FROM lexicon)"""))
def _(m):
    d = m.raw("documents").select(F.col("doc_id").alias("title_id"), F.col("text").alias("title"))
    return T.lexicon_scores(d, m.lexicon).select(F.col("title_id").alias("doc_id"), r6("lm_net", 9).alias("lm_net"))


@query("F12_ticker_mentions", W("forum", "universe", body="SELECT f.post_id, u.symbol FROM forum f, universe u WHERE regexp_matches(concat_ws(' ', f.title, f.body), '\\b' || u.symbol || '\\b')"))
def _(m):
    return mentioned_symbols(m.forum, m.universe, ["post_id"])


VT = r"regexp_extract_all(lower({0}), '\$?[A-Za-z]+(?:[.''&-][A-Za-z]+)*|\d+(?:[.,]\d+)*%?')"


@query("F13_vector_tokens", f"SELECT doc_id, len({VT.replace('{0}', 'text')}) AS n, md5(array_to_string({VT.replace('{0}', 'text')}, ' ')) AS tokens_md5 FROM documents")
def _(m):
    t = X.vector_tokens("text")
    return m.raw("documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


NAMES = "|".join(n for ns in ALIASES.values() for n in ns)
TIDY = "trim(regexp_replace(regexp_replace({0}, '" + DATE_RX + "', '[DATE]', 'g'), '\\s+', ' ', 'g'))"
ANON = (f"regexp_replace(regexp_replace(regexp_replace(title, '{CASHTAG_RX}', '[COMPANY]', 'g'), '(?i)\\b({NAMES})(''s)?\\b', '[COMPANY]', 'g'), "
        f"'\\b({'|'.join(ALIASES)})\\b', '[COMPANY]', 'g')")


@query("F14_anonymise", W("news", body=f"SELECT doc_id, md5({TIDY.replace('{0}', ANON)}) AS anon_md5 FROM news"))
def _(m):
    from ..plans.anonymise import anonymise
    return m.news.select("doc_id", F.md5(anonymise("title", ALIASES)).alias("anon_md5"))


OWN = {s: "|".join([f"\\${s}\\b", f"\\b{s}\\b"] + [f"(?i:\\b{n}(''s)?\\b)" for n in ALIASES.get(s, [])]) for s in SYMBOLS}
OWN_ROWS = ", ".join(f"('{s}', '{p}')" for s, p in OWN.items())


@query("F14_anonymise_target", W("news", body=f"""SELECT doc_id, md5({TIDY.replace('{0}', "regexp_replace(regexp_replace(title, p, '[TARGET]', 'g'), '" + '|'.join(OWN[s] for s in ALIASES) + "', '[OTHER]', 'g')")}) AS masked_md5
  FROM news JOIN (VALUES {OWN_ROWS}) t(s, p) ON s = string_split(symbols, ',')[1]"""))
def _(m):
    from ..plans.anonymise import anonymise_target
    x = anonymise_target(m.news.withColumn("symbol", F.split("symbols", ",")[0]), "title", "symbol", SYMBOLS, ALIASES)
    return x.select("doc_id", F.md5("masked").alias("masked_md5"))


@query("F15_split_tags", W("news", body="SELECT doc_id, unnest(string_split(symbols, ',')) AS symbol FROM news"))
def _(m):
    from ..operators.events import tagged
    return tagged(m.news).select("doc_id", "symbol")


@query("F16_scalar_math", W("ev", body=f"""SELECT o_orderkey, sign(eps_reported - eps_estimate) AS sg, {R('ln(1 + eps_reported)')} AS l1, {R('exp(-eps_reported)')} AS ex,
  {R('greatest(abs(eps_reported - eps_estimate), 1, eps_estimate)')} AS mx FROM ev"""))
def _(m):
    d = F.col("eps_reported") - F.col("eps_estimate")
    return m.orders_ev.select("o_orderkey", F.signum(d).cast("int").alias("sg"), r6(F.log1p("eps_reported")).alias("l1"), r6(F.exp(-F.col("eps_reported"))).alias("ex"),
                              r6(F.greatest(F.abs(d), F.lit(1.0), F.col("eps_estimate"))).alias("mx"))


@query("F17_argmax_class", f"SELECT title_id, CASE WHEN p_pos >= p_neg AND p_pos >= p_neu THEN 'positive' WHEN p_neg >= p_neu THEN 'negative' ELSE 'neutral' END AS cls FROM ({SCORES_SQL})")
def _(m):
    return scores_of(m).select("title_id", C.argmax_label(["p_pos", "p_neg", "p_neu"], ["positive", "negative", "neutral"]).alias("cls"))


@query("F18_tone_polarity", W("news", body="SELECT doc_id, CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' ELSE 'neutral' END AS pol FROM news"))
def _(m):
    from ..plans.annotation import polarity
    return m.news.select("doc_id", polarity("tone", 1, -1).alias("pol"))


@query("F19_record_to_numbers", W("tags", body="""SELECT doc_id, symbol, CAST(sign(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS DOUBLE) + 0.0 AS sign,
  CAST(doc_id % 4 AS DOUBLE) AS severity FROM tags"""))
def _(m):
    from ..plans.annotation import NEWS_RECORD, news_annotation_sign
    x = annotations(m).withColumn("_r", F.from_json("record", NEWS_RECORD))
    return x.select("doc_id", "symbol", (news_annotation_sign("_r") + 0.0).alias("sign"), F.col("_r.severity").alias("severity"))


@query("F20_day_and_zone", "SELECT event_id, CAST(ts AS DATE) AS day, ts - INTERVAL 5 HOUR AS local_time FROM events")
def _(m):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz"))
    return m.raw("events").select("event_id", F.to_date("ts").alias("day"), local.alias("local_time"))


COST = [" + ".join(f"p{i} * {WEIGHT[i][j]}" for i in range(5)) for j in range(5)]


@query("F21_expected_penalty_label", f"""SELECT vec_id, (list_position([{', '.join(COST)}], list_min([{', '.join(COST)}])) - 1)::INT AS pred FROM (SELECT vec_id, {', '.join(f'abs(embedding[{i + 1}])::DOUBLE AS p{i}' for i in range(5))} FROM embeddings)""")
def _(m):
    p = [F.abs(F.col("embedding")[i]).cast("double") for i in range(5)]
    return m.raw("embeddings").select("vec_id", C.expected_penalty_label(p).alias("pred"))


@query("T1_article_table", W("arts", body="SELECT symbol, target, widx, known_at, source, title_id, ckey, is_template, rel, n_entities::INT AS n_entities, tone FROM arts"))
def _(m):
    return articles(m).drop("title", "tkey")


@query("T2_text_block_counts", W("clu", "grid", "arts", body=f"""SELECT symbol, target, n_clu_r1, n_first_r0, {R('ln(1 + n_clu_r0) - ln(1 + CASE WHEN count(n_clu_r0) OVER w >= 20 THEN avg(n_clu_r0) OVER w END)')} AS n_clu_r0_abn, n_src_r1,
  {R('share')} AS tmpl_share_r0, CAST(symbol IN ('S08', 'S09') AS DOUBLE) AS alias_missing FROM (SELECT g.symbol, g.target, g.widx, coalesce(r0, 0.0) AS n_clu_r0, coalesce(r1, 0.0) AS n_clu_r1, coalesce(f0, 0.0) AS n_first_r0,
   coalesce(src, 0.0) AS n_src_r1, share FROM grid g LEFT JOIN (SELECT symbol, widx, CAST(count(*) AS DOUBLE) AS r0, CAST(count(*) FILTER (rel >= 1) AS DOUBLE) AS r1, CAST(count(*) FILTER (is_first) AS DOUBLE) AS f0 FROM clu GROUP BY 1, 2) c USING (symbol, widx)
   LEFT JOIN (SELECT symbol, widx, avg(is_template) AS share FROM arts GROUP BY 1, 2) t USING (symbol, widx)
   LEFT JOIN (SELECT symbol, widx, CAST(count(DISTINCT source) AS DOUBLE) AS src FROM arts WHERE rel >= 1 AND is_template = 0 GROUP BY 1, 2) s USING (symbol, widx))
  WINDOW w AS (PARTITION BY symbol ORDER BY widx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def _(m):
    x = T.text_block(articles(m), m.cal, m.universe, m.aliases, parts=("count",))
    return x.select("symbol", "target", "n_clu_r1", "n_first_r0", r6("n_clu_r0_abn").alias("n_clu_r0_abn"), "n_src_r1", r6("tmpl_share_r0").alias("tmpl_share_r0"), "alias_missing")


# RE2 word bounds are ASCII: accented letters become a digit, a word character outside the token class
NT = "list_filter(regexp_extract_all(regexp_replace(lower(title), '[À-ɏͰ-῿]', '0', 'g'), '\\b[a-zA-Z][a-zA-Z''&-]+\\b'), lambda w: NOT list_contains(" + CKEY.split("list_contains(")[1].split(", t)")[0] + ", w))"


@query("T3_novelty", W("reps", body=f"""SELECT symbol, widx, {R('max(1 - coalesce(best, 0))', 8)} AS novelty_r1 FROM (SELECT r.symbol, r.widx, r.ckey, (SELECT max(sim) FROM sims s WHERE s.symbol = r.symbol AND s.widx = r.widx AND s.ckey = r.ckey) AS best FROM reps r) GROUP BY 1, 2""")
       .replace("\nSELECT symbol, widx, (round", f""",
tf AS (SELECT symbol, widx, ckey, w, count(*)::DOUBLE AS tf FROM (SELECT symbol, widx, ckey, unnest({NT}) AS w FROM reps) GROUP BY ALL),
nv AS (SELECT symbol, widx, ckey, w, tf / sqrt(sum(tf * tf) OVER (PARTITION BY symbol, widx, ckey)) AS x FROM tf),
sims AS (SELECT a.symbol, a.widx, a.ckey, sum(a.x * b.x) AS sim FROM nv a JOIN nv b ON a.symbol = b.symbol AND a.w = b.w AND b.widx < a.widx AND b.widx >= a.widx - 20 GROUP BY a.symbol, a.widx, a.ckey, b.widx, b.ckey)
SELECT symbol, widx, (round"""))
def _(m):
    reps = cut_lineage(T.representatives(articles(m)))
    return T.novelty(reps).select("symbol", "widx", r6("novelty_r1", 8).alias("novelty_r1"))


TOK = VT.replace("{0}", "text")
STOPX = CKEY.split("list_contains(")[1].split(", t)")[0]
NEGSQL = "['no', 'not', 'never', 'without', 'neither', 'nor', 'none', 'cannot', 'nobody', 'nothing']"
TERMS = {"count_uni": TOK, "tfidf_uni": TOK, "tfidf_df": TOK,
         "tfidf_bi": "toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])",
         "tfidf_stop": f"list_filter({TOK}, lambda t: NOT list_contains({STOPX}, t) OR list_contains({NEGSQL}, t))"}


def tfidf_sql(name, lo, hi):
    base = f"""WITH t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM (SELECT doc_id, {TERMS[name] if name == 'tfidf_bi' else 'toks'} AS toks FROM (SELECT doc_id, {TOK if name == 'tfidf_bi' else TERMS[name]} AS toks FROM documents))) GROUP BY ALL),
  d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
  w AS (SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM t JOIN d USING (term), n WHERE df >= {lo} AND df <= {hi} * n)"""
    if name == "count_uni":
        return base + f" SELECT doc_id, count(*) AS n_terms, {R('sum(tf)')} AS total FROM w GROUP BY 1"
    return base + f", z AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS x FROM w) SELECT doc_id, count(*) AS n_terms, {R('sum(x)')} AS total FROM z GROUP BY 1"


for _n, _lo, _hi in (("count_uni", 5, 1.0), ("tfidf_uni", 5, 1.0), ("tfidf_bi", 5, 1.0), ("tfidf_stop", 5, 1.0), ("tfidf_df", 20, 0.5)):
    @query(f"T4_{_n}", tfidf_sql(_n, _lo, _hi))
    def _(m, name=_n):
        w = term_weights(m.raw("documents").select("doc_id", "text"), "doc_id", "text", name)
        return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), r6(F.sum("weight")).alias("total"))


@query("T4_tfidf_char", f"""WITH p AS (SELECT doc_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) || ' ' AS w FROM documents),
  g AS (SELECT doc_id, w, length(w) AS n FROM p), t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (
   SELECT doc_id, unnest(list_transform(range(1, n - k + 2), lambda i: substr(w, CAST(i AS INT), k))) AS term FROM g, (SELECT unnest([3, 4, 5]) AS k) WHERE n >= k) GROUP BY ALL),
  d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM t JOIN d USING (term), n WHERE df >= 5),
  z AS (SELECT doc_id, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS x FROM w) SELECT doc_id, count(*) AS n_terms, {R('sum(x)')} AS total FROM z GROUP BY 1""")
def _(m):
    w = term_weights(m.raw("documents").select("doc_id", "text"), "doc_id", "text", "tfidf_char")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), r6(F.sum("weight")).alias("total"))


@query("T4_hashing", f"""WITH t AS (SELECT doc_id, b, count(*)::DOUBLE AS tf FROM (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 12) AS BIGINT) % 262144 AS b FROM (
  SELECT doc_id, unnest({TOK}) AS term FROM documents)) GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, {R('sum(tf) / sqrt(sum(tf * tf))')} AS total FROM t GROUP BY 1""")
def _(m):
    w = term_weights(m.raw("documents").select("doc_id", "text"), "doc_id", "text", "hashing")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), r6(F.sum("weight")).alias("total"))


@query("T4_lm_vocab", W("lexicon", body=f"""SELECT doc_id, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents)
  WHERE term IN (SELECT lower(word) FROM lexicon) GROUP BY ALL"""))
def _(m):
    return term_weights(m.raw("documents").select("doc_id", "text"), "doc_id", "text", "lm_vocab", vocabulary=m.lexicon)


def early_vectors(m):
    """Title vectors with the time of their article, and the vectors of the earlier half of the articles' days."""
    from ..operators.ranks import quantiles
    e = m.raw("embeddings").join(m.news.select(F.col("doc_id").alias("vec_id"), F.unix_date(F.to_date("known_at")).cast("double").alias("day")), "vec_id")
    edge = quantiles(e, [], "day", {"edge": 0.5}).first()["edge"]
    return e, e.where(F.col("day") <= edge)


@query("T5_projection_group_mean")
def _(m):
    """32 components fitted on the vectors of the earlier titles, applied to all."""
    from ..plans.vectors import fit_projection, mean_vector, project
    e, early = early_vectors(m)
    z = mean_vector(project(e, "embedding", fit_projection(early, "embedding", 32), "pc"), ["label"], "pc")
    return z.select("label", F.transform("mean", lambda v: F.round(F.abs(v), 6)).alias("abs_mean"), "n")


T5_ROWS = "(SELECT vec_id, embedding, date_diff('day', DATE '1970-01-01', CAST(known_at AS DATE))::DOUBLE AS day FROM embeddings JOIN news ON doc_id = vec_id)"


@query("T5_projection_energy", W("news", body=f"""SELECT vec_id, {R('sum((v - mu) * (v - mu))', 5)} AS energy, {R('sum((v - mu) * (v - mu))', 5)} AS rebuilt FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM {T5_ROWS})
  JOIN (SELECT pos, avg(v) AS mu FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM {T5_ROWS} WHERE day <= (SELECT quantile_cont(day, 0.5) FROM {T5_ROWS})) GROUP BY 1) USING (pos) GROUP BY 1"""))
def _(m):
    """Sign-free check of the projector: under all components a row keeps its length about the early mean; under 32 the kept part and the rest add up to it."""
    from ..plans.vectors import fit_projection, project
    e, early = early_vectors(m)
    length = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    whole, part = fit_projection(early, "embedding", 64), fit_projection(early, "embedding", 32)
    x = project(project(e, "embedding", whole, "all"), "embedding", part, "some")
    kept, rest = length(F.col("some")), length(F.slice("all", 33, 32))
    return x.select("vec_id", r6(length(F.col("all")), 5).alias("energy"), r6(kept + rest, 5).alias("rebuilt"))


@query("T6_score_features", W("news", body=f"""SELECT symbol, {R('avg(p_pos - p_neg)')} AS fb_net_r1, {R('avg(CAST(p_neg > p_pos AND p_neg >= p_neu AS INT))')} AS fb_neg_share_r1, count(*) AS fb_n_r1 FROM (
  SELECT unnest(string_split(symbols, ',')) AS symbol, doc_id FROM news) n JOIN ({SCORES_SQL}) s ON n.doc_id = s.title_id GROUP BY 1"""))
def _(m):
    from ..operators.events import tagged
    from ..plans.panel import score_features
    n = tagged(m.news.select("symbols", F.col("doc_id").alias("title_id")))
    x = score_features(n, scores_of(m), ["symbol"])
    return x.select("symbol", r6("fb_net_r1").alias("fb_net_r1"), r6("fb_neg_share_r1").alias("fb_neg_share_r1"), "fb_n_r1")
