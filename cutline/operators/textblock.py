"""Article table, company mentions, story clusters, lexicon tone and novelty."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..fixed import (COMMON_TICKERS, EVENT_RX, FIRST_LOOKBACK, LEXICON_TOKEN_RX, NEGATORS, NEWS_WINDOW,
                     NOVELTY_TOKEN_RX, RELEVANCE, STOPWORDS)
from ..functions.text import (clean_title, cluster_key, event_flags, is_template, symbol_pattern, title_id, tokens,
                              word_runs)
from ..session import cut_lineage, drop_written, local_table
from .calendar import assign_window, dense_grid
from .events import abnormal_counts, tagged
from .membership import may_be_in, word_filter


# ---- company mentions ---------------------------------------------------------
def mention_patterns(spark: SparkSession, symbols, aliases: dict) -> DataFrame:
    """(token, symbol, pattern): a title can only match the pattern if it has the token as a whole
    word, so tokens pick the candidates and the regex only verifies them. The table is made
    from the caller's dictionary on the driver, so its size is known."""
    rows = set()
    for s in sorted(set(symbols) | set(aliases)):
        pattern = symbol_pattern(s, aliases.get(s, []), COMMON_TICKERS)
        for name in [s, *aliases.get(s, [])]:
            rows.add((word_runs(name)[0].lower(), s, pattern))
    rows = sorted(rows)
    return local_table(spark, {c: [r[i] for r in rows] for i, c in enumerate(("token", "mentioned", "pattern"))})


def with_mentions(df: DataFrame, title: str, patterns: DataFrame, out: str = "mentioned") -> DataFrame:
    """Distinct companies named in the title, as a sorted array (empty for a missing title).

    Words that a filter of the patterns' tokens lets pass look their candidates up in the patterns, which travel as one scalar map; the regex
    decides. All of it happens inside the row: no text is shuffled, and copies of a title do not meet in one task."""
    who = patterns.groupBy("token").agg(F.collect_set(F.struct("mentioned", "pattern")).alias("who"))
    known = who.agg(F.map_from_entries(F.collect_list(F.struct("token", "who")))).scalar()
    x = df.withColumns({"_held": word_filter(patterns, "token"), "_known": known})
    some = F.array_distinct(F.filter(tokens(F.lower(title), r"(?U)\w+"), lambda w: may_be_in(w, F.col("_held"))))
    met = F.flatten(F.filter(F.transform(some, lambda w: F.try_element_at("_known", w)), lambda e: e.isNotNull()))
    hits = F.filter(met, lambda e: F.rlike(F.col(title), e["pattern"]))
    names = F.array_sort(F.array_distinct(F.transform(hits, lambda e: e["mentioned"])))
    return x.withColumn(out, F.coalesce(names, F.array().cast("array<string>"))).drop("_held", "_known")


def with_article_text(news: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds what an article's title alone decides: its cleaned form, ids, template flag and the companies it names."""
    n = news.withColumn("title", clean_title("title"))
    keep = [c for c in ("known_at", "target", "widx") if c in n.columns]
    n = n.select(*keep, "symbols", "source", "title", "tone", F.md5("title").alias("tkey"),
                 title_id("title").alias("title_id"), cluster_key("title").alias("ckey"),
                 is_template("title").alias("is_template"))
    return with_mentions(n, "title", patterns)


def tagged_articles(n: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per (article, tagged symbol) from articles with their text columns and windows, with relevance: rel 0 only tagged, 1 own
    company in the title, 2 the only company in it."""
    n = tagged(n, universe, carry=("is_template",)).drop("symbols")
    own, count = F.array_contains("mentioned", F.col("symbol")), F.size("mentioned")
    return n.withColumns({"rel": F.when(~own, 0).when(count <= 1, 2).otherwise(1),
                          "n_entities": F.when(own, count).otherwise(0)}).drop("mentioned")


def article_table(news: DataFrame, cal: DataFrame, universe: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per (article, tagged symbol) with ids, template flag and relevance. Text work is done once per article, before the
    tags are exploded."""
    return tagged_articles(with_article_text(assign_window(news, cal, "known_at"), patterns), universe)


# ---- lexicon tone ---------------------------------------------------------------
def lexicon_scores(titles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(title_id, lm_net, lm_unc), one row per title_id. Only words that a filter of the lexicon lets pass become rows. A positive word within three words after a negator counts as
    negative; a title without words scores NULL."""
    words = F.transform(tokens("title", LEXICON_TOKEN_RX), F.upper)
    neg = F.array(*[F.lit(v.upper()) for v in NEGATORS])
    t = titles.select("title_id", words.alias("_w")).withColumn("n_words", F.size("_w"))
    placed = F.transform("_w", lambda x, i: F.struct(x.alias("word"), i.alias("i")))
    some = F.filter(placed, lambda e: may_be_in(e["word"], F.col("_held")))
    pos = F.transform(some, lambda e: F.struct(
        e["word"].alias("word"), F.arrays_overlap(F.slice("_w", F.greatest(e["i"] - 2, F.lit(1)), F.least(e["i"], F.lit(3))), neg)
        .alias("negated")))
    flags = (lexicon.groupBy("word").agg(*[F.max((F.col("category") == c).cast("int")).alias(c)
                                           for c in ("positive", "negative", "uncertainty")]))
    one = F.when(F.col("positive") == 1, F.when(F.col("negated"), -1).otherwise(1)).when(F.col("negative") == 1, -1).otherwise(0)
    # the text is cut into words once: a title without a word of the lexicon stays as one row
    rows = t.withColumn("_held", word_filter(lexicon, "word")).select("title_id", "n_words", F.explode_outer(pos).alias("t")).select("title_id", "n_words", "t.*")
    return rows.join(flags, "word", "left").groupBy("title_id").agg(
        F.try_divide(F.coalesce(F.sum(one), F.lit(0)).cast("double"), F.max("n_words")).alias("lm_net"),
        F.try_divide(F.coalesce(F.sum("uncertainty"), F.lit(0)).cast("double"), F.max("n_words")).alias("lm_unc"))


# ---- story clusters ---------------------------------------------------------------
def clusters(articles: DataFrame, lookback: int = FIRST_LOOKBACK) -> DataFrame:
    """Non-template stories per (symbol, window) with top relevance and first-seen flag.

    Only the nearest earlier window decides whether a story is new, so a lag over the story's
    own windows replaces the interval self-join."""
    c = (articles.where(F.col("is_template") == 0).groupBy("symbol", "widx", "ckey")
         .agg(F.max("rel").alias("rel"), F.count(F.lit(1)).alias("copies")))
    prev = F.lag("widx").over(W.partitionBy("symbol", "ckey").orderBy("widx"))
    return c.withColumn("is_first", prev.isNull() | (F.col("widx") - prev > lookback))


def cluster_counts(clu: DataFrame) -> DataFrame:
    aggs = []
    for i, r in enumerate(RELEVANCE):
        at = F.col("rel") >= i
        aggs += [F.count_if(at).cast("double").alias(f"n_clu_{r}"),
                 F.count_if(at & F.col("is_first")).cast("double").alias(f"n_first_{r}")]
    return clu.groupBy("symbol", "widx").agg(*aggs)


def representatives(articles: DataFrame) -> DataFrame:
    """First article (known_at, title_id, title) of each story naming the company, with mean tone."""
    return (articles.where((F.col("is_template") == 0) & (F.col("rel") >= 1))
            .groupBy("symbol", "target", "widx", "ckey")
            .agg(F.min_by(F.struct("title", "known_at", "title_id"), F.struct("known_at", "title_id", "title")).alias("_f"),
                 F.avg("tone").alias("tone"))
            .select("symbol", "target", "widx", "ckey", "_f.*", "tone"))


def joined_titles(reps: DataFrame) -> DataFrame:
    """Titles in (known_at, ckey) order joined by `` || ``. The cell is the group's whole text;
    jobs over many titles should use ``representatives`` rows instead."""
    rows = F.sort_array(F.collect_list(F.struct("known_at", "ckey", "title")))
    return reps.groupBy("symbol", "widx").agg(
        F.array_join(F.transform(rows, lambda r: r["title"]), " || ").alias("titles_r1"))


def representative_features(reps: DataFrame, scores: DataFrame | None) -> DataFrame:
    r = reps.withColumns(event_flags("title")).drop("title")
    if scores is None:
        r = r.withColumns({"lm_net": F.lit(None).cast("double"), "lm_unc": F.lit(None).cast("double")})
    else:
        r = r.join(scores, "title_id", "left")
    return r.groupBy("symbol", "widx").agg(
        F.avg("tone").alias("tone_mean_r1"), F.avg((F.col("tone") < 0).cast("double")).alias("tone_neg_share_r1"),
        F.stddev_samp("tone").alias("tone_sd_r1"), F.avg("lm_net").alias("lm_net_r1"),
        F.avg((F.col("lm_net") < 0).cast("double")).alias("lm_neg_share_r1"), F.avg("lm_unc").alias("lm_unc_r1"),
        F.count(F.lit(1)).cast("double").alias("n_scored_r1"),
        *[F.max(f"ev_{e}").alias(f"ev_{e}_r1") for e in EVENT_RX])


# ---- novelty ------------------------------------------------------------------------
BLOCK_TITLES = 1024
PROBES = 4  # titles of a symbol and window that meet all of their past before the others
VOCAB_SLICE = 2048


def _block_best(window):
    """Best cosine of every title of one block against the earlier titles of another block."""
    def flat(frame, p):
        ids = [np.asarray(v, "int64") for v in frame[p + "words"]]
        row = np.repeat(np.arange(len(ids)), [len(v) for v in ids])
        val = np.concatenate([np.asarray(v, float) for v in frame[p + "weights"]])
        return row, np.concatenate(ids), val

    def dense(row, ids, val, n, part):
        pos = np.minimum(np.searchsorted(part, ids), len(part) - 1)
        hit = part[pos] == ids
        m = np.zeros((n, len(part)))
        m[row[hit], pos[hit]] = val[hit]
        return m

    def best(today, past):
        out = today[["symbol", "widx", "ckey"]].assign(best=pd.Series(dtype="float64"))
        if today.empty or past.empty:
            return out.iloc[:0]
        gap = today["widx"].to_numpy()[:, None] - past["p_widx"].to_numpy()[None, :]
        earlier = (gap >= 1) & (gap <= window)
        if not earlier.any():
            return out.iloc[:0]
        (tr, ti, tv), (pr, pi, pv) = flat(today, ""), flat(past, "p_")
        shared = np.intersect1d(ti, pi)
        sim = np.zeros((len(today), len(past)))
        for lo in range(0, len(shared), VOCAB_SLICE):
            part = shared[lo:lo + VOCAB_SLICE]
            sim += dense(tr, ti, tv, len(today), part) @ dense(pr, pi, pv, len(past), part).T
        out["best"] = np.where(earlier, sim, -1.0).max(axis=1)
        return out[earlier.any(axis=1)]

    return best


def title_words(c):
    """Word multiset of a title, sorted: equal arrays mean equal vectors."""
    return F.sort_array(F.filter(tokens(F.lower(c), NOVELTY_TOKEN_RX), lambda w: ~w.isin(*STOPWORDS)))


@F.pandas_udf(T.StructType([T.StructField("words", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))
def _unit_counts(ids: pd.Series) -> pd.DataFrame:
    """Distinct ids of each row and their counts, scaled to length 1."""
    found = [np.unique(np.asarray(v, "int64"), return_counts=True) for v in ids]
    return pd.DataFrame({"words": [w for w, _ in found], "weights": [n / np.sqrt(max((n * n).sum(), 1)) for _, n in found]})


def title_vectors(reps: DataFrame) -> DataFrame:
    """Adds the unit-length term-count vector of each title as parallel arrays (64-bit term id, weight), made inside the row."""
    return reps.withColumn("_v", _unit_counts(F.transform(title_words("title"), lambda w: F.xxhash64(w)))).select("*", "_v.*").drop("_v")


def best_past(asked: DataFrame, past: DataFrame, window: int, block_titles: int) -> DataFrame:
    """(symbol, widx, ckey, best): best cosine of each asked title against those of ``past`` that one of the previous ``window`` windows
    of its symbol has; titles that meet none are left out.

    Titles meet by time chunks (``_g``): the past of a chunk lies in that chunk and the one before. Inside a chunk both sides are spread
    over blocks of about ``block_titles``; a pair of blocks is one task-sized matrix product that returns one best value per title.
    """
    both = F.explode(F.array(F.col("_g"), F.col("_g") + 1)).alias("_g")
    blocks = lambda c: F.ceil(F.col(c) / block_titles).cast("int")
    new = asked.groupBy("symbol", "_g").agg(F.count(F.lit(1)).alias("_new"))
    spans = past.select("symbol", both).groupBy("symbol", "_g").agg(F.count(F.lit(1)).alias("_past"))
    cells = new.join(spans, ["symbol", "_g"]).select("symbol", "_g", blocks("_new").alias("_nb"), blocks("_past").alias("_npb"))
    block_of = lambda n: F.pmod(F.xxhash64("ckey", "widx"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["symbol", "_g", "_b", "_pb"]
    today = (asked.join(cells, ["symbol", "_g"])
             .select("symbol", "_g", block_of("_nb").alias("_b"), each("_npb").alias("_pb"), "widx", "ckey", "words", "weights"))
    earlier = (past.select("symbol", both, "widx", "ckey", "words", "weights").join(cells, ["symbol", "_g"])
               .select("symbol", "_g", each("_nb").alias("_b"), block_of("_npb").alias("_pb"), "widx", "words", "weights")
               .toDF(*[f"p{c}" for c in cell], "p_widx", "p_words", "p_weights"))
    return (today.groupBy(*cell).cogroup(earlier.groupBy(*[f"p{c}" for c in cell]))
            .applyInPandas(_block_best(window), "symbol string, widx int, ckey string, best double")
            .groupBy("symbol", "widx", "ckey").agg(F.max("best").alias("best")))


def open_titles(least: DataFrame, found: DataFrame) -> DataFrame:
    """The titles whose best cosine may still be below that of every settled title of their group. ``least`` (symbol, widx, ckey, low) bounds
    it from below, ``found`` holds the settled ones (symbol, widx, ckey, best)."""
    top = found.groupBy("symbol", "widx").agg(F.min("best").alias("top"))
    return least.join(top, ["symbol", "widx"]).where(F.col("low") < F.col("top")).join(found, ["symbol", "widx", "ckey"], "left_anti").select("symbol", "widx", "ckey")


def novelty(reps: DataFrame, window: int = NEWS_WINDOW, block_titles: int = BLOCK_TITLES, targets=None) -> DataFrame:
    """(symbol, widx, novelty_r1): max over today's titles of 1 - best cosine with the same symbol's
    titles of the previous ``window`` windows; 1 when there are none.

    A word multiset already printed in the span has similarity 1 and is settled by a window frame. Of the rest only the title with the
    smallest best cosine decides, so not every title has to meet the whole past: first each meets a sample of it, which bounds its best
    cosine from below; then the titles with the lowest bounds of every (symbol, window) meet all of their past; last do those
    whose bound lies below the best so found, and only they. The result is exact whatever the sample; each title travels a few times.

    Of ``targets`` only: their titles are asked, and the past is that of their windows.
    """
    keys = ["symbol", "widx", "ckey"]
    wanted = F.lit(True) if targets is None else F.col("target").isin(*targets)
    if targets is not None:
        first = reps.where(wanted).agg(F.min("widx").alias("first")).scalar()
        reps = reps.where(F.col("widx") >= first - window)
    reps = reps.select(*keys, "title", wanted.alias("_asked"), F.md5(F.array_join(title_words("title"), " ")).alias("vkey"))
    empty = F.md5(F.lit(""))
    prev = F.max("widx").over(W.partitionBy("symbol", "vkey").orderBy("widx").rangeBetween(-window, -1))
    r = (reps.withColumn("_g", F.floor(F.col("widx") / window).cast("int"))
         .withColumn("_seen", prev.isNotNull() & (F.col("vkey") != empty)))
    # titles travel to the window, not their wider vectors; these feed every round and are written once instead of being rebuilt
    docs = cut_lineage(title_vectors(r).drop("title", "vkey"))
    new = docs.where(~F.col("_seen") & F.col("_asked"))
    size = docs.groupBy("symbol", "_g").agg(F.count(F.lit(1)).alias("_all"))
    drawn = F.pmod(F.xxhash64("ckey", "widx", F.lit("first")), F.col("_all")) < max(1, block_titles * 3 // 8)
    low = best_past(new, docs.join(size, ["symbol", "_g"]).where(drawn), window, block_titles).withColumnRenamed("best", "low")
    low = cut_lineage(new.select(*keys).join(low, keys, "left").select(*keys, F.coalesce("low", F.lit(0.0)).alias("low")))
    lowest = (low.groupBy("symbol", "widx", F.pmod(F.xxhash64("ckey"), F.lit(PROBES)).alias("_p")).agg(F.min(F.struct("low", "ckey")).alias("_f"))
              .select("symbol", "widx", "_f.ckey"))

    rounds = []

    def settled(some):
        some = cut_lineage(some)
        best = best_past(new.join(some, keys, "left_semi"), docs, window, block_titles)
        rounds.extend([some, cut_lineage(some.join(best, keys, "left").select(*keys, F.coalesce("best", F.lit(0.0)).alias("best")))])
        return rounds[-1]

    found = settled(lowest)
    found = found.unionByName(settled(open_titles(low, found)))
    # a title left open by none is no better than a settled one of its group, so its bound may stand for it
    x = docs.where("_asked").select(*keys, "_seen").join(low, keys, "left").join(found, keys, "left")
    sim = F.when(F.col("_seen"), 1.0).otherwise(F.coalesce("best", "low"))
    out = cut_lineage(x.groupBy("symbol", "widx").agg(F.max(1 - sim).alias("novelty_r1")))
    drop_written(docs, low, *rounds)
    return out


# ---- the whole block -------------------------------------------------------------------
def text_block(articles: DataFrame, cal: DataFrame, universe: DataFrame, aliased: DataFrame,
               lexicon: DataFrame | None = None, parts=("count", "tone", "novelty", "titles"), targets=None) -> DataFrame:
    """Dense text features per (symbol, window). ``parts`` leaves out unneeded jobs; counts are 0 and
    tones NULL where no article exists. With ``targets`` only rows of these days are returned, and texts of other days are read
    only where those look back at them."""
    keys = ["symbol", "widx"]
    asked = lambda x: x if targets is None else x.where(F.col("target").isin(*targets))
    # titles are read for the stories alone; of some days only where these look
    told = articles = cut_lineage(articles) if targets is None else articles
    if targets is not None:
        told = asked(articles)
        if "novelty" in parts:
            first = cal.where(F.col("target").isin(*targets)).agg(F.min("widx").alias("first")).scalar()
            told = articles.where(F.col("widx") >= first - NEWS_WINDOW)
        articles = cut_lineage(articles.select(*keys, "ckey", "source", "is_template", "rel"))
    out = dense_grid(universe, "symbol", cal)
    if "count" in parts:
        cc = cluster_counts(clusters(articles))
        cols = [f"n_{k}_{r}" for r in RELEVANCE for k in ("clu", "first")]
        out = abnormal_counts(out.join(cc, keys, "left").fillna(0.0, cols), cols)
        share = articles.groupBy(*keys).agg(F.avg("is_template").alias("tmpl_share_r0"))
        src = (articles.where((F.col("is_template") == 0) & (F.col("rel") >= 1)).groupBy(*keys)
               .agg(F.count_distinct("source").cast("double").alias("n_src_r1")))
        out = out.join(share, keys, "left").join(src, keys, "left").fillna(0.0, ["n_src_r1"])
    out = asked(out)
    if set(parts) - {"count"}:
        # the stories' titles meet once; every part below reads them from there
        past = cut_lineage(representatives(told))
        reps = asked(past)
    if "tone" in parts:
        scores = None
        if lexicon is not None:
            scores = lexicon_scores(reps.groupBy("title_id").agg(F.min("title").alias("title")), lexicon)
        out = out.join(representative_features(reps, scores), keys, "left").fillna(0.0, ["n_scored_r1"])
        out = out.withColumn("ev_any_r1", F.greatest(*[F.col(f"ev_{e}_r1") for e in EVENT_RX]))
    if "novelty" in parts:
        out = out.join(novelty(past, targets=targets), keys, "left")
    if "titles" in parts:
        out = out.join(joined_titles(reps), keys, "left").fillna("", ["titles_r1"])
    has = aliased.select("symbol", F.lit(0.0).alias("alias_missing")).distinct()
    return out.join(has, "symbol", "left").fillna(1.0, ["alias_missing"]).drop("widx")
