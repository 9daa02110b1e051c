"""Text operators on hand-written titles, novelty against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.functions import text as X
from cutline.operators import textblock as T
from cutline.operators.calendar import trading_calendar
from cutline.operators.forum import mentioned_symbols
from cutline.operators.termweights import term_weights
from cutline.plans.anonymise import anonymise, anonymise_target
from cutline.sources import tables as S


def titles(spark, *ts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id int, title string")


def col(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_clean_and_norm(spark):
    df = titles(spark, "AT&amp;T beats - Some Source", "A | B | Wire", "no suffix here", None)
    assert col(df, X.clean_title("title")) == ["AT&T beats", "A | B", "no suffix here", ""]
    assert col(df, X.norm_title("title"))[0] == "at amp t beats some source"


def test_cluster_key_ignores_order_and_punctuation(spark):
    k = col(titles(spark, "Acme lifts profit outlook", "Outlook: profit lifts, ACME!", "Acme cuts outlook"), X.cluster_key("title"))
    assert k[0] == k[1] != k[2]


def test_template_and_events(spark):
    df = titles(spark, "Fund trims stake in Acme", "Insider selling at Acme", "Acme wins FDA approval", "CEO steps down after lawsuit", None)
    assert col(df, X.is_template("title")) == [1, 1, 0, 0, 0]
    f = X.event_flags("title")
    assert col(df, f["ev_prod"])[2] == 1.0 and col(df, f["ev_mgmt"])[3] == 1.0 and col(df, f["ev_legal"])[3] == 1.0


ALIAS = {"ABC": ["Acme", "Acme Holdings"], "XY": ["Xylo"], "NOW": ["Service Now"]}


def test_mentions_need_whole_names(spark):
    pats = T.mention_patterns(spark, ["ABC", "XY", "NOW", "QQQ"], ALIAS)
    df = titles(spark, "ABC rises", "abc rises", "$XY and XY", "ACME's profit", "Acmes profit", "NOW is the time", "$NOW up", "Xylo buys Acme Holdings; QQQ", "ÉABC")
    got = [sorted(v) for v in col(T.with_mentions(df, "title", pats), "mentioned")]
    assert got == [["ABC"], [], ["XY"], ["ABC"], [], [], ["NOW"], ["ABC", "QQQ", "XY"], []]


def test_relevance_tiers(spark):
    t = dt.datetime(2024, 1, 3, 12)
    rows = [(t, "ABC,XY", "s", "Acme up", 1.0), (t, "ABC,XY", "s", "Acme and Xylo", 1.0), (t, "ABC", "s", "nothing", 1.0)]
    news = spark.createDataFrame(rows, "known_at timestamp_ntz, symbols string, source string, title string, tone double")
    cal = trading_calendar(spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 4)], "date_et date"))
    uni = spark.createDataFrame([("ABC",), ("XY",)], "symbol string")
    a = T.article_table(news, cal, uni, T.mention_patterns(spark, ["ABC", "XY"], ALIAS))
    got = {(r["title"], r["symbol"]): (r["rel"], r["n_entities"]) for r in a.collect()}
    assert got == {("Acme up", "ABC"): (2, 1), ("Acme up", "XY"): (0, 0), ("Acme and Xylo", "ABC"): (1, 2), ("Acme and Xylo", "XY"): (1, 2), ("nothing", "ABC"): (0, 0)}


def test_lexicon_negation_window(spark):
    lex = spark.createDataFrame([("positive", "GOOD"), ("negative", "BAD"), ("uncertainty", "MAYBE")], "category string, word string")
    df = titles(spark, "good news", "not a very good day", "not a b c good", "bad maybe", "123 ...").withColumnRenamed("id", "title_id")
    got = {r["title_id"]: (r["lm_net"], r["lm_unc"]) for r in T.lexicon_scores(df, lex).collect()}
    assert got[0] == (0.5, 0.0) and got[1][0] == pytest.approx(-0.2) and got[2][0] == pytest.approx(0.2)
    assert got[3] == (-0.5, 0.5) and got[4] == (None, None)


def test_first_seen_looks_back_five_windows(spark):
    rows = [("A", w, "k", 1, 0) for w in (0, 5, 11)]
    a = spark.createDataFrame(rows, "symbol string, widx int, ckey string, rel int, is_template int")
    assert {r["widx"]: r["is_first"] for r in T.clusters(a).collect()} == {0: True, 5: False, 11: True}


@pytest.mark.parametrize("block", [2, 3, 128])
def test_novelty_matches_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vocab = [f"w{c}" for c in "abcdefghij"]
    rows = [("A" if rng.random() < 0.8 else "B", int(rng.integers(0, 45)), f"k{i}", " ".join(rng.choice(vocab, int(rng.integers(1, 6))))) for i in range(90)]
    rows += [("A", 44, "kx", "the of 12"), ("A", 43, "ky", "the of")]
    df = spark.createDataFrame(rows, "symbol string, widx int, ckey string, title string")

    def vec(t):
        words = [w for w in t.split() if w[0].isalpha() and w not in ("the", "of")]
        v = {w: words.count(w) for w in words}
        n = np.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / n for w, x in v.items()}

    want = {}
    for s, w, _, t in rows:
        past = [vec(u) for s2, w2, _, u in rows if s2 == s and w - 20 <= w2 < w]
        v = vec(t)
        best = max((sum(x * p.get(k, 0) for k, x in v.items()) for p in past), default=0.0)
        want[(s, w)] = max(want.get((s, w), -9), 1 - best)
    got = {(r["symbol"], r["widx"]): r["novelty_r1"] for r in T.novelty(df, block_titles=block).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_ticker_mentions(spark):
    uni = spark.createDataFrame([("AAPL",), ("BRK-B",), ("GE",), ("NOW",)], "symbol string")
    posts = spark.createDataFrame([(1, "$brk.b and AAPL AAPL"), (2, "GE NOW"), (3, "$GE $NOW"), (4, "aapl")], "post_id int, body string")
    got = {}
    for r in mentioned_symbols(posts, uni, ["post_id"]).collect():
        got.setdefault(r["post_id"], set()).add(r["symbol"])
    assert got == {1: {"BRK-B", "AAPL"}, 3: {"GE", "NOW"}}


def test_numbers_not_in_prompt(spark):
    df = spark.createDataFrame([("gap 1.5% k 1,000", "1.5 and +1000 but 7%"), ("none", "3")], "p string, t string")
    assert [r["new"] for r in X.numbers_not_in(df, "p", "t", "new").collect()] == [["7%"], ["3"]]


def test_anonymise(spark):
    df = titles(spark, "Acme Holdings and ABC fell in March 2024, says $TSLA", "Xylo vs Acme's")
    assert col(df, anonymise("title", ALIAS)) == ["[COMPANY] and [COMPANY] fell in [DATE], says [COMPANY]", "[COMPANY] vs [COMPANY]"]
    m = anonymise_target(df.withColumn("symbol", F.lit("ABC")), "title", "symbol", ["ABC", "XY"], ALIAS)
    assert col(m, "masked")[1] == "[OTHER] vs [TARGET]"


def test_char_ngrams_inside_words(spark):
    got = col(titles(spark, "ab c"), X.char_ngrams("title"))[0]
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])


def test_tfidf_rows_have_unit_length(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3} not the") for i in range(9)], "id int, text string")
    for name in ("tfidf_uni", "tfidf_bi", "tfidf_char", "tfidf_stop", "hashing"):
        w = term_weights(docs, "id", "text", name, min_df=1)
        assert all(abs(r["n"] - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())
    assert "not" in {r["term"] for r in term_weights(docs, "id", "text", "tfidf_stop", min_df=1).collect()}
    assert {r["term"] for r in term_weights(docs, "id", "text", "count_uni", min_df=4).collect()} == {"alpha", "beta", "not", "the", "w"}


def test_resource_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_note": ["x"], "ABC": ["Acme"]}')
    assert [tuple(r) for r in S.alias_json(spark, str(tmp_path / "a.json")).collect()] == [("ABC", "Acme")]
    (tmp_path / "l.csv").write_text("Word,Positive,NEGATIVE\ngood,2009,0\nbad,0,2010\n")
    assert sorted(tuple(r) for r in S.lexicon_csv(spark, str(tmp_path / "l.csv")).collect()) == [("negative", "BAD"), ("positive", "GOOD")]
    (tmp_path / "s.json").write_text('{"x": ["A"], "y": ["B", "A"]}')
    assert sorted(r[0] for r in S.universe(spark, None, json_path=str(tmp_path / "s.json")).collect()) == ["A", "B"]


def test_unicode_spaces_are_cleaned(spark):
    rows = titles(spark, "Profit\u00a0up\u00a0", "\u2003Profit up&nbsp;", "plain").withColumn("c", X.clean_title("title")).orderBy("id").collect()
    assert [r.c for r in rows] == ["Profit\u00a0up", "Profit up", "plain"]


def test_post_titles_name_tickers(spark):
    posts = spark.createDataFrame([(1, "Is $AAPL cheap", "no idea"), (2, None, "buy $MSFT"), (3, "daily talk", "")], "post_id int, title string, body string")
    universe = spark.createDataFrame([("AAPL",), ("MSFT",)], "symbol string")
    assert {(r.post_id, r.symbol) for r in mentioned_symbols(posts, universe, ["post_id"]).collect()} == {(1, "AAPL"), (2, "MSFT")}


@pytest.mark.parametrize("name", ["tfidf_uni", "tfidf_bi", "tfidf_stop", "count_uni", "tfidf_char", "lm_vocab"])
def test_text_model_uses_the_table_s_weights(spark, name):
    from pyspark.ml.functions import vector_to_array

    from cutline.plans.signals import BigMoveModel
    texts = ["profit profit falls the market", "market rises", "the profit of the market rises rises rises", "falls not falls", ""] * 3
    rows = spark.createDataFrame([(i, t, i % 5) for i, t in enumerate(texts)], "id int, titles_r1 string, label int")
    words = ["profit", "falls"]
    model = BigMoveModel("text", min_df=2, max_iter=3, vectorizer=name, vocabulary=words).fit(rows)
    x = model._features(model._text(rows).where("_tok IS NOT NULL")).select("id", vector_to_array("features").alias("v")).collect()
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(r.id, r.term): r.weight for r in term_weights(rows.where("titles_r1 <> ''"), "id", "titles_r1", name, 2, 1.0, vocabulary).collect()}
    got = {(r.id, model.inputs[0].vocabulary[k]): w for r in x for k, w in enumerate(r.v) if w}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_unknown_vectorisers_are_rejected():
    from cutline.plans.signals import BigMoveModel
    for bad in ("nonsense", "lm_vocab"):
        with pytest.raises(ValueError):
            BigMoveModel("text", vectorizer=bad)


def test_mentions_of_missing_and_repeated_titles(spark):
    from cutline.operators.textblock import mention_patterns, with_mentions
    rows = [(1, "Acme buys $BB today"), (2, None), (3, ""), (4, "Acme buys $BB today"), (5, "acmed nothing"), (6, "ACME's gain")]
    got = {r["id"]: r["mentioned"] for r in with_mentions(spark.createDataFrame(rows, "id int, title string"), "title",
                                                          mention_patterns(spark, ["AAX", "BB"], {"AAX": ["Acme"]})).collect()}
    assert got == {1: ["AAX", "BB"], 2: [], 3: [], 4: ["AAX", "BB"], 5: [], 6: ["AAX"]}


def test_wanted_symbols_meet_comma_joined_tags(spark):
    from cutline.sources.tables import symbol_filter
    news = spark.createDataFrame([(1, "A,BB"), (2, "B"), (3, None), (4, "BB"), (5, "A,BB")], "id int, symbols string")
    want = spark.createDataFrame([("BB",), ("BB",)], "symbol string")
    out = symbol_filter(news, want)
    assert sorted(r["id"] for r in out.collect()) == [1, 4, 5] and out.columns == ["id", "symbols"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_their_text_lies(spark):
    import re
    from cutline.operators.termweights import term_weights
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three")], "id int, text string")
    for name in ("tfidf_bi", "tfidf_char"):
        assert not re.search(r"hashpartitioning\(id#\d+, (term|_w)#", _plan(term_weights(docs, "id", "text", name, min_df=1)))


def test_mentions_are_found_inside_the_row(spark):
    from cutline.operators.textblock import mention_patterns, with_mentions
    x = with_mentions(spark.createDataFrame([("Acme",)], "title string"), "title", mention_patterns(spark, ["BB"], {"BB": ["Acme"]}))
    assert "Join" not in _plan(x) and x.first()["mentioned"] == ["BB"]


def test_title_vectors_are_made_inside_the_row(spark):
    from cutline.operators.textblock import title_vectors
    x = title_vectors(spark.createDataFrame([(1, "Gain gain loss"), (2, "")], "id int, title string"))
    assert "Exchange" not in _plan(x)
    got = {r["id"]: sorted(r["weights"]) for r in x.collect()}
    assert got[2] == [] and all(abs(a - b) < 1e-12 for a, b in zip(got[1], [1 / 5 ** 0.5, 2 / 5 ** 0.5]))


def test_few_titles_meet_their_whole_past(spark, monkeypatch):
    rng = np.random.default_rng(5)
    common, rare = [f"w{c}" for c in "abcdef"], [f"v{c}" for c in "abcdefgh"]
    rows = [("A", w, f"k{w}-{i}", " ".join(rng.choice(common, 40))) for w in range(4) for i in range(150)]
    rows += [("A", w, f"odd{w}", f"{rare[w]} {rare[w + 1]}") for w in range(4)]
    asked = []
    whole = T.best_past

    def counted(some, past, window, block):
        asked.append((some.count(), past.count()))
        return whole(some, past, window, block)

    monkeypatch.setattr(T, "best_past", counted)
    got = {r["widx"]: r["novelty_r1"] for r in T.novelty(spark.createDataFrame(rows, "symbol string, widx int, ckey string, title string"), block_titles=64).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.5, 2: 0.5, 3: 0.5})
    assert all(min(pair) <= len(rows) // 4 for pair in asked)  # all titles meet a sample, few meet all


def test_open_titles_are_those_that_may_decide(spark):
    low = spark.createDataFrame([("A", 1, "a", 0.2), ("A", 1, "b", 0.4), ("A", 1, "c", 0.6), ("A", 2, "d", 0.0)], "symbol string, widx int, ckey string, low double")
    found = spark.createDataFrame([("A", 1, "a", 0.5), ("A", 2, "d", 0.0)], "symbol string, widx int, ckey string, best double")
    assert [r["ckey"] for r in T.open_titles(low, found).collect()] == ["b"]


def test_template_filters_do_not_redo_the_titles(spark):
    t = dt.datetime(2024, 1, 3, 12)
    news = spark.createDataFrame([(t, "ABC", "s", "Acme &amp; Co up", 1.0), (t, "ABC", "s", "Fund trims stake in Acme", 1.0)], "known_at timestamp_ntz, symbols string, source string, title string, tone double")
    cal = trading_calendar(spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 4)], "date_et date"))
    a = T.article_table(news, cal, spark.createDataFrame([("ABC",)], "symbol string"), T.mention_patterns(spark, ["ABC"], ALIAS))
    reps = T.representatives(a)
    assert _plan(reps).count("ArrowEvalPython") == _plan(a).count("ArrowEvalPython")
    assert [r["title"] for r in reps.collect()] == ["Acme & Co up"]


def test_template_words_leave_no_match_out(spark):
    yes = ["10 SHARES sold by", "shares in X bought by", "raises its holdings", "Holding cut", "has $5 million", "invests $2.5 billion in", "Stock Position", "takes position in",
           "buys 1,000 shares", "sells $5 in stock", "INSIDER buying", "short interest", "stocks to watch", "watchlist", "po\u017fition in", "po\u017fItIon raised", "pos\u0130tion cut", "\u017ftake trimmed", "pos\u0131tion cut", "stoc\u212a position"]
    df = titles(spark, *yes, "holds nothing", "share", "", None)
    want = col(df, F.coalesce(F.col("title").rlike("(?iU)" + X.TEMPLATE_RX), F.lit(False)).cast("int"))
    assert col(df, X.is_template("title")) == want and sum(want) == len(yes)


def test_carried_columns_are_made_once(spark):
    from cutline.operators.events import tagged
    n = spark.createDataFrame([(1, "A,B", "x"), (2, None, "yx"), (3, "A", None)], "id int, symbols string, title string")
    x = tagged(n.withColumn("flag", F.regexp_replace("title", "y+", "z")), carry=("flag",)).where("flag = 'x'")
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert sorted((r["id"], r["symbol"]) for r in x.collect()) == [(1, "A"), (1, "B")]
    assert sorted((r["id"], r["symbol"]) for r in tagged(n, carry=("title",)).collect()) == [(1, "A"), (1, "B"), (2, ""), (3, "A")]


def test_titles_are_masked_once(spark, tmp_path):
    from cutline.queries.composites import annotation_signs
    from cutline.sources.market import Market
    for table, rows in (("documents", "SELECT 1L AS doc_id, 'x' AS text, 'en' AS lang, 's' AS source, 1L AS n_chars"),
                        ("events", "SELECT 1L AS event_id, 1L AS user_id, TIMESTAMP_NTZ '2024-01-02 10:00:00' AS ts, 1.0D AS value")):
        spark.sql(rows).write.parquet(str(tmp_path / f"{table}.parquet"))
    raw, anon = (x._jdf.queryExecution().optimizedPlan().toString().count("(?iU)") for x in annotation_signs(Market(spark, str(tmp_path))))
    assert (raw, anon) == (0, 1)


TITLES = [("A", 1, "k1", "Profit falls. Market rises"), ("A", 2, "k2", "!!"), ("A", 2, "k3", "profit not the market"), ("B", 1, "k4", ""), ("C", 1, "k5", "Rises rises"), ("D", 1, "k6", ""), ("D", 1, "k7", "")]


@pytest.mark.parametrize("name", ["tfidf_uni", "tfidf_bi", "tfidf_stop", "count_uni", "tfidf_char", "lm_vocab", "hashing"])
def test_terms_of_titles_are_those_of_the_joined_text(spark, name):
    from cutline.operators.termweights import text_terms, title_terms
    from cutline.operators.textblock import joined_titles
    reps = spark.createDataFrame([(s, s, at, key, t) for s, at, key, t in TITLES], "symbol string, widx string, known_at int, ckey string, title string")
    words = spark.createDataFrame([("Profit",), ("falls",)], "word string")
    one = text_terms(joined_titles(reps), ["symbol"], "titles_r1", name, words)
    each = title_terms(reps, name, words, keys=["symbol"])
    rows = lambda t: (sorted(r[0] for r in t.held.collect()), sorted(tuple(r) for r in t.counts.collect()))
    assert rows(each) == rows(one) and rows(each)[0] == ["A", "C", "D"]


@pytest.mark.parametrize("name", ["tfidf_bi", "count_uni"])
def test_text_model_finds_the_least_loss_without_a_vocabulary_on_the_driver(spark, name, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from cutline.operators.termweights import title_terms
    from cutline.plans import termmodel
    from cutline.plans.signals import BigMoveModel
    monkeypatch.setattr(termmodel, "BLOCK", 16)
    rng = np.random.default_rng(3)
    words = [f"w{c}" for c in "abcdefghijkl"]
    reps = spark.createDataFrame([(f"S{i}", 1, k, f"k{k}", " ".join(rng.choice(words, 5))) for i in range(40) for k in range(2)], "symbol string, target int, known_at int, ckey string, title string")
    rows = spark.createDataFrame([(f"S{i}", 1, i % 5) for i in range(41)], "symbol string, target int, label int")
    terms = title_terms(reps, name)
    model = BigMoveModel("text", min_df=2, vectorizer=name)
    monkeypatch.setattr(BigMoveModel, "inputs", property(lambda self: pytest.fail("vocabulary collected")))
    got = {r["symbol"]: r["p_big"] for r in model.fit(rows, terms=terms).transform(rows, terms=terms).collect()}
    assert len(got) == 41 and got["S40"] is None
    monkeypatch.undo()
    # pyspark.ml on the joined titles
    from cutline.operators.textblock import joined_titles
    joined = joined_titles(reps.withColumn("widx", F.lit(1))).join(rows, "symbol")
    x = model._features(joined).withColumn("_y", F.col("label").isin(0, 4).cast("double"))
    n, pos = 40, x.agg(F.sum("_y")).first()[0]
    x = x.withColumn("_w", F.when(F.col("_y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    want = LogisticRegression(labelCol="_y", weightCol="_w", standardization=False, maxIter=500, tol=1e-12, regParam=1 / n).fit(x)
    p = {r["symbol"]: r["probability"][1] for r in want.transform(x).select("symbol", "probability").collect()}
    assert max(abs(got[s] - p[s]) for s in p) < 5e-3
    vocabulary, coef = model.inputs[0].vocabulary, want.coefficients.toArray()
    assert all(abs(r["coef"] - coef[vocabulary.index(r["term"])]) < 1e-2 for r in model.fitted.collect())
    ends = model.terms(spark, 3).collect()
    assert [r["direction"] for r in ends] == ["up"] * 3 + ["down"] * 3 and ends[0]["coef"] == max(r["coef"] for r in model.fitted.collect())


def test_a_text_candidate_is_saved_and_loaded(spark, tmp_path):
    from cutline.operators.termweights import title_terms
    from cutline.plans.signals import BigMoveModel
    rows = spark.createDataFrame([(i, f"alpha w{i % 3} beta", i % 5) for i in range(20)], "id int, titles_r1 string, label int")
    model = BigMoveModel("text", min_df=1).fit(rows)
    model.tables()["terms"].write.parquet(str(tmp_path / "terms"))
    again = BigMoveModel(**model.settings()["made"])
    again.restore(model.settings(), str(tmp_path), spark)
    assert sorted(again.transform(rows).collect()) == sorted(model.transform(rows).collect())


def test_novelty_of_some_days_is_that_of_all(spark):
    rng = np.random.default_rng(2)
    rows = [("A", w, f"k{w}-{i}", f"d{w}", " ".join(f"w{'abcdefgh'[j]}" for j in rng.integers(0, 8, 5))) for w in range(6) for i in range(6)]
    reps = spark.createDataFrame(rows, "symbol string, widx int, ckey string, target string, title string")
    every = {r["widx"]: r["novelty_r1"] for r in T.novelty(reps, window=3).collect()}
    some = {r["widx"]: r["novelty_r1"] for r in T.novelty(reps, window=3, targets=["d2", "d5"]).collect()}
    assert some == pytest.approx({w: every[w] for w in (2, 5)})


def test_weights_are_worked_once(spark):
    """Counts meet their document frequencies once and unsorted, and one frame scales them."""
    import re
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3}") for i in range(30)], "id long, text string")
    for name in ("tfidf_bi", "tfidf_char", "tfidf_uni"):
        plan = _plan(term_weights(docs, "id", "text", name, min_df=1))
        assert "SortMergeJoin" not in plan and len(re.findall(r"(?:ShuffledHash|BroadcastHash)Join", plan)) == 1
