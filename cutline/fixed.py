"""Fixed values.

Everything in this module is a fixed value of the task (cut points, weights, word
lists, patterns, feature registry).  They decide results, so they are stated here
once, in natural order, and used everywhere else by name.
"""

# ---- fixed values: decision windows -----------------------------------------
CUTOFF_INTERVAL = "INTERVAL '09:30' HOUR TO MINUTE"
HIST_DAYS = 100
NEWS_HIST_DAYS = 30
NEWS_WINDOW = 20
FIRST_LOOKBACK = 5
EMBARGO_DAYS = 14

# ---- fixed values: grades and weights ----------------------------------------
RET_CUTS = (-2.5, -0.6, 0.6, 2.5)
CRASH, DOWN, FLAT, UP, SURGE = 0, 1, 2, 3, 4
GRADES = (0, 1, 2, 3, 4)
WEIGHT = tuple(tuple((i - j) ** 2 * (i - 2) ** 2 for j in GRADES) for i in GRADES)
MAGNITUDE = (2, 1, 0, 1, 2)
CLASS_CENTERS = (-4.0, -1.5, 0.0, 1.5, 4.0)

# ---- fixed values: feature constants -----------------------------------------
BIG_CUT = 2.5
VOL_FLOOR = 0.5
ZGAP_CLIP = 10.0
BETA_SHRINK = 0.5
SURP_CLIP = 50.0
TARGET_CHANGE_CLIP = 0.5
TONE_TAIL = 5.0
MIN_LOO = 3
BIG_GAP = 1.0
RET_CLIP = 15.0
DEFAULT_K = 5.25

# ---- fixed values: word lists -------------------------------------------------
NEGATORS = ("no", "not", "never", "without", "neither", "nor", "none", "cannot", "nobody", "nothing")
STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "by", "with", "from", "and", "or", "as",
             "is", "are", "was", "were", "be", "been", "its", "it", "this", "that", "these", "those", "into",
             "over", "after", "before", "about", "s", "inc", "corp", "co", "ltd", "plc", "llc", "nyse", "nasdaq")
COMMON_TICKERS = ("NOW", "COST", "WELL", "GILD", "COP", "BA", "DE", "GE", "KO", "MS", "PM", "CB", "V", "ALL", "ARE")

# ---- fixed values: patterns ---------------------------------------------------
NORM_RX = r"[^a-z0-9]+"
SOURCE_SUFFIX_RX = r"\s+[-|–—]\s+[^-|–—]{1,40}$"
CLUSTER_TOKEN_RX = r"[a-z][a-z'&-]+"
NOVELTY_TOKEN_RX = r"(?U)\b[a-zA-Z][a-zA-Z'&-]+\b"
LEXICON_TOKEN_RX = r"[A-Za-z]+"
VEC_TOKEN_RX = r"\$?[A-Za-z]+(?:[.'&-][A-Za-z]+)*|\d+(?:[.,]\d+)*%?"
NUMBER_RX = r"[-+−]?\d+(?:[.,]\d+)*%?"
DATE_RX = (
    r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
    r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s*\d{0,2}(?:,?\s*\d{4})?\b|\b(?:19|20)\d{2}\b"
    r"|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b|\b(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day\b")
CASHTAG_RX = r"\$[A-Za-z]{1,5}(?:[.\-][A-Za-z])?\b"
TEMPLATE_RX = (
    r"(?:shares (?:sold|bought|purchased|acquired) by|shares (?:in|of) .{0,80}(?:acquired|sold|bought|purchased) by"
    r"|(?:acquires?|buys?|sells?|purchases?|trims?|cuts?|lowers?|raises?|boosts?|increases?|decreases?|reduces?|grows?|lifts?)"
    r" (?:\$[\d.,]+ (?:million|billion) |new |[\d,]+ shares (?:of|in) |its )?(?:stake|position|holdings?|shares)\b"
    r"|(?:stake|position|holdings?) (?:in|raised|lowered|boosted|trimmed|cut|increased|decreased|reduced|lifted)\b"
    r"|has \$[\d.,]+ (?:million|billion|thousand)|invests? \$[\d.,]+ (?:million|billion|thousand) in|stock position"
    r"|takes position in|(?:sells?|buys?) [\d,]+ shares|sells? \$[\d.,]+ in stock|insider (?:selling|buying|sells|buys)"
    r"|short interest|stocks to (?:add|watch|buy)|watchlist)")
#: Every branch of TEMPLATE_RX holds one of these.
TEMPLATE_WORDS = ("shares", "stake", "position", "holding", "has $", "invest", "stock", "insider ", "short interest", "watchlist")
EVENT_RX = {
    "earn": r"\b(?:earnings|eps|quarterly (?:results|profit|revenue)|q[1-4] (?:results|earnings|revenue|sales)|beats?|miss(?:es|ed)?|profit (?:rises|falls|jumps|drops))\b",
    "guid": r"\b(?:guidance|outlook|forecasts?|raises? (?:its )?(?:full-year|annual|outlook|forecast)|cuts? (?:its )?(?:outlook|forecast))\b",
    "anal": r"\b(?:upgraded?s?|downgraded?s?|price target|initiates? coverage|reiterates?|overweight|underweight|outperform|underperform)\b",
    "legal": r"\b(?:lawsuit|sued?s?|probe|investigation|settles?|settlement|fined?|antitrust|subpoena|recalls?|indicted|charges filed)\b",
    "mna": r"\b(?:acquisition|acquires?|to acquire|merger|merges?|buyout|takeover|deal to buy|spin-?off|divest\w*)\b",
    "prod": r"\b(?:launch\w*|unveil\w*|fda|approv\w+|clinical trial|patent|rollout|release[sd]? new)\b",
    "mgmt": r"\b(?:ceo|cfo|chief executive|resign\w*|steps? down|appoint\w*|succeed\w*|layoffs?|job cuts)\b",
}

# ---- fixed values: feature registry --------------------------------------------
RELEVANCE = ("r0", "r1", "r2")
FEATURE_GROUPS = {
    "core": ["gap_pct", "gap_rank"],
    "scale": ["vol5", "vol20", "atr14", "big_rate60", "zgap"],
    "cross": ["mkt_gap", "resid_gap", "beta60"],
    "event": ["earn", "surp_sign", "surp_abs", "surp_pct_w"],
    "analyst": ["an_n", "an_up", "an_down", "an_tgt_chg", "an_gap_agree"],
    "news": ["news_n", "news_abn", "tone_mean", "tone_min", "tone_max", "tone_neg_tail", "news_missing"],
    "regime": ["reg_med_vol20", "reg_med_absgap", "reg_gap_disp", "reg_mkt_gap", "reg_big_ratio"],
    "txt_count": ["n_clu_r0", "n_clu_r1", "n_clu_r2", "n_first_r0", "n_first_r1", "n_first_r2",
                  "n_clu_r0_abn", "n_clu_r1_abn", "n_clu_r2_abn",
                  "n_first_r0_abn", "n_first_r1_abn", "n_first_r2_abn", "n_src_r1"],
    "txt_tone_gdelt": ["tone_mean_r1", "tone_neg_share_r1", "tone_sd_r1"],
    "txt_tone_lm": ["lm_net_r1", "lm_neg_share_r1", "lm_unc_r1"],
    "txt_novelty": ["novelty_r1"],
    "txt_event": ["ev_earn_r1", "ev_guid_r1", "ev_anal_r1", "ev_legal_r1", "ev_mna_r1", "ev_prod_r1",
                  "ev_mgmt_r1", "ev_any_r1"],
    "txt_meta": ["n_scored_r1", "tmpl_share_r0", "alias_missing"],
    "txt_text": ["titles_r1"],
}

# fixed values: adoption thresholds of a candidate against its baseline
ADOPTION = {"min_positive_folds": 3, "reject_negative_folds": 2, "reject_fold_tol": 0.005, "worst_fold_tol": 0.02, "flip_tol": 0.02,
            "extreme_band": 0.25, "min_gain": 0.0, "multiplicity": None, "family_size": None, "alpha": 0.05}

# ---- fixed values: research groups, joined from outside tables ------------------
RESEARCH_FORUMS = ("Daytrading", "StockMarket", "Superstonk", "ValueInvesting", "investing", "options", "stocks", "wallstreetbets")
RESEARCH_GROUPS = {
    "reddit": ["mentions_abn", *(f"act_{s}_abn" for s in RESEARCH_FORUMS)],
    "news_llm_anon": ["llm_anon_sign", "llm_anon_severity", "llm_anon_unexpected", "llm_anon_n"],
    "news_llm_raw": ["llm_raw_sign", "llm_raw_severity", "llm_raw_unexpected", "llm_raw_n"],
    "reddit_llm": ["llm_reddit_bull", "llm_reddit_hype", "llm_reddit_n"],
    "finbert": ["fb_net_r1", "fb_neg_share_r1", "fb_n_r1"],
    "finbert_emb": [f"fb_pc{i}" for i in range(32)],
}

# ---- fixed values: search grids (first, last, step) and what a spec leaves open ----
K_GRID = (0.5, 8.0, 0.25)
SYM2_GRID = (0.05, 0.98, 0.03)
DECOMP_GRID = (0.05, 0.95, 0.05)
CONFIDENCE_GRID = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3)
FACTOR_GRID = (0.6, 1.6, 0.1)
SLOPE_GRID = (-1.0, 1.0, 0.1)
SPEC_DEFAULTS = {"signal": {"type": "gap"}, "decision": {"type": "k"}, "regime": {"type": "none"}, "selection": {"criterion": "pooled"},
                 "tune_frac": 0.2, "tune_on": "auto", "seed": 0}

# ---- fixed values: event classes of conditional tables ---------------------------
# rules: the first condition that holds names the class, the last name is for all others
# quartiles: names of the four quartiles of a column; agreement: a column's direction against the gap
EVENT_RULES = {
    "analyst": (("an_up > an_down", "upgrade"), ("an_down > an_up", "downgrade"), "none"),
    "earnings": (("earn > 0 AND surp_sign > 0", "beat"), ("earn > 0", "miss_or_meet"), "none"),
    "txt_relevance": (("n_first_r2 > 0", "R2 new"), ("n_first_r1 > 0", "R1 new"), ("n_first_r0 > 0", "R0 tag only"), "none"),
    "txt_first_r1": (("n_first_r1 >= 3", "3+"), ("n_first_r1 >= 1", "1-2"), "0"),
    "txt_event": (("ev_any_r1 = 1", "event"), ("n_scored_r1 > 0", "no event"), "no article"),
    "txt_novelty": (("novelty_r1 >= 0.7D", "high"), ("novelty_r1 >= 0.4D", "middle"), ("novelty_r1 IS NOT NULL", "low"), "no article"),
}
EVENT_QUARTILES = {
    "news_volume": ("news_abn", "q1 low", "q2", "q3", "q4 high"),
    "reddit_mentions": ("mentions_abn", "q1", "q2", "q3", "q4 surge"),
}
EVENT_AGREEMENT = {
    "news_tone_vs_gap": "tone_mean", "llm_anon_vs_gap": "llm_anon_sign", "llm_raw_vs_gap": "llm_raw_sign",
    "txt_lm_vs_gap": "lm_net_r1", "txt_gdelt_vs_gap": "tone_mean_r1", "txt_finbert_vs_gap": "fb_net_r1",
}
