"""Registry of runnable queries and the shared building blocks of their SQL twins."""

from ..sources.market import ALIASES, LEXICON, SYMBOLS, Market

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(market) -> DataFrame`` under a name, with its independent SQL twin."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(Market(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def R(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def clip_sql(x, lo, hi):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {hi}), {lo}) END"


def grade_sql(x, cuts):
    return "(" + " + ".join(f"CAST({x} >= {float(c)!r} AS INT)" for c in cuts) + ")"


PATTERN_ROWS = []
for _s in SYMBOLS:
    _parts = [rf"\${_s}\b", rf"\b{_s}\b"] + [rf"(?i:(^|[^A-Za-z0-9_]){n}('s)?([^A-Za-z0-9_]|$))" for n in ALIASES.get(_s, [])]
    PATTERN_ROWS.append((_s, "|".join(_parts)))
_q = lambda t: "'" + t.replace("'", "''") + "'"

CTES: dict = {}


def cte(name, sql, *deps):
    CTES[name] = (sql, deps)


def W(*names, body: str) -> str:
    """WITH clause of the named tables and everything they need, then the body."""
    order = []

    def add(n):
        for d in CTES[n][1]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = body.strip()
    if body.startswith("WITH "):
        body = "," + body[4:]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body


sym = lambda c: f"'S' || lpad(CAST({c} % 10 AS VARCHAR), 2, '0')"

cte("bars", f"""SELECT {sym('user_id')} AS symbol, date_trunc('hour', ts) AS datetime, max_by(value, event_id) AS close,
  count(*) AS volume, CASE WHEN hour(min(ts)) <= 9 THEN 'pre' WHEN hour(min(ts)) <= 15 THEN 'regular' ELSE 'post' END AS session,
  date_trunc('hour', ts) + CASE WHEN hour(min(ts)) = 9 THEN INTERVAL 30 MINUTE ELSE INTERVAL 60 MINUTE END AS known_at
  FROM events GROUP BY 1, date_trunc('hour', ts)""")
cte("daily_b", f"""SELECT {sym('user_id')} AS symbol, CAST(ts AS DATE) AS date_et, min_by(value, event_id) AS open,
  max(value) AS high, min(value) AS low, round(avg(value), 6) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
cte("daily", """SELECT *, lag(close) OVER s AS prev_close, close / NULLIF(lag(close) OVER s, 0) - 1 AS ret,
  date_et + INTERVAL 16 HOUR AS known_at FROM daily_b WINDOW s AS (PARTITION BY symbol ORDER BY date_et)""", "daily_b")
cte("daily_wb", f"""SELECT {sym('l_suppkey')} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date_et,
  min_by(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""")
cte("daily_w", """SELECT *, lag(close) OVER s AS prev_close, close / NULLIF(lag(close) OVER s, 0) - 1 AS ret,
  row_number() OVER s - 1 AS i FROM daily_wb WINDOW s AS (PARTITION BY symbol ORDER BY date_et)""", "daily_wb")
for _n, _d in (("cal", "daily"), ("cal_w", "daily_w")):
    cte(_n, f"""SELECT date, target, date + INTERVAL '9 hours 30 minutes' AS lo, target + INTERVAL '9 hours 30 minutes' AS cutoff, widx
  FROM (SELECT date_et AS date, lead(date_et) OVER (ORDER BY date_et) AS target,
        CAST(row_number() OVER (ORDER BY date_et) - 1 AS INT) AS widx
        FROM (SELECT DISTINCT date_et FROM {_d})) WHERE target IS NOT NULL""", _d)
cte("cal2", "SELECT date, target, lo, cutoff, widx FROM (SELECT date, target, cutoff, widx, lag(cutoff) OVER (ORDER BY target) AS lo FROM cal) WHERE lo IS NOT NULL", "cal")
cte("ev", f"""SELECT {sym('o_custkey')} AS symbol, o_orderdate AS known_at, o_orderkey, (o_custkey % 100) / 10.0 AS eps_estimate,
  o_totalprice / 50000 AS eps_reported, (o_totalprice / 50000 / NULLIF((o_custkey % 100) / 10.0, 0) - 1) * 100 AS surprise_pct,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'up' WHEN '5-LOW' THEN 'down' WHEN '2-HIGH' THEN 'init' ELSE 'main' END AS action,
  o_totalprice AS target_current, CAST((o_custkey % 40) * 8000 AS DOUBLE) AS target_prior FROM orders""")
cte("ev_t", "SELECT e.*, c.target, c.widx FROM ev e JOIN cal_w c ON e.known_at >= c.lo AND e.known_at < c.cutoff", "ev", "cal_w")
cte("news", """SELECT doc_id, 'S0' || doc_id % 10 || ',S0' || (doc_id * 7 + 3) % 10 AS symbols, source, lang, 'u' || doc_id AS url,
  CASE doc_id % 5 WHEN 0 THEN 'S0' || doc_id % 10 || ' beats earnings forecast: '
    WHEN 1 THEN '$S0' || doc_id % 10 || ' and S0' || (doc_id * 3 + 1) % 10 || ' merger talks; '
    WHEN 2 THEN 'Company ' || chr(CAST(65 + doc_id % 10 AS INT)) || ' appoints CEO, '
    WHEN 3 THEN 'Fund trims stake in S0' || (doc_id * 7 + 3) % 10 || ' ' ELSE '' END || text AS title,
  CAST((n_chars % 21) - 10 AS DOUBLE) AS tone,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 43200 AS INT)) AS known_at FROM documents""")
cte("forum", """SELECT conv_id || '-' || turn AS post_id, conv_id, turn, role AS sub,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((conv_id * 7919 + turn * 37) % 43200 AS INT)) AS created_et,
  CASE WHEN turn = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'Thread on $S0' || (conv_id * 3 + 1) % 10 ELSE 'Daily talk' END END AS title,
  CASE WHEN conv_id % 2 = 0 THEN '$S0' || conv_id % 10 || ' vs S0' || turn % 10 || ' ' || text ELSE text END AS body FROM conversations""")
cte("universe", "SELECT DISTINCT symbol FROM daily", "daily")
NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
cte("tags", f"""SELECT * FROM (SELECT n.* EXCLUDE (symbols), unnest(string_split(symbols, ',')) AS symbol, c.target, c.widx,
  md5({NORM.replace('{0}', 'title')}) AS h FROM news n JOIN cal c ON n.known_at >= c.lo AND n.known_at < c.cutoff)
  WHERE symbol IN (SELECT symbol FROM universe)""", "news", "cal", "universe")
cte("news_u", """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, target, h) AS copies FROM tags)
  QUALIFY row_number() OVER (PARTITION BY symbol, target, h ORDER BY known_at, url) = 1""", "tags")
cte("grid", "SELECT symbol, target, widx FROM universe, cal", "universe", "cal")
cte("patterns", "SELECT * FROM (VALUES " + ", ".join(f"({_q(s)}, {_q(p)})" for s, p in PATTERN_ROWS) + ") t(symbol, pattern)")
from ..fixed import SOURCE_SUFFIX_RX, STOPWORDS, TEMPLATE_RX  # noqa: E402
CLEAN = rf"regexp_replace(regexp_replace({{0}}, '{SOURCE_SUFFIX_RX}', ''), '^\s+|\s+$', '', 'g')"
STOP_SQL = "[" + ", ".join(_q(w) for w in STOPWORDS) + "]"
CKEY = (f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z][a-z''&-]+'), "
        f"lambda t: NOT list_contains({STOP_SQL}, t)))), ' ')")
cte("arts0", f"""SELECT known_at, target, widx, symbols, source, title, tone, md5(title) AS tkey, md5({NORM.replace('{0}', 'title')}) AS title_id,
  md5({CKEY.replace('{0}', 'title')}) AS ckey, CAST(regexp_matches(title, '(?i){TEMPLATE_RX.replace("'", "''")}') AS INT) AS is_template
  FROM (SELECT n.* REPLACE ({CLEAN.replace('{0}', 'title')} AS title), c.target, c.widx FROM news n
        JOIN cal c ON n.known_at >= c.lo AND n.known_at < c.cutoff)""", "news", "cal")
cte("ment", """SELECT DISTINCT t.tkey, p.symbol FROM (SELECT DISTINCT tkey, title FROM arts0) t, patterns p
  WHERE regexp_matches(t.title, p.pattern)""", "arts0", "patterns")
cte("arts", """SELECT a.* , coalesce(CASE WHEN n.k IS NULL THEN 0 WHEN n.k <= 1 THEN 2 ELSE 1 END, 0) AS rel, coalesce(n.k, 0) AS n_entities
  FROM (SELECT * EXCLUDE (symbols), unnest(string_split(symbols, ',')) AS symbol FROM arts0) a
  LEFT JOIN (SELECT m.tkey, m.symbol, c.k FROM ment m JOIN (SELECT tkey, count(*) AS k FROM ment GROUP BY 1) c USING (tkey)) n
    ON a.tkey = n.tkey AND a.symbol = n.symbol
  WHERE a.symbol IN (SELECT symbol FROM universe)""", "arts0", "ment", "universe")
cte("clu", """SELECT *, (pw IS NULL OR widx - pw > 5) AS is_first FROM (SELECT *, lag(widx) OVER (PARTITION BY symbol, ckey ORDER BY widx) AS pw
  FROM (SELECT symbol, widx, ckey, max(rel) AS rel, count(*) AS copies FROM arts WHERE is_template = 0 GROUP BY ALL))""", "arts")
cte("reps", """SELECT symbol, target, widx, ckey, title, known_at, title_id, mt AS tone FROM (
  SELECT *, avg(tone) OVER (PARTITION BY symbol, widx, ckey) AS mt FROM arts WHERE is_template = 0 AND rel >= 1)
  QUALIFY row_number() OVER (PARTITION BY symbol, widx, ckey ORDER BY known_at, title_id, title) = 1""", "arts")
cte("lexicon", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in LEXICON.items() for w in ws) + ") t(category, word)")
cte("ext", """SELECT symbol, CAST(datetime AS DATE) AS day,
  max_by(close, datetime) FILTER (session = 'pre' AND known_at < CAST(datetime AS DATE) + INTERVAL '9 hours 30 minutes') AS pre_last,
  max_by(close, datetime) FILTER (session = 'pre' AND known_at <= CAST(datetime AS DATE) + INTERVAL '9 hours 30 minutes') AS pre_last_leak,
  max_by(close, datetime) FILTER (session = 'post') AS post_last FROM bars WHERE session <> 'regular' GROUP BY 1, 2""", "bars")
LOO = "(SELECT CASE WHEN count({v}) >= {m} THEN median({v}) END FROM {t} o WHERE o.{k} = d.{k} AND o.symbol <> d.symbol)"
cte("dm", "SELECT *, ret * 100 AS r FROM daily", "daily")
cte("dmm", "SELECT d.*, " + LOO.format(v="o.r", m=3, t="dm", k="date_et") + " AS m FROM dm d", "dm")
_roll = lambda f, c, n, mp: (f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY date_et ROWS {n - 1} PRECEDING) >= {mp} THEN "
                             f"{f}({c}) OVER (PARTITION BY symbol ORDER BY date_et ROWS {n - 1} PRECEDING) END")


def block_sql(src, r="r", m="m", tr_scale=100):
    return f"""SELECT symbol, date_et AS date, close AS close_d0, {_roll('stddev_samp', r, 5, 2)} AS vol5,
  {_roll('stddev_samp', r, 20, 10)} AS vol20,
  {_roll('avg', 'tr', 14, 7)} AS atr14, {_roll('avg', 'big', 60, 30)} AS big_rate60,
  coalesce(0.5 * ({_roll('avg', 'rm', 60, 30)} - {_roll('avg', r, 60, 30)} * {_roll('avg', m, 60, 30)})
   / NULLIF({_roll('avg', 'mm', 60, 30)} - {_roll('avg', m, 60, 30)} * {_roll('avg', m, 60, 30)}, 0) + 0.5, 1.0) AS beta60
  FROM (SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) / close * {tr_scale} AS tr,
        CASE WHEN {r} IS NOT NULL THEN CAST(({r} < -2.5 OR {r} >= 2.5) AS INT) END AS big, {r} * {m} AS rm, {m} * {m} AS mm FROM {src})"""


cte("blk", block_sql("dmm"), "dmm")
cte("gap", """SELECT *, (px / close_d0 - 1) * 100 AS gap_pct FROM (
  SELECT b.*, c.target, CAST(p.pre_last IS NULL AND q.post_last IS NOT NULL AS DOUBLE) AS gap_fallback,
   CAST(coalesce(p.pre_last, q.post_last) IS NULL AS DOUBLE) AS gap_missing, coalesce(p.pre_last, q.post_last) AS px
  FROM blk b JOIN cal c ON b.date = c.date LEFT JOIN ext p ON p.symbol = b.symbol AND p.day = c.target
  LEFT JOIN ext q ON q.symbol = b.symbol AND q.day = b.date)""", "blk", "cal", "ext")
cte("peer", """SELECT d.*, CASE WHEN gap_pct IS NOT NULL THEN (rank() OVER (PARTITION BY target ORDER BY gap_pct)
   + (count(*) OVER (PARTITION BY target, gap_pct) - 1) / 2.0) / count(gap_pct) OVER (PARTITION BY target) END AS gap_rank,
  CASE WHEN gap_pct IS NOT NULL AND vol20 IS NOT NULL THEN greatest(least(gap_pct / greatest(vol20, 0.5), 10), -10) END AS zgap,
  """ + LOO.format(v="o.gap_pct", m=3, t="gap", k="target") + """ AS mkt_gap FROM gap d""", "gap")
cte("regime", """SELECT target, median(vol20) AS reg_med_vol20, median(abs(gap_pct)) AS reg_med_absgap, stddev_samp(gap_pct) AS reg_gap_disp,
  median(gap_pct) AS reg_mkt_gap, avg(CAST(abs(gap_pct) >= 1 AS INT)) AS reg_big_ratio FROM gap GROUP BY 1""", "gap")
cte("panel", """SELECT p.*, p.gap_pct - p.beta60 * p.mkt_gap AS resid_gap, r.* EXCLUDE (target), l.ret * 100 AS ret_pct, """
    + grade_sql("(l.ret * 100)", (-25, -6, 6, 25)) + """ AS label,
  CASE WHEN p.gap_pct > -100 THEN ln(1 + l.ret) - ln(1 + p.gap_pct / 100) END AS rest
  FROM peer p LEFT JOIN regime r USING (target) JOIN daily l ON l.symbol = p.symbol AND l.date_et = p.target AND l.ret IS NOT NULL""",
    "peer", "regime", "daily")

cte("ev_m", "SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((o_orderkey * 7919) % 43200 AS INT)) AS known_at) FROM ev", "ev")
cte("ev_mt", "SELECT e.*, c.target, c.widx FROM ev_m e JOIN cal c ON e.known_at >= c.lo AND e.known_at < c.cutoff", "ev_m", "cal")
