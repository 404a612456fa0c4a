"""SQL statements of the named queries, over the same tables (checked with DuckDB)."""

from __future__ import annotations

import math
from itertools import combinations

from quantspan.functions.normal import ppf
from quantspan.functions.text import accent_tables
from quantspan.operators.crossval import _runs

LOOKBACKS = (10, 20, 30, 40, 50)

BARS = """
bars AS (
  SELECT event_type AS instrument, date_trunc('hour', ts) AS ts,
         first(value + 1000.0 ORDER BY ts, event_id) AS open, max(value + 1000.0) AS high,
         min(value + 1000.0) AS low, last(value + 1000.0 ORDER BY ts, event_id) AS close,
         count(*)::DOUBLE AS volume
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""

RETS = f"""{BARS},
rets AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY instrument) AS n,
         ln(close) - ln(lag(close) OVER w) AS log_ret,
         coalesce(close / lag(close) OVER w - 1, 0.0) AS ret
  FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY ts))"""

_FEATURE = """
  SELECT instrument, ts, pos, ret, {lb} AS lookback,
         CASE WHEN pos >= {lb} - 1 THEN stddev_samp(ret) OVER
           (PARTITION BY instrument ORDER BY pos ROWS BETWEEN {lb} - 1 PRECEDING AND CURRENT ROW) END AS vol,
         coalesce(sign(close - lag(close, {lb}) OVER (PARTITION BY instrument ORDER BY pos)), 0)::DOUBLE AS mom
  FROM rets"""

FEATURES = f"""{RETS},
raw AS ({' UNION ALL '.join(_FEATURE.format(lb=lb) for lb in LOOKBACKS)}),
features AS (
  SELECT *, lag(vol) OVER w AS prev_vol, lag(mom) OVER w AS prev_mom
  FROM raw WINDOW w AS (PARTITION BY instrument, lookback ORDER BY pos))"""

PANEL = f"""{FEATURES},
med AS (SELECT instrument, lookback, quantile_cont(vol, 0.5) AS m FROM features GROUP BY 1, 2),
panel AS (
  SELECT instrument AS sleeve_id, (lookback // 10 - 1)::BIGINT AS config_id, pos - {max(LOOKBACKS) + 1} AS t, ts,
         coalesce(CASE WHEN prev_vol > m THEN -prev_mom ELSE prev_mom END, 0.0) * ret AS ret
  FROM features JOIN med USING (instrument, lookback) WHERE pos >= {max(LOOKBACKS) + 1})"""

STATS = f"""{PANEL},
mu AS (SELECT sleeve_id, config_id, count(*) AS n_obs, avg(ret) AS mean, stddev_samp(ret) AS std FROM panel GROUP BY 1, 2),
mom AS (
  SELECT sleeve_id, config_id, n_obs, any_value(mean) AS mean, any_value(std) AS std,
         avg((ret - mean) ** 2) AS m2, avg((ret - mean) ** 3) AS m3, avg((ret - mean) ** 4) AS m4
  FROM panel JOIN mu USING (sleeve_id, config_id) GROUP BY 1, 2, 3),
stats AS (
  SELECT sleeve_id, config_id, n_obs, mean, std, CASE WHEN std > 0 THEN mean / std ELSE 0 END AS sharpe,
         m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) AS kurt
  FROM mom)"""

BLOCKS = f"""{PANEL},
blocked AS (
  SELECT *, ntile(6) OVER w - 1 AS grp, ntile(10) OVER w - 1 AS blk
  FROM panel WINDOW w AS (PARTITION BY sleeve_id, config_id ORDER BY t))"""

_COMBOS = list(combinations(range(6), 2))
_COMBO_ROWS = ", ".join(f"({i}, {g})" for i, cmb in enumerate(_COMBOS) for g in cmb)
_RUN_ROWS = ", ".join(f"({i}, {a}, {b})" for i, cmb in enumerate(_COMBOS) for a, b in _runs(cmb))

PATHS = f"""{BLOCKS},
combos(combo_id, grp) AS (VALUES {_COMBO_ROWS}),
paths AS (
  SELECT sleeve_id, config_id, combo_id, count(*) AS n_test,
         CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS path_sharpe
  FROM blocked JOIN combos USING (grp) GROUP BY 1, 2, 3)"""

CSCV = f"""{BLOCKS},
parts AS (
  SELECT sleeve_id, config_id, blk, count(*) AS n, avg(ret) AS mean, var_pop(ret) * count(*) AS m2
  FROM blocked GROUP BY 1, 2, 3),
masks AS (SELECT i AS mask FROM range(1024) r(i) WHERE bit_count(i::INTEGER) = 5),
sides AS (
  SELECT sleeve_id, config_id, mask, (mask & (1 << blk::BIGINT)) <> 0 AS inside, sum(n) AS n,
         sum(n * mean) / sum(n) AS mean, sum(m2) + sum(n * mean * mean) - sum(n * mean) ** 2 / sum(n) AS m2
  FROM parts CROSS JOIN masks GROUP BY 1, 2, 3, 4),
perf AS (
  SELECT sleeve_id, config_id, mask,
         max(CASE WHEN inside THEN mean / sqrt(m2 / (n - 1)) END) AS is_sharpe,
         max(CASE WHEN NOT inside THEN mean / sqrt(m2 / (n - 1)) END) AS oos_sharpe
  FROM sides GROUP BY 1, 2, 3),
best AS (
  SELECT sleeve_id, mask, config_id AS best_config, oos_sharpe AS best_oos FROM perf
  QUALIFY row_number() OVER (PARTITION BY sleeve_id, mask ORDER BY is_sharpe DESC, config_id) = 1),
ranks AS (
  SELECT sleeve_id, mask, best_config, count(*) AS n_configs,
         count_if(oos_sharpe < best_oos) + (count_if(oos_sharpe = best_oos) + 1) / 2.0 AS oos_rank
  FROM perf JOIN best USING (sleeve_id, mask) GROUP BY 1, 2, 3),
logits AS (SELECT *, ln(oos_rank / (n_configs + 1) / (1 - oos_rank / (n_configs + 1))) AS logit FROM ranks),
pbo AS (
  SELECT sleeve_id, avg((logit <= 0)::INT) AS pbo, count(*) AS n_combos, quantile_cont(logit, 0.5) AS median_logit
  FROM logits GROUP BY 1)"""

# Normal CDF by its power series, good to about 1e-12 for |z| < 6.
PHI = (
    "0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), "
    "lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"
)
_N = len(LOOKBACKS)
_BEST = (1 - 0.5772156649015329) * ppf(1 - 1 / _N) + 0.5772156649015329 * ppf(1 - 1 / (_N * math.e))

_DSR = f"""
cand AS (
  SELECT *, var_samp(sharpe) OVER (PARTITION BY sleeve_id) AS v FROM stats
  QUALIFY row_number() OVER (PARTITION BY sleeve_id ORDER BY sharpe DESC, config_id) = 1),
zed AS (
  SELECT sleeve_id, config_id, n_obs, sharpe, sqrt(v) * {_BEST!r} AS sr0,
         (sharpe - sqrt(v) * {_BEST!r}) * sqrt(n_obs - 1)
           / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)) AS z
  FROM cand),
dsr AS (SELECT *, {PHI.format(z='z')} AS dsr FROM zed)"""

_EQUITY_LINE = """
line AS (
  SELECT sleeve_id, config_id, t, product(1 + ret) OVER (PARTITION BY sleeve_id, config_id ORDER BY t) AS eq FROM panel),
dd AS (
  SELECT sleeve_id, config_id, max((peak - eq) / peak) AS max_dd FROM (
    SELECT *, max(eq) OVER (PARTITION BY sleeve_id, config_id ORDER BY t) AS peak FROM line) GROUP BY 1, 2)"""

CAL = f"""{BARS},
hb AS (
  SELECT *, hour(ts) AS hour_utc, greatest(1.0, 0.10 * ((high - low) / 0.25)) AS spread,
         ln(close) - ln(lag(close) OVER (PARTITION BY instrument, hour(ts) ORDER BY ts)) AS lr FROM bars),
cal AS (
  SELECT instrument, hour_utc, count(*) AS n_samples, avg(spread) AS spread_ticks_mean,
         quantile_cont(spread, 0.95) AS spread_ticks_p95, var_pop(spread) AS slippage_var,
         0.10 * (coalesce(stddev_pop(lr), 0) * avg(close) / greatest(avg(volume), 1.0)) AS impact
  FROM hb GROUP BY 1, 2)"""

EQUITY = """
pnl AS (
  SELECT l_suppkey::VARCHAR AS sleeve_id, l_shipdate AS ts,
         sum(round(l_extendedprice * (l_discount - l_tax) * 100)::BIGINT)::BIGINT AS pnl
  FROM lineitem GROUP BY 1, 2),
eq AS (
  SELECT sleeve_id, ts, pnl,
         (20000000 + sum(pnl) OVER (PARTITION BY sleeve_id ORDER BY ts))::BIGINT / 100.0::DOUBLE AS equity FROM pnl),
curve AS (
  SELECT *, max(equity) OVER (PARTITION BY sleeve_id ORDER BY ts) AS peak_equity FROM eq),
ddc AS (
  SELECT *, CASE WHEN peak_equity > 0 THEN greatest(0, (peak_equity - equity) / peak_equity) ELSE 0 END AS dd FROM curve),
lev AS (
  SELECT *, CASE WHEN dd >= 0.20 THEN 'halt' WHEN dd >= 0.15 THEN 'dd15' WHEN dd >= 0.10 THEN 'dd10'
                 WHEN dd >= 0.05 THEN 'dd5' ELSE 'normal' END AS gate_level FROM ddc),
gates AS (
  SELECT sleeve_id, ts, round(dd, 6) AS current_dd_pct, gate_level,
         CASE gate_level WHEN 'halt' THEN 0.0 WHEN 'dd15' THEN 0.125 WHEN 'dd10' THEN 0.25
                         WHEN 'dd5' THEN 0.5 ELSE 1.0 END::DOUBLE AS sizing_mult,
         lag(gate_level) OVER (PARTITION BY sleeve_id ORDER BY ts) AS previous_level
  FROM lev)"""

_SYMBOL = "['NQ', 'ES', 'GC', 'MNQ'][{k} % 4 + 1]"

SIGNALS = f"""
sig0 AS (
  SELECT o_orderkey AS k, o_orderkey::VARCHAR AS signal_id, o_custkey AS account_id,
         o_orderdate + to_minutes(o_orderkey % 1440) AS created_at, {_SYMBOL.format(k='o_orderkey')} AS symbol,
         CASE WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'SCALP_EMA' WHEN '2-HIGH' THEN 'NEWS_DRIVEN'
           WHEN '3-MEDIUM' THEN 'SETUP_1' WHEN '4-NOT SPECIFIED' THEN 'SETUP_2' ELSE 'SETUP_3' END AS setup_type,
         round(o_totalprice * 100)::BIGINT AS entry_c,
         (round(o_totalprice * 100)::BIGINT * (1 + o_orderkey % 3)) // 100 AS dist_c,
         0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE AS confidence,
         o_orderkey % 10 + 1 AS size, (o_orderkey % 40 * 50 + 50) * 100 AS risk_c,
         CASE WHEN o_orderkey % 23 = 0 THEN 'short' ELSE 'order signal ' || o_orderkey END AS justification
  FROM orders),
sig AS (
  SELECT *, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS up,
         entry_c - CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * CASE WHEN k % 17 = 0 THEN -1 ELSE 1 END * dist_c AS stop_c,
         entry_c + CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END * ((dist_c * (2 + k % 5)) // 2) AS tp_c
  FROM sig0),
acct AS (
  SELECT c_custkey AS account_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'APEX' WHEN 'BUILDING' THEN 'TOPSTEP'
           WHEN 'FURNITURE' THEN 'LUCID' ELSE 'OWN_LIVE' END AS firm,
         round(c_acctbal * 100)::BIGINT * 10 AS equity_c, round(c_acctbal * 100)::BIGINT - 450000 AS pnl_c,
         c_custkey % 5 AS trades_today, c_custkey % 4 AS losses, c_custkey * 37 % 160000 AS dd_c,
         CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 END AS consistency
  FROM customer),
frame AS (
  SELECT *, CASE WHEN abs(entry_c - stop_c) > 0
              THEN (abs(tp_c - entry_c) / 100.0::DOUBLE) / (abs(entry_c - stop_c) / 100.0::DOUBLE) ELSE 0 END AS rr,
         CASE setup_type WHEN 'SCALP_EMA' THEN 1.5 WHEN 'NEWS_DRIVEN' THEN 2.5 ELSE 2.0 END AS rr_floor,
         strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%H:%M:%S') AS ny
  FROM sig JOIN acct USING (account_id))"""


def _hard_rules(mode: str) -> str:
    topstep = "false" if mode == "C" else "firm = 'TOPSTEP'"
    return f"""
hard AS (
  SELECT *, concat_ws(',',
    CASE WHEN trades_today >= 3 THEN 'max_daily_trades' END,
    CASE WHEN losses >= 3 THEN 'max_consecutive_losses' END,
    CASE WHEN (pnl_c / 100.0::DOUBLE) / 50000.0::DOUBLE * 100 <= -5.0 THEN 'max_daily_loss' END,
    CASE WHEN dd_c / 100.0::DOUBLE >= 1250.0 THEN 'trailing_dd_buffer' END,
    CASE WHEN rr < rr_floor THEN 'risk_reward_minimum' END,
    CASE WHEN confidence < 0.55::DOUBLE THEN 'confidence_threshold' END,
    CASE WHEN {topstep} THEN 'topstep_no_vps' END,
    CASE WHEN firm = 'APEX' AND consistency > 28 THEN 'apex_consistency_30_pct' END,
    CASE WHEN setup_type = 'SCALP_EMA' AND firm = 'APEX' THEN 'scalp_only_in_allowed_mode' END,
    CASE WHEN setup_type = 'SCALP_EMA' AND NOT (ny BETWEEN '08:30:00' AND '11:30:00' OR ny BETWEEN '14:00:00' AND '15:45:00')
         THEN 'scalp_window' END) AS failed
  FROM frame)"""


RULES = f"""
rules AS (
  SELECT 'rule_' || s_suppkey AS id, s_suppkey * 60 AS ts_s, s_suppkey % 50 = 7 AS block,
         CASE WHEN s_suppkey % 5 < 4 THEN {_SYMBOL.format(k='(s_suppkey % 5)')} END AS instrument,
         CASE WHEN s_suppkey % 25 <> 3 THEN TIMESTAMP '1995-01-01' + to_days((s_suppkey * 23 % 2400)::INTEGER) END AS event_ts,
         to_minutes(s_suppkey % 12 * 720) AS pre, to_minutes(s_suppkey % 9 * 480) AS post,
         CASE WHEN s_suppkey % 3 = 0 THEN 'veto' ELSE 'size_down' END AS action,
         CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 5) * 0.25 ELSE 0.5 END::DOUBLE AS mult,
         s_suppkey % 10 <> 9 AS active
  FROM supplier),
matches AS (
  SELECT signal_id, id, action, mult FROM sig JOIN rules ON active
    AND (instrument IS NULL OR instrument = symbol)
    AND (block OR event_ts IS NULL OR (created_at >= event_ts - pre AND created_at <= event_ts + post)))"""

TRADES = f"""
trades AS (
  SELECT o_orderkey AS id, (o_custkey % 100)::VARCHAR AS sleeve_id, o_orderdate + to_minutes(o_orderkey % 1440) AS ts,
         {_SYMBOL.format(k='o_orderkey')} AS instrument, CASE WHEN o_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
         (o_orderkey % 10 + 1)::DOUBLE AS size_target,
         CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'vetoed' ELSE 'approved' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN ' priority ' || o_orderpriority END AS veto_reason,
         o_orderkey * 7919 % 20001 - 10000 AS pnl
  FROM orders)"""

CHAIN = """
doc AS (
  SELECT source AS chain_id, doc_id, sha256(text) AS ph, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq
  FROM documents),
links AS (
  SELECT chain_id, doc_id, seq, ph, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ph) AS chain_hash
  FROM doc WHERE seq = 1
  UNION ALL
  SELECT d.chain_id, d.doc_id, d.seq, d.ph, l.chain_hash, sha256(l.chain_hash || d.ph)
  FROM links l JOIN doc d ON d.chain_id = l.chain_id AND d.seq = l.seq + 1)"""

# chains over payloads that hold the hash of a text, and the edits made to their lines
EDITED = CHAIN.replace(
    "sha256(text) AS ph", """sha256('{"doc_id":' || doc_id || ',"sha":"' || sha256(text) || '"}') AS ph"""
) + """,
edited AS (
  SELECT *, CASE WHEN doc_id % 131 = 11 THEN 'seq' WHEN doc_id % 113 = 5 THEN 'payload_hash'
                 WHEN doc_id % 127 = 9 THEN 'prev_hash' END AS bad FROM links)"""

_SRC, _DST = accent_tables()
_TOKENS = f"regexp_extract_all(translate(lower({{x}}), '{_SRC}', '{_DST}'), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+')"

INDEX = f"""
notes AS (
  SELECT source || '/' || doc_id || '.md' AS path, 'DOC-' || doc_id AS id_key, doc_id, 'doc ' || doc_id AS title, lang, source,
         list_distinct(['DOC-' || doc_id, 'DOC-' || (doc_id // 2), 'DOC-' || (doc_id // 3)]) AS links,
         {_TOKENS.format(x="'doc ' || doc_id || chr(10) || lang || chr(10) || text")} AS toks
  FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM notes),
postings AS (
  SELECT path, term, len, count(*) AS tf
  FROM (SELECT path, unnest(toks) AS term, len(toks) AS len FROM notes) GROUP BY 1, 2, 3)"""

BM25 = f"""{INDEX},
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
qt AS (
  SELECT item_id AS query_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (
  SELECT query_id, term, qtf * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS w FROM qt JOIN df USING (term), corpus),
bm AS (
  SELECT query_id, path, -sum(w * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))) AS score
  FROM postings JOIN qw USING (term), corpus GROUP BY 1, 2)"""

RANKED = f"""{BM25},
keys AS (
  SELECT key, max(path) AS target
  FROM (SELECT id_key AS key, path FROM notes UNION ALL SELECT doc_id::VARCHAR, path FROM notes) GROUP BY 1),
base AS (
  SELECT b.query_id, b.path, b.score, n.links, n.lang = 'en' AS by_inst,
         n.source = 'src' || (b.query_id % 20) AS by_regime, contains(lower(q.text), n.lang) AS by_tag
  FROM bm b JOIN notes n USING (path) JOIN benchmark q ON q.item_id = b.query_id),
hits AS (
  SELECT e.query_id, k.target AS path, count(*) AS n_links
  FROM (SELECT query_id, path, unnest(links) AS key FROM base) e JOIN keys k USING (key)
  WHERE k.target <> e.path GROUP BY 1, 2),
scored AS (
  SELECT query_id, path, round(score - (CASE WHEN by_inst THEN 0.5 ELSE 0 END + CASE WHEN by_regime THEN 0.4 ELSE 0 END
           + CASE WHEN by_tag THEN 0.3 ELSE 0 END + coalesce(n_links, 0) * 0.2::DOUBLE), 9) AS s,
         concat_ws(',', 'bm25', CASE WHEN by_inst THEN 'instrument' END, CASE WHEN by_regime THEN 'regime' END,
           CASE WHEN by_tag THEN 'tag' END, CASE WHEN n_links > 0 THEN 'graph' END) AS reasons
  FROM base LEFT JOIN hits USING (query_id, path))"""

CARDS = """
bt AS (
  SELECT 'sleeve_' || (l_suppkey + 5) AS sleeve_id, ascii(l_returnflag) AS o,
         sum(round(l_discount * 100)::BIGINT) / count(*)::DOUBLE / 10 AS dsr,
         sum(round(l_tax * 100)::BIGINT) / count(*)::DOUBLE / 8 AS pbo,
         sum(round(l_tax * 100)::BIGINT) / count(*)::DOUBLE / 20 AS max_dd_pct,
         sum(round(l_discount * 100)::BIGINT) / count(*)::DOUBLE / 50 AS sharpe_mean, count(*) AS n_paths
  FROM lineitem GROUP BY l_suppkey, l_returnflag),
last_bt AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY sleeve_id ORDER BY o DESC) = 1),
reg AS (
  SELECT 'sleeve_' || s_suppkey AS sleeve_id, s_name AS name, 'B' AS track,
         CASE WHEN s_suppkey % 2 = 0 THEN 'paper' ELSE 'live' END AS status FROM supplier),
cards AS (
  SELECT sleeve_id, coalesce(name, sleeve_id) AS name, track, coalesce(status, 'research') AS status,
         round(dsr, 6) AS dsr, round(pbo, 6) AS pbo, round(max_dd_pct, 6) AS max_dd_pct,
         round(sharpe_mean, 6) AS sharpe_mean, n_paths,
         CASE WHEN dsr IS NULL OR pbo IS NULL THEN 'PENDING' WHEN dsr > 0 AND pbo < 0.5 THEN 'GO' ELSE 'NO-GO' END AS verdict
  FROM reg FULL JOIN last_bt USING (sleeve_id))"""

WEIGHTS = f"""{RETS},
s AS (
  SELECT instrument AS sleeve_id, count(log_ret) AS n_obs, avg(log_ret) AS mu, greatest(var_samp(log_ret), 1e-12) AS v,
         CASE instrument WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 4 ELSE 0 END / 8.0::DOUBLE AS prior
  FROM rets GROUP BY 1),
p AS (SELECT *, (n_obs * mu / v) / (n_obs / v + 1 / v) AS post_mean, sqrt(1 / (n_obs / v + 1 / v)) AS sd FROM s),
z AS (SELECT *, post_mean / sd AS post_z, 0.5 * greatest(post_mean / sd, 0) ** 2 AS log_evidence, mu / sqrt(v) AS sharpe FROM p),
w AS (SELECT *, prior * exp(log_evidence) / sum(prior * exp(log_evidence)) OVER () AS weight FROM z)"""

CSV = """csv AS (
  SELECT instrument, ts, CASE WHEN hour(ts) % 13 <> 3 THEN open END AS open, high, low, close,
         volume + CASE WHEN hour(ts) % 5 = 0 THEN 1000 ELSE 0 END AS volume FROM bars)"""

# the same over two tracks, one of which mirrors the other
TRACK_GATES = (
    EQUITY.replace("AS equity FROM pnl)", """AS equity FROM pnl),
tracks AS (SELECT sleeve_id, 'B' AS track, ts, equity FROM eq
  UNION ALL SELECT sleeve_id, 'A', ts, 400000.0::DOUBLE - equity FROM eq)""")
    .replace("max(equity) OVER (PARTITION BY sleeve_id ORDER BY ts) AS peak_equity FROM eq", "max(equity) OVER (PARTITION BY sleeve_id, track ORDER BY ts) AS peak_equity FROM tracks")
    .replace("SELECT sleeve_id, ts, round(dd, 6)", "SELECT sleeve_id, track, ts, round(dd, 6)")
    .replace("lag(gate_level) OVER (PARTITION BY sleeve_id ORDER BY ts)", "lag(gate_level) OVER (PARTITION BY sleeve_id, track ORDER BY ts)")
)

STATE = f"""{EQUITY},
e1 AS (SELECT * FROM ddc ORDER BY ts DESC, sleeve_id DESC LIMIT 1),
g1 AS (SELECT * FROM gates ORDER BY ts DESC, sleeve_id DESC LIMIT 1),
state AS (
  SELECT round(equity, 2) AS equity, round(peak_equity, 2) AS peak_equity, round(dd, 6) AS drawdown_pct,
         round(pnl / 100.0::DOUBLE, 2) AS realized_pnl, gate_level, sizing_mult, current_dd_pct,
         strftime(e1.ts, '%Y-%m-%d %H:%M:%S') AS as_of
  FROM e1, g1)"""

NOTE_TEXT = """
note AS (
  SELECT doc_id, source || '/DEC-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '-' || doc_id || '.md' AS path,
         'DEC-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END AS id_key,
         ['proposed', 'accepted', 'superseded', 'draft'][doc_id % 4 + 1] AS status, source, lang,
         chr(10) || '[[DOC-' || (doc_id // 2) || '|half]] [[DOC-' || (doc_id // 3) || ']]' || chr(10) || text AS body
  FROM documents)"""

WINDOWS = f"""{RETS},
dec AS (
  SELECT instrument, pos AS d, close AS dclose, n FROM rets WHERE pos >= 100 AND (pos - 100) % 25 = 0 AND pos < n - 1),
win AS (
  SELECT x.instrument, x.d, x.dclose, r.pos - (x.d - 100) AS i, r.close
  FROM dec x JOIN rets r ON r.instrument = x.instrument AND r.pos >= x.d - 100 AND r.pos < x.d)"""

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _r(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


ORACLE = {
    "bars_hourly": f"WITH {BARS} SELECT instrument, {_TS}, open, high, low, close, volume FROM bars",
    "bars_quality": f"""WITH {BARS},
b AS (SELECT instrument, close, hour(ts) AS h, CASE WHEN hour(ts) = 3 THEN low - 1 ELSE high END AS high,
             CASE WHEN hour(ts) = 5 THEN close + 1 ELSE low END AS low,
             CASE WHEN hour(ts) = 7 THEN -volume ELSE volume END AS volume,
             CASE WHEN hour(ts) = 9 THEN NULL ELSE open END AS open FROM bars)
SELECT instrument, count(*) AS n_bars, 0::BIGINT AS bad_timestamp, count_if(open IS NULL)::BIGINT AS not_numeric,
       count_if(high < low)::BIGINT AS high_below_low, count_if(high < open OR high < close)::BIGINT AS high_below_open_close,
       count_if(low > open OR low > close)::BIGINT AS low_above_open_close, count_if(volume < 0)::BIGINT AS negative_volume
FROM b GROUP BY 1""",
    "bar_return_series": f"WITH {RETS} SELECT instrument, {_TS}, {_r(8, 'log_ret')}, round(ret, 8) + 0.0::DOUBLE AS simple_ret FROM rets",
    "rolling_vol": f"WITH {FEATURES} SELECT instrument, {_TS}, lookback::BIGINT AS lookback, {_r(8, 'vol', 'prev_mom')} FROM features",
    "returns_panel": f"WITH {PANEL} SELECT sleeve_id, config_id, t, {_r(8, 'ret')} FROM panel",
    "drawdowns": f"WITH {PANEL}, {_EQUITY_LINE} SELECT sleeve_id, config_id, {_r(6, 'max_dd')} FROM dd",
    "sharpe_stats": f"WITH {STATS} SELECT sleeve_id, config_id, n_obs, {_r(6, 'mean', 'std', 'sharpe', 'skew', 'kurt')} FROM stats",
    "cpcv_roles": f"""WITH {BLOCKS},
idx AS (SELECT sleeve_id, t, grp, count(*) OVER (PARTITION BY sleeve_id) AS n FROM blocked WHERE config_id = 0),
ends AS (SELECT sleeve_id, grp, min(t) AS lo, max(t) AS hi FROM idx GROUP BY 1, 2),
runs(combo_id, a, b) AS (VALUES {_RUN_ROWS}),
spans AS (SELECT combo_id, x.sleeve_id, x.lo, y.hi FROM runs JOIN ends x ON x.grp = a JOIN ends y ON y.grp = b AND y.sleeve_id = x.sleeve_id)
SELECT i.sleeve_id, combo_id::BIGINT AS combo_id, t,
       CASE WHEN bool_or(t BETWEEN lo AND hi) THEN 'test'
            WHEN bool_or(t BETWEEN lo - round_even(n * 0.02::DOUBLE, 0) AND hi + round_even(n * 0.01::DOUBLE, 0)) THEN 'dropped'
            ELSE 'train' END AS role
FROM idx i JOIN spans s ON s.sleeve_id = i.sleeve_id GROUP BY 1, 2, 3""",
    "cpcv_path_sharpe": f"WITH {PATHS} SELECT sleeve_id, config_id, combo_id::BIGINT AS combo_id, n_test, {_r(6, 'path_sharpe')} FROM paths",
    "cscv_combinations": f"WITH {CSCV} SELECT sleeve_id, mask, best_config, {_r(6, 'oos_rank', 'logit')} FROM logits",
    "pbo_cscv": f"WITH {CSCV} SELECT sleeve_id, {_r(6, 'pbo', 'median_logit')}, n_combos FROM pbo",
    "deflated_sharpe": f"WITH {STATS}, {_DSR} SELECT sleeve_id, config_id, n_obs, {_r(6, 'sharpe', 'sr0', 'z', 'dsr')} FROM dsr",
    "sleeve_validation": f"""WITH {CSCV}, {STATS[len(PANEL) + 1:]}, {_DSR}, {PATHS[len(BLOCKS) + 1:]}, {_EQUITY_LINE},
p AS (
  SELECT sleeve_id, avg(path_sharpe) AS sharpe_mean, stddev_samp(path_sharpe) AS sharpe_std
  FROM paths JOIN dsr USING (sleeve_id, config_id) GROUP BY 1),
v AS (
  SELECT sleeve_id, CASE WHEN dsr > 0 AND pbo < 0.5 THEN 'GO' ELSE 'NO-GO' END AS verdict, 15::BIGINT AS n_paths,
         n_combos, config_id AS candidate_col, 5::BIGINT AS n_configs, sharpe_mean, sharpe_std, dsr, pbo, median_logit,
         max_dd AS max_dd_pct, sharpe_mean / max_dd AS calmar
  FROM dsr JOIN p USING (sleeve_id) JOIN pbo USING (sleeve_id) JOIN dd USING (sleeve_id, config_id))
SELECT sleeve_id, verdict, n_paths, n_combos, candidate_col, n_configs,
       {_r(6, 'sharpe_mean', 'sharpe_std', 'dsr', 'pbo', 'median_logit', 'max_dd_pct', 'calmar')} FROM v""",
    "csv_bars": f"""WITH {BARS}, {{csv}} SELECT instrument, {_TS}, open, high, low, close, volume FROM csv""".replace("{csv}", CSV),
    "bar_rejects": f"""WITH {BARS} SELECT instrument, {_TS}, 'not_numeric' AS violations FROM bars WHERE hour(ts) % 13 = 3""",
    "fallback_bars": f"""WITH {BARS}, {{csv}} SELECT instrument, {_TS}, open, high, low, close, volume FROM csv WHERE instrument IN ('click', 'error')
UNION ALL SELECT instrument, {_TS}, open, high, low, close, volume * 10 FROM bars WHERE instrument NOT IN ('click', 'error')""".replace("{csv}", CSV),
    "bma_log": f"""WITH {WEIGHTS} SELECT 'agent:signal:bma' AS actor, 'run' AS event_key, sleeve_id, round(weight, 8) AS weight FROM w""",
    "bma_posterior": f"""WITH {WEIGHTS}
SELECT sleeve_id, n_obs, {_r(6, 'weight', 'prior', 'log_evidence', 'post_mean', 'post_z', 'sharpe')} FROM w""",
    "cost_calibration": f"""WITH {CAL}
SELECT instrument, hour_utc, n_samples, {_r(5, 'spread_ticks_mean', 'spread_ticks_p95')},
       round(impact, 5) + 0.0::DOUBLE AS impact_eta, round(impact, 5) + 0.0::DOUBLE AS impact_gamma, {_r(5, 'slippage_var')},
       1.0::DOUBLE AS tick_value FROM cal""",
    "calibration_increments": f"""WITH {CAL}
SELECT instrument, hour_utc, n_samples, {_r(5, 'spread_ticks_mean', 'spread_ticks_p95')},
       round(impact, 5) + 0.0::DOUBLE AS impact_eta, round(impact, 5) + 0.0::DOUBLE AS impact_gamma, {_r(5, 'slippage_var')},
       1.0::DOUBLE AS tick_value FROM cal""",
    "order_costs": f"""WITH {CAL},
o AS (SELECT o_orderkey AS order_id, ['click', 'error', 'purchase', 'signup', 'view'][o_custkey % 5 + 1] AS instrument,
             o_orderkey % 24 AS hour_utc, o_orderkey % 20 + 1 AS size FROM orders),
x AS (SELECT order_id, instrument, hour_utc, size, 0.5 * spread_ticks_mean * size + 2 * impact * size * size AS cost
      FROM o LEFT JOIN cal USING (instrument, hour_utc))
SELECT order_id, instrument, hour_utc, size, {_r(4, 'cost')} FROM x""",
    "equity_curve": f"WITH {EQUITY} SELECT sleeve_id, {_TS}, {_r(2, 'equity', 'peak_equity')}, {_r(6, 'dd')} FROM ddc",
    "equity_gates": f"""WITH {EQUITY} SELECT sleeve_id, {_TS}, current_dd_pct, gate_level, sizing_mult, previous_level,
       coalesce(previous_level, 'normal') <> gate_level AS tripped FROM gates""",
    "gate_trips": f"""WITH {EQUITY} SELECT sleeve_id, {_TS}, coalesce(previous_level, 'normal') AS from_level, gate_level, current_dd_pct
FROM gates WHERE coalesce(previous_level, 'normal') <> gate_level""",
    "global_gate_trips": f"""WITH {EQUITY},
g AS (SELECT sleeve_id, ts, gate_level, lag(gate_level) OVER (ORDER BY ts, sleeve_id) AS previous_level FROM lev)
SELECT sleeve_id, {_TS}, previous_level, gate_level FROM g WHERE coalesce(previous_level, 'normal') <> gate_level""",
    "current_gates": f"""WITH {EQUITY} SELECT sleeve_id, {_TS}, gate_level, sizing_mult FROM gates
QUALIFY row_number() OVER (PARTITION BY sleeve_id ORDER BY gates.ts DESC) = 1""",
    "kill_switch": f"""SELECT user_id AS switch_id, event_type = 'error' AS triggered, CASE WHEN event_type = 'error' THEN props END AS reason,
       event_id::VARCHAR AS actor, {_TS} FROM events WHERE event_type IN ('error', 'signup')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC) = 1""",
    "trade_day_counters": f"""WITH {TRADES}
SELECT id, instrument, (count(*) OVER w)::BIGINT AS trades_today, coalesce(sum(pnl) OVER w, 0)::BIGINT AS daily_pnl FROM trades
WINDOW w AS (PARTITION BY instrument, ts::DATE ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "signal_validity": f"""WITH {SIGNALS} SELECT signal_id, concat_ws(',',
  CASE WHEN length(justification) < 10 THEN 'justification' END,
  CASE WHEN (direction = 'LONG' AND stop_c >= entry_c) OR (direction = 'SHORT' AND stop_c <= entry_c) THEN 'stop_side' END,
  CASE WHEN (direction = 'LONG' AND tp_c <= entry_c) OR (direction = 'SHORT' AND tp_c >= entry_c) THEN 'target_side' END) AS problems
FROM sig""",
    "hard_rules": f"""WITH {SIGNALS}, {_hard_rules('A')}
SELECT signal_id, failed, CASE WHEN failed = '' THEN 0 ELSE len(string_split(failed, ',')) END AS n_failed FROM hard""",
    "rule_matches": f"WITH {SIGNALS}, {RULES} SELECT signal_id, id, action FROM matches",
    "size_multipliers": f"""WITH {SIGNALS}, {RULES}
SELECT signal_id, round(product(mult), 9) + 0.0::DOUBLE AS ontology_mult, count(*) AS n_size_down
FROM matches WHERE action = 'size_down' GROUP BY 1""",
    "risk_verdicts": f"""WITH {SIGNALS}, {_hard_rules('C')}, {RULES},
eff AS (SELECT signal_id, count(*) AS n_rules, count_if(action = 'veto') AS n_veto,
               coalesce(product(mult) FILTER (action = 'size_down'), 1) AS m FROM matches GROUP BY 1),
sized AS (
  SELECT *, floor(least(size, greatest(0, (equity_c::HUGEINT * CASE WHEN setup_type = 'SCALP_EMA' THEN 7 ELSE 13 END)
                  // (risk_c::HUGEINT * 1000))) * coalesce(m, 1) + 1e-9)::BIGINT AS cut
  FROM hard LEFT JOIN eff USING (signal_id)),
v AS (
  SELECT *, CASE WHEN failed <> '' OR coalesce(n_veto, 0) > 0 OR cut = 0 THEN 'REJECT'
                 WHEN firm = 'APEX' OR cut * risk_c >= 100000 THEN 'APPROVE_PENDING_HUMAN' ELSE 'APPROVE' END AS verdict
  FROM sized)
SELECT signal_id, verdict, CASE WHEN verdict = 'REJECT' THEN 0 ELSE cut END AS approved_size_contracts,
       verdict = 'APPROVE_PENDING_HUMAN' AS requires_human_confirm,
       11 + CASE WHEN failed = '' THEN coalesce(n_rules, 0) ELSE 0 END AS n_checks FROM v""",
    "signal_verdicts": f"""WITH {SIGNALS}, {RULES}, {EQUITY},
snap AS (
  SELECT account_id, firm, equity_c, pnl_c, trades_today, losses, dd_c, consistency,
         TIMESTAMP '1993-01-01' + to_days((account_id % 300)::INTEGER) AS snapped FROM acct
  UNION ALL
  SELECT account_id, firm, equity_c, CASE WHEN account_id % 7 <> 0 THEN pnl_c END,
         CASE WHEN account_id % 11 <> 0 THEN (account_id + 1) % 5 END, losses,
         CASE WHEN account_id % 13 <> 0 THEN dd_c END, consistency,
         TIMESTAMP '1993-01-01' + to_days((account_id % 300 + 1000)::INTEGER) FROM acct),
acc AS (
  SELECT sig.*, firm, equity_c, pnl_c, trades_today, losses, dd_c, consistency,
         CASE WHEN abs(entry_c - stop_c) > 0
           THEN (abs(tp_c - entry_c) / 100.0::DOUBLE) / (abs(entry_c - stop_c) / 100.0::DOUBLE) ELSE 0 END AS rr,
         CASE setup_type WHEN 'SCALP_EMA' THEN 1.5 WHEN 'NEWS_DRIVEN' THEN 2.5 ELSE 2.0 END AS rr_floor,
         strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%H:%M:%S') AS ny,
         (sig.account_id % 100)::VARCHAR AS sleeve
  FROM sig ASOF LEFT JOIN snap ON sig.account_id = snap.account_id AND created_at >= snapped),
gated AS (
  SELECT acc.*, gate_level, sizing_mult FROM acc ASOF LEFT JOIN gates ON sleeve = gates.sleeve_id AND created_at >= gates.ts),
judged AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN firm IS NULL OR coalesce(trades_today, 0) >= 3 THEN 'max_daily_trades' END,
    CASE WHEN firm IS NULL OR losses >= 3 THEN 'max_consecutive_losses' END,
    CASE WHEN pnl_c IS NULL OR (pnl_c / 100.0::DOUBLE) / 50000.0::DOUBLE * 100 <= -5.0 THEN 'max_daily_loss' END,
    CASE WHEN firm IS NULL OR coalesce(dd_c, 0) / 100.0::DOUBLE >= 1250.0 THEN 'trailing_dd_buffer' END,
    CASE WHEN rr < rr_floor THEN 'risk_reward_minimum' END,
    CASE WHEN k % 29 = 0 OR confidence < 0.55::DOUBLE THEN 'confidence_threshold' END,
    CASE WHEN firm = 'APEX' AND consistency > 28 THEN 'apex_consistency_30_pct' END,
    CASE WHEN setup_type = 'SCALP_EMA' AND (firm IS NULL OR firm = 'APEX') THEN 'scalp_only_in_allowed_mode' END,
    CASE WHEN setup_type = 'SCALP_EMA' AND NOT (ny BETWEEN '08:30:00' AND '11:30:00' OR ny BETWEEN '14:00:00' AND '15:45:00')
         THEN 'scalp_window' END], lambda x: x IS NOT NULL)) AS failed
  FROM gated),
twice AS (SELECT *, CASE WHEN split_part(id, '_', 2)::BIGINT % 20 = 3 THEN 2 ELSE 1 END AS times FROM matches),
eff AS (
  SELECT signal_id, count(DISTINCT id) AS n_ids, count_if(action = 'veto') AS n_veto,
         coalesce(round(product(pow(mult, times)) FILTER (action = 'size_down'), 12), 1) AS m FROM twice GROUP BY 1),
sized AS (
  SELECT *, floor(floor(least(size, greatest(0, (equity_c::HUGEINT * CASE WHEN setup_type = 'SCALP_EMA' THEN 7 ELSE 13 END)
                  // (risk_c::HUGEINT * 1000))) * coalesce(m, 1)) * coalesce(sizing_mult, 1))::BIGINT AS cut
  FROM judged LEFT JOIN eff USING (signal_id)),
v AS (
  SELECT *, CASE WHEN len(failed) > 0 OR coalesce(n_veto, 0) > 0 OR coalesce(cut, 0) = 0 THEN 'REJECT'
                 WHEN firm = 'APEX' OR cut * risk_c >= 100000 THEN 'APPROVE_PENDING_HUMAN' ELSE 'APPROVE' END AS verdict
  FROM sized)
SELECT 'off' AS switch, signal_id, verdict, CASE WHEN verdict = 'REJECT' THEN 0 ELSE cut END AS approved_size_contracts,
       verdict = 'APPROVE_PENDING_HUMAN' AS requires_human_confirm, array_to_string(failed, ',') AS failed,
       11 + CASE WHEN len(failed) > 0 THEN 0 ELSE coalesce(n_ids, 0)
         + CASE WHEN coalesce(n_veto, 0) = 0 AND gate_level IS NOT NULL THEN 1 ELSE 0 END END AS n_checks FROM v
UNION ALL SELECT 'on', signal_id, 'REJECT', 0, false, 'kill_switch_check', 1 FROM sig""",
    "asof_gates": f"""WITH {TRADES}, {EQUITY}
SELECT id, t.sleeve_id, strftime(g.ts, '%Y-%m-%d') AS gate_day, gate_level, sizing_mult
FROM trades t ASOF LEFT JOIN gates g ON t.sleeve_id = g.sleeve_id AND t.ts >= g.ts""",
    "asof_ticks": """SELECT p.event_id, p.user_id, coalesce(v.event_id, -1) AS view_id, v.value AS view_value
FROM events p LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts
WHERE p.event_type = 'purchase'
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) = 1""",
    "chain_links": f"WITH RECURSIVE {CHAIN} SELECT chain_id, doc_id, seq, prev_hash, chain_hash FROM links",
    "chain_verify": f"""WITH RECURSIVE {CHAIN},
c AS (SELECT *, CASE WHEN doc_id % 113 = 5 THEN 'payload_hash' WHEN doc_id % 127 = 9 THEN 'prev_hash' END AS bad FROM links)
SELECT chain_id, count(*) AS n_events, coalesce(min(seq) FILTER (bad IS NOT NULL), -1) AS first_bad, count(bad) = 0 AS ok,
       arg_min(bad, seq) FILTER (bad IS NOT NULL) AS first_failure, arg_max(chain_hash, seq) AS tip FROM c GROUP BY 1""",
    "log_verify": f"""WITH RECURSIVE {EDITED}
SELECT chain_id, count(*) AS n_events, coalesce(min(seq) FILTER (bad IS NOT NULL), -1) AS first_bad, count(bad) = 0 AS ok,
       arg_min(bad, seq) FILTER (bad IS NOT NULL) AS first_failure, arg_max(chain_hash, seq) AS tip FROM edited GROUP BY 1""",
    "log_digests": f"""WITH RECURSIVE {CHAIN},
hashed AS (
  SELECT chain_id, seq, sha256(length(seq::VARCHAR) || ':' || seq || '64:' || ph || '64:' || prev_hash || '64:' || chain_hash) AS h FROM links),
lv AS (SELECT k AS level, (4 ** k)::BIGINT AS wide FROM range(0, 20) r(k) WHERE k = 0 OR (SELECT max(seq) // 16 FROM links) // (4 ** (k - 1))::BIGINT > 0)
SELECT chain_id, level, seq // 16 // wide AS node, count(*) AS n_events, {" || '-' || ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT)::VARCHAR" for k in range(4))} AS digest
FROM hashed, lv GROUP BY 1, 2, 3""",
    "differing_log_ranges": f"""WITH RECURSIVE {EDITED}
SELECT chain_id, seq // 16 * 16 AS first, seq // 16 * 16 + 15 AS last, count(*) AS n_left, count(*) AS n_right
FROM edited GROUP BY chain_id, seq // 16 HAVING count(bad) > 0""",
    "audit_replay": f"""WITH RECURSIVE {EDITED},
sums AS (
  SELECT chain_id, count(*) AS n, count(bad) = 0 AS log_ok, arg_max(chain_hash, seq) AS log_tip,
         arg_max(chain_hash, CASE WHEN bad = 'seq' THEN ('9' || seq)::BIGINT ELSE seq END) AS table_tip,
         count_if(coalesce(bad IN ('payload_hash', 'prev_hash') OR (bad = 'seq' AND seq < size), false)) = 0 AS table_ok
  FROM edited JOIN (SELECT chain_id, max(seq) AS size FROM links GROUP BY 1) USING (chain_id) GROUP BY 1)
SELECT chain_id, n AS log_n, n AS table_n, log_ok, table_ok, log_ok AND table_ok AND log_tip = table_tip AS agree, log_tip FROM sums""",
    "log_round_trip": f"""WITH RECURSIVE {EDITED.replace("ORDER BY doc_id)", "ORDER BY doc_id % 2, doc_id)")}
SELECT chain_id, count(*) AS n_events, true AS ok, arg_max(chain_hash, seq) AS tip FROM links GROUP BY 1""",
    "audit_agreement": f"""WITH RECURSIVE {CHAIN}
SELECT chain_id, count(*) AS log_n, count(*) AS table_n, true AS log_ok, true AS table_ok, true AS agree,
       arg_max(chain_hash, seq) AS log_tip, arg_max(chain_hash, seq) AS table_tip FROM links GROUP BY 1""",
    "worst_drawdowns": f"WITH {EQUITY} SELECT sleeve_id, 'B' AS track, round(max(dd), 6) + 0.0::DOUBLE AS max_dd_pct FROM ddc GROUP BY 1",
    "gate_trip_log": f"""WITH {EQUITY}
SELECT row_number() OVER (ORDER BY ts, sleeve_id) AS seq, gate_level AS to_level, sleeve_id, coalesce(previous_level, 'normal') AS from_level,
       current_dd_pct AS drawdown_pct, strftime(ts, '%Y-%m-%d') AS day, true AS ok
FROM gates WHERE coalesce(previous_level, 'normal') <> gate_level""",
    "trade_log": f"""WITH {TRADES}
SELECT sleeve_id AS chain_id, row_number() OVER (PARTITION BY sleeve_id ORDER BY ts, id) AS seq, 'agent:sleeve:' || sleeve_id AS actor, instrument, side,
       size_target::BIGINT AS size, status, id AS trade_id, CASE WHEN status = 'vetoed' THEN 'REJECT' ELSE 'APPROVE' END AS verdict FROM trades""",
    "injected_rules_log": f"""WITH {SIGNALS}, {RULES},
r AS (SELECT *, split_part(id, '_', 2)::BIGINT AS k FROM rules)
SELECT id, strftime(TIMESTAMP '1970-01-01' + to_seconds(ts_s), '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN block THEN 'instrument_block' ELSE 'event_window' END AS rule_type, instrument, action,
       CASE WHEN k % 4 <> 0 THEN ((k % 5) * 0.25)::DOUBLE::VARCHAR END AS size_mult, 'event ' || k AS event, (k % 12 * 720)::DOUBLE AS pre_min,
       strftime(event_ts, '%Y-%m-%d') AS event_day, row_number() OVER (ORDER BY ts_s, id) AS audit_id FROM r WHERE k % 8 <> 5""",
    "recent_regime_rows": f"""SELECT event_id AS regime_id, event_type AS classifier,
       CASE WHEN round(value / 10000, 6) > 0.02 THEN 'shift' ELSE 'stable' END AS regime,
       CASE WHEN event_id % 3 <> 0 THEN coalesce(round(value / 10000, 6), 0) ELSE 0 END + 0.0::DOUBLE AS d_topo, {_TS}
FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50)""",
    "registry_counts": f"""WITH {EQUITY}, {CARDS},
p AS (SELECT count(*) AS n, count_if(day(ts) = 31) AS wrong, count_if(day(ts) = 2) AS twice, count_if(day(ts) = 31 AND day(ts) = 2) AS both FROM eq)
SELECT 'sleeves' AS "table", 'track' AS "check", 0 AS n_bad UNION ALL SELECT 'sleeves', 'status', 0
UNION ALL SELECT 'sleeves', 'dsr', count(*) FROM supplier UNION ALL SELECT 'sleeves', 'pbo', 0
UNION ALL SELECT 'trades', 'track', 0 UNION ALL SELECT 'trades', 'side', 0 UNION ALL SELECT 'trades', 'status', 0
UNION ALL SELECT 'trades', 'sleeve_id in sleeves', count_if(o_orderkey % 11 = 0 OR o_custkey % 10 + 1 NOT IN (SELECT s_suppkey FROM supplier)) FROM orders
UNION ALL SELECT 'executions', 'side', count_if(l_linenumber = 7) FROM lineitem
UNION ALL SELECT 'executions', 'trade_id in trades', count_if(l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem
UNION ALL SELECT 'equity_curve', 'track', 2 * wrong FROM p UNION ALL SELECT 'equity_curve', 'unique(ts,sleeve_id,track)', 0
UNION ALL SELECT 'equity_curve', 'sleeve_id in sleeves', n FROM p
UNION ALL SELECT 'backtest_results', 'n_paths', count_if(n_paths < 10) FROM bt
UNION ALL SELECT 'backtest_results', 'pbo', count_if(pbo * 100 > 1) FROM bt
UNION ALL SELECT 'ontology_rules', 'action', count_if(s_suppkey % 10 = 9) FROM supplier
UNION ALL SELECT 'risk_gates_state', 'gate_level', 0""",
    "decision_replay": """WITH e AS (
  SELECT o_orderkey AS k, 'DEC-' || (o_custkey % 997) AS id, o_orderkey + 1 AS seq,
         ['create', 'accept', 'supersede', 'accept'][o_orderkey % 4 + 1] AS a FROM orders),
m AS (SELECT id, max(seq) FILTER (a = 'create') AS made, max(seq) FILTER (a = 'accept') AS acc0, max(seq) FILTER (a = 'supersede') AS sup0
      FROM e GROUP BY 1),
n AS (SELECT id, made, made - 1 AS k, CASE WHEN acc0 > made THEN acc0 END AS acc, CASE WHEN sup0 > made THEN sup0 END AS sup
      FROM m WHERE made IS NOT NULL)
SELECT id, 'order ' || k AS title, CASE WHEN coalesce(acc, -1) > coalesce(sup, -1) THEN 'accepted' WHEN sup IS NOT NULL THEN 'superseded' ELSE 'proposed' END AS status,
       'clerk ' || (k % 13) AS owner, strftime(TIMESTAMP '1970-01-01' + to_seconds(k), '%Y-%m-%d %H:%M:%S') AS created,
       CASE WHEN sup IS NOT NULL THEN 'DEC-' || ((sup - 1) % 997) END AS superseded_by, sha256(k::VARCHAR) AS content_hash,
       greatest(made, coalesce(acc, 0), coalesce(sup, 0)) AS audit_id FROM n""",
    "rule_replay": f"""WITH e AS (
  SELECT o_orderkey AS k, 'rule_' || (o_custkey % 991) AS id, o_orderkey + 1 AS seq,
         CASE WHEN o_orderkey % 3 = 1 THEN 'deactivate' ELSE 'create' END AS op,
         CASE WHEN o_orderkey % 7 = 0 THEN 'approve' WHEN o_orderkey % 2 = 0 THEN 'veto' ELSE 'size_down' END AS action FROM orders),
m AS (SELECT id, max(seq) FILTER (op = 'create' AND action <> 'approve') AS made, max(seq) FILTER (op = 'deactivate') AS stopped FROM e GROUP BY 1),
n AS (SELECT *, made - 1 AS k, coalesce(stopped > made, false) AS off FROM m WHERE made IS NOT NULL)
SELECT id, strftime(TIMESTAMP '1970-01-01' + to_seconds(k), '%Y-%m-%d %H:%M:%S') AS ts, 'event_window' AS rule_type,
       {_SYMBOL.format(k='k')} AS instrument, CASE WHEN k % 2 = 0 THEN 'veto' ELSE 'size_down' END AS action, '0.25' AS size_mult,
       (k % 60)::DOUBLE AS pre_min, CASE WHEN off THEN stopped ELSE made END AS audit_id, NOT off AS active FROM n""",
    "rejected_rules": """SELECT 'rule_' || (o_custkey % 991) AS id, 'approve' AS action, count(*) AS n FROM orders
WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 1 GROUP BY 1""",
    "rule_requests": """WITH f AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN length(b) > 48 THEN substr(b, 1, 48) || '_' || substr(sha256(text), 1, 8) ELSE b END AS b FROM f)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'rule_' || CASE WHEN b = '' THEN 'unnamed' ELSE b END END AS id,
       CASE WHEN doc_id % 3 = 0 THEN 'action must restrict: approve' ELSE '' END AS error FROM s""",
    "bm25_scores": f"WITH {BM25} SELECT query_id, path, {_r(6, 'score')} FROM bm",
    "retrieval_ranked": f"""WITH {RANKED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, path) AS rank FROM scored)
SELECT query_id, rank, path, round(s, 6) AS score, reasons FROM r WHERE rank <= 10""",
    "stored_index_ranked": f"""WITH {RANKED},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, path) AS rank FROM scored)
SELECT query_id, rank, path, round(s, 6) AS score, reasons FROM r WHERE rank <= 10""",
    "term_frequency": f"WITH {INDEX} SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_tokens FROM postings GROUP BY 1",
    "query_token_counts": """SELECT role, term, count(*) AS n
FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations) GROUP BY 1, 2""",
    "page_link_counts": """WITH p AS (
  SELECT page_id, lpad(page_id::VARCHAR, 12, '0') AS path, '/' || regexp_extract(html, '<title>([^\\s<]*)', 1) AS id_key,
         list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS links FROM pages),
keys AS (SELECT key, max(path) AS target FROM (SELECT id_key AS key, path FROM p UNION ALL SELECT path, path FROM p) GROUP BY 1)
SELECT target::BIGINT AS page_id, count(*) AS n_links
FROM (SELECT path, unnest(links) AS key FROM p) e JOIN keys USING (key) WHERE target <> e.path GROUP BY 1""",
    "note_fields": f"""WITH {NOTE_TEXT}
SELECT n.path, id_key, 'doc ' || n.doc_id AS title, n.source AS folder, n.lang || '|' || n.source AS tags, n.lang AS instrument,
       array_to_string(list_sort(list_distinct(list_concat(['DOC-' || (n.doc_id // 2), 'DOC-' || (n.doc_id // 3)],
         list_transform(regexp_extract_all(d.text, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(string_split(x, '|')[1]))))), '|') AS links,
       sha256(n.body) AS body_hash FROM note n JOIN documents d USING (doc_id)""",
    "note_hashes": f"WITH {NOTE_TEXT} SELECT path, sha256(ltrim(body, chr(10))) AS content_hash FROM note",
    "note_checks": f"""WITH {NOTE_TEXT} SELECT path, concat_ws('; ',
  CASE WHEN doc_id % 5 = 0 THEN 'missing keys: owner' END,
  CASE WHEN doc_id % 11 = 0 THEN 'invalid id: ' || id_key END,
  CASE WHEN status = 'draft' THEN 'invalid status: draft' END,
  CASE WHEN doc_id % 11 = 0 THEN 'id is not the file name prefix' END) AS problems FROM note""",
    "fk_orphans": """WITH o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey FROM orders)
SELECT o_custkey, count(*) AS n_rows FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "constraint_checks": """WITH n AS (SELECT count_if(o_orderstatus = 'P')::BIGINT AS p, count_if(o_orderkey % 9 = 0)::BIGINT AS s,
                   count_if(o_orderstatus <> 'P')::BIGINT AS r FROM orders)
SELECT 'track' AS "check", 0::BIGINT AS n_bad UNION ALL SELECT 'side', s FROM n UNION ALL SELECT 'status', p FROM n
UNION ALL SELECT 'reason_present', r FROM n""",
    "unfilled_executions": """SELECT l_orderkey AS trade_id, count(*) AS n_fills FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
    "latest_orders": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "upserted_accounts": """WITH n AS (SELECT o_custkey * 2 AS id, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT id, v FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)""",
    "absent_customers": """SELECT c_custkey AS id, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)""",
    "recent_trades": f"""WITH {TRADES}
SELECT id AS trade_id, instrument, side, size_target AS size, status, status = 'vetoed' AS vetoed, trim(coalesce(veto_reason, '')) AS reason,
       {_TS} FROM (SELECT * FROM trades ORDER BY ts DESC, id LIMIT 50)""",
    "sleeve_cards": f"WITH {CARDS} SELECT sleeve_id, name, track, status, dsr, pbo, max_dd_pct, sharpe_mean, coalesce(n_paths, -1) AS n_paths, verdict FROM cards",
    "equity_state": f"WITH {STATE} SELECT * FROM state",
    "rule_view": f"""WITH {SIGNALS}, {RULES} SELECT id AS rule_id, CASE WHEN block THEN 'instrument_block' ELSE 'event_window' END AS rule_type,
       instrument, action FROM rules WHERE active""",
    "report_summary": f"""WITH {STATE}, {CARDS}
SELECT gate_level, sizing_mult, equity, drawdown_pct, (SELECT count(*) FROM cards WHERE verdict = 'GO') AS sleeves_go,
       (SELECT count(*) FROM cards WHERE verdict = 'NO-GO') AS sleeves_nogo, (SELECT count(*) FROM cards) AS n_sleeves,
       (SELECT least(50, count(*)) FROM orders) AS n_trades,
       (SELECT count(*) FROM supplier WHERE s_suppkey % 10 <> 9) AS n_rules FROM state""",
    "takens_points": f"""WITH {WINDOWS},
r AS (SELECT instrument, d, i - 1 AS j, ln(close) - ln(lag(close) OVER (PARTITION BY instrument, d ORDER BY i)) AS x FROM win),
s AS (SELECT instrument, d, CASE WHEN j < 49 THEN 'ref' ELSE 'cur' END AS part, CASE WHEN j < 49 THEN j ELSE j - 49 END AS idx, x FROM r WHERE j >= 0),
e AS (SELECT *, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY instrument, d, part ORDER BY idx))
SELECT instrument, d AS pos, idx, part, round(x, 8) AS x0, round(x1, 8) AS x1, round(x2, 8) AS x2 FROM e WHERE x2 IS NOT NULL""",
    "baseline_signals": f"""WITH {WINDOWS},
recent AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument, d ORDER BY i) AS step FROM win WHERE i >= 80),
every AS (SELECT instrument, d, close - lag(close) OVER (PARTITION BY instrument, d ORDER BY i) AS step FROM win),
overall AS (SELECT instrument, d, stddev_pop(step) AS sd_all FROM every GROUP BY 1, 2),
a AS (SELECT instrument, d, dclose, arg_min(close, i) AS c0, stddev_pop(step) AS sd FROM recent GROUP BY 1, 2, 3),
b AS (SELECT *, greatest(0.25, 2.0 * sd) AS dist,
        CASE WHEN CASE WHEN sd > sd_all THEN dclose - c0 < 0 ELSE dclose - c0 >= 0 END THEN 1 ELSE -1 END AS sgn
      FROM a JOIN overall USING (instrument, d))
SELECT instrument, d AS pos, CASE WHEN sgn = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, round(dclose, 2) AS entry_price,
       round(dclose - sgn * dist, 2) AS stop_loss, round(dclose + 2.5 * sgn * dist, 2) AS take_profit_1,
       round(dist * 4.0, 2) AS risk_per_contract_usd FROM b""",
    "stream_bars": f"""WITH {BARS} SELECT instrument, {_TS}, open, high, low, close, volume FROM bars""",
    "stream_gates": f"""WITH {TRACK_GATES} SELECT sleeve_id, track, {_TS}, current_dd_pct, gate_level, sizing_mult, previous_level,
       coalesce(previous_level, 'normal') <> gate_level AS tripped FROM gates""",
    "stream_unique": "SELECT l_suppkey::VARCHAR AS sleeve_id, track, count(DISTINCT l_shipdate) AS n_points FROM lineitem, (VALUES ('A'), ('B')) t(track) GROUP BY 1, 2",
}

ORACLE["stored_accounts"] = ORACLE["upserted_accounts"]
ORACLE["live_projection"] = f"""SELECT 'decision' AS kind, id, status, superseded_by AS detail, audit_id FROM ({ORACLE["decision_replay"]})
UNION ALL SELECT 'rule', id, action, CASE WHEN active THEN 'active' ELSE 'off' END, audit_id FROM ({ORACLE["rule_replay"]})"""
ORACLE["backtest_rows"] = f"""SELECT sleeve_id, 'abc123' AS git_commit, '2026-01-02 03:04:05' AS ts, n_paths,
  row_number() OVER (ORDER BY sleeve_id) AS audit_id, sharpe_mean, sharpe_std, dsr, pbo, max_dd_pct, calmar, candidate_col, sleeve_id AS logged
FROM ({ORACLE["sleeve_validation"]})"""
