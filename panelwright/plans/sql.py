"""The catalogue's answers in DuckDB SQL, put together from named common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "panel": """SELECT n_name AS ticker, r_name AS asset_class, CAST(l_shipdate AS DATE) AS date,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "numbered": "SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS INT) AS pos FROM panel",
    "logret": """SELECT a.ticker, a.asset_class, a.date, a.pos, 100 * (ln(a.close) - ln(b.close)) AS return_pct
      FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND a.pos = b.pos + 1""",
    "simple": """SELECT a.ticker, a.asset_class, a.date, a.pos, a.close, a.close / b.close - 1 AS r
      FROM numbered a LEFT JOIN numbered b ON a.ticker = b.ticker AND a.pos = b.pos + 1""",
    "vol": """SELECT *, CASE WHEN count(r) OVER w >= 63 THEN stddev_samp(r) OVER w END AS sd FROM simple
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
    "sig": """SELECT *, 0.15 / (sd * sqrt(252.0)) AS lev, lead(r) OVER w * (0.15 / (sd * sqrt(252.0))) AS target, lead(date) OVER w AS target_date,
      (close / lag(close, 1) OVER w - 1) / (sd * sqrt(1.0)) AS s0, (close / lag(close, 5) OVER w - 1) / (sd * sqrt(5.0)) AS s1,
      (close / lag(close, 10) OVER w - 1) / (sd * sqrt(10.0)) AS s2, (close / lag(close, 21) OVER w - 1) / (sd * sqrt(21.0)) AS s3,
      (close / lag(close, 42) OVER w - 1) / (sd * sqrt(42.0)) AS s4, (close / lag(close, 63) OVER w - 1) / (sd * sqrt(63.0)) AS s5
      FROM vol WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "usable": "SELECT * FROM sig WHERE sd > 0 AND s5 IS NOT NULL AND target IS NOT NULL",
    "members": " UNION ALL ".join(f"SELECT ticker, asset_class, date, {i} AS member, (exp(2 * least(greatest(s{i}, -20), 20)) - 1) / (exp(2 * least(greatest(s{i}, -20), 20)) + 1) AS position, target, lev FROM usable" for i in range(6)),
    "ens": """SELECT ticker, asset_class, date, avg(position) AS mean, stddev_samp(position) AS sd, min(target) AS target, min(lev) AS lev,
      abs(avg(position)) / (stddev_samp(position) + 1e-9) AS kappa FROM members GROUP BY 1, 2, 3""",
    "ranked": """SELECT a.ticker, a.asset_class, a.date, any_value(a.mean) AS mean, any_value(a.target) AS target, any_value(a.lev) AS lev, any_value(a.kappa) AS kappa,
      CASE WHEN count(b.kappa) >= 63 THEN (sum(CASE WHEN b.kappa < a.kappa THEN 1.0 ELSE 0 END) + 0.5 * sum(CASE WHEN b.kappa = a.kappa THEN 1.0 ELSE 0 END)) / count(b.kappa) END AS rank
      FROM ens a LEFT JOIN ens b ON a.ticker = b.ticker AND b.date < a.date GROUP BY 1, 2, 3""",
    "gated": """SELECT *, coalesce(last_value(CASE WHEN rank IS NULL OR rank >= 0.5 THEN true WHEN rank < 0.25 THEN false END IGNORE NULLS)
      OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), true) AS mask FROM ranked""",
    "days": "SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM gated)",
    "counts": "SELECT date, count(*) AS n, sum(mask::INT) AS a FROM gated GROUP BY 1",
    "capped": """SELECT g.*, day, n, a, CASE WHEN mask THEN 1.0 ELSE 0 END / greatest(CAST(a AS DOUBLE), n / 2.0) AS capital FROM gated g JOIN counts USING (date) JOIN days USING (date)""",
    "norms": "SELECT date, sum(coalesce(rank, 0.5)) AS whole FROM gated WHERE mask GROUP BY 1",
    "confident": """SELECT g.*, day, n, a, least(mask::INT / CAST(n AS DOUBLE) + coalesce(CASE WHEN mask THEN coalesce(rank, 0.5) END / whole * greatest(0.0, (n - a) / CAST(n AS DOUBLE)), 0), 2.0 / n) AS capital
      FROM gated g JOIN counts USING (date) JOIN days USING (date) LEFT JOIN norms USING (date)""",
    "stream": "SELECT event_type AS key, value, ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INT) AS pos FROM events",
    "burn": "SELECT key, avg(value) AS mean, stddev_samp(value) AS scale FROM stream WHERE pos < 50 GROUP BY 1",
    "chart": """SELECT s.key, s.pos, s.value, mean, scale, 0.0::DOUBLE AS um, 0.0::DOUBLE AS lm, 0.0::DOUBLE AS uv, 0.0::DOUBLE AS lv, mean AS ewma FROM stream s JOIN burn USING (key) WHERE pos = 49
      UNION ALL SELECT s.key, s.pos, s.value, c.mean, c.scale, greatest(0, um + (s.value - c.mean) / c.scale - 0.5), greatest(0, lm - (s.value - c.mean) / c.scale - 0.5),
      greatest(0, uv + (pow((s.value - c.mean) / c.scale, 2) - 1) / sqrt(2.0) - 0.5), greatest(0, lv - (pow((s.value - c.mean) / c.scale, 2) - 1) / sqrt(2.0) - 0.5), 0.8 * c.ewma + 0.2 * s.value
      FROM chart c JOIN stream s ON s.key = c.key AND s.pos = c.pos + 1""",
    "stats": """SELECT s.key, s.pos, s.ts, coalesce(greatest(um, lm), 0) AS m, coalesce(greatest(uv, lv), 0) AS v, coalesce(greatest(um, lm, uv, lv), 0) AS c,
      CASE WHEN s.pos >= 50 THEN abs(ewma - mean) / (scale * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (s.pos - 49))))) ELSE 0 END AS e
      FROM stream s LEFT JOIN chart c ON c.key = s.key AND c.pos = s.pos AND c.pos >= 50""",
    "alarms": """SELECT key, pos FROM (SELECT key, pos, m > 4 AS above, coalesce(lag(m > 4) OVER (PARTITION BY key ORDER BY pos), false) AS before FROM stats) WHERE above AND NOT before AND pos >= 50""",
    "pstats": """SELECT ticker AS key, asset_class, date, pos, pos AS at, return_pct AS value FROM logret""",
    "palarms": """SELECT ticker, asset_class, pos FROM (SELECT ticker, asset_class, pos, abs(return_pct) > 150 AS above, coalesce(lag(abs(return_pct) > 150) OVER (PARTITION BY ticker ORDER BY pos), false) AS before FROM logret) WHERE above AND NOT before AND pos >= 50""",
    "event_dim": """SELECT * FROM (VALUES ('first', DATE '1996-06-03', 'ASIA'), ('first', DATE '1996-06-03', 'EUROPE'), ('second', DATE '1998-08-17', 'EUROPE'), ('second', DATE '1998-08-17', 'AMERICA'),
      ('second', DATE '1998-08-17', 'AFRICA'), ('third', DATE '2000-03-10', 'AMERICA'), ('late', DATE '2030-01-01', 'ASIA')) v(event, event_date, asset_class)""",
    "positions": """SELECT event, ticker, asset_class, min(CASE WHEN date >= event_date THEN pos END) AS position FROM logret JOIN event_dim USING (asset_class) GROUP BY 1, 2, 3 HAVING min(CASE WHEN date >= event_date THEN pos END) > 0""",
    "delays": """SELECT p.event, p.ticker, p.asset_class, p.position, min(a.pos - p.position) AS delay FROM positions p LEFT JOIN palarms a ON a.ticker = p.ticker AND a.pos >= p.position AND a.pos < p.position + 50 GROUP BY 1, 2, 3, 4""",
    "netted": "SELECT date, sum(mean * capital * target) AS gross FROM capped GROUP BY 1",
    "changes": "SELECT key, pos AS position FROM stream WHERE pos >= 100 AND pos % 200 = 0",
    "matched": "SELECT c.key, c.position, min(a.pos) AS matched FROM changes c LEFT JOIN alarms a ON a.key = c.key AND a.pos >= c.position AND a.pos < c.position + 50 GROUP BY 1, 2",
    "fits": "SELECT *, 1 - alpha / 2 AS persistence, 1 - 1.5 * alpha AS beta, hbar * alpha / 2 AS omega FROM (SELECT asset_class, ticker, avg(return_pct) AS mean, var_pop(return_pct) AS hbar, avg((return_pct > 100)::INT) AS alpha FROM logret GROUP BY 1, 2)",
    "folio": "SELECT asset_class, date, avg(r) AS r FROM simple WHERE r IS NOT NULL GROUP BY 1, 2",
}
RECURSIVE = {"chart", "likely"}


def _no_minus_zero(select: str) -> str:
    """round(...) AS name with 0.0 added, which turns a minus zero into zero."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", select):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(select[end], 0)
            end += 1
        if select[end : end + 4] == " AS " and m.start() >= at:
            out += select[at : m.start()] + f"({select[m.start():end]} + 0.0)"
            at = end
    return out + select[at:]


def query(select: str, **more: str) -> str:
    """The select with all expressions before it that it needs."""
    select = _no_minus_zero(select)
    known = {**CTES, **more}
    needed: dict[str, str] = {}

    def need(text: str, own: str = "") -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in known and name != own and name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                need(known[name], name)
                needed[name] = known[name]

    need(select)
    if not needed:
        return select
    return f"WITH {'RECURSIVE ' * bool(RECURSIVE & set(needed))}" + ",\n".join(f"{k} AS ({v})" for k, v in needed.items()) + "\n" + select


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


_PERF = """count(r) AS days, avg(r) * 252 AS returns, stddev_samp(r) * sqrt(252) AS vol, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) AS sharpe, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252) AS downside,
  avg((r > 0)::INT) AS positive, avg(CASE WHEN r > 0 THEN r END) / abs(avg(CASE WHEN r < 0 THEN r END)) AS gain_loss"""
_SHARPE = "CASE WHEN count({0}) >= 2 AND stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(252) END"
_TURN = """SELECT *, mean * capital * lev AS h, lag(mean * capital * lev) OVER (PARTITION BY ticker ORDER BY day) AS h0, lag(day) OVER (PARTITION BY ticker ORDER BY day) AS d0 FROM {0}"""
_DAY = "SELECT date, round(sum(mean * capital * target), 6) AS gross, round(coalesce(sum(CASE WHEN day - d0 = 1 THEN abs(h - h0) END), 0), 6) AS turnover, count(*) AS n_available, CAST(sum(mask::INT) AS BIGINT) AS n_active FROM turned GROUP BY 1"


def _ewm(x: str, table: str, decay: str, least: int, where: str = "true") -> dict[str, str]:
    """Weighted sums over each row and those before it."""
    w = f"pow({decay}, a.pos - b.pos)"
    return {"sums": f"SELECT a.ticker, a.date, a.pos, any_value(a.{x}) AS x, count(b.{x}) AS n, sum({w}) AS w, sum({w} * {w}) AS ww, sum({w} * b.{x}) AS wx, sum({w} * b.{x} * b.{x}) AS wxx FROM {table} a LEFT JOIN {table} b ON a.ticker = b.ticker AND b.pos <= a.pos AND b.{x} IS NOT NULL GROUP BY 1, 2, 3",
            "moments": f"SELECT ticker, date, pos, x, n, wx / w AS mean, CASE WHEN n >= {least} THEN sqrt(greatest(0, (wxx / w - pow(wx / w, 2)) * w * w / (w * w - ww))) END AS sd FROM sums"}


ORACLES: dict[str, str] = {
    "src_panel": query("SELECT ticker, asset_class, date, round(close, 6) AS close FROM panel"),
    "src_integrity": query("SELECT ticker, count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_dates, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS not_positive FROM panel GROUP BY 1"),
    "src_universe_unknown": query("SELECT ticker FROM (VALUES ('NATION_3'), ('ATLANTIS'), ('NATION_7'), ('LEMURIA')) v(ticker) WHERE ticker NOT IN (SELECT ticker FROM panel)"),
    "src_study_view": query("SELECT ticker, date, round(close, 6) AS close FROM panel WHERE date >= DATE '1999-01-01'"),
    "proj_log_return": query("SELECT ticker, date, round(return_pct, 6) AS return_pct FROM logret"),
    "proj_simple_return": query("SELECT ticker, date, round(r, 6) AS r FROM simple WHERE r IS NOT NULL"),
    "proj_horizon_returns": query("SELECT ticker, date, " + ", ".join(f"round(close / lag(close, {h}) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS ret_{h}" for h in (1, 21, 63, 126, 252)) + " FROM panel"),
    "proj_lead_target": query("SELECT ticker, date, round(lead(r) OVER w, 6) AS next_return, lead(date) OVER w AS target_date FROM simple WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    "proj_leverage": query("SELECT ticker, date, round(lev, 6) AS lev, round(target, 6) AS target FROM sig WHERE sd > 0"),
    "proj_clip": query("SELECT ticker, date, round(least(greatest(return_pct / 21, 0), 1), 6) AS clipped FROM logret"),
    "proj_likelihood": query("SELECT ticker, date, round(-0.5 * (ln(2 * pi()) + ln(400.0) + pow(return_pct, 2) / 400), 6) AS gaussian, round(lgamma(3.5) - lgamma(3.0) - 0.5 * ln(4 * pi()) - 0.5 * ln(400.0) - 3.5 * ln(1 + pow(return_pct, 2) / 1600), 6) AS student FROM logret"),
    "proj_log_sum_exp": query("SELECT ticker, round(max(return_pct) + ln(sum(exp(return_pct - top))), 6) AS lse FROM logret JOIN tops USING (ticker) GROUP BY ticker", tops="SELECT ticker, max(return_pct) AS top FROM logret GROUP BY 1"),
    "proj_labels": "SELECT n_name AS name, lower(replace(replace(n_name || '@A-B', '@', '_at_'), '-', '_')) AS safe, CASE WHEN n_nationkey = 0 THEN 'Gaussian' ELSE 't(' || n_nationkey || ')' END AS law, make_date(greatest(1999, CAST(1990 + n_nationkey AS INT)), 1, 1) AS start FROM nation",
    "win_rolling_sd": query("SELECT ticker, date, round(sd, 6) AS sd FROM vol"),
    "win_ewm_vol": query("SELECT ticker, date, round(sd, 6) AS daily_volatility FROM moments", **_ewm("r", "simple", "(1 - 2.0 / 61)", 60)),
    "win_winsorize": query("SELECT ticker, date, round(CASE WHEN sd IS NULL THEN x ELSE greatest(mean - 5 * sd, least(mean + 5 * sd, x)) END, 5) AS wins FROM moments", **_ewm("close", "numbered", "pow(0.5, 1.0 / 252)", 2)),
    "win_macd": query(
        """SELECT ticker, date, round(CASE WHEN count(q) OVER w >= 252 THEN q / stddev_samp(q) OVER w END, 5) AS macd_8_24 FROM quotient WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""",
        quotient="""SELECT ticker, date, (f - s) / CASE WHEN count(close) OVER w >= 63 THEN stddev_samp(close) OVER w END AS q FROM means WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
        means="""SELECT a.ticker, a.date, any_value(a.close) AS close, sum(pow(7.0 / 9, a.pos - b.pos) * b.close) / sum(pow(7.0 / 9, a.pos - b.pos)) AS f, sum(pow(23.0 / 25, a.pos - b.pos) * b.close) / sum(pow(23.0 / 25, a.pos - b.pos)) AS s
          FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND b.pos <= a.pos GROUP BY 1, 2""",
    ),
    "win_burn_in_flag": query("SELECT ticker, date, day <= 126 AS burning FROM gated JOIN days USING (date)"),
    "win_drawdown": query(
        "SELECT asset_class, date, round(w, 4) AS wealth, round(w / max(w) OVER (PARTITION BY asset_class ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM wealth",
        wealth="SELECT asset_class, date, product(1 + r * 0.05) OVER (PARTITION BY asset_class ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM folio",
    ),
    "filt_train_split": query(
        "SELECT ticker, part, count(*) AS rows, min(date) AS first, max(date) AS last FROM (SELECT *, CASE WHEN p < floor(0.9 * n) THEN 'train' ELSE 'validation' END AS part FROM kept WHERE n - floor(0.9 * n) >= 63) GROUP BY 1, 2",
        kept="SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY ticker) AS n FROM usable WHERE date <= DATE '1998-12-31' AND target_date <= DATE '1998-12-31'",
    ),
    "filt_eligible": query("SELECT ticker, count(*) AS n FROM usable WHERE target_date <= DATE '1998-12-31' GROUP BY 1 HAVING count(*) >= 500"),
    "arr_blocks63": query(
        "SELECT ticker, CAST(p // 63 AS INT) AS block, CAST(63 AS INT) AS steps, count(*) AS real_steps, round(sum(CAST(lev AS FLOAT)), 3) AS lev_sum FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS p FROM usable) GROUP BY 1, 2",
    ),
    "arr_trailing63": query(
        "SELECT ticker, date, CAST(63 AS INT) AS steps, round(f, 3) AS first_lev FROM (SELECT ticker, date, lag(lev, 62) OVER (PARTITION BY ticker ORDER BY date) AS f FROM usable) WHERE f IS NOT NULL",
    ),
    "arr_date_codes": query("SELECT target_date, dense_rank() OVER (ORDER BY target_date) - 1 AS code FROM (SELECT DISTINCT target_date FROM usable)"),
    "arr_quantile_grid": query("SELECT key, round(unnest(list_sort(list_distinct(quantile_cont(m, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])))), 6) AS threshold FROM stats WHERE pos >= 50 GROUP BY key"),
    "chart_cusum_mean": query("SELECT key, pos, round(m, 6) AS statistic FROM stats"),
    "chart_cusum_variance": query("SELECT key, pos, round(v, 6) AS statistic FROM stats"),
    "chart_cusum_combined": query("SELECT key, pos, round(c, 6) AS statistic FROM stats"),
    "chart_ewma": query("SELECT key, pos, round(e, 6) AS statistic FROM stats"),
    "alarm_upcross": query("SELECT key, pos FROM alarms"),
    "alarm_first_cross": query("SELECT key, min(CASE WHEN m > 4 AND pos >= 50 THEN pos END) AS first FROM stats GROUP BY 1"),
    "alarm_recency": query("SELECT s.key, s.pos, round(coalesce(exp(-(s.pos - max(a.pos)) / 21.0), 0), 6) AS recent FROM stats s LEFT JOIN alarms a ON a.key = s.key AND a.pos <= s.pos GROUP BY 1, 2"),
    "cal_arl_threshold": query(
        "SELECT threshold, round(arl, 6) AS arl FROM (SELECT *, row_number() OVER (ORDER BY abs(arl - 100), threshold DESC) AS k FROM lengths) WHERE k = 1",
        lengths="SELECT threshold, avg(length) AS arl FROM runs GROUP BY 1",
        runs="SELECT threshold, key, coalesce(min(CASE WHEN m > threshold AND pos >= 50 THEN pos - 49 END), max(pos) + 1 - 50) AS length FROM stats CROSS JOIN (VALUES (1.0), (2.0), (3.0), (4.0), (6.0), (8.0)) t(threshold) GROUP BY 1, 2",
    ),
    "arl_summary_point": query(
        "SELECT round(avg(length), 6) AS arl, round(stddev_samp(length), 6) AS sdrl, round(avg(censored::INT), 6) AS censored FROM runs",
        runs="SELECT key, coalesce(min(CASE WHEN m > 6 AND pos >= 50 THEN pos - 49 END), max(pos) + 1 - 50) AS length, min(CASE WHEN m > 6 AND pos >= 50 THEN pos END) IS NULL AS censored FROM stats GROUP BY 1",
    ),
    "evt_position": query("SELECT event, ticker, asset_class, position FROM positions"),
    "evt_detection": query("SELECT event, ticker, delay FROM delays"),
    "evt_awareness": query("SELECT p.event, p.ticker, bool_or(a.pos IS NOT NULL) AS aware FROM positions p LEFT JOIN palarms a ON a.ticker = p.ticker AND a.pos >= p.position - 63 AND a.pos < p.position GROUP BY 1, 2"),
    "evt_combined_delay": query(
        "SELECT p.event, p.ticker, coalesce(min(a.pos - p.position), any_value(CASE WHEN abs(l.return_pct) >= 50 THEN 0 END)) AS delay FROM positions p LEFT JOIN palarms a ON a.ticker = p.ticker AND a.pos >= p.position - 15 AND a.pos < p.position + 50 LEFT JOIN logret l ON l.ticker = p.ticker AND l.pos = p.position GROUP BY 1, 2",
    ),
    "evt_off_rate": query(
        "SELECT r.ticker, count(a.pos) AS alarms, count(*) AS exposure FROM logret r LEFT JOIN palarms a ON a.ticker = r.ticker AND a.pos = r.pos WHERE r.pos >= 50 AND NOT EXISTS (SELECT 1 FROM positions p WHERE p.ticker = r.ticker AND r.pos >= p.position AND r.pos < p.position + 50) GROUP BY 1",
    ),
    "evt_by_class_all": query("SELECT coalesce(asset_class, 'All') AS asset_class, count(*) AS applicable, count(delay) AS detected, round(avg(delay), 6) AS mean_delay, median(delay)::DOUBLE AS median_delay FROM delays GROUP BY GROUPING SETS ((asset_class), ())"),
    "sim_delay_summary": query("SELECT event, round(avg(delay), 6) AS mean_delay, round(stddev_samp(delay), 6) AS sd_delay, median(delay)::DOUBLE AS median_delay, round(avg((delay IS NULL OR delay >= 20)::INT), 6) AS miss_rate, round(avg((delay IS NULL)::INT), 6) AS miss_horizon, count(*) AS trials FROM delays GROUP BY 1"),
    "sim_match_alarms": query("SELECT key, position, matched FROM matched"),
    "sim_ccd_dnf": query(
        "SELECT key, correct, missed, wrong, CASE WHEN correct + missed > 0 THEN round(correct / CAST(correct + missed AS DOUBLE), 6) ELSE -1 END AS ccd, CASE WHEN correct + wrong > 0 THEN round(correct / CAST(correct + wrong AS DOUBLE), 6) ELSE -1 END AS dnf FROM tallies",
        tallies="SELECT m.key, count(matched) AS correct, count(*) - count(matched) AS missed, (SELECT count(*) FROM alarms a WHERE a.key = m.key) - count(matched) AS wrong FROM matched m GROUP BY m.key",
    ),
    "agg_prior_quantiles": query(
        "SELECT asset_class, round(m, 6) AS mu_mean, round(greatest(ms, 0.05), 6) AS mu_sd, round(l, 6) AS log_hbar_mean, round(greatest(ls, 0.25), 6) AS log_hbar_sd, round(alpha_low, 6) AS alpha_low, round(alpha_high, 6) AS alpha_high, round(persistence_low, 6) AS persistence_low, round(least(greatest(p9, persistence_low + 0.005), 0.995), 6) AS persistence_high, 25.0::DOUBLE AS hbar_cap FROM lasting",
        lasting="SELECT *, least(greatest(p1, alpha_high + 0.01), 0.985) AS persistence_low FROM (SELECT *, least(greatest(a9, alpha_low + 0.01), 0.4) AS alpha_high FROM (SELECT *, least(greatest(a1, 0.01), 0.4) AS alpha_low FROM moments))",
        moments="SELECT asset_class, median(mean) AS m, stddev_samp(mean) AS ms, avg(ln(greatest(hbar, 1e-4))) AS l, stddev_samp(ln(greatest(hbar, 1e-4))) AS ls, quantile_cont(alpha, 0.1) AS a1, quantile_cont(alpha, 0.9) AS a9, quantile_cont(persistence, 0.1) AS p1, quantile_cont(persistence, 0.9) AS p9 FROM fits GROUP BY 1",
    ),
    "agg_nested_scores": query(
        "SELECT law, round(avg(score), 6) AS pooled FROM (SELECT law, asset_class, avg(score) AS score FROM scores GROUP BY 1, 2) GROUP BY 1",
        scores="SELECT ticker, asset_class, law, avg(-ln(1 + pow(return_pct, 2) / (law * 100.0))) AS score FROM logret CROSS JOIN (VALUES (4), (6), (10)) n(law) GROUP BY 1, 2, 3",
    ),
    "agg_argmax_ties": query("SELECT asset_class, ticker FROM (SELECT asset_class, ticker, row_number() OVER (PARTITION BY asset_class ORDER BY round(top, 0) DESC, ticker) AS k FROM (SELECT asset_class, ticker, max(return_pct) AS top FROM logret GROUP BY 1, 2)) WHERE k = 1"),
    "agg_systemic": query("SELECT date, round(avg(x), 6) AS young, round(avg((x > 0.5)::INT), 6) AS share FROM (SELECT date, least(abs(return_pct) / 200, 1.0) AS x FROM logret) GROUP BY 1"),
    "join_family_features": query(
        "SELECT f.ticker, f.date, round(f.s0, 5) AS s0, round(l.return_pct, 6) AS chart, round(y.young, 6) AS young FROM usable f JOIN logret l USING (ticker, date) LEFT JOIN young y ON y.date = f.date",
        young="SELECT date, avg(least(abs(return_pct) / 200, 1.0)) AS young FROM logret GROUP BY 1",
    ),
    "ens_mean_kappa": query(f"SELECT ticker, date, {rounded('mean sd', 6)}, round(kappa, 4) AS kappa FROM ens"),
    "ens_topk_members": query(
        "SELECT member FROM (SELECT member, row_number() OVER (ORDER BY round(score, 6) DESC, member) AS k FROM scored) WHERE k <= 3",
        scored=f"SELECT member, {_SHARPE.format('r')} AS score FROM (SELECT member, date, avg(position * target) AS r FROM members GROUP BY 1, 2) GROUP BY 1",
    ),
    "ens_grid_check": query("SELECT ticker, date FROM (SELECT ticker, date, count(DISTINCT member) AS n, max(target) - min(target) AS d FROM members GROUP BY 1, 2) WHERE n <> 6 OR d <> 0"),
    "gate_rank": query("SELECT ticker, date, round(rank, 6) AS rank FROM ranked"),
    "gate_hysteresis": query("SELECT ticker, date, mask FROM gated"),
    "gate_divisor": query("SELECT date, round(greatest(CAST(a AS DOUBLE), n / 2.0), 6) AS divisor FROM counts"),
    "gate_portfolio": query(_DAY, turned=_TURN.format("capped")),
    "gate_conf_capital": query("SELECT ticker, date, round(capital, 6) AS capital FROM confident"),
    "gate_conf_portfolio": query(_DAY, turned=_TURN.format("confident")),
    "gate_abstention": query("SELECT ticker, count(*) AS days, round(avg((NOT mask)::INT), 6) AS abstained FROM gated JOIN days USING (date) WHERE day > 126 GROUP BY 1"),
    "gate_abstention_top5": query("SELECT ticker, round(abstained, 6) AS abstained FROM (SELECT ticker, avg((NOT mask)::INT) AS abstained FROM gated JOIN days USING (date) WHERE day > 126 GROUP BY 1) ORDER BY round(abstained, 6) DESC, ticker LIMIT 5"),
    "gate_conditional_sharpe": query(
        "SELECT round(sum(avg / dev * sqrt(252) * days) FILTER (days >= 60 AND dev > 0) / sum(days) FILTER (days >= 60 AND dev > 0), 6) AS conditional_sharpe, CAST(count(*) FILTER (days >= 60 AND dev > 0) AS BIGINT) AS included, CAST(count(*) FILTER (NOT coalesce(days >= 60 AND dev > 0, false)) AS BIGINT) AS excluded FROM each",
        each="SELECT ticker, count(*) AS days, avg(mean * target) AS avg, stddev_samp(mean * target) AS dev FROM gated WHERE mask GROUP BY 1",
    ),
    "gate_by_class": query(
        f"SELECT asset_class, round(abstained, 6) AS abstained, round(sharpe, 6) AS sharpe FROM (SELECT asset_class, avg((NOT mask)::INT) AS abstained FROM gated GROUP BY 1) JOIN (SELECT asset_class, {_SHARPE.format('r')} AS sharpe FROM (SELECT asset_class, date, sum(mean * capital * target) AS r FROM capped GROUP BY 1, 2) GROUP BY 1) USING (asset_class)",
    ),
    "gate_cost_sweep": query(
        f"SELECT bps, CAST(year(date) AS INT) AS year, round({_SHARPE.format('net')}, 6) AS sharpe FROM nets GROUP BY 1, 2",
        nets="SELECT bps, date, gross - bps * 1e-4 * turnover AS net FROM daily CROSS JOIN (VALUES (0), (1), (2), (5), (10)) c(bps)",
        daily="SELECT date, sum(mean * capital * target) AS gross, coalesce(sum(CASE WHEN day - d0 = 1 THEN abs(h - h0) END), 0) AS turnover FROM turned GROUP BY 1",
        turned=_TURN.format("capped"),
    ),
    "perf_metrics": query(
        f"SELECT asset_class, days, {rounded('returns vol sharpe downside', 5)}, round(returns / downside, 5) AS sortino, round(mdd, 6) AS mdd, round(returns / mdd, 5) AS calmar, {rounded('positive gain_loss')} FROM (SELECT asset_class, {_PERF} FROM (SELECT asset_class, date, r * 0.05 AS r FROM folio) GROUP BY 1) JOIN falls USING (asset_class)",
        falls="SELECT asset_class, -min(w / top - 1) AS mdd FROM (SELECT *, max(w) OVER (PARTITION BY asset_class ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM wealth) GROUP BY 1",
        wealth="SELECT asset_class, date, product(1 + r * 0.05) OVER (PARTITION BY asset_class ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM folio",
    ),
    "perf_window_mean": query(f"SELECT asset_class, round(avg(s), 6) AS sharpe FROM (SELECT asset_class, year(date) AS y, {_SHARPE.format('r')} AS s FROM folio GROUP BY 1, 2) GROUP BY 1"),
    "perf_rescaled": query("SELECT asset_class, date, round(r * 0.15 / v, 6) AS r FROM folio JOIN (SELECT asset_class, avg(s) AS v FROM (SELECT asset_class, year(date) AS y, stddev_samp(r) * sqrt(252) AS s FROM folio GROUP BY 1, 2) GROUP BY 1) USING (asset_class)"),
    "perf_by_window": query("SELECT asset_class, " + ", ".join(f"round(max(CASE WHEN y = {y} THEN s END), 6) AS y{y}" for y in range(1996, 2002)) + f" FROM (SELECT asset_class, year(date) AS y, {_SHARPE.format('r')} AS s FROM folio GROUP BY 1, 2) GROUP BY 1"),
    "port_fixed_divisor": query(
        "SELECT date, round(sum(mean * target) / 25, 6) AS gross, round(sum(coalesce(abs(mean * lev - h0), 0)) / 25, 6) AS turnover FROM (SELECT *, lag(mean * lev) OVER (PARTITION BY ticker ORDER BY date) AS h0 FROM ens) GROUP BY 1",
    ),
    "seed_summary": query(f"SELECT CAST(6 AS BIGINT) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high, round(stddev_samp(s) / sqrt(6.0), 6) AS se FROM (SELECT member, {_SHARPE.format('r')} AS s FROM (SELECT member, date, avg(position * target) AS r FROM members GROUP BY 1, 2) GROUP BY 1)"),
    "size_sensitivity": query(
        f"SELECT size, round({_SHARPE.format('r')}, 6) AS sharpe FROM (SELECT size, date, sum(p * target) / 25 AS r FROM (SELECT size, ticker, date, avg(position) AS p, min(target) AS target FROM members JOIN (VALUES (1), (3), (6)) s(size) ON member < size GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1",
    ),
    "boot_blocks_fixed": "SELECT CAST(i AS INT) AS i, CAST(([17, 93, 55, 80])[1 + i // 30] + i % 30 AS INT) % 100 AS day FROM range(100) t(i)",
    "boot_delta_observed": query(
        f"SELECT round(avg(d), 6) AS delta FROM (SELECT y, {_SHARPE.format('gross')} - {_SHARPE.format('plain')} AS d FROM both_ GROUP BY 1)",
        both_="SELECT year(date) AS y, date, n.gross, p.plain FROM netted n JOIN plain_ p USING (date)",
        plain_="SELECT date, sum(mean * target) / count(*) AS plain FROM gated GROUP BY 1",
    ),
    "meta_dup_keys": query("SELECT ticker, date, count(*) AS n FROM panel GROUP BY 1, 2 HAVING count(*) > 1"),
    "meta_grid_missing": query("SELECT t.ticker, y.year FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN range(1994, 2003) y(year) WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.ticker = t.ticker AND year(p.date) = y.year)"),
}
