"""Queries of the report, record and simulation tables, each with its DuckDB SQL beside it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators import ensemble as E
from panelwright.operators import metrics as M
from panelwright.operators import regimes as R
from panelwright.operators import simulation as U
from panelwright.plans import catalogue as Q
from panelwright.plans.sql import _SHARPE, query
from panelwright.sources import panel as src
from panelwright.sources import records, sinks

QUERIES: dict[str, Q.Query] = {}
ORACLES: dict[str, str] = {}
GRID_P, GRID_M = (0.0, 0.10, 0.25, 0.50), (1.0, 2.0, math.inf)
GARCH_CELLS = [(0.0, 0.05, 0.08, 0.87), (0.0, 0.5, 0.05, 0.45), (0.1, 0.2, 0.3, 0.5)]


def _report(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- rows and labels ------------------------------------------------------------------------------------------


@_report(query("SELECT ticker, strftime(date, '%Y-%m-%d') AS day FROM panel"))
def proj_iso_date(spark, d):
    return src.star_panel(spark, d).select("ticker", F.date_format("date", "yyyy-MM-dd").alias("day"))


@_report(query("SELECT ticker, asset_class, 'returns' AS detector, date, round(return_pct / stddev_pop(return_pct) OVER (PARTITION BY ticker), 6) AS standardised FROM logret"))
def proj_detector_rows(spark, d):
    """A detector's long output, with the constant columns that say whose it is."""
    scale = F.stddev_pop("return_pct").over(Window.partitionBy("ticker"))
    return Q._round(Q._log(spark, d).select("ticker", "asset_class", F.lit("returns").alias("detector"), "date", (F.col("return_pct") / scale).alias("standardised")))


@_report("SELECT CASE WHEN m = 'inf'::DOUBLE THEN 'inf' ELSE format('{:g}', m) END AS label FROM (VALUES (1.0::DOUBLE), (2.0), (1.5), ('inf'::DOUBLE)) v(m)")
def proj_cap_label(spark, d):
    return spark.createDataFrame([(1.0,), (2.0,), (1.5,), (math.inf,)], "m double").select(U.cap_label(F.col("m")).alias("label"))


@_report(query("SELECT ticker, count(*) AS early FROM panel WHERE date < DATE '1996-01-01' GROUP BY 1"))
def filt_pre_study(spark, d):
    """The rows that the guard of the study's start refuses."""
    return src.early_rows(src.star_panel(spark, d), Q.dt.date(1996, 1, 1))


_INTERIOR = "hbar > 0 AND omega > 0 AND alpha > 0 AND alpha < persistence AND persistence < 0.999 AND beta > 0 AND abs(alpha + beta - persistence) <= 1e-8 + 1e-5 * abs(persistence)"


@_report(query(f"SELECT ticker, {_INTERIOR} AS inside FROM fits"))
def filt_garch_interior(spark, d):
    return Q._stand_in_fits(spark, d).select("ticker", R.interior_fits().alias("inside"))


@_report(query(f"SELECT asset_class, count(*) FILTER (WHERE {_INTERIOR}) AS inside, count(*) AS fits, string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE NOT ({_INTERIOR})) AS refused FROM fits GROUP BY 1"))
def agg_calibration_summary(spark, d):
    """Counts of usable fits by class, and the others by name."""
    inside = R.interior_fits()
    refused = F.array_join(F.sort_array(F.collect_list(F.when(~inside, F.col("ticker")))), ",")
    return Q._stand_in_fits(spark, d).groupBy("asset_class").agg(F.count_if(inside).alias("inside"), F.count("*").alias("fits"), F.when(F.count_if(~inside) > 0, refused).alias("refused"))


_PRIOR_SQL = """SELECT k, round(m, 6) AS mu_mean, round(greatest(ms, 0.05), 6) AS mu_sd, round(l, 6) AS log_hbar_mean, n < 2 AS pooled FROM (SELECT c.k, coalesce(o.m, a.m) AS m, coalesce(o.ms, a.ms) AS ms, coalesce(o.l, a.l) AS l, coalesce(o.n, 0) AS n
  FROM (SELECT DISTINCT k FROM keyed UNION SELECT 'none') c LEFT JOIN (SELECT k, count(*) AS n, median(mean) AS m, stddev_samp(mean) AS ms, avg(ln(greatest(hbar, 1e-4))) AS l FROM keyed GROUP BY 1 HAVING count(*) >= 2) o USING (k)
  CROSS JOIN (SELECT median(mean) AS m, stddev_samp(mean) AS ms, avg(ln(greatest(hbar, 1e-4))) AS l FROM keyed) a)"""


@_report(query(_PRIOR_SQL, keyed="SELECT *, asset_class AS k FROM fits"))
def agg_class_priors(spark, d):
    """Priors by class, a class without two fits of its own taking the pooled one."""
    fits = Q._stand_in_fits(spark, d).withColumnRenamed("asset_class", "k")
    classes = fits.select("k").unionByName(spark.createDataFrame([("none",)], "k string"))
    return Q._round(R.class_priors(fits, "k", classes).select("k", "mu_mean", "mu_sd", "log_hbar_mean", "pooled"))


@_report(
    query(
        "SELECT ticker, CAST(cell AS INT) AS cell, round(0.5 * sum(ln(h) + pow(x - mean, 2) / h + ln(2 * pi())), 3) AS nll FROM likely GROUP BY 1, 2",
        likely="""SELECT ticker, cell, pos, x, mean, omega, alpha, beta, greatest(v, 1e-6) AS h FROM scaled CROSS JOIN cells WHERE pos = 1
          UNION ALL SELECT s.ticker, l.cell, s.pos, s.x, l.mean, l.omega, l.alpha, l.beta, l.omega + l.alpha * pow(l.x - l.mean, 2) + l.beta * l.h FROM likely l JOIN scaled s ON s.ticker = l.ticker AND s.pos = l.pos + 1""",
        scaled="SELECT ticker, pos, x, var_pop(x) OVER (PARTITION BY ticker) AS v FROM (SELECT ticker, pos, return_pct / stddev_pop(return_pct) OVER (PARTITION BY ticker) AS x FROM logret)",
        cells="SELECT * FROM (VALUES " + ", ".join(f"({i}, {m}::DOUBLE, {o}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for i, (m, o, a, b) in enumerate(GARCH_CELLS)) + ") c(cell, mean, omega, alpha, beta)",
    )
)
def garch_nll_grid(spark, d):
    """The likelihood of each whole series at fixed parameters."""
    return Q._round(R.garch_grid(Q._prices_for_filter(spark, d), "ticker", "x", GARCH_CELLS), 3)


# ---- joins ----------------------------------------------------------------------------------------------------


@_report(query("SELECT n_name AS ticker, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS place FROM nation WHERE n_regionkey IN (1, 3) AND n_name IN (SELECT ticker FROM panel)"))
def join_ordered_universe(spark, d):
    """The tickers of two classes in the order of the universe."""
    nation = src.table(spark, d, "nation")
    universe = nation.where("n_regionkey IN (1, 3)").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("ord"))
    return records.ordered_universe(universe, src.star_panel(spark, d).select("ticker"))


@_report(query("SELECT f.ticker, f.date, round(f.s0, 5) AS s0, round(b.bocpd_score, 6) AS bocpd_score, round(b.bocpd_rl, 6) AS bocpd_rl, round(y.young, 6) AS sys_score, round(y.share, 6) AS sys_frac FROM usable f JOIN own b ON b.ticker = f.ticker AND b.date = f.date LEFT JOIN young y ON y.date = f.date", own="SELECT ticker, date, least(abs(return_pct) / 200, 1.0) AS bocpd_score, least(greatest(pos % 50 / 21.0, 0.0), 1.0) AS bocpd_rl FROM logret WHERE pos >= 100", young="SELECT date, avg(bocpd_score) AS young, avg((bocpd_score > 0.5)::INT) AS share FROM own GROUP BY 1"))
def join_family_dispatch(spark, d):
    """The family that has both a detector's columns and the panel's, on stand-ins of the detector."""
    score = F.least(F.abs("return_pct") / 200, F.lit(1.0))
    rows = Q._log(spark, d).where("pos >= 100").select("ticker", "date", score.alias("young_prob"), (F.col("pos") % 50).alias("expected_run_length"), F.lit(0.0).alias("cp_prob"), F.lit(1.0).alias("expected_volatility"))
    own = records.change_columns(rows)
    daily = own.groupBy("date").agg(F.avg("bocpd_score").alias("sys_score"), F.avg((F.col("bocpd_score") > 0.5).cast("int")).alias("sys_frac"))
    return Q._round(records.family_features("bocpd_sys", Q._full(spark, d).select("ticker", "date", "s0"), own, daily), s0=5)


@_report(query("SELECT CAST(year(date) AS INT) AS \"window\", ticker, round(avg(return_pct), 6) AS mean, round(var_pop(return_pct), 4) AS hbar FROM logret GROUP BY 1, 2"))
def union_window_tables(spark, d):
    """The windows' tables of fits as one, with the window in a column."""
    rows = Q._log(spark, d).withColumn("window", F.year("date"))
    return Q._round(rows.groupBy("window", "ticker").agg(F.avg("return_pct").alias("mean"), F.var_pop("return_pct").alias("hbar")), hbar=4)


# ---- ensembles and gates --------------------------------------------------------------------------------------


def _validation(spark, d) -> DataFrame:
    """Sharpe ratio of each member's portfolio by year."""
    daily = Q._members(spark, d).groupBy("member", "date").agg(F.avg(F.col("position") * F.col("target")).alias("r"))
    return Q._year(daily).groupBy("year", "member").agg(M.sharpe("r").alias("score")).withColumn("score", F.round("score", 6))


_VALID = dict(
    valid=f"SELECT y, member, round({_SHARPE.format('r')}, 6) AS score FROM (SELECT CAST(year(date) AS INT) AS y, member, date, avg(position * target) AS r FROM members GROUP BY 1, 2, 3) GROUP BY 1, 2",
    chosen="SELECT y, member FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY score DESC NULLS LAST, member) AS k FROM valid) WHERE k <= 3",
)


@_report(query("SELECT y AS year, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members, CAST(count(*) AS INT) AS n FROM chosen GROUP BY 1", **_VALID))
def ens_member_lists(spark, d):
    """The chosen members of each window as text, and how many the text holds."""
    members = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("members")
    lists = E.top_members(_validation(spark, d), 3, ["year"]).groupBy("year").agg(members)
    return lists.withColumn("n", F.size(F.split("members", ",")))


@_report(query("SELECT ticker, date, round(avg(position), 6) AS mean, count(*) AS n FROM members m JOIN chosen c ON c.member = m.member AND year(m.date) = c.y + 1 GROUP BY 1, 2", **_VALID))
def ens_ranked_windows(spark, d):
    """Each year's ensemble of the members that the year before ranked first."""
    chosen = E.top_members(_validation(spark, d), 3, ["year"]).select((F.col("year") + 1).alias("year"), "member")
    rows = Q._year(Q._members(spark, d)).join(chosen, ["year", "member"])
    return Q._round(rows.groupBy("ticker", "date").agg(F.avg("position").alias("mean"), F.count("*").alias("n")))


@_report("SELECT trials, least(5, trials) AS size FROM (VALUES (1), (3), (5), (50)) v(trials)")
def ens_size(spark, d):
    return spark.createDataFrame([(1,), (3,), (5,), (50,)], "trials int").select("trials", E.ensemble_size(F.col("trials")).alias("size"))


@_report("SELECT list_contains([4, 1, 9], CAST(i AS INT)) AS taken, CAST(i AS INT) AS i FROM range(12) t(i)")
def sort_member_mask(spark, d):
    """A mask over positions from a set of indices."""
    return spark.range(12).select(F.array_contains(F.sort_array(F.array(F.lit(4), F.lit(1), F.lit(9))), F.col("id").cast("int")).alias("taken"), F.col("id").cast("int").alias("i"))


@_report(query("SELECT date, round(avg(r), 6) AS r, count(r) AS models FROM (SELECT asset_class, date, CASE WHEN abs(r) < 0.5 THEN r END AS r FROM folio) GROUP BY 1"))
def port_composite(spark, d):
    """The models' daily mean, days that a model lacks skipped."""
    rows = Q._class_returns(spark, d).withColumn("r", F.when(F.abs("r") < 0.5, F.col("r")))
    return Q._round(rows.groupBy("date").agg(F.avg("r").alias("r"), F.count("r").alias("models")))


_SEEDS = dict(
    singles="SELECT asset_class, member, date, avg(position * target) AS r FROM members GROUP BY 1, 2, 3",
    each=f"SELECT asset_class, member, {_SHARPE.format('r')} AS s FROM singles GROUP BY 1, 2",
    joint=f"SELECT asset_class, {_SHARPE.format('r')} AS ensemble FROM (SELECT asset_class, date, avg(r) AS r FROM singles GROUP BY 1, 2) GROUP BY 1",
)


@_report(query("SELECT e.asset_class, count(s) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(any_value(ensemble), 6) AS ensemble FROM each e LEFT JOIN joint USING (asset_class) GROUP BY 1", **_SEEDS))
def join_seed_ensemble(spark, d):
    """What single replicates reach, beside the ensemble of their portfolios' daily means."""
    singles = Q._members(spark, d).groupBy("asset_class", "member", "date").agg(F.avg(F.col("position") * F.col("target")).alias("r"))
    each = singles.groupBy("asset_class", "member").agg(M.sharpe("r").alias("s")).groupBy("asset_class").agg(F.count("s").alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"))
    joint = singles.groupBy("asset_class", "date").agg(F.avg("r").alias("r")).groupBy("asset_class").agg(M.sharpe("r").alias("ensemble"))
    return Q._round(each.join(joint, "asset_class", "left"))


_GRID = dict(
    masks="""SELECT ranked.*, p, CASE WHEN p <= 0 THEN true ELSE coalesce(last_value(CASE WHEN rank IS NULL OR rank >= p THEN true WHEN rank < p / 2 THEN false END IGNORE NULLS)
      OVER (PARTITION BY p, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), true) END AS mask FROM ranked CROSS JOIN (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5)) ps(p)""",
    tallies="SELECT p, date, count(*) AS n, sum(mask::INT) AS a, sum(CASE WHEN mask THEN coalesce(rank, 0.5) END) AS whole FROM masks GROUP BY 1, 2",
    shares="""SELECT k.*, m, rule, day, CASE WHEN rule = 'rank-hyst' THEN coalesce(CASE WHEN mask THEN 1.0 / greatest(CAST(a AS DOUBLE), n / m) ELSE 0 END, 0)
      ELSE least(mask::INT / CAST(n AS DOUBLE) + coalesce(CASE WHEN mask THEN coalesce(rank, 0.5) END / whole * greatest(0.0, (n - a) / CAST(n AS DOUBLE)), 0), m / n) END AS capital
      FROM masks k JOIN tallies USING (p, date) JOIN (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM ranked)) USING (date)
      CROSS JOIN (VALUES (1.0::DOUBLE), (2.0), ('inf'::DOUBLE)) ms(m) CROSS JOIN (VALUES ('rank-hyst'), ('rank-cwhyst')) rs(rule)""",
    turned="SELECT *, mean * capital * lev AS h, lag(mean * capital * lev) OVER w AS h0, lag(day) OVER w AS d0 FROM shares WINDOW w AS (PARTITION BY rule, p, m, ticker ORDER BY day)",
    daily="SELECT rule AS variant, p, CASE WHEN m = 'inf'::DOUBLE THEN 'inf' ELSE format('{:g}', m) END AS m, date, sum(mean * capital * target) AS gross, coalesce(sum(CASE WHEN day - d0 = 1 THEN abs(h - h0) END), 0) AS turnover, count(*) AS n_available, CAST(sum(mask::INT) AS BIGINT) AS n_active FROM turned GROUP BY 1, 2, 3, 4",
)


@_report(
    query(
        f"SELECT y.variant, y.p, y.m, round(avg(y.s), 5) AS sharpe, round(any_value(t.turnover), 6) AS turnover, round(any_value(t.idle), 6) AS idle FROM (SELECT variant, p, m, year(date) AS y, {_SHARPE.format('gross')} AS s FROM daily GROUP BY 1, 2, 3, 4) y JOIN (SELECT variant, p, m, avg(turnover) AS turnover, 1 - sum(n_active) / sum(n_available) AS idle FROM daily GROUP BY 1, 2, 3) t USING (variant, p, m) GROUP BY 1, 2, 3",
        **_GRID,
    )
)
def gate_grid(spark, d):
    """Both rules over all thresholds and caps, from one pass over the ranks."""
    daily = Q._year(E.gate_grid(Q._ensemble(spark, d), GRID_P, GRID_M))
    keys = ["variant", "p", "m"]
    by_year = daily.groupBy(*keys, "year").agg(M.sharpe("gross").alias("s"), F.sum("turnover").alias("t"), F.count("*").alias("days"), F.sum("n_active").alias("a"), F.sum("n_available").alias("n"))
    out = by_year.groupBy(*keys).agg(F.avg("s").alias("sharpe"), (F.sum("t") / F.sum("days")).alias("turnover"), (1 - F.sum("a") / F.sum("n")).alias("idle"))
    return out.select(*keys, F.round("sharpe", 5).alias("sharpe"), F.round("turnover", 6).alias("turnover"), F.round("idle", 6).alias("idle"))


@_report(query("SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, n_available, n_active FROM daily WHERE variant = 'rank-hyst' AND abs(p - 0.25) < 1e-9 AND m = '2'", **_GRID))
def filt_gate_policy(spark, d):
    """One policy's days out of the grid; a date that it has twice is an error."""
    return Q._round(E.select_policy(E.gate_grid(Q._ensemble(spark, d), GRID_P, GRID_M), "rank-hyst", 0.25, "2"))


_CLASSES = dict(
    peers="SELECT asset_class, date, count(*) AS n, sum(mask::INT) AS a, sum(CASE WHEN mask THEN coalesce(rank, 0.5) END) AS whole FROM gated GROUP BY 1, 2",
    held="""SELECT g.*, day, policy, CASE policy WHEN 'ungated' THEN 1.0 / n WHEN 'hyst' THEN mask::INT / CAST(n AS DOUBLE)
      ELSE mask::INT / CAST(n AS DOUBLE) + coalesce(CASE WHEN mask THEN coalesce(rank, 0.5) END / nullif(whole, 0) * (n - a) / CAST(n AS DOUBLE), 0) END AS capital
      FROM gated g JOIN days USING (date) JOIN peers USING (asset_class, date) CROSS JOIN (VALUES ('ungated'), ('hyst'), ('confidence')) p(policy)""",
    moved="SELECT *, mean * capital * lev AS h, lag(mean * capital * lev) OVER w AS h0, lag(day) OVER w AS d0 FROM held WINDOW w AS (PARTITION BY policy, ticker ORDER BY day)",
    sleeves="SELECT asset_class, policy, date, sum(mean * capital * target) AS gross, coalesce(sum(CASE WHEN day - d0 = 1 THEN abs(h - h0) END), 0) AS turnover FROM moved GROUP BY 1, 2, 3",
    nets="""SELECT k.asset_class, k.policy, d.date, bps, coalesce(gross, 0) - bps * 1e-4 * coalesce(turnover, 0) AS net FROM (SELECT DISTINCT asset_class, policy FROM sleeves) k CROSS JOIN days d
      CROSS JOIN (VALUES (0.0::DOUBLE), (2.0), (3.0)) b(bps) LEFT JOIN sleeves s ON s.asset_class = k.asset_class AND s.policy = k.policy AND s.date = d.date""",
    free="SELECT g.*, mask::INT / CAST(n AS DOUBLE) + coalesce(CASE WHEN mask THEN coalesce(rank, 0.5) END / nullif(whole, 0) * (n - a) / CAST(n AS DOUBLE), 0) AS capital, n FROM gated g JOIN counts USING (date) LEFT JOIN norms USING (date)",
    by_day="SELECT asset_class, date, sum(mean * target) / count(*) AS u, coalesce(sum(mean * target) FILTER (WHERE mask), 0) / count(*) AS g, sum(capital) AS c, sum(1.0 / n) AS s FROM free GROUP BY 1, 2",
    contract="SELECT asset_class, ticker, count(*) AS n, avg(mean * target) AS x, stddev_samp(mean * target) AS d, count(*) FILTER (WHERE mask) AS n1, avg(mean * target) FILTER (WHERE mask) AS x1, stddev_samp(mean * target) FILTER (WHERE mask) AS d1, count(*) FILTER (WHERE NOT mask) AS idle FROM gated GROUP BY 1, 2",
    conditional="""SELECT asset_class, count(*) AS contracts, sum(idle) / sum(n) AS abstention, sum(x / d * sqrt(252) * n) FILTER (WHERE n >= 60 AND d > 0) / sum(n) FILTER (WHERE n >= 60 AND d > 0) AS cond_ungated,
      sum(x1 / d1 * sqrt(252) * n1) FILTER (WHERE n1 >= 60 AND d1 > 0) / sum(n1) FILTER (WHERE n1 >= 60 AND d1 > 0) AS cond_gated FROM contract GROUP BY 1""",
)


@_report(query(f"SELECT asset_class, policy, CAST(year(date) AS INT) AS \"window\", bps, round({_SHARPE.format('net')}, 5) AS sharpe FROM nets GROUP BY 1, 2, 3, 4", **_CLASSES))
def gate_class_windows(spark, d):
    """Each class's sleeve under three rules and three costs, by year."""
    return Q._round(E.class_windows(Q._gated(spark, d), (0.0, 2.0, 3.0), F.year("date")), 5)


@_report(query(f"SELECT asset_class, contracts, {', '.join(f'round({c}, 5) AS {c}' for c in ('abstention', 'cond_ungated', 'cond_gated', 'sleeve_ungated', 'sleeve_hyst', 'share_baseline', 'share_confidence'))} FROM conditional JOIN (SELECT asset_class, {_SHARPE.format('u')} AS sleeve_ungated, {_SHARPE.format('g')} AS sleeve_hyst, sum(s) / (SELECT count(DISTINCT date) FROM gated) AS share_baseline, avg(c) AS share_confidence FROM by_day GROUP BY 1) USING (asset_class)", **_CLASSES))
def gate_class_summary(spark, d):
    """What the gate leaves idle in each class, what it earns there, and the capital that it moves between classes."""
    return Q._round(E.class_summary(Q._gated(spark, d)), 5)


@_report(query("SELECT coalesce(a.date, b.date) AS date, a.date IS NULL AS lacks_first, b.date IS NULL AS lacks_second FROM (SELECT date FROM folio WHERE asset_class = 'ASIA') a FULL JOIN (SELECT date FROM folio WHERE asset_class = 'EUROPE') b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL"))
def join_calendar_gaps(spark, d):
    """The dates that only one of two portfolios has."""
    rows = Q._class_returns(spark, d)
    return E.calendar_gaps(rows.where("asset_class = 'ASIA'"), rows.where("asset_class = 'EUROPE'"))


# ---- simulation tables ----------------------------------------------------------------------------------------


@_report("SELECT scenario, mu, hbar, hbar * (1 - 0.08 - 0.87) AS omega, 0.08::DOUBLE AS alpha, 0.87::DOUBLE AS beta FROM (VALUES ('S1', 0.75::DOUBLE, 1.0::DOUBLE), ('S2', 0.0, 3.0), ('S3', 0.0, 1.0 / 3.0), ('S4', 0.75, 3.0)) s(scenario, mu, hbar)")
def sim_scenarios(spark, d):
    return U.scenario_table(spark)


_MONITOR = dict(
    tallies="SELECT m.key, count(matched) AS correct, count(*) - count(matched) AS missed, (SELECT count(*) FROM alarms a WHERE a.key = m.key) - count(matched) AS wrong FROM matched m GROUP BY m.key",
    numbered_keys="SELECT *, row_number() OVER (ORDER BY key) - 1 AS stream FROM tallies",
)


@_report(query("SELECT t.correct, t.missed, t.wrong, round(t.correct / CAST(nullif(t.correct + t.missed, 0) AS DOUBLE), 6) AS ccd, round(t.correct / CAST(nullif(t.correct + t.wrong, 0) AS DOUBLE), 6) AS dnf, round(x.mean_delay, 6) AS mean_delay, x.median_delay FROM (SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(wrong) AS BIGINT) AS wrong FROM tallies) t CROSS JOIN (SELECT avg(matched - position) AS mean_delay, median(matched - position)::DOUBLE AS median_delay FROM matched) x", **_MONITOR))
def sim_monitor_totals(spark, d):
    """Sums over all streams, ratios of the sums, and the delays of all streams together."""
    return Q._round(U.monitor_totals(_stream_tallies(spark, d), Q._matched(spark, d)))


def _stream_tallies(spark, d) -> DataFrame:
    hits = Q._matched(spark, d).groupBy("key").agg(F.count("matched").alias("correct"), (F.count("*") - F.count("matched")).alias("missed"))
    counts = hits.join(Q._alarms(spark, d).groupBy("key").agg(F.count("*").alias("alarms")), "key", "left")
    return counts.select("key", "correct", "missed", (F.coalesce("alarms", F.lit(0)) - F.col("correct")).alias("wrong"))


@_report(
    query(
        "SELECT round(quantile_cont(ccd, 0.025), 6) AS ccd_low, round(quantile_cont(ccd, 0.975), 6) AS ccd_high, round(quantile_cont(dnf, 0.025), 6) AS dnf_low, round(quantile_cont(dnf, 0.975), 6) AS dnf_high FROM sampled",
        sampled="SELECT sample, sum(correct) / CAST(nullif(sum(correct + missed), 0) AS DOUBLE) AS ccd, sum(correct) / CAST(nullif(sum(correct + wrong), 0) AS DOUBLE) AS dnf FROM (SELECT s.i AS sample, (s.i * 7919 + t.i * 104729 + s.i * t.i * 31) % (SELECT count(*) FROM tallies) AS stream FROM range(200) s(i) CROSS JOIN range((SELECT count(*) FROM tallies)) t(i)) JOIN numbered_keys USING (stream) GROUP BY 1",
        **_MONITOR,
    )
)
def sim_ratio_intervals(spark, d):
    """Percentile intervals of the ratios over resampled streams; here the draws follow a rule that SQL can repeat."""
    tallies = _stream_tallies(spark, d).withColumn("stream", F.row_number().over(Window.orderBy("key")) - 1)  # one row a stream
    n = tallies.agg(F.count("*").alias("n"))
    draw = spark.range(200).withColumnRenamed("id", "sample").crossJoin(n).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    draw = draw.select("sample", ((F.col("sample") * 7919 + F.col("slot") * 104729 + F.col("sample") * F.col("slot") * 31) % F.col("n")).alias("stream"))
    return Q._round(U.ratio_intervals(tallies, draw))


_PICK = dict(
    _MONITOR,
    ratios="SELECT stream, 'own' AS detector, coalesce(correct / CAST(nullif(correct + missed, 0) AS DOUBLE), -1) AS ccd, coalesce(correct / CAST(nullif(correct + wrong, 0) AS DOUBLE), -1) AS dnf FROM numbered_keys",
    rivals="SELECT stream, 'rival' AS detector, ccd * 0.9 + 0.05 * (stream % 2) AS ccd, dnf - 0.01 AS dnf FROM ratios",
)


@_report(query("SELECT coalesce(min(o.stream) FILTER (WHERE o.ccd > r.ccd AND o.dnf > r.dnf), 0) AS stream, count(*) FILTER (WHERE o.ccd > r.ccd AND o.dnf > r.dnf) > 0 AS met FROM ratios o JOIN rivals r USING (stream)", **_PICK))
def sim_pick_example(spark, d):
    """The first stream on which one detector beats all others on both ratios, else the stream 0."""
    tallies = _stream_tallies(spark, d).withColumn("stream", F.row_number().over(Window.orderBy("key")) - 1)  # one row a stream
    ratio = lambda below: F.coalesce(F.try_divide(F.col("correct"), F.col("correct") + F.col(below)), F.lit(-1.0))
    own = tallies.select("stream", F.lit("own").alias("detector"), ratio("missed").alias("ccd"), ratio("wrong").alias("dnf"))
    rival = own.select("stream", F.lit("rival").alias("detector"), (F.col("ccd") * 0.9 + 0.05 * (F.col("stream") % 2)).alias("ccd"), (F.col("dnf") - 0.01).alias("dnf"))
    return U.pick_stream(own.unionByName(rival), "own").select(F.col("stream").cast("long"), "met")


# ---- records --------------------------------------------------------------------------------------------------

_LINES = {"region": "concat_ws('|', r_regionkey, r_name)", "nation": "concat_ws('|', n_nationkey, n_name, n_regionkey)", "supplier": "concat_ws('|', s_suppkey, s_name)"}


@_report(" UNION ALL ".join(f"SELECT '{t}' AS output, count(*) AS rows, sha256(string_agg({line}, chr(10) ORDER BY {line})) AS sha256 FROM {t}" for t, line in _LINES.items()))
def meta_manifest(spark, d):
    """Rows and digest of each small output table."""
    columns = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name"]}
    return sinks.row_digests({t: src.table(spark, d, t).select(*c) for t, c in columns.items()})


@_report("SELECT j.n_name AS name, CASE WHEN r.k IS NULL THEN 'missing' WHEN r.k % 3 = 0 THEN 'stale' WHEN r.k % 3 = 1 THEN 'corrupt' ELSE 'cached' END AS state FROM nation j LEFT JOIN (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2) r ON r.k = j.n_nationkey")
def meta_cached_records(spark, d):
    """What becomes of each job, by its record: missing, stale, corrupt or cached."""
    nation = src.table(spark, d, "nation")
    jobs = nation.select(F.col("n_name").alias("name"), F.lit("recipe").alias("fingerprint"))
    kind = F.col("n_nationkey") % 3
    had = nation.where("n_regionkey <> 2").select(F.col("n_name").alias("name"), F.when(kind == 0, "older").otherwise("recipe").alias("fingerprint"), F.lit("a").alias("recorded"), F.when(kind == 1, "b").otherwise("a").alias("found"))
    return sinks.checked_records(jobs, had, ["name"]).select("name", "state")


@_report(query("SELECT DISTINCT ticker FROM panel WHERE ticker NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)"))
def meta_incremental(spark, d):
    """The tickers that an incremental build still has to make."""
    built = src.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("ticker"))
    return sinks.missing_keys(src.star_panel(spark, d), built, ["ticker"])
