"""The engine's queries over the driver's tables: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import charts as C
from panelwright.operators import ensemble as E
from panelwright.operators import events as V
from panelwright.operators import metrics as M
from panelwright.operators import positions as P
from panelwright.operators import regimes as R
from panelwright.operators import tensors as T
from panelwright.operators import windows as W
from panelwright.sources import panel as src
from panelwright.streaming import online as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIGNALS = (1, 5, 10, 21, 42, 63)
TRAIN_END = dt.date(1998, 12, 31)
EVENTS = [("first", dt.date(1996, 6, 3), ["ASIA", "EUROPE"]), ("second", dt.date(1998, 8, 17), ["EUROPE", "AMERICA", "AFRICA"]), ("third", dt.date(2000, 3, 10), ["AMERICA"]), ("late", dt.date(2030, 1, 1), ["ASIA"])]
#: Rows at the end of each series that the selection of a law rests on.
SELECTION_ROWS, SELECTION_BURN_IN = 2_000, 50
LAWS: list[float | None] = [4.0, 6.0, 10.0]
#: Sizes of the reference's full profile.
FILTER = {"particles": 500, "most": 250}
SELECTION_SEEDS, GARCH_STARTS, BOOT_SAMPLES = 2, 5, 2_000
TRIALS, REPLICATES, TRAINING = 50, 20, {"epochs": 300, "patience": 25}
THRESHOLDS = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0)


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.withColumns({c: F.round(c, other.get(c, digits)) for c, t in df.dtypes if t == "double"})


# ---- shared inputs --------------------------------------------------------------------------------------------


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return src.star_panel(spark, d).withColumn("pos", F.row_number().over(W.by("ticker")) - 1)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """pos counts prices, so that the first return has 1."""
    change = 100 * (F.log("close") - F.lag(F.log("close")).over(W.by("ticker")))
    return _numbered(spark, d).withColumn("return_pct", change).where("return_pct IS NOT NULL").drop("close")


def _simple(spark: SparkSession, d: str) -> DataFrame:
    return src.star_panel(spark, d).withColumn("r", W.horizon_return(1))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """All lags, leads and rolling moments share one partitioning by ticker."""
    w = W.by("ticker")
    out = _simple(spark, d).withColumn("sd", W.rolling_sd("r", 63)).withColumn("lev", 0.15 / (F.nullif("sd", F.lit(0.0)) * math.sqrt(252)))
    out = out.withColumn("target", F.lead("r").over(w) * F.col("lev")).withColumn("target_date", F.lead("date").over(w))
    return out.withColumns({f"s{i}": F.try_divide(F.col("close") / F.lag("close", h).over(w) - 1, F.col("sd") * math.sqrt(h)) for i, h in enumerate(SIGNALS)})


def _full(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).where("sd > 0 AND s5 IS NOT NULL AND target IS NOT NULL")


def _members(spark: SparkSession, d: str) -> DataFrame:
    held = [F.least(F.greatest(F.col(f"s{i}"), F.lit(-20.0)), F.lit(20.0)) for i in range(len(SIGNALS))]
    each = F.array(*[F.struct(F.lit(i).alias("member"), ((F.exp(2 * x) - 1) / (F.exp(2 * x) + 1)).alias("position")) for i, x in enumerate(held)])
    return _full(spark, d).select("ticker", "asset_class", "date", "target", "lev", F.inline(each))


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    return E.ensemble(_members(spark, d), ["ticker", "asset_class", "date"])


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return E.gate(_ensemble(spark, d), 0.5)


def _capped(spark: SparkSession, d: str) -> DataFrame:
    """The gated panel with capital shares under the cap of two equal shares."""
    day = Window.partitionBy("date")
    rows = _gated(spark, d).withColumns({"n": F.count("*").over(day), "a": F.sum(F.col("mask").cast("long")).over(day)})
    return rows.withColumn("capital", F.col("mask").cast("double") / E.divisor(F.col("n"), F.col("a"), 2.0))


def _class_returns(spark: SparkSession, d: str) -> DataFrame:
    return _simple(spark, d).where("r IS NOT NULL").groupBy("asset_class", "date").agg(F.avg("r").alias("r"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = src.table(spark, d, "events").select(F.col("event_type").alias("key"), "value", "ts", "event_id")
    return C.positions(events, "key", ("ts", "event_id")).drop("event_id")


def _statistics(spark: SparkSession, d: str, kind: str = "cusum-mean") -> DataFrame:
    return C.trajectory(_stream(spark, d), "key", "value", C.Chart(kind))


def _upcrossed(rows: DataFrame, key: str, above) -> DataFrame:
    crossed = W.upcrossing(above, F.col("pos"), Window.partitionBy(key).orderBy("pos"), 50)
    return rows.withColumn("_up", crossed).where("_up").drop("_up")


def _alarms(spark: SparkSession, d: str) -> DataFrame:
    return _upcrossed(_statistics(spark, d), "key", F.col("statistic") > 4).select("key", "pos")


def _panel_alarms(spark: SparkSession, d: str) -> DataFrame:
    return _upcrossed(_log(spark, d), "ticker", F.abs("return_pct") > 150).select("ticker", "asset_class", "pos")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    events = spark.createDataFrame(EVENTS, "event string, date date, classes array<string>")
    return V.event_positions(events, _log(spark, d))


def _delays(spark: SparkSession, d: str) -> DataFrame:
    return V.first_hits(_panel_alarms(spark, d), _marks(spark, d), ["ticker"], 0, V.DETECT, "delay")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    changes = _stream(spark, d).where("pos >= 100 AND pos % 200 = 0").select("key", F.col("pos").alias("position"))
    return V.match_alarms(_alarms(spark, d), changes, ["key"], V.DETECT)


def _year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def _prices_for_filter(spark: SparkSession, d: str, last: int | None = None) -> DataFrame:
    """Whole series in units of their deviation; last: only so many rows at the end of each, after the scaling."""
    w = Window.partitionBy("ticker")
    out = _log(spark, d).withColumn("x", F.try_divide(F.col("return_pct"), F.stddev_pop("return_pct").over(w))).where("x IS NOT NULL")
    if last is not None:
        out = out.withColumn("k", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("k") <= last)
    return out.select("ticker", "asset_class", F.col("pos").cast("int").alias("pos"), "x")


# ---- sources and projections ----------------------------------------------------------------------------------


@_query
def src_panel(spark, d):
    return _round(src.star_panel(spark, d))


@_query
def src_integrity(spark, d):
    return src.integrity(src.star_panel(spark, d))


@_query
def src_universe_unknown(spark, d):
    wanted = spark.createDataFrame([("NATION_3",), ("ATLANTIS",), ("NATION_7",), ("LEMURIA",)], "ticker string")
    return src.unknown_tickers(wanted, src.star_panel(spark, d))


@_query
def src_study_view(spark, d):
    return _round(src.study_view(src.star_panel(spark, d), dt.date(1999, 1, 1)).select("ticker", "date", "close"))


@_query
def proj_log_return(spark, d):
    return _round(W.log_returns(src.star_panel(spark, d)))


@_query
def proj_simple_return(spark, d):
    return _round(_simple(spark, d).where("r IS NOT NULL").select("ticker", "date", "r"))


@_query
def proj_horizon_returns(spark, d):
    return _round(src.star_panel(spark, d).select("ticker", "date", *[W.horizon_return(h).alias(f"ret_{h}") for h in W.HORIZONS]))


@_query
def proj_lead_target(spark, d):
    w = W.by("ticker")
    return _round(_simple(spark, d).select("ticker", "date", F.lead("r").over(w).alias("next_return"), F.lead("date").over(w).alias("target_date")))


@_query
def proj_leverage(spark, d):
    return _round(_signals(spark, d).where("sd > 0").select("ticker", "date", "lev", "target"))


@_query
def proj_clip(spark, d):
    return _round(_log(spark, d).select("ticker", "date", S.clip(F.col("return_pct") / 21, 0.0, 1.0).alias("clipped")))


@_query
def proj_likelihood(spark, d):
    x, zero, v = F.col("return_pct"), F.lit(0.0), F.lit(400.0)
    return _round(_log(spark, d).select("ticker", "date", S.gaussian_log_density(x, zero, v).alias("gaussian"), S.student_log_density(x, zero, v, 6.0).alias("student")))


@_query
def proj_log_sum_exp(spark, d):
    top = F.max("return_pct").over(Window.partitionBy("ticker"))
    rows = _log(spark, d).withColumn("top", top)
    return _round(rows.groupBy("ticker").agg((F.max("top") + F.log(F.sum(F.exp(F.col("return_pct") - F.col("top"))))).alias("lse")))


@_query
def proj_labels(spark, d):
    nation = src.table(spark, d, "nation")
    law = S.innovation_label(F.when(F.col("n_nationkey") != 0, F.col("n_nationkey")))
    return nation.select(F.col("n_name").alias("name"), S.safe_label(F.concat("n_name", F.lit("@A-B"))).alias("safe"), law.alias("law"), S.backtest_start(F.lit(1999), F.col("n_nationkey") + 1990).alias("start"))


@_query
def proj_seed(spark, d):
    return src.table(spark, d, "nation").select("n_name", S.stable_seed(F.lit(20260828), F.col("n_name"), F.lit("search"), F.col("n_nationkey").cast("string")).alias("seed"))


# ---- windows --------------------------------------------------------------------------------------------------


@_query
def win_rolling_sd(spark, d):
    return _round(_simple(spark, d).select("ticker", "date", W.rolling_sd("r", 63).alias("sd")))


@_query
def win_ewm_vol(spark, d):
    out = W.ewm(_simple(spark, d).select("ticker", "date", "r"), "r", {"daily_volatility": ("std-span", 60, 60)})
    return _round(out.select("ticker", "date", "daily_volatility"))


@_query
def win_winsorize(spark, d):
    return _round(W.winsorise(src.star_panel(spark, d)).select("ticker", "date", "wins"), 5)


@_query
def win_macd(spark, d):
    return _round(W.macd(src.star_panel(spark, d), "close").select("ticker", "date", "macd_8_24"), 5)


@_query
def feat_base(spark, d):
    names = ["daily_return", "daily_volatility", "lev", "target", *[f"norm_ret_{h}" for h in W.HORIZONS], *[f"macd_{s}_{l}" for s, l in W.MACD_SPANS]]
    return W.base_features(src.star_panel(spark, d)).select("ticker", "date", "target_date", *names)


@_query
def win_burn_in_flag(spark, d):
    rows = _ensemble(spark, d).select("ticker", "date")
    return rows.join(E.calendar(rows), "date").select("ticker", "date", (F.col("day") <= E.BURN_IN).alias("burning"))


@_query
def win_drawdown(spark, d):
    out = W.drawdown(_class_returns(spark, d).withColumn("r", F.col("r") * 0.05), "r", ["asset_class"])
    return _round(out.select("asset_class", "date", "wealth", "drawdown"), wealth=4)


# ---- splits and sequences -------------------------------------------------------------------------------------


@_query
def filt_train_split(spark, d):
    rows = T.train_split(_full(spark, d), [f"s{i}" for i in range(len(SIGNALS))], TRAIN_END)
    return rows.groupBy("ticker", "part").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


@_query
def filt_eligible(spark, d):
    return _full(spark, d).where(F.col("target_date") <= F.lit(TRAIN_END)).groupBy("ticker").agg(F.count("*").alias("n")).where("n >= 500")


@_query
def arr_blocks63(spark, d):
    rows = T.blocks(_full(spark, d).withColumn("part", F.lit("all")), ["s0", "s1"])
    total = lambda i: F.aggregate("y", F.lit(0.0), lambda s, y: s + F.get(y, F.lit(i)))
    return _round(rows.select("ticker", "block", F.size("x").alias("steps"), total(1).cast("long").alias("real_steps"), total(2).alias("lev_sum")), 3)


@_query
def arr_trailing63(spark, d):
    rows = T.trailing(_full(spark, d), ["lev"])
    return _round(rows.select("ticker", "date", F.size("x").alias("steps"), F.col("x")[0][0].cast("double").alias("first_lev")), 3)


@_query
def arr_date_codes(spark, d):
    return T.date_codes(_full(spark, d))


@_query
def arr_quantile_grid(spark, d):
    grid = F.percentile("statistic", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)]))
    rows = _statistics(spark, d).where("pos >= 50").groupBy("key").agg(F.array_sort(F.array_distinct(grid)).alias("grid"))
    return _round(rows.select("key", F.explode("grid").alias("threshold")))


# ---- charts and alarms ----------------------------------------------------------------------------------------


def _chart_query(name: str, kind: str) -> None:
    def run(spark, d):
        return _round(_statistics(spark, d, kind).select("key", "pos", "statistic"))

    run.__name__ = name
    _query(run)


for _kind in C.KINDS:
    _chart_query("chart_" + _kind.replace("-", "_"), _kind)


@_query
def alarm_upcross(spark, d):
    return _alarms(spark, d)


@_query
def alarm_first_cross(spark, d):
    return _statistics(spark, d).groupBy("key").agg(F.min(F.when((F.col("statistic") > 4) & (F.col("pos") >= 50), F.col("pos"))).alias("first"))


@_query
def alarm_recency(spark, d):
    w = Window.partitionBy("key").orderBy("pos")
    rows = _statistics(spark, d).withColumn("alarm", W.upcrossing(F.col("statistic") > 4, F.col("pos"), w, 50))
    return _round(rows.select("key", "pos", W.recency(F.col("alarm"), F.col("pos"), w).alias("recent")))


def _run_lengths(stats: DataFrame, thresholds) -> DataFrame:
    """One pass over the statistics for all thresholds: a row for each threshold, series and partition meets the shuffle."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    crossed = F.min(F.when((F.col("statistic") > F.col("threshold")) & (F.col("pos") >= 50), F.col("pos") - 49))
    return stats.select("key", "pos", "statistic", grid).groupBy("threshold", "key").agg(F.coalesce(crossed, F.max("pos") - 49).alias("length"), crossed.isNull().alias("censored"))


@_query
def cal_arl_threshold(spark, d):
    arl = _run_lengths(_statistics(spark, d), THRESHOLDS).groupBy("threshold").agg(F.avg("length").alias("arl"))
    return _round(arl.orderBy(F.abs(F.col("arl") - 100), F.desc("threshold")).limit(1))


@_query
def arl_summary_point(spark, d):
    return _round(_run_lengths(_statistics(spark, d), [6.0]).agg(F.avg("length").alias("arl"), F.stddev_samp("length").alias("sdrl"), F.avg(F.col("censored").cast("int")).alias("censored")))


@_query
def chart_reset(spark, d):
    return C.reset_runs(_stream(spark, d), "key", "value", C.Chart("cusum-combined"), 5.0)


@_query
def cal_rate_threshold(spark, d):
    return C.rate_thresholds(_stream(spark, d), "key", "value", C.Chart("cusum-mean"), [1.0 + 0.5 * i for i in range(20)], 1 / 252)


@_query
def feat_cusum(spark, d):
    rows = C.reset_runs(_log(spark, d).withColumn("pos", F.col("pos").cast("int") - 1), "ticker", "return_pct", C.Chart("cusum-mean"), 6.0)
    w = Window.partitionBy("ticker").orderBy("pos")
    return rows.select("ticker", "pos", S.clip(F.col("statistic") / 6, 0.0, 2.0).alias("cmv_stat"), W.recency(F.col("alarm"), F.col("pos"), w).alias("cmv_recent"), "alarm", "monitored")


# ---- events ---------------------------------------------------------------------------------------------------


@_query
def evt_position(spark, d):
    return _marks(spark, d)


@_query
def evt_detection(spark, d):
    return _delays(spark, d).select("event", "ticker", "delay")


@_query
def evt_awareness(spark, d):
    found = V.first_hits(_panel_alarms(spark, d), _marks(spark, d), ["ticker"], -V.AWARE, 0, "hit")
    return found.select("event", "ticker", F.col("hit").isNotNull().alias("aware"))


@_query
def evt_combined_delay(spark, d):
    found = V.first_hits(_panel_alarms(spark, d), _marks(spark, d), ["ticker"], -V.BEFORE, V.DETECT, "hit")
    on_day = _log(spark, d).select("ticker", F.col("pos").alias("position"), F.abs("return_pct").alias("statistic"))
    rows = found.join(on_day, ["ticker", "position"], "left")
    return rows.select("event", "ticker", V.combined_delay(F.col("hit"), F.col("statistic"), F.lit(50.0)).alias("delay"))


@_query
def evt_off_rate(spark, d):
    return V.off_event(_log(spark, d), _panel_alarms(spark, d), _marks(spark, d), ["ticker"], 50)


@_query
def evt_by_class_all(spark, d):
    _delays(spark, d).createOrReplaceTempView("_panelwright_delays")
    grouped = spark.sql("SELECT coalesce(asset_class, 'All') AS asset_class, count(*) AS applicable, count(delay) AS detected, avg(delay) AS mean_delay, median(delay) AS median_delay FROM _panelwright_delays GROUP BY GROUPING SETS ((asset_class), ())")
    return _round(grouped)


@_query
def sim_delay_summary(spark, d):
    return _round(V.delay_summary(_delays(spark, d), ["event"], 20))


@_query
def sim_match_alarms(spark, d):
    return _matched(spark, d)


@_query
def sim_ccd_dnf(spark, d):
    hits = _matched(spark, d).groupBy("key").agg(F.count("matched").alias("correct"), (F.count("*") - F.count("matched")).alias("missed"))
    counts = hits.join(_alarms(spark, d).groupBy("key").agg(F.count("*").alias("alarms")), "key", "left")
    rows = V.monitoring_ratios(counts.withColumn("false", F.coalesce("alarms", F.lit(0)) - F.col("correct")))
    shown = lambda c: F.when(F.col(c) == float("-inf"), -1.0).otherwise(F.col(c)).alias(c)
    return _round(rows.select("key", "correct", "missed", F.col("false").alias("wrong"), shown("ccd"), shown("dnf")))


# ---- aggregates -----------------------------------------------------------------------------------------------


def _stand_in_fits(spark, d) -> DataFrame:
    """Moments of each series in the place of fitted parameters, so that SQL can follow."""
    high = F.avg((F.col("return_pct") > 100).cast("int"))
    rows = _log(spark, d).groupBy("asset_class", "ticker").agg(F.avg("return_pct").alias("mean"), F.var_pop("return_pct").alias("hbar"), high.alias("alpha"))
    return rows.withColumns({"persistence": 1 - F.col("alpha") / 2, "beta": 1 - 1.5 * F.col("alpha"), "omega": F.col("hbar") * F.col("alpha") / 2, "negative_log_likelihood": F.log("hbar")})


@_query
def agg_prior_quantiles(spark, d):
    return _round(R.prior_from_fits(_stand_in_fits(spark, d), ["asset_class"]))


@_query
def agg_nested_scores(spark, d):
    laws = F.explode(F.array(F.lit(4), F.lit(6), F.lit(10))).alias("law")
    each = _log(spark, d).select("ticker", "asset_class", "return_pct", laws).groupBy("ticker", "asset_class", "law")
    each = each.agg(F.avg(-F.log1p(F.col("return_pct") * F.col("return_pct") / (F.col("law") * 100.0))).alias("score"))
    return _round(each.groupBy("law", "asset_class").agg(F.avg("score").alias("score")).groupBy("law").agg(F.avg("score").alias("pooled")))


@_query
def agg_argmax_ties(spark, d):
    tops = _log(spark, d).groupBy("asset_class", "ticker").agg(F.round(F.max("return_pct"), 0).alias("top"))
    w = Window.partitionBy("asset_class").orderBy(F.desc("top"), "ticker")
    return tops.withColumn("k", F.row_number().over(w)).where("k = 1").select("asset_class", "ticker")


def _systemic(spark, d) -> DataFrame:
    young = F.least(F.abs("return_pct") / 200, F.lit(1.0))
    return _log(spark, d).select("date", young.alias("x")).groupBy("date").agg(F.avg("x").alias("young"), F.avg((F.col("x") > 0.5).cast("int")).alias("share"))


@_query
def agg_systemic(spark, d):
    return _round(_systemic(spark, d))


@_query
def join_family_features(spark, d):
    chart = _log(spark, d).select("ticker", "date", F.col("return_pct").alias("chart"))
    rows = _full(spark, d).select("ticker", "date", "s0").join(chart, ["ticker", "date"]).join(_systemic(spark, d).select("date", "young"), "date", "left")
    return _round(rows, s0=5)


# ---- ensembles and gates --------------------------------------------------------------------------------------


@_query
def ens_mean_kappa(spark, d):
    return _round(_ensemble(spark, d).select("ticker", "date", "mean", "sd", "kappa"), kappa=4)


def _member_sharpes(spark, d) -> DataFrame:
    daily = _members(spark, d).groupBy("member", "date").agg(F.avg(F.col("position") * F.col("target")).alias("r"))
    return daily.groupBy("member").agg(M.sharpe("r").alias("s"))


@_query
def ens_topk_members(spark, d):
    return E.top_members(_member_sharpes(spark, d).select("member", F.round("s", 6).alias("score")), 3).select("member")


@_query
def ens_grid_check(spark, d):
    return E.grid_faults(_members(spark, d), len(SIGNALS)).select("ticker", "date")


@_query
def gate_rank(spark, d):
    return _round(_gated(spark, d).select("ticker", "date", "rank"))


@_query
def gate_hysteresis(spark, d):
    return _gated(spark, d).select("ticker", "date", "mask")


@_query
def gate_divisor(spark, d):
    counts = _gated(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.sum(F.col("mask").cast("long")).alias("a"))
    return _round(counts.select("date", E.divisor(F.col("n"), F.col("a"), 2.0).alias("divisor")))


@_query
def gate_portfolio(spark, d):
    return _round(E.gated_portfolio(_gated(spark, d), 2.0))


@_query
def gate_conf_capital(spark, d):
    return _round(E.confidence_capital(_gated(spark, d), 2.0).select("ticker", "date", "capital"))


@_query
def gate_conf_portfolio(spark, d):
    return _round(E.capital_portfolio(E.confidence_capital(_gated(spark, d), 2.0)))


@_query
def gate_abstention(spark, d):
    return _round(E.abstention(_gated(spark, d)))


@_query
def gate_abstention_top5(spark, d):
    return _round(E.abstention(_gated(spark, d)).select("ticker", "abstained")).orderBy(F.desc("abstained"), "ticker").limit(5)


@_query
def gate_conditional_sharpe(spark, d):
    return _round(E.conditional_sharpe(_gated(spark, d)))


@_query
def gate_by_class(spark, d):
    rows = _capped(spark, d)
    off = rows.groupBy("asset_class").agg(F.avg((~F.col("mask")).cast("int")).alias("abstained"))
    sleeve = rows.groupBy("asset_class", "date").agg(F.sum(F.col("mean") * F.col("capital") * F.col("target")).alias("r"))
    return _round(off.join(sleeve.groupBy("asset_class").agg(M.sharpe("r").alias("sharpe")), "asset_class"))


@_query
def gate_cost_sweep(spark, d):
    costs = F.explode(F.array(*[F.lit(b) for b in (0, 1, 2, 5, 10)])).alias("bps")
    daily = _year(E.gated_portfolio(_gated(spark, d), 2.0)).select("year", "gross", "turnover", costs)
    net = daily.withColumn("net", S.net_return(F.col("gross"), F.col("turnover"), F.col("bps")))
    return _round(net.groupBy("bps", "year").agg(M.sharpe("net").alias("sharpe")))


# ---- performance ----------------------------------------------------------------------------------------------


@_query
def perf_metrics(spark, d):
    out = M.performance(_class_returns(spark, d).withColumn("r", F.col("r") * 0.05), "r", ["asset_class"])
    return _round(out, returns=5, vol=5, sharpe=5, downside=5, sortino=5, calmar=5)


@_query
def perf_window_mean(spark, d):
    by_year = _year(_class_returns(spark, d)).groupBy("asset_class", "year").agg(M.sharpe("r").alias("s"))
    return _round(by_year.groupBy("asset_class").agg(F.avg("s").alias("sharpe")))


@_query
def perf_rescaled(spark, d):
    rows = _year(_class_returns(spark, d))
    vol = rows.groupBy("asset_class", "year").agg((F.stddev_samp("r") * math.sqrt(252)).alias("s")).groupBy("asset_class").agg(F.avg("s").alias("v"))
    return _round(rows.join(vol, "asset_class").select("asset_class", "date", (F.col("r") * 0.15 / F.col("v")).alias("r")))


@_query
def perf_by_window(spark, d):
    years = list(range(1996, 2002))
    wide = _year(_class_returns(spark, d)).groupBy("asset_class").pivot("year", years).agg(M.sharpe("r"))
    return _round(wide.select("asset_class", *[F.col(str(y)).alias(f"y{y}") for y in years]))


@_query
def port_fixed_divisor(spark, d):
    return _round(E.fixed_portfolio(_ensemble(spark, d).withColumnRenamed("mean", "position"), 25))


@_query
def seed_summary(spark, d):
    s = F.col("s")
    return _round(_member_sharpes(spark, d).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"), (F.stddev_samp(s) / F.sqrt(F.count(s))).alias("se")))


@_query
def size_sensitivity(spark, d):
    sizes = F.explode(F.filter(F.array(F.lit(1), F.lit(3), F.lit(6)), lambda s: F.col("member") < s)).alias("size")
    rows = _members(spark, d).select("ticker", "date", "position", "target", sizes).groupBy("size", "ticker", "date").agg(F.avg("position").alias("p"), F.min("target").alias("target"))
    daily = rows.groupBy("size", "date").agg((F.sum(F.col("p") * F.col("target")) / 25).alias("r"))
    return _round(daily.groupBy("size").agg(M.sharpe("r").alias("sharpe")))


@_query
def boot_blocks_fixed(spark, d):
    starts = F.array(*[F.lit(s) for s in (17, 93, 55, 80)])
    i = F.col("id").cast("int")
    return spark.range(100).select(i.alias("i"), F.pmod(F.get(starts, F.floor(i / 30).cast("int")) + i % 30, F.lit(100)).alias("day"))


def _pairs(spark, d) -> DataFrame:
    gated = E.gated_portfolio(_gated(spark, d), 2.0).select("date", F.col("gross").alias("gated"))
    plain = _ensemble(spark, d).groupBy("date").agg((F.sum(F.col("mean") * F.col("target")) / F.count("*")).alias("ungated"))
    return _year(gated.join(plain, "date")).withColumnRenamed("year", "window")


@_query
def boot_delta_observed(spark, d):
    each = _pairs(spark, d).groupBy("window").agg((M.sharpe("gated") - M.sharpe("ungated")).alias("d"))
    return _round(each.agg(F.avg("d").alias("delta")))


@_query
def boot_seeded(spark, d):
    return M.paired_bootstrap(_pairs(spark, d).withColumn("policy", F.lit("hysteresis")), ["policy"], BOOT_SAMPLES)


# ---- regime models --------------------------------------------------------------------------------------------


@_query
def garch_fit(spark, d):
    return R.garch_fits(_prices_for_filter(spark, d), "ticker", "x", starts=GARCH_STARTS)


def _filter_query(name: str, garch: bool, nu: float | None) -> None:
    def run(spark, d):
        return R.change_features(_prices_for_filter(spark, d), "ticker", "x", garch=garch, nu=nu, **FILTER)

    run.__name__ = name
    _query(run)


_filter_query("bocpd_iid", False, None)
_filter_query("bocpd_garch", True, None)
_filter_query("bocpd_garch_t", True, 6.0)


@_query
def nu_select(spark, d):
    """The finite law of best score: mean predictive log likelihood by series over all seeds, then class, then over classes; ties to the first law."""
    series = _prices_for_filter(spark, d, SELECTION_ROWS)
    return R.select_law(R.law_scores(series, ["asset_class", "ticker"], "x", LAWS, SELECTION_SEEDS, burn_in=SELECTION_BURN_IN, **FILTER), ["ticker"], "asset_class")


@_query
def sim_garch_source(spark, d):
    return R.synthetic_streams(spark, 20, 300, seed=7)


def _online(spark, d, detector) -> DataFrame:
    """The events table as a stream that is read to its end; the rows are those of the batch detectors."""
    import uuid

    folder = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints/panelwright").rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = src.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(d if d.endswith("/") else d + "/")
    rows = stream.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    out = O.detect_online(rows, detector)
    out.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder + "/out")


@_query
def stream_cusum(spark, d):
    return _online(spark, d, O.OnlineChart(C.Chart("cusum-mean")))


@_query
def stream_bocpd(spark, d):
    return _online(spark, d, O.OnlineFilter(R.Prior(mu_mean=50.0, mu_sd=50.0, log_hbar_mean=7.0), **FILTER))


# ---- training and bookkeeping ---------------------------------------------------------------------------------


def _blocks(spark, d) -> DataFrame:
    inputs = [f"s{i}" for i in range(len(SIGNALS))]
    held = _full(spark, d).withColumns({c: F.tanh(F.col(c)) for c in inputs}).withColumn("target", S.clip(F.col("target"), -1.0, 1.0))
    split = T.train_split(held, inputs, TRAIN_END)
    codes = F.transform(F.sequence(F.lit(0), F.lit(T.LENGTH - 1)), lambda i: F.concat_ws("-", F.col("block").cast("string"), i.cast("string")))
    return T.blocks(split, inputs).select(F.lit(1999).alias("window"), "part", "x", "y", codes.alias("dates"))


def _search(spark, d) -> DataFrame:
    seed = S.stable_seed(F.lit(1), F.lit("1999"), F.lit("lstm"), F.col("id").cast("string")).cast("long")
    jobs = spark.range(TRIALS).select(F.lit(1999).alias("window"), F.col("id").cast("int").alias("trial"), seed.alias("seed"))
    return P.search(jobs, _blocks(spark, d), **TRAINING)


@_query
def lstm_search(spark, d):
    return _search(spark, d)


@_query
def lstm_replicate(spark, d):
    return P.search(P.replicate_jobs(_search(spark, d), REPLICATES), _blocks(spark, d), **TRAINING)


@_query
def meta_dup_keys(spark, d):
    return src.star_panel(spark, d).groupBy("ticker", "date").agg(F.count("*").alias("n")).where("n > 1")


@_query
def meta_grid_missing(spark, d):
    rows = src.star_panel(spark, d)
    grid = rows.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(1994).cast("long"), F.lit(2002).cast("long"))).alias("year"))
    return grid.join(rows.select("ticker", F.year("date").cast("long").alias("year")).distinct(), ["ticker", "year"], "left_anti")
