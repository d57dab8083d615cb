"""From members' signals to gated portfolios. All panels are long: an absent row is a contract that is not available."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.metrics import YEAR, sharpe
from panelwright.operators.windows import expanding_rank, hysteresis

EPSILON, RANK_HISTORY, MIN_ACTIVE, BURN_IN = 1e-9, 63, 60, 126
KEYS = ["ticker", "date"]


def ensemble(members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, sample deviation and kappa = |mean| / (deviation + epsilon) of the members' positions in each cell."""
    out = members.groupBy(*keys).agg(F.avg("position").alias("mean"), F.stddev_samp("position").alias("sd"), F.min("target").alias("target"), F.min("lev").alias("lev"))
    return out.withColumn("kappa", F.abs("mean") / (F.col("sd") + EPSILON))


def grid_faults(members: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells without exactly n members, or whose members disagree on the target."""
    cells = members.groupBy(*keys).agg(F.countDistinct("member").alias("members"), (F.max("target") - F.min("target")).alias("spread"))
    return cells.where((F.col("members") != n) | (F.col("spread") != 0))


def top_members(scores: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The k members of highest score, ties to the lower number."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), "member")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def gate(ens: DataFrame, p: float, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """ens with day (see calendar), rank (causal, against the contract's own past) and mask: hysteresis on at p, off below p / 2; p <= 0 is always on."""
    ranked = expanding_rank(_numbered(ens), "kappa", "rank", keys, least=RANK_HISTORY)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("mask", hysteresis(F.col("rank"), p, p / 2, w) if p > 0 else F.lit(True))


def divisor(available: Column, active: Column, m: float) -> Column:
    if not m >= 1:
        raise ValueError("the cap must be at least 1")
    return active if math.isinf(m) else F.greatest(active.cast("double"), available / m)


def calendar(rows: DataFrame) -> DataFrame:
    """date, day: the numbered dates of the whole panel, so that a contract's missing day is a gap in day."""
    dates = rows.select("date").distinct()
    return dates.withColumn("day", F.row_number().over(Window.orderBy("date")))  # one row a date


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with day; numbered once, before ranks are computed, so that these aren't computed a second time for their dates."""
    return rows if "day" in rows.columns else rows.join(calendar(rows), "date")


def _turnover(rows: DataFrame, holding: Column) -> DataFrame:
    """rows with turnover: the change of the holding since the calendar's day before; none across a gap."""
    w = Window.partitionBy("ticker").orderBy("day")
    rows = rows.withColumn("holding", holding)
    follows = F.col("day") - F.lag("day").over(w) == 1
    return rows.withColumn("turnover", F.coalesce(F.when(follows, F.abs(F.col("holding") - F.lag("holding").over(w))), F.lit(0.0)))


def _daily(rows: DataFrame, capital: Column) -> DataFrame:
    rows = _numbered(rows).withColumn("capital", capital)
    rows = _turnover(rows, F.col("mean") * F.col("capital") * F.col("lev"))
    day = rows.groupBy("date").agg(
        F.coalesce(F.sum(F.col("mean") * F.col("capital") * F.col("target")), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"),
        F.count("*").alias("n_available"), F.sum(F.col("mask").cast("long")).alias("n_active"),
    )
    return day


def gated_portfolio(gated: DataFrame, m: float) -> DataFrame:
    """date, gross, turnover, n_available, n_active: freed capital goes to the active contracts up to m times the equal share."""
    day = Window.partitionBy("date")
    rows = gated.where("target IS NOT NULL").withColumns({"_n": F.count("*").over(day), "_a": F.sum(F.col("mask").cast("long")).over(day)})
    share = F.coalesce(F.try_divide(F.col("mask").cast("double"), divisor(F.col("_n"), F.col("_a"), m)), F.lit(0.0))
    return _daily(rows, share)


def confidence_capital(gated: DataFrame, m: float) -> DataFrame:
    """gated with capital: an equal share for each active contract, and the freed capital by rank (null: one half), held under m equal shares."""
    if not m >= 1:
        raise ValueError("the cap must be at least 1")
    day = Window.partitionBy("date")
    rows = gated.where("target IS NOT NULL").withColumns({"_n": F.count("*").over(day), "_a": F.sum(F.col("mask").cast("long")).over(day)})
    rows = rows.withColumn("_c", F.when(F.col("mask"), F.coalesce("rank", F.lit(0.5))))
    freed = F.greatest(F.lit(0.0), (F.col("_n") - F.col("_a")) / F.col("_n"))
    extra = F.coalesce(F.try_divide(F.col("_c"), F.sum("_c").over(day)) * freed, F.lit(0.0))
    capital = F.col("mask").cast("double") / F.col("_n") + extra
    rows = rows.withColumn("capital", capital if math.isinf(m) else F.least(capital, m / F.col("_n")))
    return rows.drop("_n", "_a", "_c")


def capital_portfolio(shares: DataFrame) -> DataFrame:
    """The daily portfolio of explicit shares (column capital)."""
    return _daily(shares.withColumnRenamed("capital", "_capital"), F.col("_capital"))


def conditional_sharpe(gated: DataFrame, bps: float = 0.0, keys: Sequence[str] = (), least: int = MIN_ACTIVE) -> DataFrame:
    """Mean of the contracts' Sharpe ratios over their active days, weighted by these; with costs, the first abstained day's exit counts too."""
    w = Window.partitionBy(*keys, "ticker").orderBy("date")
    rows = gated.where("target IS NOT NULL")
    rows = rows.withColumn("_h", F.when(F.col("mask"), F.col("mean") * F.col("lev")).otherwise(0.0))
    rows = rows.withColumn("_t", F.coalesce(F.abs(F.col("_h") - F.lag("_h").over(w)), F.lit(0.0)))
    gross = F.when(F.col("mask"), F.col("mean") * F.col("target")).otherwise(0.0)
    counted = F.col("mask") | (F.col("_t") > 0) if bps else F.col("mask")
    caught = F.when(counted, gross - bps * 1e-4 * F.col("_t"))
    each = rows.groupBy(*keys, "ticker").agg(F.sum(F.col("mask").cast("long")).alias("days"), F.avg(caught).alias("avg"), F.stddev_samp(caught).alias("dev"))
    used = (F.col("days") >= least) & (F.col("dev") > 0)
    return each.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(used, F.col("avg") / F.col("dev") * math.sqrt(252) * F.col("days"))), F.sum(F.when(used, F.col("days")))).alias("conditional_sharpe"),
        F.coalesce(F.sum(F.when(used, 1).otherwise(0)), F.lit(0)).alias("included"), F.coalesce(F.sum(F.when(F.coalesce(used, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias("excluded"),
    )


def abstention(gated: DataFrame, burn_in: int = BURN_IN) -> DataFrame:
    """ticker, days, abstained: the share of days off after the calendar's first burn_in days."""
    rows = _numbered(gated).where(F.col("day") > burn_in)
    return rows.groupBy("ticker").agg(F.count("*").alias("days"), F.avg((~F.col("mask")).cast("double")).alias("abstained"))


def class_windows(gated: DataFrame, costs: Sequence[float], window: Column) -> DataFrame:
    """asset_class, policy, window, bps, sharpe of each class's sleeve under three rules within the class: ungated and hyst
    hold equal shares of all or of the active contracts, confidence adds the freed capital by rank without a cap.

    A day of the panel without a contract of the class counts as zero, without a row for it: the window's days are counted
    from all classes. A class without any row in a window has none there.
    """
    day = Window.partitionBy("asset_class", "date")
    sure, on, n = F.when(F.col("mask"), F.coalesce("rank", F.lit(0.5))), F.col("mask").cast("double"), F.col("_n")
    rows = gated.where("target IS NOT NULL").withColumns({"_n": F.count("*").over(day), "_a": F.sum(F.col("mask").cast("long")).over(day), "_c": sure, "_w": F.sum(sure).over(day)})
    extra = F.coalesce(F.try_divide(F.col("_c"), F.col("_w")) * (n - F.col("_a")) / n, F.lit(0.0))
    shares = {"ungated": 1 / n, "hyst": on / n, "confidence": on / n + extra}
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("_capital")) for k, v in shares.items()]))
    rows = rows.select("asset_class", "ticker", "date", "day", "mean", "target", "lev", each).withColumn("_h", F.col("mean") * F.col("_capital") * F.col("lev"))
    own = Window.partitionBy("policy", "ticker").orderBy("day")
    rows = rows.withColumn("_t", F.when(F.col("day") - F.lag("day").over(own) == 1, F.abs(F.col("_h") - F.lag("_h").over(own))))
    daily = rows.groupBy("policy", "asset_class", "date").agg(F.sum(F.col("mean") * F.col("_capital") * F.col("target")).alias("gross"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("turnover"))
    whole = Window.partitionBy("policy", "window")  # a row a class and day
    daily = daily.withColumn("window", window).withColumn("_d", F.dense_rank().over(whole.orderBy("date"))).withColumn("_days", F.max("_d").over(whole))
    net = daily.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in costs]))).withColumn("net", F.col("gross") - F.col("bps") * 1e-4 * F.col("turnover"))
    out = net.groupBy("asset_class", "policy", "window", "bps").agg(F.max("_days").alias("days"), F.count("net").alias("k"), F.avg("net").alias("x"), F.var_pop("net").alias("v"))
    mean = F.col("k") * F.col("x") / F.col("days")
    spread = F.col("k") * (F.col("v") + F.pow(F.col("x") - mean, 2)) + (F.col("days") - F.col("k")) * mean * mean
    ratio = F.when((F.col("days") >= 2) & (spread > 0), mean / F.sqrt(spread / (F.col("days") - 1)) * math.sqrt(YEAR))
    return out.select("asset_class", "policy", "window", "bps", ratio.alias("sharpe"))


def class_summary(gated: DataFrame, least: int = MIN_ACTIVE) -> DataFrame:
    """By class: contracts, abstention, conditional Sharpe ratios over all and over active days (weighted by a contract's days, of which it needs least),
    ratios of the sleeves of all and of active contracts, and mean capital shares: equal ones, and those by confidence without a cap.
    """
    rows = confidence_capital(gated, math.inf).withColumn("_all", F.count("*").over(Window.partitionBy("date")))
    got, on = F.col("mean") * F.col("target"), F.col("mask")
    daily = rows.groupBy("asset_class", "date").agg(
        F.count("*").alias("n"), F.sum(got).alias("u"), F.coalesce(F.sum(F.when(on, got)), F.lit(0.0)).alias("g"),
        F.sum("capital").alias("c"), F.sum(1 / F.col("_all")).alias("s"), F.count_if(~on).alias("off"),
    ).withColumns({"u": F.col("u") / F.col("n"), "g": F.col("g") / F.col("n")})
    by_class = daily.groupBy("asset_class").agg(
        (F.sum("off") / F.sum("n")).alias("abstention"), sharpe("u").alias("sleeve_ungated"), sharpe("g").alias("sleeve_hyst"), F.sum("s").alias("_s"), F.avg("c").alias("share_confidence"),
    )
    # equal shares add up to one on every day of the panel, so that their sum over the classes counts the days
    by_class = by_class.withColumn("share_baseline", F.col("_s") / F.sum("_s").over(Window.partitionBy(F.lit(0)))).drop("_s")
    held = {"ungated": got, "gated": F.when(on, got)}
    each = rows.groupBy("asset_class", "ticker").agg(*[a for k, v in held.items() for a in (F.count(v).alias(f"n_{k}"), F.avg(v).alias(f"x_{k}"), F.stddev_samp(v).alias(f"d_{k}"))])
    used = {k: (F.col(f"n_{k}") >= least) & (F.col(f"d_{k}") > 0) for k in held}
    ratios = [F.try_divide(F.sum(F.when(used[k], F.col(f"x_{k}") / F.col(f"d_{k}") * F.col(f"n_{k}"))), F.sum(F.when(used[k], F.col(f"n_{k}")))) * math.sqrt(YEAR) for k in held]
    per_contract = each.groupBy("asset_class").agg(F.count("*").alias("contracts"), *[r.alias(f"cond_{k}") for k, r in zip(held, ratios)])
    return by_class.join(per_contract, "asset_class")


def fixed_portfolio(positions: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, gross, turnover with the constant divisor n; a contract's change is since its own last row."""
    w = Window.partitionBy(*keys, "ticker").orderBy("date")
    held = F.col("position") * F.col("lev")
    rows = positions.withColumn("_t", F.coalesce(F.abs(held - F.lag(held).over(w)), F.lit(0.0)))
    return rows.groupBy(*keys, "date").agg((F.sum(F.col("position") * F.col("target")) / n).alias("gross"), (F.sum("_t") / n).alias("turnover"))


def ensemble_size(trials: Column, wanted: int | None = None) -> Column:
    """The members that a report takes: five, or all of fewer trials; a wanted number must lie in 1 to trials."""
    if wanted is None:
        return F.least(F.lit(5), trials)
    return F.when((trials >= wanted) & F.lit(wanted >= 1), F.lit(wanted)).otherwise(F.raise_error(F.lit(f"an ensemble of {wanted} asks for other trials")).cast("int"))


def gate_grid(ens: DataFrame, ps: Sequence[float], ms: Sequence[float]) -> DataFrame:
    """variant, p, m, date, gross, turnover, n_available, n_active for both rules under all thresholds and caps.

    The ranks, the sequential part, are computed once; thresholds, rules and caps are exploded after them.
    """
    ranked = expanding_rank(_numbered(ens), "kappa", "rank", ["ticker"], least=RANK_HISTORY).where("target IS NOT NULL")
    rows = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    past = Window.partitionBy("p", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("rank").isNull() | (F.col("rank") >= F.col("p")), True).when(F.col("rank") < F.col("p") / 2, False)
    rows = rows.withColumn("mask", (F.col("p") <= 0) | F.coalesce(F.last(state, ignorenulls=True).over(past), F.lit(True)))
    day = Window.partitionBy("p", "date")
    sure = F.when(F.col("mask"), F.coalesce("rank", F.lit(0.5)))
    rows = rows.withColumns({"_n": F.count("*").over(day), "_a": F.sum(F.col("mask").cast("long")).over(day), "_c": sure, "_w": F.sum(sure).over(day)})
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(float(m)).alias("m")) for v in ("rank-hyst", "rank-cwhyst") for m in ms]))
    rows = rows.withColumn("_cell", cells).select("*", "_cell.variant", "_cell.m")
    on, n = F.col("mask").cast("double"), F.col("_n")
    equal = F.coalesce(F.try_divide(on, F.greatest(F.col("_a").cast("double"), n / F.col("m"))), F.lit(0.0))
    extra = F.coalesce(F.try_divide(F.col("_c"), F.col("_w")) * F.greatest(F.lit(0.0), (n - F.col("_a")) / n), F.lit(0.0))
    rows = rows.withColumn("_capital", F.when(F.col("variant") == "rank-hyst", equal).otherwise(F.least(on / n + extra, F.col("m") / n)))
    own = Window.partitionBy("variant", "p", "m", "ticker").orderBy("day")
    held = F.col("mean") * F.col("_capital") * F.col("lev")
    rows = rows.withColumn("_h", held)
    rows = rows.withColumn("_t", F.when(F.col("day") - F.lag("day").over(own) == 1, F.abs(F.col("_h") - F.lag("_h").over(own))))
    label = F.when(F.col("m") == math.inf, "inf").otherwise(F.format_string("%.4f", "m"))
    label = F.regexp_replace(label, r"\.?0+$", "")
    return rows.groupBy("variant", "p", label.alias("m"), "date").agg(
        F.coalesce(F.sum(F.col("mean") * F.col("_capital") * F.col("target")), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("turnover"),
        F.count("*").alias("n_available"), F.sum(F.col("mask").cast("long")).alias("n_active"),
    )


def select_policy(daily: DataFrame, variant: str, p: float, m: str) -> DataFrame:
    """The days of one cell of gate_grid(); a date with two rows is an error."""
    rows = daily.where((F.col("variant") == variant) & (F.abs(F.col("p") - p) < 1e-9) & (F.col("m") == m)).drop("variant", "p", "m")
    twice = F.count("*").over(Window.partitionBy("date")) > 1
    return rows.withColumn("_twice", twice).withColumn("date", F.when(F.col("_twice"), F.raise_error(F.lit("a date of the policy has two rows")).cast("date")).otherwise(F.col("date"))).drop("_twice")


def calendar_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """date, lacks_first, lacks_second for the dates that only one of two policies has; equal calendars give none."""
    a, b = first.select("date", F.lit(1).alias("_a")), second.select("date", F.lit(1).alias("_b"))
    both = a.join(b, "date", "full").where("_a IS NULL OR _b IS NULL")
    return both.select("date", F.col("_a").isNull().alias("lacks_first"), F.col("_b").isNull().alias("lacks_second"))
