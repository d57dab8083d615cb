"""Window operators over long panels: one row for each (ticker, date)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import finite

YEAR = 252
HORIZONS = (1, 21, 63, 126, 252)
MACD_SPANS = ((8, 24), (16, 48), (32, 96))
TARGET_VOLATILITY = 0.15


def by(*keys: str, order: Sequence[str] = ("date",)):
    return Window.partitionBy(*keys).orderBy(*order)


def log_returns(panel: DataFrame) -> DataFrame:
    """ticker, date, return_pct: 100 times the difference of log closes; each series' first row goes."""
    change = 100 * (F.log("close") - F.lag(F.log("close")).over(by("ticker")))
    return panel.select("ticker", "date", change.alias("return_pct")).where("return_pct IS NOT NULL")


def horizon_return(h: int, price: str = "close") -> Column:
    return finite(F.try_divide(F.col(price), F.lag(price, h).over(by("ticker"))) - 1)


def rolling_sd(value: str, width: int, keys: Sequence[str] = ("ticker",)) -> Column:
    """Sample deviation of the last width rows, null before there are as many values."""
    w = by(*keys).rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(w) >= width, F.stddev_samp(value).over(w))


def ewm(panel: DataFrame, value: str, made: dict[str, tuple[str, float, int]], key: str = "ticker", order: str = "date") -> DataFrame:
    """panel with columns of exponentially weighted moments, adjusted weights.

    made: name to (mean-span, mean-halflife, std-span or std-halflife; its length; least number of values). One pass in
    linear time over each series, which is a task's unit of memory.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in panel.schema)}, {', '.join(f'{n} double' for n in made)}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        for name, (kind, length, least) in made.items():
            moment, _, unit = kind.partition("-")
            weighted = pdf[value].ewm(**{unit: length}, min_periods=least)
            pdf[name] = weighted.mean() if moment == "mean" else weighted.std()
        return pdf

    return panel.groupBy(key).applyInPandas(run, schema).withColumns({n: finite(F.col(n)) for n in made})


def winsorise(panel: DataFrame, half_life: float = 252, width: float = 5.0) -> DataFrame:
    """panel with wins: the close held within width deviations of its weighted mean, both of which include the row."""
    out = ewm(panel, "close", {"_mean": ("mean-halflife", half_life, 2), "_sd": ("std-halflife", half_life, 2)})
    held = F.greatest(F.col("_mean") - width * F.col("_sd"), F.least(F.col("_mean") + width * F.col("_sd"), F.col("close")))
    return out.withColumn("wins", F.when(F.col("_sd").isNull(), F.col("close")).otherwise(held)).drop("_mean", "_sd")


def macd(panel: DataFrame, price: str = "wins") -> DataFrame:
    """panel with macd_s_l for each pair of spans: the difference of means over a 63-row deviation of the price, over its own 252-row deviation."""
    means = {f"_m{s}": ("mean-span", s, 1) for pair in MACD_SPANS for s in pair}
    out = ewm(panel, price, means).withColumn("_sd63", rolling_sd(price, 63))
    out = out.withColumns({f"_q{s}_{l}": finite(F.try_divide(F.col(f"_m{s}") - F.col(f"_m{l}"), F.col("_sd63"))) for s, l in MACD_SPANS})
    out = out.withColumns({f"macd_{s}_{l}": finite(F.try_divide(F.col(f"_q{s}_{l}"), rolling_sd(f"_q{s}_{l}", 252))) for s, l in MACD_SPANS})
    return out.drop(*means, "_sd63", *[f"_q{s}_{l}" for s, l in MACD_SPANS])


def base_features(panel: DataFrame) -> DataFrame:
    """daily return and volatility, leverage, next day's scaled return, normalised returns and trend signals, all causal."""
    out = winsorise(panel).withColumn("daily_return", horizon_return(1, "wins"))
    out = ewm(out, "daily_return", {"daily_volatility": ("std-span", 60, 60)})
    out = out.withColumn("lev", finite(F.try_divide(F.lit(TARGET_VOLATILITY), F.col("daily_volatility") * float(np.sqrt(YEAR)))))
    out = out.withColumns({f"norm_ret_{h}": finite(F.try_divide(horizon_return(h, "wins"), F.col("daily_volatility") * float(np.sqrt(h)))) for h in HORIZONS})
    out = out.withColumn("target", F.lead("daily_return").over(by("ticker")) * F.col("lev")).withColumn("target_date", F.lead("date").over(by("ticker")))
    return macd(out)


def expanding_rank(df: DataFrame, value: str, name: str, keys: Sequence[str], order: str = "date", least: int = 63) -> DataFrame:
    """Share of the series' strict past below the value, ties counted half; null before least past values. Sorted insertion, one series at a time."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, {name} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        past = pdf[value].expanding().count() - 1
        pdf[name] = ((pdf[value].expanding().rank(method="average") - 1) / past).where(past >= max(least, 1))
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema).withColumn(name, finite(F.col(name)))


def hysteresis(score: Column, on: float, off: float, window) -> Column:
    """True from a score of at least on until one below off; a null score is on."""
    state = F.when(score.isNull() | (score >= on), True).when(score < off, False)
    return F.coalesce(F.last(state, ignorenulls=True).over(window), F.lit(True))


def upcrossing(above: Column, position: Column, window, start: int) -> Column:
    return above & ~F.coalesce(F.lag(above).over(window), F.lit(False)) & (position >= start)


def recency(alarm: Column, position: Column, window, decay: float = 21.0) -> Column:
    """exp(-age / decay) since the last alarm, 0 before the first."""
    last = F.last(F.when(alarm, position), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.exp(-(position - last) / decay), F.lit(0.0))


def drawdown(df: DataFrame, value: str, keys: Sequence[str], order: str = "date") -> DataFrame:
    """df with wealth and drawdown: the running product of 1 + value, and what it has lost of its highest so far."""
    w = by(*keys, order=(order,)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("wealth", F.product(1 + F.col(value)).over(w))
    return out.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)
