"""Performance of daily return series, and circular block bootstrap of their differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.windows import drawdown

YEAR = 252


def sharpe(value: str) -> Column:
    """Aggregate: null for fewer than two days or without spread."""
    dev = F.stddev_samp(value)
    return F.when((F.count(value) >= 2) & (dev > 0), F.avg(value) / dev * math.sqrt(YEAR))


def performance(daily: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Annual return and volatility, Sharpe, downside deviation, Sortino, largest drawdown, Calmar, share of gains, gain/loss; null for fewer than two days."""
    rows = drawdown(daily, value, keys)
    down = F.stddev_samp(F.when(F.col(value) < 0, F.col(value)))
    out = rows.groupBy(*keys).agg(
        F.count(value).alias("days"), (F.avg(value) * YEAR).alias("returns"), (F.stddev_samp(value) * math.sqrt(YEAR)).alias("vol"), (down * math.sqrt(YEAR)).alias("downside"),
        (-F.min("drawdown")).alias("mdd"), F.avg((F.col(value) > 0).cast("double")).alias("positive"),
        F.try_divide(F.avg(F.when(F.col(value) > 0, F.col(value))), F.abs(F.avg(F.when(F.col(value) < 0, F.col(value))))).alias("gain_loss"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    out = out.withColumns({"sharpe": ratio("returns", "vol"), "sortino": ratio("returns", "downside"), "calmar": ratio("returns", "mdd")})
    names = ["returns", "vol", "sharpe", "downside", "sortino", "mdd", "calmar", "positive", "gain_loss"]
    return out.select(*keys, "days", *[F.when(F.col("days") >= 2, F.col(n)).alias(n) for n in names])


def circular_blocks(n: int, length: int, starts: Sequence[int]) -> np.ndarray:
    return ((np.asarray(starts)[:, None] + np.arange(length)) % n).ravel()[:n]


def _sharpe(x: np.ndarray) -> float:
    dev = x.std(ddof=1) if len(x) > 1 else 0.0
    return x.mean() / dev * math.sqrt(YEAR) if dev > 0 else math.nan


def paired_bootstrap(pairs: DataFrame, keys: Sequence[str], samples: int, length: int = 63, seed: int = 20260828) -> DataFrame:
    """keys, delta, p_value, samples of rows (keys, window, date, gated, ungated): the mean over windows of the Sharpe difference, and the share of resamples in which it is not above zero.

    One generator walks the resamples, and within each the windows; both series take the same days.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", delta double, p_value double, samples int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        windows = [(g["gated"].to_numpy(float), g["ungated"].to_numpy(float)) for _, g in pdf.sort_values("date").groupby("window")]
        gap = lambda a, b: _sharpe(a) - _sharpe(b)
        rng, draws = np.random.default_rng(seed), []
        for _ in range(samples):
            drawn = []
            for a, b in windows:
                at = circular_blocks(len(a), length, rng.integers(0, len(a), -(-len(a) // length)))
                drawn.append(gap(a[at], b[at]))
            draws.append(np.mean(drawn))
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "delta": [np.mean([gap(a, b) for a, b in windows])], "p_value": [np.mean(np.array(draws) <= 0)], "samples": [samples]})

    return pairs.groupBy(*keys).applyInPandas(run, schema)
