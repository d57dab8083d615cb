"""Control charts: trajectories without reset as window sums, runs with reset as a function over each series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("cusum-mean", "cusum-variance", "cusum-combined", "ewma")
#: Rows of a run with reset that are followed at a time.
FIRST_STRETCH, LONGEST_STRETCH = 64, 1 << 16


@dataclass(frozen=True)
class Chart:
    kind: str
    burn_in: int = 50
    reference: float = 0.5
    smoothing: float = 0.2


def positions(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return stream.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def standardised(stream: DataFrame, key: str, value: str, burn_in: int) -> DataFrame:
    """stream (with pos) with mean, scale and z by each series' first burn_in rows; series without spread or beyond burn-in rows go."""
    early = F.when(F.col("pos") < burn_in, F.col(value))
    w = Window.partitionBy(key)
    out = stream.withColumns({"mean": F.avg(early).over(w), "scale": F.stddev_samp(early).over(w), "n": F.count("*").over(w)})
    return out.where((F.col("scale") > 0) & (F.col("n") > burn_in)).withColumn("z", (F.col(value) - F.col("mean")) / F.col("scale")).drop("n")


def trajectory(stream: DataFrame, key: str, value: str, chart: Chart) -> DataFrame:
    """stream (with pos) with statistic; burn-in rows have 0.

    A sum that is held at zero from below is the plain running sum less its least value so far, or zero if that is above.
    """
    if chart.kind == "ewma":
        return _ewma(stream, key, value, chart)
    rows = standardised(stream, key, value, chart.burn_in)
    after = F.col("pos") >= chart.burn_in
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    square = (F.col("z") * F.col("z") - 1) / float(np.sqrt(2))
    drifts = {"um": F.col("z"), "lm": -F.col("z"), "uv": square, "lv": -square}
    used = {"cusum-mean": ("um", "lm"), "cusum-variance": ("uv", "lv"), "cusum-combined": ("um", "lm", "uv", "lv")}[chart.kind]
    rows = rows.withColumns({f"_s{d}": F.sum(F.when(after, drifts[d] - chart.reference).otherwise(0.0)).over(w) for d in used})
    held = [F.col(f"_s{d}") - F.least(F.lit(0.0), F.min(f"_s{d}").over(w)) for d in used]
    return rows.withColumn("statistic", F.when(after, F.greatest(*held)).otherwise(0.0)).drop(*[f"_s{d}" for d in used], "z", "mean", "scale")


def _ewma(stream: DataFrame, key: str, value: str, chart: Chart) -> DataFrame:
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, statistic double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, b, s = pdf[value].to_numpy(float), chart.burn_in, chart.smoothing
        scale = x[:b].std(ddof=1) if len(x) > b else 0.0
        if not scale > 0:
            return pdf.iloc[:0].assign(statistic=0.0)
        level = pd.Series(np.concatenate([[x[:b].mean()], x[b:]])).ewm(alpha=s, adjust=False).mean().to_numpy()[1:]
        age = np.arange(1, len(x) - b + 1)
        deviation = scale * np.sqrt(s / (2 - s) * (1 - (1 - s) ** (2 * age)))
        return pdf.assign(statistic=np.concatenate([np.zeros(b), np.abs(level - x[:b].mean()) / deviation]))

    return stream.groupBy(key).applyInPandas(run, schema)


def _stretch(x: np.ndarray, chart: Chart, mean: float, scale: float, age: int, carried) -> tuple[np.ndarray, object]:
    """The statistic of the next rows of a run of that age, and what the rows after them need of it (None: the run begins)."""
    if chart.kind == "ewma":
        s = chart.smoothing
        level = pd.Series(np.concatenate([[mean if carried is None else carried], x])).ewm(alpha=s, adjust=False).mean().to_numpy()[1:]
        return np.abs(level - mean) / (scale * np.sqrt(s / (2 - s) * (1 - (1 - s) ** (2 * np.arange(age + 1, age + len(x) + 1))))), level[-1]
    z = (x - mean) / scale
    square = (z * z - 1) / np.sqrt(2) if chart.kind != "cusum-mean" else z
    drifts = {"cusum-mean": (z, -z), "cusum-variance": (square, -square), "cusum-combined": (z, -z, square, -square)}[chart.kind]
    steps = np.array(drifts) - chart.reference
    total, least = (0.0, np.zeros((len(drifts), 1))) if carried is None else carried
    steps[:, 0] += total
    sums = np.cumsum(steps, axis=1)
    lows = np.minimum(np.minimum.accumulate(sums, axis=1), least)
    return (sums - lows).max(axis=0), (sums[:, -1], lows[:, -1:])


def run_with_reset(x: np.ndarray, chart: Chart, threshold: float, reestimate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, alarm, monitored). The alarm's row is monitored; then the sums restart, and if asked the next burn_in rows give new estimates.

    A run is followed in stretches that double, and ends at its alarm: the work is linear in the rows, however many alarms there are.
    """
    n, b = len(x), chart.burn_in
    statistic, alarm, monitored = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    at, base = b, x[:b]
    while at < n:
        mean, scale = base.mean(), base.std(ddof=1)
        if not scale > 0:
            raise ValueError("burn-in without spread")
        end, carried, wide, over = at, None, FIRST_STRETCH, ()
        while end < n and not len(over):
            own, carried = _stretch(x[end : end + wide], chart, mean, scale, end - at, carried)
            over = np.flatnonzero(own > threshold)
            own = own[: over[0] + 1] if len(over) else own
            statistic[end : end + len(own)] = own
            end, wide = end + len(own), min(2 * wide, LONGEST_STRETCH)
        monitored[at:end] = True
        at = end
        if not len(over):
            break
        alarm[at - 1] = True
        if reestimate:
            if at + b > n:
                break
            base = x[at : at + b]
            at += b
    return statistic, alarm, monitored


def reset_runs(stream: DataFrame, key: str, value: str, chart: Chart, threshold: float, reestimate: bool = True) -> DataFrame:
    """key, pos, statistic, alarm, monitored for each series (with pos) that is longer than the burn-in."""
    kind = dict(stream.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf[value].to_numpy(float)
        if len(x) <= chart.burn_in or not x[: chart.burn_in].std(ddof=1) > 0:
            return pd.DataFrame({key: [], "pos": [], "statistic": [], "alarm": [], "monitored": []})
        statistic, alarm, monitored = run_with_reset(x, chart, threshold, reestimate)
        return pd.DataFrame({key: pdf[key].to_numpy(), "pos": pdf["pos"].to_numpy(), "statistic": statistic, "alarm": alarm, "monitored": monitored})

    return stream.select(key, "pos", value).groupBy(key).applyInPandas(run, f"{key} {kind}, pos int, statistic double, alarm boolean, monitored boolean")


def rate_thresholds(stream: DataFrame, key: str, value: str, chart: Chart, candidates: Sequence[float], rate: float) -> DataFrame:
    """key, threshold: the candidate whose alarms per monitored row come nearest to rate, the larger of two as near."""
    kind = dict(stream.dtypes)[key]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, best = pdf.sort_values("pos")[value].to_numpy(float), None
        if len(x) > chart.burn_in and x[: chart.burn_in].std(ddof=1) > 0:
            for t in candidates:
                _, alarm, monitored = run_with_reset(x, chart, t, True)
                if monitored.sum():
                    gap = (abs(alarm.sum() / monitored.sum() - rate), -t)
                    best = gap if best is None else min(best, gap)
        return pd.DataFrame({key: pdf[key].iloc[:1], "threshold": [-best[1] if best else None]})

    return stream.select(key, "pos", value).groupBy(key).applyInPandas(search, f"{key} {kind}, threshold double")
