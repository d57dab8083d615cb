"""Synthetic scenarios, and the tables over simulated streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.charts import KINDS, Chart
from panelwright.operators.charts import run_with_reset
from panelwright.operators.regimes import ChangeFilter, Prior, garch_stream

#: The regime before a change, and what each scenario changes. Fixed values.
BEFORE = {"mu": 0.0, "omega": 0.05, "alpha": 0.08, "beta": 0.87, "hbar": 1.0}
SCENARIOS = {"S1": {"mu": 0.75}, "S2": {"hbar": 3.0}, "S3": {"hbar": 1 / 3}, "S4": {"mu": 0.75, "hbar": 3.0}}


def after_change(scenario: str) -> dict[str, float]:
    out = {**BEFORE, **SCENARIOS[scenario]}
    return {**out, "omega": out["hbar"] * (1 - out["alpha"] - out["beta"])}


def scenario_table(spark: SparkSession) -> DataFrame:
    names = ("mu", "hbar", "omega", "alpha", "beta")
    rows = [(s, *[after_change(s)[n] for n in names]) for s in SCENARIOS]
    return spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{n} double" for n in names))


def cap_label(m: Column) -> Column:
    """A cap as text: whole numbers without a point, infinity as inf."""
    return F.when(m == math.inf, "inf").when(m == F.floor(m), F.floor(m).cast("long").cast("string")).otherwise(m.cast("string"))


def stream_jobs(spark: SparkSession, kind: str, n: int, length: int, change: int = 0, least: int = 60, hazard: float = 1 / 250, prior: Prior = Prior(), seed: int = 0) -> DataFrame:
    """scenario, stream, pos, value, changed (whether a regime begins there) of n simulated streams of a kind, made by the executors.

    kind: null (no change), single (one change, for each scenario) or continuous (drawn regimes of at least least rows).
    """
    if kind not in ("null", "single", "continuous"):
        raise ValueError(f"unknown kind {kind}")
    names = list(SCENARIOS) if kind == "single" else [kind]

    def make(batches):
        for batch in batches:
            for i in batch["id"]:
                number, name = int(i) // len(names), names[int(i) % len(names)]
                rng = np.random.default_rng([seed, int(i)])
                if kind == "continuous":
                    values, regime = garch_stream(rng, length, hazard=hazard, prior=prior, least=least)
                else:
                    values, regime = garch_stream(rng, length, [(0, BEFORE)] + ([(change, after_change(name))] if kind == "single" else []))
                changed = np.append(False, regime[1:] != regime[:-1])
                yield pd.DataFrame({"scenario": name, "stream": number, "pos": np.arange(length, dtype=np.int32), "value": values, "changed": changed})

    # a stream is few bytes and much work: as many tasks as there are slots, whatever the number of rows
    jobs = spark.range(0, n * len(names), 1, max(1, min(n * len(names), 8 * spark.sparkContext.defaultParallelism)))
    return jobs.mapInPandas(make, "scenario string, stream long, pos int, value double, changed boolean")


def stream_trajectories(streams: DataFrame, burn_in: int = 50, threshold: float = math.inf, **settings) -> DataFrame:
    """scenario, stream, pos, detector, statistic: every chart's path, and the young mass of the filter with and without GARCH."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("pos")
        x, own = pdf["value"].to_numpy(float), {}
        for kind in KINDS:
            own[kind] = run_with_reset(x, Chart(kind, burn_in=burn_in), threshold, False)[0]
        seed = zlib.crc32(f"{pdf['scenario'].iloc[0]}/{pdf['stream'].iloc[0]}".encode())
        for name, garch in (("bocpd", False), ("bocpd-garch", True)):
            detector = ChangeFilter(Prior(), garch, seed=seed, **settings)
            own[name] = np.array([detector.update(float(v))[1] for v in x])
        base = pdf[["scenario", "stream", "pos"]]
        return pd.concat([base.assign(detector=k, statistic=v) for k, v in own.items()])

    return streams.groupBy("scenario", "stream").applyInPandas(run, "scenario string, stream long, pos int, detector string, statistic double")


def monitor_totals(tallies: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: sums of correct, missed and wrong over all streams, ratios of the sums, mean and median delay of all matches."""
    sums = tallies.agg(*[F.sum(c).alias(c) for c in ("correct", "missed", "wrong")])
    delay = F.col("matched") - F.col("position")
    delays = matched.agg(F.avg(delay).alias("mean_delay"), F.median(delay).alias("median_delay"))
    ratio = lambda below: F.try_divide(F.col("correct"), F.col("correct") + F.col(below))
    return sums.crossJoin(delays).select("correct", "missed", "wrong", ratio("missed").alias("ccd"), ratio("wrong").alias("dnf"), "mean_delay", "median_delay")


def ratio_intervals(tallies: DataFrame, draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile intervals of both ratios: tallies by stream, draws (sample, stream) with repeats. Samples without a base are left out."""
    sums = draws.join(tallies, "stream").groupBy("sample").agg(*[F.sum(c).alias(c) for c in ("correct", "missed", "wrong")])
    ratio = lambda below: F.try_divide(F.col("correct"), F.col("correct") + F.col(below))
    each = sums.select(ratio("missed").alias("ccd"), ratio("wrong").alias("dnf"))
    return each.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("ccd", "dnf") for name, q in (("low", low), ("high", high))])


def pick_stream(ratios: DataFrame, own: str) -> DataFrame:
    """One row (stream, met): the first stream where the detector own beats all others strictly on ccd and dnf; without one, stream 0."""
    mine, others = F.col("detector") == own, F.col("detector") != own
    best = [F.max(F.when(mine, F.col(c))).alias(c) for c in ("ccd", "dnf")] + [F.max(F.when(others, F.col(c))).alias(f"other_{c}") for c in ("ccd", "dnf")]
    won = ratios.groupBy("stream").agg(*best).where("ccd > other_ccd AND dnf > other_dnf").agg(F.min("stream").alias("stream"))
    return won.select(F.coalesce("stream", F.lit(0)).alias("stream"), F.col("stream").isNotNull().alias("met"))
