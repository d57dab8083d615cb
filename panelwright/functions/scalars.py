"""Scalar expressions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def gaussian_log_density(x: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * (F.lit(math.log(2 * math.pi)) + F.log(variance) + (x - mean) * (x - mean) / variance)


def student_log_density(x: Column, mean: Column, variance: Column, nu: float) -> Column:
    """Student's t with this variance, for nu over 2; the constant is folded here."""
    constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log((nu - 2) * math.pi)
    return F.lit(constant) - 0.5 * F.log(variance) - (nu + 1) / 2 * F.log1p((x - mean) * (x - mean) / ((nu - 2) * variance))


def stable_seed(base: Column, *parts: Column) -> Column:
    """(base + crc32 of the parts joined by bars) modulo 2**31 - 1."""
    return (base + F.crc32(F.concat_ws("|", *parts))) % F.lit(2147483647)


def innovation_label(nu: Column) -> Column:
    """Gaussian for null, else t(nu) without trailing zeros."""
    return F.when(nu.isNull(), "Gaussian").otherwise(F.concat(F.lit("t("), F.regexp_replace(nu.cast("double").cast("string"), r"\.0$", ""), F.lit(")")))


def cap_label(m: Column) -> Column:
    return F.when(m == float("inf"), "inf").otherwise(F.regexp_replace(m.cast("double").cast("string"), r"\.0$", ""))


def safe_label(name: Column) -> Column:
    return F.lower(F.replace(F.replace(name, F.lit("@"), F.lit("_at_")), F.lit("-"), F.lit("_")))


def backtest_start(window: Column, first_year: Column) -> Column:
    return F.make_date(F.greatest(window, first_year), F.lit(1), F.lit(1))


def net_return(gross: Column, turnover: Column, bps: Column) -> Column:
    return gross - bps * 1e-4 * turnover
