"""Training splits and fixed-length sequences."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 63


def train_split(features: DataFrame, inputs: Sequence[str], train_end: dt.date, share: float = 0.9, least: int = LENGTH) -> DataFrame:
    """Rows with all inputs whose label is known by train_end, with pos and part: the first nine tenths of each series train.

    A series whose validation part has fewer than least rows goes. A count and a rank over one window: no second pass.
    """
    rows = features.dropna(subset=list(inputs)).where((F.col("date") <= F.lit(train_end)) & (F.col("target_date") <= F.lit(train_end)))
    whole = Window.partitionBy("ticker")
    rows = rows.withColumn("pos", F.row_number().over(whole.orderBy("date")) - 1).withColumn("n", F.count("*").over(whole))
    cut = F.floor(F.col("n") * share)
    return rows.where(F.col("n") - cut >= least).withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("validation")).drop("n")


def blocks(rows: DataFrame, inputs: Sequence[str], length: int = LENGTH) -> DataFrame:
    """ticker, part, block, x (length x inputs), y (length x target, mask, lev), filled with zeros at the end."""
    ordered = Window.partitionBy("ticker", "part").orderBy("date")
    rows = rows.withColumn("at", F.row_number().over(ordered) - 1)
    step = F.struct("at", F.array(*[F.col(c).cast("float") for c in inputs]).alias("x"), F.array(F.col("target").cast("float"), F.lit(1.0).cast("float"), F.col("lev").cast("float")).alias("y"))
    grouped = rows.groupBy("ticker", "part", F.floor(F.col("at") / length).cast("int").alias("block")).agg(F.sort_array(F.collect_list(step)).alias("steps"))  # at most length rows each
    none = lambda k: F.array(*[F.lit(0.0).cast("float")] * k)
    padded = lambda part, k: F.concat(F.transform("steps", lambda s: s[part]), F.array_repeat(none(k), F.lit(length) - F.size("steps")))
    return grouped.select("ticker", "part", "block", padded("x", len(inputs)).alias("x"), padded("y", 3).alias("y"))


def trailing(rows: DataFrame, inputs: Sequence[str], length: int = LENGTH) -> DataFrame:
    """rows with x: the inputs of the row and the length - 1 before it; rows with fewer before them go."""
    w = Window.partitionBy("ticker").orderBy("date")
    vector = F.array(*[F.col(c).cast("float") for c in inputs])
    out = rows.withColumn("x", F.collect_list(vector).over(w.rowsBetween(1 - length, 0)))
    return out.where(F.size("x") == length)


def date_codes(rows: DataFrame, date: str = "target_date") -> DataFrame:
    """Each distinct date and its rank from 0; the dates are few beside the rows."""
    return rows.select(date).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(date)) - 1)
