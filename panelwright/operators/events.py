"""Alarms against dated events: positions, detection, awareness, delays and off-event rates.

Range conditions are bucketed by width, so that Spark plans equi-joins with a residual instead of nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETECT, AWARE, BEFORE = 50, 63, 15


def event_positions(events: DataFrame, panel: DataFrame) -> DataFrame:
    """event, ticker, asset_class, position of each event that applies to the ticker's class: its first row on or after the event's date, if neither first nor beyond the last.

    panel has pos. Events are few: they are exploded by class and joined on it; each series contributes an aggregate.
    """
    wanted = events.select("event", F.col("date").alias("event_date"), F.explode("classes").alias("asset_class"))
    rows = panel.join(wanted, "asset_class").groupBy("event", "ticker", "asset_class").agg(F.min(F.when(F.col("date") >= F.col("event_date"), F.col("pos"))).alias("position"))
    return rows.where("position > 0")


def within(alarms: DataFrame, marks: DataFrame, keys: list[str], low: int, high: int, width: int | None = None) -> DataFrame:
    """Pairs of marks (keys, position) and alarms (keys, pos) with position + low <= pos < position + high."""
    width = width or max(1, high - low)
    near = marks.withColumn("_b", F.explode(F.sequence(F.floor((F.col("position") + low) / width), F.floor((F.col("position") + high - 1) / width))))
    placed = alarms.select(*keys, "pos", F.floor(F.col("pos") / width).alias("_b"))
    pairs = near.join(placed, [*keys, "_b"]).drop("_b")
    return pairs.where((F.col("pos") >= F.col("position") + low) & (F.col("pos") < F.col("position") + high))


def first_hits(alarms: DataFrame, marks: DataFrame, keys: list[str], low: int, high: int, name: str) -> DataFrame:
    """marks with name: the first alarm's distance from the position within the bounds, or null."""
    by = marks.columns
    hits = within(alarms, marks, keys, low, high).groupBy(*by).agg(F.min(F.col("pos") - F.col("position")).alias(name))
    return marks.join(hits, by, "left")


def combined_delay(hits: Column, on_event: Column, threshold: Column) -> Column:
    """The first hit, else 0 if the event-day statistic is at least the threshold."""
    return F.coalesce(hits, F.when(on_event >= threshold, 0))


def off_event(rows: DataFrame, alarms: DataFrame, marks: DataFrame, keys: list[str], burn_in: int, low: int = 0, high: int = DETECT) -> DataFrame:
    """keys, alarms, exposure: alarms and rows from burn_in on that lie in no event's window."""
    covered = marks.select(*keys, F.explode(F.sequence(F.col("position") + low, F.col("position") + high - 1)).alias("pos")).distinct()
    free = rows.where(F.col("pos") >= burn_in).select(*keys, "pos").join(covered, [*keys, "pos"], "left_anti")
    flagged = free.join(alarms.select(*keys, "pos").distinct().withColumn("_hit", F.lit(1)), [*keys, "pos"], "left")
    return flagged.groupBy(*keys).agg(F.count("_hit").alias("alarms"), F.count("*").alias("exposure"))


def match_alarms(alarms: DataFrame, changes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, position, matched (null: missed): each change takes the earliest alarm in [change, change + width) that no earlier change took.

    Where changes are at least width apart no alarm has two candidates, so the least alarm is exact; otherwise the
    pairs of a series are swept in order.
    """
    near = Window.partitionBy(*keys).orderBy("position")
    tight = changes.withColumn("_gap", F.lead("position").over(near) - F.col("position")).where(F.col("_gap") < width)
    pairs = within(alarms, changes, keys, 0, width)
    if tight.isEmpty():
        best = pairs.groupBy(*keys, "position").agg(F.min("pos").alias("matched"))
        return changes.select(*keys, "position").join(best, [*keys, "position"], "left")
    start = F.struct(F.array().cast("array<struct<position:int,matched:int>>").alias("out"), F.lit(-1).alias("used"))
    own = pairs.groupBy(*keys, F.col("position").cast("int").alias("position")).agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("at"))  # at most width alarms
    swept = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "at"))).alias("changes"))

    def step(s: Column, c: Column) -> Column:
        free = F.get(F.filter(c["at"], lambda a: a > s["used"]), F.lit(0))
        return F.struct(F.concat(s["out"], F.array(F.struct(c["position"].alias("position"), free.alias("matched")))).alias("out"), F.coalesce(free, s["used"]).alias("used"))

    taken = swept.select(*keys, F.explode(F.aggregate("changes", start, step, lambda s: s["out"])).alias("m")).select(*keys, F.col("m.position").alias("position"), F.col("m.matched").alias("matched"))
    return changes.select(*keys, "position").join(taken, [*keys, "position"], "left")


def delay_summary(delays: DataFrame, keys: list[str], width: int = DETECT) -> DataFrame:
    """Mean, deviation and median of detected delays, and the shares missed within width and altogether; delay null: missed."""
    missed = F.col("delay").isNull()
    return delays.groupBy(*keys).agg(
        F.avg("delay").alias("mean_delay"), F.stddev_samp("delay").alias("sd_delay"), F.median("delay").alias("median_delay"),
        F.avg((missed | (F.col("delay") >= width)).cast("double")).alias("miss_rate"), F.avg(missed.cast("double")).alias("miss_horizon"), F.count("*").alias("trials"),
    )


def monitoring_ratios(counts: DataFrame) -> DataFrame:
    """counts (correct, missed, false) with ccd and dnf, minus infinity where there is nothing to count."""
    least = F.lit(float("-inf"))
    return counts.withColumn("ccd", F.coalesce(F.try_divide("correct", F.col("correct") + F.col("missed")), least)).withColumn("dnf", F.coalesce(F.try_divide("correct", F.col("correct") + F.col("false")), least))
