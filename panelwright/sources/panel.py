"""Panel sources: the driver's tables, CSV and ZIP archives of price series, and checks of what they hold."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")] + [T.StructField(c, T.LongType()) for c in ("vol", "oi")]
)
DATE_FORMAT = "MM/dd/yyyy"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def star_panel(spark: SparkSession, folder: str) -> DataFrame:
    """ticker, asset_class, date, close: a price panel out of the star tables, one series for each nation.

    The sums are decimal and so exact, whatever the order of rows. The dimensions are tiny and broadcast by their size.
    """
    t = lambda name: table(spark, folder, name)
    lines = t("lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"))
    places = t("customer").select("c_custkey", "c_nationkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("c_custkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("asset_class"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(places, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("ticker", "asset_class", "date").agg((F.sum("price").cast("double") / F.sum("quantity").cast("double")).alias("close"))


def csv_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One header-less CSV for each ticker, <TICKER>_RAD.CSV; a malformed line is an error."""
    read = spark.read.schema(PRICE_SCHEMA).option("dateFormat", DATE_FORMAT).option("mode", "FAILFAST").csv(folder)
    return read.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)_RAD\.CSV$", 1))


def zip_panel(spark: SparkSession, path: str, tickers: Iterable[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """ticker, date, close from a ZIP archive of such CSVs, date bounds inclusive.

    An archive cannot be split, so one task reads one archive; its members stream through in batches. A ticker that
    the archive lacks is an error. Only wanted members are unpacked.
    """
    wanted = None if tickers is None else list(tickers)

    def unpack(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = {n.rpartition("/")[2].removesuffix("_RAD.CSV"): n for n in archive.namelist() if n.endswith("_RAD.CSV")}
                    if missing := set(wanted or ()) - set(members):
                        raise ValueError(f"archive lacks {sorted(missing)}")
                    for ticker in members if wanted is None else wanted:
                        with archive.open(members[ticker]) as raw:
                            rows = [(ticker, dt.datetime.strptime(r[0], "%m/%d/%Y").date(), float(r[4])) for r in csv.reader(io.TextIOWrapper(raw)) if r]
                        yield pd.DataFrame(rows, columns=["ticker", "date", "close"])

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "ticker string, date date, close double")
    if start:
        out = out.where(F.col("date") >= F.lit(start))
    return out.where(F.col("date") <= F.lit(end)) if end else out


def integrity(panel: DataFrame) -> DataFrame:
    """For each ticker: rows, duplicate dates, closes that are null or not finite, closes that are not positive."""
    finite = F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf"))
    per_date = panel.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum((~finite).cast("long")).alias("bad"), F.sum((finite & (F.col("close") <= 0)).cast("long")).alias("low"))
    return per_date.groupBy("ticker").agg(
        F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_dates"), F.sum("bad").alias("not_finite"), F.sum("low").alias("not_positive")
    )


def require_sound(panel: DataFrame) -> DataFrame:
    """The panel, or an error that names the first faulty tickers."""
    faults = integrity(panel).where("duplicate_dates + not_finite + not_positive > 0").limit(5).collect()
    if faults:
        raise ValueError(f"unsound series: {[r['ticker'] for r in faults]}")
    return panel


def study_view(panel: DataFrame, start: dt.date) -> DataFrame:
    return panel.where(F.col("date") >= F.lit(start))


def unknown_tickers(wanted: DataFrame, panel: DataFrame) -> DataFrame:
    return wanted.join(panel.select("ticker").distinct(), "ticker", "left_anti")


def universe(spark: SparkSession, rows: Iterable[tuple[str, str, int]]) -> DataFrame:
    """The static dimension (ticker, asset_class, first_year, ord), in canonical order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ticker string, asset_class string, first_year int, ord int")


def early_rows(df: DataFrame, start: dt.date) -> DataFrame:
    """ticker, early: how many rows of a ticker lie before the study's start; none if all is well."""
    return df.where(F.col("date") < F.lit(start)).groupBy("ticker").agg(F.count("*").alias("early"))


def require_start(df: DataFrame, start: dt.date) -> DataFrame:
    """df, whose rows before start are an error when they are read."""
    late = F.when(F.col("date") >= F.lit(start), F.col("date")).otherwise(F.raise_error(F.lit(f"a row lies before {start}")).cast("date"))
    return df.withColumn("date", late)
