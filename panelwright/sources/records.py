"""Readers of features, records, fits and profiles."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, fields
from datetime import date
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import clip

Made = TypeVar("Made")


def features(spark: SparkSession, path: str, columns: Sequence[str] = (), tickers: Sequence[str] = ()) -> DataFrame:
    """A feature table by ticker; only these columns are read, and of a table partitioned by ticker only these partitions."""
    out = spark.read.parquet(path)
    lacking = [c for c in ("ticker", "date", *columns) if c not in out.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    out = out.select("ticker", "date", *columns) if columns else out
    return out.where(F.col("ticker").isin(*tickers)) if tickers else out


def change_columns(detector: DataFrame) -> DataFrame:
    """What models read of a change detector's output: its young mass, its run length in months up to one, change mass and volatility."""
    month = clip(F.col("expected_run_length") / 21, 0.0, 1.0)
    return detector.select("ticker", "date", F.col("young_prob").alias("bocpd_score"), month.alias("bocpd_rl"), F.col("cp_prob").alias("bocpd_cp_prob"), F.col("expected_volatility").alias("bocpd_exp_vol"))


def chart_columns(detector: DataFrame) -> DataFrame:
    return detector.select("ticker", "date", "cmv_stat", "cmv_recent")


#: What each family joins to the base features: columns by ticker and date (inner), columns by date alone (left). Fixed values.
FAMILIES = {
    "base": ((), ()),
    "bocpd": (("bocpd_score", "bocpd_rl"), ()),
    "bocpd_rich": (("bocpd_score", "bocpd_rl", "bocpd_cp_prob", "bocpd_exp_vol"), ()),
    "bocpd_sys": (("bocpd_score", "bocpd_rl"), ("sys_score", "sys_frac")),
    "bocpd_full": (("bocpd_score", "bocpd_rl", "bocpd_cp_prob", "bocpd_exp_vol"), ("sys_score", "sys_frac")),
    "cusum": (("cmv_stat", "cmv_recent"), ()),
}


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str
    cost_bps: float = 0.0

    @property
    def columns(self) -> tuple[str, ...]:
        own, daily = FAMILIES[self.family]
        return own + daily


#: Models by name; those trained on net returns have the cost in their name. Fixed values.
MODELS = {
    m.name: m
    for m in (
        ModelSpec("LSTM", "base"), ModelSpec("LSTM-BOCPD", "bocpd"), ModelSpec("LSTM-BOCPD-rich", "bocpd_rich"), ModelSpec("LSTM-BOCPD-sys", "bocpd_sys"), ModelSpec("LSTM-BOCPD-full", "bocpd_full"),
        ModelSpec("LSTM-CUSUM-mv", "cusum"), ModelSpec("LSTM@2bp", "base", 2.0), ModelSpec("LSTM-BOCPD@2bp", "bocpd", 2.0), ModelSpec("LSTM-BOCPD-rich@2bp", "bocpd_rich", 2.0),
    )
}


def family_features(family: str, base: DataFrame, detector: DataFrame | None = None, daily: DataFrame | None = None) -> DataFrame:
    """base with a family's columns: a detector's by ticker and date, where it has rows, and the whole panel's by date."""
    if family not in FAMILIES:
        raise KeyError(f"unknown family {family}")
    own, shared = FAMILIES[family]
    out = base
    if own:
        out = out.join(detector.select("ticker", "date", *own), ["ticker", "date"])
    if shared:
        out = out.join(daily.select("date", *shared), "date", "left")
    return out


def trial_records(spark: SparkSession, path: str, schema: str, trials: int | None = None) -> DataFrame:
    """Records of trials, one JSON object a file or line, in the order of their index; trials: only those below."""
    out = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return (out.where(F.col("index") < trials) if trials is not None else out).orderBy("index")


def fitted_inputs(spark: SparkSession, path: str, source_sha256: str) -> DataFrame:
    """Fits with the hash of the archive that they were made from; those of another archive are refused."""
    out = spark.read.parquet(path)
    other = out.where(~F.col("source_sha256").eqNullSafe(F.lit(source_sha256))).select("source_sha256").first()
    if other:
        raise ValueError(f"{path} was fitted on {other[0]}, not on {source_sha256}")
    return out


def profile(text: str, kind: type[Made]) -> Made:
    """A frozen dataclass from TOML: no unknown entry, none missing without a default, and each of its field's type."""
    given, known = tomllib.loads(text), {f.name: f for f in fields(kind)}
    unknown, lacking = sorted(given.keys() - known.keys()), sorted(n for n, f in known.items() if n not in given and f.default is MISSING and f.default_factory is MISSING)
    if unknown or lacking:
        raise ValueError(f"unknown entries: {unknown}; missing ones: {lacking}")
    plain = {"int": int, "float": (int, float), "str": str, "bool": bool, "tuple": list, "date": date}
    out = {}
    for name, value in given.items():
        want = known[name].type
        want = (want if isinstance(want, str) else want.__name__).partition("[")[0]
        if want in plain and (not isinstance(value, plain[want]) or (want in ("int", "float") and isinstance(value, bool))):
            raise ValueError(f"{name} must be {want}, not {value!r}")
        out[name] = tuple(value) if isinstance(value, list) else float(value) if want == "float" else value
    return kind(**out)


def require_dates(windows: Sequence[int], span: int, first: date, last: date) -> None:
    """Test windows (first years) must follow each other within the study's dates."""
    if not windows or list(windows) != sorted(set(windows)):
        raise ValueError("windows must be rising years")
    if date(windows[0], 1, 1) < first or date(windows[-1] + span - 1, 12, 31) > last:
        raise ValueError(f"windows must lie in {first} to {last}")


def ordered_universe(universe: DataFrame, wanted: DataFrame) -> DataFrame:
    """ticker, place: the wanted tickers in the universe's order (its column ord), numbered from 0."""
    both = universe.join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    return both.select("ticker", (F.row_number().over(Window.orderBy("ord")) - 1).alias("place"))  # one row a ticker
