"""Sinks, caches, records and profiles, and the simulated streams."""

import hashlib
import json
import os
from dataclasses import dataclass
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ensemble, simulation
from panelwright.sources import records, sinks


def left_over(folder):
    return [n for _, dirs, files in os.walk(folder) for n in dirs + files if n.startswith(".") and not n.endswith(".crc") and not n.startswith("._")]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_publish_replaces_whole(spark, tmp_path, kind):
    place = str(tmp_path / "out" / "table")
    for n in (5, 3):
        sinks.publish(spark.range(n).withColumn("ticker", F.concat(F.lit("t"), F.col("id") % 2)), place, kind, by=["ticker"])
        back = spark.read.schema("id long, ticker string").format(kind).load(place)
        assert sorted(r["id"] for r in back.collect()) == list(range(n)) and {r["ticker"] for r in back.collect()} == {"t0", "t1"}
    with pytest.raises(Exception, match="DIVIDE|divide"):
        sinks.publish(spark.range(3).select((F.lit(1) / F.col("id")).alias("id")), place, kind)
    assert spark.read.format(kind).load(place).count() == 3 and left_over(tmp_path) == []


def test_small_values(spark, tmp_path):
    where = lambda n: str(tmp_path / "deep" / n)
    for text in ("first", "é" * 3_000_000, ""):
        sinks.publish_text(spark, where("a.txt"), text)
        assert sinks.read_bytes(spark, where("a.txt")).decode() == text
    sinks.publish_json(spark, where("a.json"), {"b": [1, None], "a": date(2000, 1, 2)})
    assert sinks.read_json(spark, where("a.json")) == {"b": [1, None], "a": "2000-01-02"}
    arrays = {"x": np.arange(12.0).reshape(3, 4), "days": np.array(["2000-01-01"], "datetime64[D]"), "none": np.zeros((0, 3), np.float32)}
    sinks.publish_arrays(spark, where("a.npz"), **arrays)
    back = sinks.read_arrays(spark, where("a.npz"))
    assert back.keys() == arrays.keys() and all(back[k].dtype == v.dtype and np.array_equal(back[k], v) for k, v in arrays.items())
    with open(where("evil.npz"), "wb") as f:
        np.savez(f, x=np.array([{"a": 1}], object))
    with pytest.raises(ValueError, match="pickle|Object"):
        sinks.read_arrays(spark, where("evil.npz"))
    sinks.copy_file(spark, where("a.json"), where("b.json"))
    assert sinks.read_json(spark, where("b.json"))["b"] == [1, None]
    sinks.publish_csv(spark.range(2), where("rows"))
    assert spark.read.option("header", "true").csv(where("rows")).count() == 2 and left_over(tmp_path) == []


def test_cleanup_stays_inside(spark, tmp_path):
    for n in ("results/a", "build/b", "kept/c"):
        os.makedirs(tmp_path / n)
    assert sinks.remove_generated(spark, str(tmp_path), "results", "build", "absent") == ["results", "build"] and os.listdir(tmp_path) == ["kept"]
    for bad in ("..", "../x", "/etc", "", "a/../b", "file:x"):
        with pytest.raises(ValueError, match="not a folder"):
            sinks.remove_generated(spark, str(tmp_path), bad)


def test_digests_and_manifest(spark, tmp_path):
    assert sinks.value_digest({"b": 1, "a": [1.5, None]}) == sinks.value_digest({"a": [1.5, None], "b": 1}) == hashlib.sha256(b'{"a":[1.5,null],"b":1}').hexdigest()
    os.makedirs(tmp_path / "x")
    content = {"one.txt": b"one", "x/two.bin": bytes(range(256)), "x/none": b""}
    for n, c in content.items():
        (tmp_path / n).write_bytes(c)
    for _ in range(2):  # a manifest doesn't hold itself
        made = sinks.write_manifest(spark, str(tmp_path), {"archive": "abc"}, {"p": 1}, {"ok": True})
    assert made["outputs"] == {n: hashlib.sha256(c).hexdigest() for n, c in content.items()} and json.loads((tmp_path / "manifest.json").read_text()) == made


def test_stale_cache_is_an_error(spark, tmp_path):
    place = str(tmp_path / "meta.json")
    assert not sinks.is_cached(spark, place, "f1")
    sinks.publish_json(spark, place, {"fingerprint": "f1"})
    assert sinks.is_cached(spark, place, "f1")
    with pytest.raises(RuntimeError, match="stale"):
        sinks.is_cached(spark, place, "f2")


def test_only_missing_keys_are_built(spark, tmp_path):
    place, asked = str(tmp_path / "cache"), []

    def build(keys):
        asked.append(sorted(r["ticker"] for r in keys.collect()))
        return keys.withColumn("x", F.length("ticker"))

    wanted = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert [sinks.build_missing(spark, place, w, "ticker", build, {"v": 1}) for w in (wanted("a", "b"), wanted("a", "b", "cc"), wanted("a"))] == [2, 1, 0]
    assert asked == [["a", "b"], ["cc"]] and spark.read.parquet(f"{place}/data").count() == 3
    with pytest.raises(RuntimeError, match="stale"):
        sinks.build_missing(spark, place, wanted("a"), "ticker", build, {"v": 2})
    os.remove(f"{place}/recipe.json")
    assert sinks.build_missing(spark, place, wanted("d"), "ticker", build, {"v": 2}) == 1 and spark.read.parquet(f"{place}/data").count() == 1


@dataclass(frozen=True)
class Small:
    name: str
    seed: int
    rate: float = 0.5
    windows: tuple = (1999,)


def test_profiles():
    assert records.profile('name = "a"\nseed = 3\nrate = 1\nwindows = [1999, 2000]', Small) == Small("a", 3, 1.0, (1999, 2000))
    for text, what in (('name = "a"', "missing ones: .'seed'"), ('name = "a"\nseed = 1\nother = 2', "other"), ('name = "a"\nseed = true', "must be int"), ('name = 1\nseed = 1', "must be str")):
        with pytest.raises(ValueError, match=what):
            records.profile(text, Small)
    records.require_dates([1999, 2000], 1, date(1995, 1, 1), date(2000, 12, 31))
    for years in ([], [2000, 1999], [1999, 1999], [1994], [2001]):
        with pytest.raises(ValueError, match="windows"):
            records.require_dates(years, 1, date(1995, 1, 1), date(2000, 12, 31))


def test_readers(spark, tmp_path):
    place = str(tmp_path / "features")
    rows = spark.createDataFrame([("A", date(2000, 1, d), float(d), 0.0) for d in (1, 2)] + [("B", date(2000, 1, 1), 9.0, 0.0)], "ticker string, date date, x double, y double")
    rows.write.partitionBy("ticker").parquet(place)
    read = records.features(spark, place, ["x"], ["A"])
    assert read.columns == ["ticker", "date", "x"] and read.count() == 2
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "y:double" not in plan.split("ReadSchema")[-1]
    with pytest.raises(ValueError, match="lacks z"):
        records.features(spark, place, ["z"])
    for i in (2, 0, 1):
        sinks.publish_json(spark, str(tmp_path / "trials" / f"trial{i}.json"), {"index": i, "status": "success"})
    found = records.trial_records(spark, str(tmp_path / "trials"), "index int, status string", 2)
    assert [r["index"] for r in found.collect()] == [0, 1]
    sinks.publish(spark.createDataFrame([("A", "h1")], "ticker string, source_sha256 string"), str(tmp_path / "fits"))
    assert records.fitted_inputs(spark, str(tmp_path / "fits"), "h1").count() == 1
    with pytest.raises(ValueError, match="fitted on h1"):
        records.fitted_inputs(spark, str(tmp_path / "fits"), "h2")


def test_families(spark):
    base = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2), ("B", 1, 0.3)], "ticker string, date int, x double")
    own = spark.createDataFrame([("A", 1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("A", 2, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "ticker string, date int, bocpd_score double, bocpd_rl double, bocpd_cp_prob double, bocpd_exp_vol double, cmv_stat double, cmv_recent double")
    daily = spark.createDataFrame([(1, 0.5, 0.25)], "date int, sys_score double, sys_frac double")
    for family, (mine, shared) in records.FAMILIES.items():
        out = records.family_features(family, base, own, daily)
        assert out.columns[:2] == (["date", "ticker"] if shared else ["ticker", "date"]) and {"x", *mine, *shared} == set(out.columns) - {"ticker", "date"}
        assert out.count() == (2 if mine else 3)
        if shared:
            assert {r["date"]: r["sys_score"] for r in out.collect()} == {1: 0.5, 2: None}
    with pytest.raises(KeyError, match="unknown"):
        records.family_features("other", base)
    assert len(records.MODELS) == 9 and {m.family for m in records.MODELS.values()} == set(records.FAMILIES)


def test_policy_and_sizes(spark):
    rows = [("rank-hyst", 0.25, "2", date(2000, 1, d), 1.0) for d in (1, 2)] + [("rank-hyst", 0.25, "inf", date(2000, 1, 1), 2.0)]
    daily = spark.createDataFrame(rows, "variant string, p double, m string, date date, gross double")
    assert ensemble.select_policy(daily, "rank-hyst", 0.25, "2").count() == 2
    with pytest.raises(Exception, match="two rows"):
        ensemble.select_policy(daily.unionByName(daily), "rank-hyst", 0.25, "2").collect()
    with pytest.raises(Exception, match="ensemble of 7"):
        spark.createDataFrame([(5,)], "trials int").select(ensemble.ensemble_size(F.col("trials"), 7)).collect()


def test_simulated_streams(spark):
    single = simulation.stream_jobs(spark, "single", 40, 400, change=200, seed=3)
    shape = single.groupBy("scenario").agg(F.countDistinct("stream").alias("n"), F.sum(F.col("changed").cast("int")).alias("changes"), F.max(F.when(F.col("changed"), F.col("pos"))).alias("at"))
    assert {r["scenario"]: (r["n"], r["changes"], r["at"]) for r in shape.collect()} == dict.fromkeys(simulation.SCENARIOS, (40, 40, 200))
    late = {r["scenario"]: r for r in single.where("pos >= 200").groupBy("scenario").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var")).collect()}
    assert abs(late["S1"]["mean"] - 0.75) < 0.1 and abs(late["S2"]["mean"]) < 0.15
    assert 2.3 < late["S2"]["var"] < 4 and 0.25 < late["S3"]["var"] < 0.45
    null = simulation.stream_jobs(spark, "null", 3, 200)
    assert null.where("changed").count() == 0 and null.exceptAll(simulation.stream_jobs(spark, "null", 3, 200)).count() == 0
    gaps = [r["gap"] for r in simulation.stream_jobs(spark, "continuous", 5, 2000, least=60).where("changed").selectExpr("pos - lag(pos) OVER (PARTITION BY stream ORDER BY pos) AS gap").where("gap IS NOT NULL").collect()]
    assert gaps and min(gaps) >= 60
    paths = simulation.stream_trajectories(null.where("pos < 90"), particles=20, most=20)
    assert {(r["detector"], r["n"]) for r in paths.groupBy("detector").agg(F.count("*").alias("n")).collect()} == {(k, 270) for k in ("cusum-mean", "cusum-variance", "cusum-combined", "ewma", "bocpd", "bocpd-garch")}
    with pytest.raises(ValueError, match="unknown kind"):
        simulation.stream_jobs(spark, "other", 1, 1)


def test_pick_stream(spark):
    def pick(rows):
        r = simulation.pick_stream(spark.createDataFrame(rows, "stream int, detector string, ccd double, dnf double"), "own").first()
        return r["stream"], r["met"]

    rival = lambda s, c, f: [(s, "own", 0.5, 0.5), (s, "a", c, f), (s, "b", 0.1, 0.1)]
    assert pick(rival(3, 0.4, 0.4) + rival(0, 0.5, 0.4) + rival(2, 0.4, 0.49)) == (2, True)
    assert pick(rival(3, 0.4, 0.5) + rival(1, 0.6, 0.4)) == (0, False)
