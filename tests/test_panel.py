"""Exact small cases of the panel operators."""

import datetime as dt
import math
import zipfile
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import charts, ensemble, events, metrics, positions, regimes, windows
from panelwright.plans import catalogue, reports, sql
from panelwright.sources import panel

DAY = dt.date(2000, 1, 1)


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", i, DAY + dt.timedelta(i), v) for i, v in enumerate(values)], f"ticker string, pos int, date date, {name} double")


def drawn(seed, n, step=0.05, gaps=0.1):
    """n values on a grid, so that ties with thresholds happen, some of them null."""
    rng = np.random.default_rng(seed)
    return [None if rng.random() < gaps else float(np.round(rng.integers(0, 21) * step, 2)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_upcrossing_equals_a_loop(spark, seed):
    values, start = drawn(seed, 60, gaps=0), 5 * seed
    w = Window.partitionBy("ticker").orderBy("pos")
    rows = series(spark, values).withColumn("up", windows.upcrossing(F.col("x") > 0.6, F.col("pos"), w, start))
    want = [i for i, v in enumerate(values) if v > 0.6 and i >= start and (i == 0 or not values[i - 1] > 0.6)]
    assert [r["pos"] for r in rows.where("up").orderBy("pos").collect()] == want and want


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_a_sweep(spark, seed):
    rng = np.random.default_rng(seed)
    alarms, changes, width = sorted(set(rng.integers(0, 120, 25).tolist())), sorted(set(rng.integers(0, 120, 6 + 6 * (seed % 2)).tolist())), 9
    free, want = list(alarms), {}
    for c in changes:
        want[c] = next((x for x in free if c <= x < c + width), None)
        free = [x for x in free if x != want[c]]
    marks = spark.createDataFrame([("k", c) for c in changes], "key string, position int")
    found = events.match_alarms(spark.createDataFrame([("k", x) for x in alarms], "key string, pos int"), marks, ["key"], width)
    assert {r["position"]: r["matched"] for r in found.collect()} == want


def test_delay_summary_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    delays = [None if rng.random() < 0.2 else int(rng.integers(0, 100)) for _ in range(57)] + [60]
    r = events.delay_summary(spark.createDataFrame([("k", x) for x in delays], "key string, delay int"), ["key"], 60).first()
    known = [x for x in delays if x is not None]
    assert r["miss_rate"] == pytest.approx(sum(x is None or x >= 60 for x in delays) / len(delays)) and r["miss_horizon"] == pytest.approx((len(delays) - len(known)) / len(delays))
    assert r["mean_delay"] == pytest.approx(np.mean(known))


@pytest.mark.parametrize("seed", range(3))
def test_off_event_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n, burn_in, alarms, marks = 130, 17, sorted(set(rng.integers(0, 130, 30).tolist())), rng.integers(0, 120, 4).tolist()
    free = [i for i in range(burn_in, n) if not any(m - 3 <= i < m + 11 for m in marks)]
    rows = spark.createDataFrame([("k", i) for i in range(n)], "key string, pos int")
    own = spark.createDataFrame([("k", x) for x in alarms], "key string, pos int")
    r = events.off_event(rows, own, spark.createDataFrame([("k", m) for m in marks], "key string, position int"), ["key"], burn_in, -3, 11).first()
    assert (r["alarms"], r["exposure"]) == (len(set(alarms) & set(free)), len(free))


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis_equals_a_loop(spark, seed):
    values, state, want = drawn(seed + 10, 80), True, []
    for v in values:
        state = True if v is None or v >= 0.7 else False if v < 0.35 else state
        want.append(state)
    w = Window.partitionBy("ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = series(spark, values).withColumn("on", windows.hysteresis(F.col("x"), 0.7, 0.35, w))
    assert [r["on"] for r in rows.orderBy("pos").collect()] == want and len(set(want)) == 2


def test_divisor_by_its_definition(spark):
    rows = spark.createDataFrame([(n, a) for n in range(1, 12) for a in range(n + 1)], "n long, a long")
    for m in (1.0, 1.5, 3.0, math.inf):
        for r in rows.select("n", "a", ensemble.divisor(F.col("n"), F.col("a"), m).alias("d")).collect():
            assert r["d"] == (r["a"] if math.isinf(m) else max(r["a"], r["n"] / m))
    with pytest.raises(ValueError, match="at least 1"):
        ensemble.divisor(F.lit(1), F.lit(1), 0.5)


def test_circular_blocks_and_ratio(spark):
    rng = np.random.default_rng(8)
    for n, length in ((7, 3), (10, 10), (9, 20)):
        starts = rng.integers(0, n, -(-n // length)).tolist()
        assert metrics.circular_blocks(n, length, starts).tolist() == [(s + k) % n for s in starts for k in range(length)][:n]
    returns = rng.normal(0.001, 0.01, 90).round(4).tolist() + [0.0]
    gains, losses = [x for x in returns if x > 0], [x for x in returns if x < 0]
    assert metrics.performance(series(spark, returns, "r"), "r", ["ticker"]).first()["gain_loss"] == pytest.approx(np.mean(gains) / abs(np.mean(losses)))


def test_bootstrap_of_equal_series(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("p", 1, DAY + dt.timedelta(i), float(v), float(v)) for i, v in enumerate(rng.normal(size=80))], "policy string, window int, date date, gated double, ungated double")
    r = metrics.paired_bootstrap(rows, ["policy"], 20).first()
    assert (r["delta"], r["p_value"]) == (0.0, 1.0)


@pytest.mark.parametrize("kind", charts.KINDS)
def test_reset_runs_equal_a_loop(kind):
    rng, chart = np.random.default_rng(1), charts.Chart(kind, burn_in=5)
    x = rng.normal(size=120) + (np.arange(120) > 60)
    statistic, alarm, monitored = charts.run_with_reset(x, chart, 2.0, True)
    at, base, want = 5, x[:5], np.zeros(120)
    while at < 120:
        mean, scale, sums, level, age = base.mean(), base.std(ddof=1), np.zeros(4), base.mean(), 0
        while at < 120:
            z = (x[at] - mean) / scale
            q = (z * z - 1) / math.sqrt(2)
            sums, level, age = np.maximum(0, sums + np.array([z, -z, q, -q]) - 0.5), 0.8 * level + 0.2 * x[at], age + 1
            want[at] = {"cusum-mean": sums[:2].max(), "cusum-variance": sums[2:].max(), "cusum-combined": sums.max(), "ewma": abs(level - mean) / (scale * math.sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * age))))}[kind]
            at += 1
            if want[at - 1] > 2.0:
                break
        if want[at - 1] <= 2.0 or at + 5 > 120:
            break
        base, at = x[at : at + 5], at + 5
    assert np.allclose(statistic, want) and alarm.sum() == (want > 2.0).sum() and monitored.sum() < 120


def test_filter_invariants():
    own = regimes.ChangeFilter(regimes.Prior(), particles=30, most=20, seed=1)
    for x in np.random.default_rng(2).normal(size=80):
        cp, young, run, var, *_ = own.update(float(x))
        assert 0 <= cp <= young <= 1 and run >= 0 and var >= -1e-9 and len(own.runs) <= 20 and abs(np.exp(own.joint).sum() - 1) < 1e-9


def test_law_scores_equal_the_filter_in_a_loop(spark):
    rng = np.random.default_rng(6)
    values = {(w, t): rng.standard_t(5, 40 if w == 1 else 25) for w in (1, 2) for t in "abc"}
    rows = [(w, "c" if t == "a" else "d", t, i, float(x)) for (w, t), xs in values.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "window int, k string, ticker string, pos int, x double")
    laws, small = [4.0, 10.0, None], {"particles": 20, "most": 10}
    scores = regimes.law_scores(df, ["window", "k", "ticker"], "x", laws, 2, burn_in=10, **small)
    got = {(r["window"], r["ticker"], r["ord"], r["replicate"]): r["score"] for r in scores.collect()}
    want = {}
    for (w, t), xs in values.items():
        for i, nu in enumerate(laws):
            for j in range(2):
                seed = zlib.crc32(t.encode())
                own = regimes.ChangeFilter(regimes.Prior(), True, nu, seed=[seed, j] if j else seed, **small)
                want[w, t, i, j] = np.mean([own.update(float(x))[-1] for x in xs][10:])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {r["window"]: r["nu"] for r in regimes.select_law(scores, ["ticker"], "k", ["window"]).collect()}
    for w in (1, 2):
        pooled = [np.mean([np.mean([np.mean([want[w, t, i, j] for j in range(2)]) for t in ts]) for ts in ("a", "bc")]) for i in range(2)]
        assert best[w] == laws[int(np.argmax(pooled))]
    tied = spark.createDataFrame([(i, nu, "c", "t", 1.0) for i, nu in enumerate((6.0, 4.0))], "ord int, nu double, k string, ticker string, score double")
    assert [r["nu"] for r in regimes.select_law(tied, ["ticker"], "k").collect()] == [6.0]
    with pytest.raises(Exception, match="no finite scores"):
        regimes.law_scores(df, ["window", "k", "ticker"], "x", [4.0], 1, burn_in=30, **small).collect()


def test_garch_finds_the_stream():
    values, _ = regimes.garch_stream(np.random.default_rng(3), 800, [(0, {"mu": 0.0, "omega": 0.05, "alpha": 0.08, "beta": 0.87, "hbar": 1.0})])
    fit = regimes.fit_garch(values, starts=1)
    assert 0.6 < fit["persistence"] < 1 and 0.3 < fit["hbar"] < 3 and regimes.interior(fit)
    mean, omega, alpha, beta = (fit[k] for k in ("mean", "omega", "alpha", "beta"))
    h = [values.var()]
    for x in values[:-1]:
        h.append(omega + alpha * (x - mean) ** 2 + beta * h[-1])
    h = np.array(h)
    assert fit["negative_log_likelihood"] == pytest.approx(0.5 * (np.log(2 * np.pi * h) + (values - mean) ** 2 / h).sum())
    assert not regimes.interior({**fit, "alpha": 0.0}) and not regimes.interior({**fit, "hbar": math.nan}) and not regimes.interior({**fit, "persistence": 0.5 * fit["persistence"]})
    with pytest.raises(ValueError, match="100"):
        regimes.fit_garch(values[:99])


def test_class_priors_pool_small_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(c, float(rng.normal()), float(rng.gamma(2.0)), float(rng.uniform(0, 0.6)), float(rng.uniform(0.3, 1.0))) for c, n in (("a", 7), ("b", 2), ("c", 1)) for _ in range(n)]
    fits = spark.createDataFrame(rows, "k string, mean double, hbar double, alpha double, persistence double")
    got = {r["k"]: r for r in regimes.class_priors(fits, "k", spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")).collect()}

    def plain(own):
        mean, hbar, alpha, lasting = (np.array([r[i] for r in own]) for i in (1, 2, 3, 4))
        level = np.log(np.maximum(hbar, 1e-4))
        low = min(max(np.quantile(alpha, 0.1), 0.01), 0.4)
        high = min(max(np.quantile(alpha, 0.9), low + 0.01), 0.4)
        first = min(max(np.quantile(lasting, 0.1), high + 0.01), 0.985)
        last = min(max(np.quantile(lasting, 0.9), first + 0.005), 0.995)
        return [np.median(mean), max(mean.std(ddof=1), 0.05), level.mean(), max(level.std(ddof=1), 0.25), low, high, first, last, 25.0]

    for k in "abcd":
        own = [r for r in rows if r[0] == k]
        assert got[k]["pooled"] == (len(own) < 2) and np.allclose([got[k][c] for c in regimes.PRIOR], plain(own if len(own) >= 2 else rows))
    with pytest.raises(Exception, match="two fits"):
        regimes.prior_from_fits(fits.where("k = 'c'"), ["k"]).collect()


def test_position_gradient():
    rng = np.random.default_rng(4)
    model = positions.PositionModel(2, 3, 0)
    x = rng.normal(size=(2, 6, 2))
    y = np.stack([rng.normal(size=(2, 6)), np.ones((2, 6)), np.ones((2, 6))], axis=-1)

    def loss():
        r = model.forward(x)[0] * y[..., 0]
        return -r.mean() / math.sqrt(r.var() + 1e-9) * math.sqrt(252)

    grad = model.gradient(x, y, 0.0, 0.0)
    for k, at in (("x", (0, 1)), ("u", (1, 7)), ("b", (4,)), ("o", (2,)), ("c", (0,))):
        held = model.w[k][at]
        model.w[k][at] = held + 1e-5
        up = loss()
        model.w[k][at] = held - 1e-5
        down = loss()
        model.w[k][at] = held
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4


def test_archive(spark, tmp_path):
    days = [DAY + dt.timedelta(i) for i in range(6)]
    closes = {t: (50 + 10 * np.random.default_rng(k).random(6)).round(2).tolist() for k, t in enumerate(("AA", "BB"))}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for t, own in closes.items():
            z.writestr(f"DATA/{t}_RAD.CSV", "".join(f"{d:%m/%d/%Y},1,1,1,{c},1,1\n" for d, c in zip(days, own)))
    rows = panel.zip_panel(spark, str(tmp_path / "a.zip"), ["BB"], start=days[2])
    got = windows.log_returns(panel.require_sound(rows)).orderBy("date").collect()
    want = [(days[i], 100 * math.log(closes["BB"][i] / closes["BB"][i - 1])) for i in range(3, 6)]
    assert [r["date"] for r in got] == [w[0] for w in want] and np.allclose([r["return_pct"] for r in got], [w[1] for w in want])
    with pytest.raises(Exception, match="lacks"):
        panel.zip_panel(spark, str(tmp_path / "a.zip"), ["XX"]).count()
    assert panel.require_start(rows, days[2]).count() == 4
    with pytest.raises(Exception, match="lies before"):
        panel.require_start(rows, days[3]).collect()


@pytest.mark.parametrize("name", ["garch_fit", "bocpd_iid", "bocpd_garch", "bocpd_garch_t", "nu_select"])
def test_models_get_whole_series(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def seen(series, *_, **__):
        raise Seen(series)

    days = [("t", "c", i, DAY + dt.timedelta(i), float((-1) ** i * (1 + i // 2000))) for i in range(2500)]
    monkeypatch.setattr(catalogue, "_log", lambda *_: spark.createDataFrame(days, "ticker string, asset_class string, pos int, date date, return_pct double"))
    monkeypatch.setattr(regimes, "change_features", seen)
    monkeypatch.setattr(regimes, "law_scores", seen)
    monkeypatch.setattr(regimes, "garch_fits", seen)
    with pytest.raises(Seen) as e:
        catalogue.QUERIES[name](spark, "")
    rows = e.value.args[0].orderBy("pos").collect()
    whole = np.array([r[4] for r in days])
    assert [r["pos"] for r in rows] == list(range(500 if name == "nu_select" else 0, 2500))
    assert np.allclose([r["x"] for r in rows], (whole / whole.std())[-len(rows) :])


@pytest.mark.parametrize(("name", "calls", "want"), [
    ("garch_fit", 1, {"starts": 5}), ("bocpd_iid", 1, {"particles": 500, "most": 250}), ("bocpd_garch", 1, {"particles": 500, "most": 250}), ("bocpd_garch_t", 1, {"particles": 500, "most": 250}),
    ("nu_select", 1, {"particles": 500, "most": 250, "burn_in": 50, "laws": [4.0, 6.0, 10.0], "replicates": 2}), ("stream_bocpd", 1, {"particles": 500, "most": 250}), ("boot_seeded", 1, {"samples": 2000}), ("lstm_search", 1, {"epochs": 300, "patience": 25, "jobs": 50}), ("lstm_replicate", 2, {"epochs": 300, "patience": 25}),
])
def test_models_have_full_sizes(spark, monkeypatch, name, calls, want):
    seen = []
    series = spark.createDataFrame([("t", "c", 1, 0.5)], "ticker string, asset_class string, pos int, x double")

    def scores(_, __, ___, laws, replicates, **settings):
        seen.append(settings | {"laws": laws, "replicates": replicates})
        return spark.createDataFrame([("c", "t", 0, 4.0, 0, 1.0)], "asset_class string, ticker string, ord int, nu double, replicate int, score double")

    def search(jobs, _, **settings):
        seen.append(settings | {"jobs": jobs.count()})
        return jobs.selectExpr("window", "trial", "'success' AS status", "'{}' AS hp", "1.0D AS val_sharpe")

    monkeypatch.setattr(catalogue, "_prices_for_filter", lambda *_: series)
    monkeypatch.setattr(catalogue, "_online", lambda _, __, detector: seen.append(detector.settings))
    monkeypatch.setattr(catalogue, "_pairs", lambda *_: series)
    monkeypatch.setattr(catalogue, "_blocks", lambda *_: None)
    monkeypatch.setattr(regimes, "change_features", lambda *_, **settings: seen.append(settings))
    monkeypatch.setattr(regimes, "law_scores", scores)
    monkeypatch.setattr(regimes, "garch_fits", lambda *_, **settings: seen.append(settings))
    monkeypatch.setattr(metrics, "paired_bootstrap", lambda _, __, samples: seen.append({"samples": samples}))
    monkeypatch.setattr(positions, "search", search)
    catalogue.QUERIES[name](spark, "")
    assert len(seen) == calls and all(want.items() <= s.items() for s in seen)
    assert name != "lstm_replicate" or seen[1]["jobs"] == 20


ORACLE_NAMES = ["perf_metrics", "evt_combined_delay", "chart_cusum_combined", "sim_ccd_dnf", "boot_blocks_fixed", "agg_prior_quantiles", "gate_portfolio", *reports.QUERIES]
QUERIES, ORACLES = catalogue.QUERIES | reports.QUERIES, sql.ORACLES | reports.ORACLES


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_queries_equal_sql(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if pd.api.types.is_numeric_dtype(b[c]) and not pd.api.types.is_bool_dtype(b[c]):
            assert np.allclose(pd.to_numeric(a[c]).astype(float), b[c].astype(float), rtol=1e-5, atol=1e-6, equal_nan=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


@pytest.mark.parametrize("kind", charts.KINDS)
def test_runs_with_reset_follow_the_chart_row_by_row_across_stretches(monkeypatch, kind):
    monkeypatch.setattr(charts, "FIRST_STRETCH", 2)
    monkeypatch.setattr(charts, "LONGEST_STRETCH", 5)
    x, chart = np.random.default_rng(8).normal(0, 1, 400), charts.Chart(kind, burn_in=20)
    whole = charts._stretch(x[20:], chart, x[:20].mean(), x[:20].std(ddof=1), 0, None)[0]
    assert np.array_equal(charts.run_with_reset(x, chart, 1e9, True)[0][20:], whole)
    statistic, alarm, monitored = charts.run_with_reset(x, chart, 2.5, True)
    for at in np.flatnonzero(alarm):
        assert statistic[at] > 2.5 and not monitored[at + 1 : at + 21].any() and monitored[at + 21 : at + 22].all()


def test_runs_with_reset_look_at_each_row_a_bounded_number_of_times(monkeypatch):
    """An alarm every few rows: what is computed must not begin anew with all the rows that are left."""
    seen, real = [], charts._stretch
    monkeypatch.setattr(charts, "_stretch", lambda x, *rest: seen.append(len(x)) or real(x, *rest))
    x = np.random.default_rng(9).exponential(1, 50_000)
    _, alarm, _ = charts.run_with_reset(x, charts.Chart("cusum-mean"), 1.0, True)
    assert alarm.sum() > 500 and sum(seen) < 3 * len(x)
