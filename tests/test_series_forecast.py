import math

import numpy as np
from pyspark.sql import functions as F

from footfall.operators import forecast as fcst
from footfall.operators import profiles
from footfall.operators import series as ser


def test_latest_keeps_ties_and_last_n_whole_group(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-02", 2), (1, "2024-01-02", 3), (2, "2024-01-01", 4)],
                               "counterId LONG, date_day STRING, visits LONG")
    assert sorted(r.visits for r in ser.latest_per_counter(df).collect()) == [2, 3, 4]
    assert ser.last_n_per_counter(df, 1500).count() == 4
    s = ser.ordered_split(df, 10)
    assert s.where(F.col("part") == "test").count() == 0


def test_weekday_profile_drops_null_keys_and_bins(spark):
    df = spark.createDataFrame([(1, 0, 8, 2), (1, 0, 8, 4), (None, 0, 8, 100)],
                               "parkCode LONG, weekday INT, hour2d INT, visits LONG")
    out = profiles.weekday_profile(df, "parkCode").collect()
    assert len(out) == 1 and out[0].hour2d == 8 and out[0].visits_mean == 3.0


def test_future_frames(spark):
    s = spark.createDataFrame([(1, "2024-01-10"), (2, "2024-01-20")], "counterId LONG, ds STRING")
    fut = ser.future_days(s, 10, include_history=False)
    firsts = {r.counterId: r.m for r in fut.groupBy("counterId").agg(F.min("ds").alias("m")).collect()}
    assert firsts == {1: "2024-01-11", 2: "2024-01-21"} and fut.count() == 20
    parts = ser.future_day_parts(s.select("counterId"), "2024-03-01", 10)
    assert parts.count() == 60
    assert {r.ds[-5:] for r in parts.collect()} == {"01:00", "09:00", "17:00"}
    assert parts.agg(F.min("ds")).first()[0] == "2024-03-01 01:00"
    counters = spark.range(42).withColumnRenamed("id", "counterId")
    assert ser.future_covariates(counters).count() == 420


def _signal(spark, days=800, noise=0.0, counters=(1,)):
    rng = np.random.default_rng(3)
    rows = []
    for c in counters:
        for d in range(days):
            y = 2 * d + 10 * math.sin(2 * math.pi * d / 7) + (rng.normal(0, noise) if noise else 0.0)
            rows.append((c, str(np.datetime64("2020-01-01") + np.timedelta64(d, "D")), float(y)))
    return spark.createDataFrame(rows, "counterId LONG, ds STRING, y DOUBLE")


def _truth(day):
    return 2 * day + 10 * math.sin(2 * math.pi * day / 7)


def test_forecast_recovers_trend_and_weekly_signal(spark):
    for days, noise in ((800, 0.0), (800, 5.0), (200, 5.0)):   # long and short (under a year) history
        s = _signal(spark, days=days, noise=noise)
        fc = fcst.fit_forecast(s, ser.future_days(s, 10, include_history=False)).collect()
        assert len(fc) == 10
        for r in fc:
            day = (np.datetime64(r.ds) - np.datetime64("2020-01-01")).astype(int)
            assert abs(r.yhat - _truth(day)) <= 0.05 * abs(_truth(day)), (noise, r)


def test_forecast_same_for_any_partitioning(spark):
    s = _signal(spark, days=300, noise=5.0, counters=(1, 2, 3))
    a = fcst.fit_forecast(s.repartition(1), include_history=True).orderBy("counterId", "ds").collect()
    b = fcst.fit_forecast(s.repartition(8), include_history=True).orderBy("counterId", "ds").collect()
    assert len(a) == len(b) == 3 * 310
    assert all(abs(x.yhat - y.yhat) < 1e-6 for x, y in zip(a, b))


def test_aggregated_duplicates_equal_the_raw_point_fit(spark):
    """Pre-aggregating duplicate timestamps is exact: same fit as on every raw point."""
    rng = np.random.default_rng(5)
    days = np.arange(120, dtype=float)
    t = np.concatenate([days, days[::3]]) + 18262.0          # every third day twice, different y
    y = 2 * (t - 18262) + rng.normal(0, 5, len(t))
    rows = [(1, str(np.datetime64("2020-01-01") + np.timedelta64(int(v - 18262), "D")), float(w))
            for v, w in zip(t, y)]
    s = spark.createDataFrame(rows, "counterId LONG, ds STRING, y DOUBLE")
    got = fcst.fit_forecast(s, horizon=5, include_history=True).orderBy("ds").collect()
    ones = np.ones(len(t))
    t_pred = np.concatenate([days, np.arange(120, 125, dtype=float)]) + 18262.0
    want, _ = fcst.fit_predict_arrays(t, y, ones, y * y, t_pred, y_amax=np.abs(y))
    assert len(got) == len(want)
    assert all(abs(r.yhat - w) < 1e-6 * max(1.0, abs(w)) for r, w in zip(got, want))


def test_holdout_beats_the_mean(spark):
    s = _signal(spark, days=500, noise=5.0)
    err = fcst.evaluate_holdout(s, 450).collect()[0]
    test = [_truth(d) for d in range(450, 500)]
    mean_rmse = math.sqrt(sum((t - np.mean([_truth(d) for d in range(450)])) ** 2 for t in test) / len(test))
    assert err.n == 50 and err.rmse < mean_rmse


def test_short_history_returns_mean(spark):
    s = spark.createDataFrame([(1, "2024-01-01", 4.0)], "counterId LONG, ds STRING, y DOUBLE")
    fc = fcst.fit_forecast(s, horizon=3, include_history=True).collect()
    assert len(fc) == 4 and all(r.yhat == 4.0 for r in fc)


def test_day_part_frame_from_as_of(spark):
    s = _signal(spark, days=60, noise=1.0, counters=(1, 2))
    fc = fcst.fit_forecast(s, horizon=10, as_of="2024-03-01").collect()
    assert len(fc) == 60
    assert min(r.ds for r in fc) == "2024-03-01 01:00" and max(r.ds for r in fc) == "2024-03-10 17:00"


def test_pooled_forecast_is_one_model_for_all_counters(spark):
    from footfall.plans.predictions import pooled_day_part_forecast
    s = _signal(spark, days=60, noise=1.0, counters=(1, 2, 3))
    fc = pooled_day_part_forecast(s, "2024-03-01", 10).collect()
    assert len(fc) == 90
    by_ds = {}
    for r in fc:
        by_ds.setdefault(r.ds, set()).add(round(r.yhat, 9))
    assert len(by_ds) == 30 and all(len(v) == 1 for v in by_ds.values())
