"""Cases found by review: missing values, time order, several members, package shipping, jobs."""

import datetime as dt
import os
import subprocess
import sys
import tempfile
from pathlib import Path

import numpy as np
import pytest
from driver_tables import SF_SMALL
from pyspark.sql import functions as F

from footfall import sources
from footfall.functions import exact_sum
from footfall.operators import clean, enrich, load
from footfall.operators import forecast as fcst
from footfall.operators import series as ser
from footfall.plans import jobs, predictions
from footfall.sources.publish import read_published
from footfall.sources.sinks import write_csv_table, write_partitioned
from footfall.testing import fixtures as fx


def series_of(spark, values, start="2024-01-01", counter=1):
    day = np.datetime64(start)
    return spark.createDataFrame([(counter, str(day + k), v) for k, v in enumerate(values)], "counterId long, ds string, y double")


def test_missing_y_stays_in_the_frame(spark):
    s = series_of(spark, [float(k) for k in range(20)] + [None] * 5).unionByName(series_of(spark, [None] * 6, counter=2))
    out = fcst.fit_forecast(s, horizon=3).orderBy("counterId", "ds").collect()
    assert [(r.counterId, r.ds) for r in out] == [(1, "2024-01-26"), (1, "2024-01-27"), (1, "2024-01-28"), (2, "2024-01-07"), (2, "2024-01-08"), (2, "2024-01-09")]
    assert all(r.yhat is not None for r in out[:3]) and all(r.yhat is None for r in out[3:])
    assert {(r.counterId, r.ds) for r in ser.future_days(s, 3, include_history=False).collect()} == {(r.counterId, r.ds) for r in out}
    assert fcst.fit_forecast(s, horizon=0, include_history=True).count() == 31


def test_unique_points_give_the_same_fit(spark):
    s = series_of(spark, [float((k * 7) % 11 + k) for k in range(90)])
    a, b = (fcst.fit_forecast(s, horizon=5, unique=u, partitions=3).orderBy("ds").collect() for u in (False, True))
    assert np.allclose([r.yhat for r in a], [r.yhat for r in b])


def test_same_prior_for_histories_of_every_length():
    cfg = fcst.ModelConfig()
    short, long_ = (fcst.Layout(np.arange(float(n)), cfg) for n in (364, 368))
    assert np.array_equal(short.precision, long_.precision)


def test_all_day_parts_are_fit(spark):
    """More than 1,500 day parts per counter: the oldest ones still change the fit."""
    rows = [(1, (dt.datetime(2022, 1, 1) + dt.timedelta(days=d)).strftime("%Y-%m-%d"), h, 10 + (500 if d < 30 else 0) + h) for d in range(540) for h in (10, 14, 18)]
    df = spark.createDataFrame(rows, "counterId long, date_day string, hour int, visits long")
    for c in ["cloud", "pressure", "humidity", "percip", "show_depth", "temp", "dewpoint", "visib", "wind_dir", "gust_speed", "wind_speed", "coordSouth"]:
        df = df.withColumn(c, F.lit(0.0))
    df = df.withColumn("holiday", F.lit(False))
    assert predictions.day_part_series(df).count() == 1620
    daily = spark.createDataFrame([(1, 100)], "counterId long, visits long")
    whole = predictions.day_part_prediction(df, daily, "2024-02-01").orderBy("date").collect()
    cut = predictions.day_part_prediction(df, daily, "2024-02-01", last_n=1500).orderBy("date").collect()
    assert any(abs(a.visits_pred - b.visits_pred) > 0.01 for a, b in zip(whole, cut))
    with pytest.raises(ValueError):
        predictions.day_part_prediction(df, daily, "2024-02-01", last_n=5, pooled=True)


def test_pooled_fit_agrees_with_the_numpy_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f"2024-01-{d:02d} {h}", float(20 + 3 * c + d + rng.normal())) for c in range(4) for d in range(1, 29) for h in ("01:00", "09:00", "17:00")]
    s = spark.createDataFrame(rows, "counterId long, ds string, y double")
    fc = predictions.pooled_day_part_forecast(s, "2024-02-01", 2)
    assert fc.count() == 24
    got = {r.ds: r.yhat for r in fc.collect()}
    by = {}
    for _, ds, y in rows:
        by.setdefault(ds, []).append(y)
    days = lambda ds: np.array([np.datetime64(x.replace(" ", "T")).astype("datetime64[s]").astype(float) / 86400 for x in ds])
    keys = sorted(by)
    want, _ = fcst.fit_predict_arrays(days(keys), np.array([sum(by[k]) for k in keys]), np.array([len(by[k]) for k in keys], float),
                                      np.array([sum(v * v for v in by[k]) for k in keys]), days(sorted(got)), y_amax=np.array([max(map(abs, by[k])) for k in keys]))
    assert np.allclose([got[k] for k in sorted(got)], want, atol=1e-6)


def test_holdout_splits_in_time_order_and_weighs_rows(spark):
    rows = [(1, d, y) for d, y in (("2024-1-9", 9.0), ("2024-1-10", 10.0), ("2024-1-11", 11.0), ("2024-1-2", 2.0), ("2024-1-11", 13.0))]
    s = spark.createDataFrame(rows, "counterId long, ds string, y double")
    out = fcst.holdout_forecast(s, 2, fcst.ModelConfig(n_changepoints=0, yearly=False, weekly=False, trend_prior=1e6)).orderBy("ds").collect()
    assert [r.ds for r in out] == ["2024-1-10", "2024-1-11"]
    e = fcst.evaluate_holdout(s, 2, fcst.ModelConfig(n_changepoints=0, yearly=False, weekly=False, trend_prior=1e6)).first()
    assert e.n == 3 and abs(e.mse - 4 / 3) < 1e-3


def test_forecast_error_leaves_nan_out_and_takes_large_values(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (1, 2.0, 2.5), (1, None, 1.0)], "counterId long, y double, yhat double")
    e = fcst.forecast_error(df).first()
    assert (e.n, e.mse) == (1, 0.25)
    big = spark.createDataFrame([(1, 0.0, 1e14), (1, 0.0, 1.0)], "counterId long, y double, yhat double")
    assert abs(fcst.forecast_error(big).first().mse / 5e27 - 1) < 1e-9
    assert spark.createDataFrame([(None,)], "x double").agg(exact_sum("x").alias("s")).first().s is None


def test_weather_times_with_seconds(spark):
    line = "2024,1,5,{},UTC," + ",".join("1" * 11)
    raw = spark.createDataFrame([(line.format(t),) for t in ("10:00", "10:00:00", "10", "25:00", "10:0x")], "value string")
    assert clean.clean_weather(raw).count() == 2
    assert {r.reason for r in clean.rejected_weather(raw).collect()} == {"time"} and clean.rejected_weather(raw).count() == 3


def test_half_a_second_into_a_holiday_counts(spark):
    base = dt.datetime(2024, 1, 6).timestamp() - dt.datetime(1970, 1, 1).timestamp()
    df = spark.createDataFrame([(base - 7200,), (base - 7200 + 0.5,), (base - 7200 - 0.5,)], "startDate double")
    days = spark.createDataFrame([(dt.date(2024, 1, 6),)], "date date")
    got = {r.startDate: r.holiday for r in enrich.mark_holidays(df, days).collect()}
    assert [got[k] for k in sorted(got)] == [False, False, True]


def test_feed_has_each_prediction_once(spark):
    pred = spark.createDataFrame([(1, "2024-01-01", 5.0, 0.5)], "counterId long, date string, visits_pred double, load double")
    routes = spark.createDataFrame([(1, 952), (1, 952)], "counterId long, parkId long")
    assert load.to_feed(pred, routes=routes).count() == 1


def test_unknown_loads_have_no_bucket(spark):
    d = dt.date(2024, 1, 1)
    feed = spark.createDataFrame([(1, 1, None, d), (2, 1, 0.1, d), (3, 1, float("nan"), d)], "counterId long, parkId long, load double, date date")
    c = load.route_bucket_counts(feed).first()
    assert (c.free, c.unknown) == (1, 2)
    assert load.with_route_bucket(feed).where("bucket IS NULL").count() == 2


def test_last_n_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(1, "d", k) for k in range(50)], "counterId long, date_day string, v long")
    a, b = ({r.v for r in ser.last_n_per_counter(x, 5).collect()} for x in (df.repartition(1), df.repartition(7)))
    assert a == b and len(a) == 5


def test_partitioned_sink_writes_one_file_a_folder(spark):
    out = tempfile.mkdtemp(prefix="footfall-sink-")
    df = spark.range(2000).select((F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("weekday"), F.col("id").alias("v")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_partitioned(df, f"{out}/a", ["k", "weekday"])
        write_partitioned(df, f"{out}/b", ["k", "weekday"], buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(out, "a").rglob("part-*.parquet"))) == 350
    assert len(list(Path(out, "b").rglob("part-*.parquet"))) == 28
    assert spark.read.parquet(f"{out}/b").where("k = 3").count() == 40


def test_csv_readers_infer_nothing(spark):
    out = tempfile.mkdtemp(prefix="footfall-csv-")
    write_csv_table(spark.createDataFrame([("007", "1")], "a string, b string"), f"{out}/t")
    assert [t for _, t in sources.read_csv_table(spark, f"{out}/t").dtypes] == ["string", "string"]


def write_lines(df, path):
    df.select("value").write.text(path)
    return path


def test_jobs_from_files_to_feed(spark):
    out = tempfile.mkdtemp(prefix="footfall-jobs-")
    ev = fx.table(spark, SF_SMALL, "events")
    paths = [write_lines(fx.raw_reading_lines(spark, ev), f"{out}/in/readings"), write_lines(fx.raw_weather_lines(ev), f"{out}/in/weather"),
             write_lines(fx.holiday_lines(spark), f"{out}/in/holidays")]
    feed = jobs.run_all(spark, *paths, f"{out}/tables", "2024-02-01", horizon=3)
    import __spark_entry__ as E
    daily = read_published(spark, f"{out}/tables/history_daily")
    want = {(r.counterId, r.date_day): r.visits for r in E.queries()["daily_rollup"](spark, SF_SMALL).collect()}
    assert {(r.counterId, r.date_day): r.visits for r in daily.collect()} == want
    counters = daily.select("counterId").distinct().count()
    assert feed.count() == 3 * counters and read_published(spark, f"{out}/tables/prediction_day_part").count() == 9 * counters
    for t in jobs.TABLES:
        assert os.path.isdir(f"{out}/tables/{t}"), t


def test_queries_run_from_another_working_folder():
    """A fresh process elsewhere: the workers get the package from the session, not from a folder."""
    repo = Path(__file__).resolve().parents[1]
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {str(repo / '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from footfall.session import build_session
s = build_session("local[2]", 2)
print("rows", m.queries()["fit_forecast"](s, {SF_SMALL!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="footfall-elsewhere-"), env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
