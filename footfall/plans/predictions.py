"""Prediction tables: forecast -> clamp -> historic max -> load (one lazy plan each)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators import enrich, keyed_trees, load, model_table, profiles, regress
from footfall.operators import forecast as fcst
from footfall.operators import series as ser


def daily_prediction(hist_daily: DataFrame, horizon: int = 10,
                     config: fcst.ModelConfig = fcst.ModelConfig()) -> DataFrame:
    """Per counter: 10 days after its last day -> (counterId, date, visits_pred, load)."""
    s = ser.to_series(hist_daily, "date_day", "visits")
    fc = fcst.fit_forecast(s, horizon=horizon, config=config)
    pred = load.clamp_visits(fc.select("counterId", F.col("ds").alias("date"), F.col("yhat").alias("visits_pred")))
    return load.compute_load(pred, hist_daily)


def prediction_from(model: DataFrame, hist_daily: DataFrame, horizon: int = 10, as_of=None) -> DataFrame:
    """(counterId, date, visits_pred, load) from a saved table of coefficients (``model_table``): nothing is
    fitted and no Python runs. Without ``as_of`` the days after each counter's last day, with it the day
    parts of ``horizon`` days from then."""
    fc = model_table.predict_from(model, horizon=horizon, as_of=as_of)
    pred = load.clamp_visits(fc.select("counterId", F.col("ds").alias("date"), F.col("yhat").alias("visits_pred")))
    return load.compute_load(pred, hist_daily)


def day_part_series(hist_hour: DataFrame, last_n: int | None = None) -> DataFrame:
    """Day-part roll-up of the hourly history as (counterId, ds, y). The whole history by default;
    ``last_n`` keeps only the last day parts of each counter."""
    dp = profiles.day_part_rollup(hist_hour)
    if last_n:
        dp = ser.last_n_per_counter(dp, last_n, order="ds")
    return ser.to_series(dp, "ds", "visits")


def day_part_prediction(hist_hour: DataFrame, hist_daily: DataFrame, as_of, horizon: int = 10,
                        last_n: int | None = None, config: fcst.ModelConfig = fcst.ModelConfig(),
                        pooled: bool = False) -> DataFrame:
    """Per counter: 3 day parts × ``horizon`` days from ``as_of``; the load divides by the
    *daily* historic maximum, as the source does. ``pooled=True`` fits one model on every
    counter's whole series together (what the source literally does) instead of one per counter."""
    if pooled:
        if last_n:
            raise ValueError("the pooled model is fit on everything: last_n does not apply")
        counters = hist_daily.select("counterId").where(F.col("counterId").isNotNull()).distinct()
        fc = pooled_day_part_forecast(day_part_series(hist_hour), as_of, horizon, config, counters)
    else:
        fc = fcst.fit_forecast(day_part_series(hist_hour, last_n), horizon=horizon, as_of=as_of, config=config, unique=True)
    pred = load.clamp_visits(fc.select("counterId", F.col("ds").alias("date"), F.col("yhat").alias("visits_pred")))
    return load.compute_load(pred, hist_daily)


def pooled_fit(series: DataFrame, config: fcst.ModelConfig = fcst.ModelConfig()):
    """One additive model over all (ds, y) points: a function of days since the epoch -> (yhat, trend).

    Points are combined per timestamp by a partial and a final aggregate and stay spread over the
    cluster; each task sums its share of the normal equations, Spark adds the shares up cell by
    cell, and only the sums (some 2,000 numbers, fixed by the model) reach the driver, which solves
    the system. None when no point has a y.
    """
    pts = fcst.aggregate_points(series.select(F.xxhash64("ds").alias("counterId"), "ds", "y"))
    pts = pts.where(F.col("y_n") > 0)
    s = pts.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"), F.max("y_amax").alias("scale"),
                F.sum("y_sum").alias("total"), F.sum("y_n").alias("rows"), F.sum("y_sq").alias("squares"),
                F.max(F.abs(F.col("t") - F.round("t")) > 1e-8).alias("clock")).first()
    if not s.n:
        return None
    mean = s.total / s.rows
    if s.n < 2:
        return lambda t: (np.full(len(t), mean), np.full(len(t), mean))
    layout = fcst.Layout.of_summary(s.lo, s.hi, s.n, bool(s.clock), config)
    scale = float(s.scale) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(layout.precision)
        gram = np.zeros((size, size + 1))
        for b in batches:
            t, y_sum, w = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            x = layout.design(t)
            gram[:, :size] += (x.T * w) @ x
            gram[:, size] += x.T @ (y_sum / scale)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size)), pa.array(gram.ravel())], names=["cell", "v"])

    cells = pts.select("t", "y_sum", "y_n").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    size = len(layout.precision)
    gram = np.zeros(size * (size + 1))
    for c in cells:
        gram[c.cell] = c.v
    gram = gram.reshape(size, size + 1)
    beta = fcst.solve(gram[:, :size], gram[:, size], float(s.squares) / scale**2, float(s.rows), layout)
    return lambda t: layout.predict(t, beta, scale)


def pooled_day_part_forecast(series: DataFrame, as_of, horizon: int = 10,
                             config: fcst.ModelConfig = fcst.ModelConfig(), counters: DataFrame | None = None) -> DataFrame:
    """One model over all counters' (ds, y) points, predicted for every counter (those of
    ``counters``, or of the series): horizon × 3 values, generated on the counters' rows."""
    if counters is None:
        counters = series.select("counterId").distinct()
    frame = ser.future_day_parts(counters, as_of, horizon).select("counterId", "ds")
    model = pooled_fit(series, config)
    if model is None:
        return frame.withColumn("yhat", F.lit(None).cast("double")).withColumn("trend", F.lit(None).cast("double"))
    days = [str(d) for d in np.arange(np.datetime64(str(as_of)), np.datetime64(str(as_of)) + horizon)]
    ds = [f"{d} {label}" for d in days for label in fcst.DAY_PART_LABELS]
    t = (np.array([x.replace(" ", "T") for x in ds], "datetime64[s]").astype(np.int64)) / 86400.0
    yhat, trend = model(t)
    values = F.create_map(*[F.lit(v) if k == 0 else F.struct(F.lit(v[0]).alias("yhat"), F.lit(v[1]).alias("trend"))
                            for d, a, b in zip(ds, yhat.tolist(), trend.tolist()) for k, v in enumerate((d, (a, b)))])
    return frame.withColumn("_v", values[F.col("ds")]).select("counterId", "ds", "_v.yhat", "_v.trend")


# ---- boosted trees over the daily history ------------------------------------------------------------

def split_features(daily: DataFrame, n_train: int, config: fcst.ModelConfig = fcst.ModelConfig()) -> DataFrame:
    """Daily features with the forecast as one of them and a ``part`` column in time order.

    The forecast of all days is fit on each counter's first ``n_train`` days only, so a validation
    day's own visits do not enter its features. ``daily`` is read twice: give it a saved table."""
    parts = ser.ordered_split(daily, n_train)
    known = ser.to_series(parts.where(F.col("part") == "train"), "date_day", "visits")
    frame = daily.select("counterId", F.col("date_day").alias("ds")).distinct()
    fc = fcst.fit_forecast(known, frame=frame, config=config).select("counterId", F.col("ds").alias("date_day"), "yhat")
    return regress.feature_table(parts.join(fc, ["counterId", "date_day"], "left"), keep=["counterId", "date_day", "part"]).drop("rn")


def future_features(daily: DataFrame, outlook: DataFrame, holidays: DataFrame | None = None, horizon: int = 10,
                    config: fcst.ModelConfig = fcst.ModelConfig()) -> DataFrame:
    """Features of the ``horizon`` days after each counter's last day: its coordinates, the calendar,
    holidays, the outlook's temperature (by counter and day offset) and the forecast of all history.
    Weather measures without an outlook are 0, as missing values are in training."""
    series = ser.to_series(daily, "date_day", "visits")
    fc = fcst.fit_forecast(series, horizon=horizon, config=config).select("counterId", F.col("ds").alias("date_day"), "yhat")
    last = daily.groupBy("counterId").agg(F.max(F.to_date("date_day")).alias("_last"), F.avg("cordNorth").alias("cordNorth"), F.avg("coordSouth").alias("coordSouth"))
    day = F.to_date("date_day")
    out = fc.join(last, "counterId").withColumn("offset", F.datediff(day, F.col("_last")).cast("bigint"))
    out = out.join(outlook.select("counterId", "offset", F.col("temp").cast("double").alias("temp")), ["counterId", "offset"], "left")
    out = out.withColumn("month", F.month(day).cast("double")).withColumn("day", F.dayofmonth(day).cast("double"))
    out = out.withColumn("startDate", F.unix_timestamp(day.cast("timestamp_ntz")).cast("double") + 12 * 3600)
    if holidays is None:
        out = out.withColumn("holiday", F.lit(False))
    else:
        out = enrich.mark_holidays(out, holidays, "+00:00")
    for m in [c for c in regress.schemas.WEATHER_MEASURES if c != "temp"]:
        out = out.withColumn(m, F.lit(0.0))
    return regress.feature_table(out.drop("_last", "offset", "startDate"), keep=["counterId", "date_day"])


def gbt_future_prediction(daily: DataFrame, outlook: DataFrame, holidays: DataFrame | None = None, horizon: int = 10,
                          n_train: int = 14, config: fcst.ModelConfig = fcst.ModelConfig(), **tree_options) -> DataFrame:
    """Boosted trees trained on the history, applied to the days to come: (counterId, date, visits_pred,
    load). ``daily`` is read more than once: give it a saved table."""
    from footfall.session import save_once
    train = save_once(split_features(daily, n_train, config), "gbt-train").drop("part")
    names = regress.feature_names(train, "visits", exclude=["counterId"])
    model = regress.fit_visits_gbt(train, names, "visits", key_feature="counterId", **tree_options)
    pred = regress.predict_visits(model, future_features(daily, outlook, holidays, horizon, config))
    return load.compute_load(load.clamp_visits(pred.select("counterId", F.col("date_day").alias("date"), "visits_pred")), daily)


def keyed_gbt_prediction(daily: DataFrame, outlook: DataFrame, holidays: DataFrame | None = None, horizon: int = 10, n_train: int = 14,
                         config: fcst.ModelConfig = fcst.ModelConfig(), trees: keyed_trees.TreeConfig = keyed_trees.TreeConfig()) -> DataFrame:
    """As ``gbt_future_prediction``, with an ensemble per counter in place of the shared one: every counter is
    fitted on its own days, and the predictions of all of them are one table. ``daily`` is read more than
    once: give it a saved table."""
    from footfall.session import save_once
    train = save_once(split_features(daily, n_train, config), "keyed-train").drop("part")
    names = regress.feature_names(train, "visits", exclude=["counterId"])
    fitted = keyed_trees.fit_keyed_trees(train, names, "visits", config=trees)
    pred = keyed_trees.predict_keyed(fitted, future_features(daily, outlook, holidays, horizon, config), names, config=trees)
    return load.compute_load(load.clamp_visits(pred.select("counterId", F.col("date_day").alias("date"), "visits_pred")), daily)


def outlook_by_offset(covariates: DataFrame) -> DataFrame:
    """(counterId, date, temp) outlook rows -> (counterId, offset, temp): the first date is offset 1."""
    first = covariates.groupBy("counterId").agg(F.min("date").alias("_first"))
    return covariates.join(first, "counterId").select(
        "counterId", (F.datediff(F.to_date("date"), F.to_date("_first")) + 1).cast("bigint").alias("offset"), "temp")
