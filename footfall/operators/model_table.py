"""Fitted forecasts as a table, and predictions from it in generated code.

``fit_coefficients`` fits every counter once (grouped pandas call, see ``forecast``) and gives one row a
counter: the layout of its features, the coefficients and the scale. ``predict_from`` evaluates those rows
with Column expressions only: the trend's hinges and the Fourier terms are ``transform`` and
``aggregate`` over the coefficient arrays. So a saved table answers any question about any date without
fitting again, in whole-stage code, and no Python runs when it is read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import DAY_PART_LABELS
from footfall.operators import forecast as fcst

MODEL_SCHEMA = ("counterId long, t0 double, span double, scale double, changepoints array<double>, trend array<double>, "
                "yearly array<double>, weekly array<double>, daily array<double>, n long, last_day string")
PERIODS = {"yearly": 365.25, "weekly": 7.0, "daily": 1.0}


def coefficient_row(layout: fcst.Layout, beta: np.ndarray, scale: float) -> dict:
    """The model columns of one fit; a season that the layout leaves out is an empty array."""
    orders = {"yearly": layout.cfg.yearly_order * layout.yearly, "weekly": layout.cfg.weekly_order * layout.weekly,
              "daily": layout.cfg.daily_order * layout.daily}
    out = {"t0": layout.t0, "span": layout.span, "scale": scale, "changepoints": layout.cps.tolist(), "trend": beta[:layout.n_trend].tolist()}
    at = layout.n_trend
    for name, order in orders.items():
        out[name] = beta[at:at + 2 * order].tolist()
        at += 2 * order
    return out


def _constant(mean: float | None) -> dict:
    return {"t0": 0.0, "span": 1.0, "scale": 1.0, "changepoints": [], "trend": [mean, 0.0] if mean is not None else None,
            "yearly": [], "weekly": [], "daily": []}


def _fit(cfg: fcst.ModelConfig):
    def fn(key: tuple, h: pd.DataFrame) -> pd.DataFrame:
        last = pd.to_datetime(h["ds"], format="mixed").max().strftime("%Y-%m-%d")
        h = h[h["y_n"] > 0].sort_values("t")
        columns = [h[c].to_numpy(float) for c in ("t", "y_sum", "y_n", "y_sq", "y_amax")]
        if len(h) < 2:
            row = _constant(float(h["y_sum"].sum() / h["y_n"].sum()) if len(h) else None)
        else:
            row = coefficient_row(*fcst.fit_arrays(*columns[:4], cfg, columns[4]))
        return pd.DataFrame([{"counterId": key[0], **row, "n": int(h["y_n"].sum()), "last_day": last}])
    return fn


def fit_coefficients(hist: DataFrame, config: fcst.ModelConfig = fcst.ModelConfig(), key: str = "counterId",
                     ds_col: str = "ds", y_col: str = "y", unique: bool = False, partitions: int | None = None) -> DataFrame:
    """One row a counter (``MODEL_SCHEMA``). A counter with one point has that point as a constant; a
    counter without any y has no trend, and its predictions are NULL."""
    pts = fcst.aggregate_points(hist, key, ds_col, y_col, unique)
    n = partitions or fcst.fit_partitions(hist.sparkSession)
    return pts.repartition(n, "counterId").groupBy("counterId").applyInPandas(_fit(config), MODEL_SCHEMA)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _season(name: str, t: Column) -> Column:
    def term(b: Column, i: Column) -> Column:
        angle = F.lit(2.0 * math.pi) * (F.floor(i / 2) + 1).cast("double") * t / F.lit(PERIODS[name])
        return b * F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
    return _total(F.transform(name, term))


def scored(rows: DataFrame, ds_col: str = "ds") -> DataFrame:
    """Rows that carry a model and a timestamp, with ``yhat`` and ``trend`` in place of the model."""
    model = ["t0", "span", "scale", "changepoints", "yearly", "weekly", "daily"]
    t = F.unix_timestamp(F.col(ds_col).try_cast("timestamp_ntz")).cast("double") / 86400.0
    s = (F.col("_t") - F.col("t0")) / F.col("span")
    hinges = _total(F.zip_with("changepoints", F.slice("trend", 3, F.size("changepoints")), lambda c, b: b * F.greatest(F.lit(0.0), F.col("_s") - c)))
    line = F.try_element_at("trend", F.lit(1)) + F.try_element_at("trend", F.lit(2)) * F.col("_s") + hinges
    out = rows.withColumn("_t", t).withColumn("_s", s).withColumn("_line", line)
    seasons = [_season(n, F.col("_t")) for n in PERIODS]
    yhat = F.col("_line") + seasons[0] + seasons[1] + seasons[2]
    return (out.withColumn("yhat", yhat * F.col("scale")).withColumn("_line", F.col("_line") * F.col("scale"))
            .drop("_t", "_s", "trend", *model).withColumnRenamed("_line", "trend"))


def future_frame(model: DataFrame, horizon: int = 10, as_of=None, labels=tuple(DAY_PART_LABELS)) -> DataFrame:
    """The model rows repeated for the dates to predict: ``horizon`` days after a counter's last day, or
    with ``as_of`` the day-part ``labels`` of ``horizon`` days from then. Generated on the rows: no join."""
    if as_of is None:
        days = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_format(F.date_add(F.to_date("last_day"), i), "yyyy-MM-dd"))
    else:
        first = F.lit(str(as_of)).cast("date")
        each = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.date_format(F.date_add(first, i), "yyyy-MM-dd"))
        days = F.flatten(F.transform(each, lambda d: F.array(*[F.concat(d, F.lit(f" {x}")) for x in labels])))
    return model.withColumn("ds", F.explode(days)) if horizon > 0 else model.withColumn("ds", F.lit(None).cast("string")).limit(0)


def predict_from(model: DataFrame, frame: DataFrame | None = None, horizon: int = 10, as_of=None,
                 labels=tuple(DAY_PART_LABELS), key: str = "counterId") -> DataFrame:
    """(counterId, ds, yhat, trend) from a table of coefficients: for the rows of ``frame`` (key, ds), else
    for ``future_frame``. A counter of the frame that has no model gets NULLs."""
    if frame is None:
        rows = future_frame(model, horizon, as_of, labels)
    else:
        asked = frame.select(F.col(key).cast("long").alias("counterId"), F.col("ds").cast("string").alias("ds"))
        rows = asked.join(model, "counterId", "left")
    return scored(rows).select("counterId", "ds", "yhat", "trend")


def changes(model: DataFrame) -> DataFrame:
    """(counterId, day, change): every change of a counter's trend that is not zero, as the day it falls on
    and the change of the slope in y a day."""
    k = F.size("changepoints")
    return (model.where(F.col("trend").isNotNull())
            .select("counterId", "t0", "span", "scale", F.posexplode(F.arrays_zip(F.col("changepoints"), F.slice("trend", 3, k).alias("delta"))).alias("_k", "_c"))
            .select("counterId", (F.col("t0") + F.col("_c.changepoints") * F.col("span")).alias("_day"), (F.col("_c.delta") * F.col("scale") / F.col("span")).alias("change"))
            .where(F.col("change") != 0)
            .select("counterId", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor("_day").cast("int")), "yyyy-MM-dd").alias("day"), "change"))
