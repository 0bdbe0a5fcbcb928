"""Runnable jobs from input paths to written tables; each stage reads what the one before wrote.

``run_all`` is the whole chain: raw counter text -> readings -> weather -> holidays -> hourly history ->
daily history, fitted models and predictions -> load feed. Every stage can be run by itself and restarted: it reads
what is published (or text, for the first ones) and publishes its own table only. A table is replaced by
a new version beside the old one (``sources.publish``): a reader, or the next stage, sees the old table or the new one,
also when a job dies half-way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import sources
from footfall.operators import clean, enrich, forecast, load, model_table, series
from footfall.operators.calendar import add_calendar
from footfall.plans import history, predictions
from footfall.sources.publish import publish, read_published

TABLES = ["reading", "rejected", "enriched_holiday", "history_hour", "history_daily", "model_daily", "model_day_part", "prediction_daily", "prediction_day_part", "feed"]


def saved(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    publish(df, path, partition_by, fmt, options=options)
    return read_published(df.sparkSession, path)


def clean_job(spark: SparkSession, readings_path: str, out: str, tz_offset: str = "+02:00") -> DataFrame:
    """Raw counter text -> ``reading``, and the lines it drops with their reasons -> ``rejected``."""
    raw = sources.read_raw_readings(spark, readings_path)
    saved(clean.rejected_readings(raw, tz_offset), f"{out}/rejected")
    return saved(clean.clean_readings(raw, tz_offset), f"{out}/reading")


def enrich_job(spark: SparkSession, weather_path: str, holidays_path: str, out: str, tz_offset: str = "+02:00",
               category: str = "National holiday") -> DataFrame:
    """``reading`` + weather text + holiday lines -> ``enriched_holiday``."""
    readings = read_published(spark, f"{out}/reading")
    joined = enrich.join_weather(sources.read_weather(spark, weather_path, tz_offset), readings)
    return saved(enrich.mark_holidays(joined, sources.read_holidays(spark, holidays_path, category), tz_offset), f"{out}/enriched_holiday")


def history_job(spark: SparkSession, out: str, routes: DataFrame | None = None, tz_offset: str = "+02:00") -> tuple[DataFrame, DataFrame]:
    """``enriched_holiday`` -> ``history_hour`` (by day, so reads prune by date) and ``history_daily``."""
    enriched = read_published(spark, f"{out}/enriched_holiday")
    hourly = saved(add_calendar(enriched, tz_offset).withColumn("day_date", F.to_date("date")), f"{out}/history_hour", "day_date").drop("day_date")
    return hourly, saved(history.daily_history(hourly, routes), f"{out}/history_daily")


def model_job(spark: SparkSession, out: str, config: forecast.ModelConfig = forecast.ModelConfig()) -> tuple[DataFrame, DataFrame]:
    """``history_hour`` and ``history_daily`` -> ``model_daily`` and ``model_day_part``: one row of coefficients a counter."""
    hourly, daily = read_published(spark, f"{out}/history_hour"), read_published(spark, f"{out}/history_daily")
    return (saved(model_table.fit_coefficients(series.to_series(daily, "date_day", "visits"), config), f"{out}/model_daily"),
            saved(model_table.fit_coefficients(predictions.day_part_series(hourly), config, unique=True), f"{out}/model_day_part"))


def prediction_job(spark: SparkSession, out: str, as_of, horizon: int = 10) -> tuple[DataFrame, DataFrame]:
    """``model_daily``, ``model_day_part`` and ``history_daily`` -> ``prediction_daily`` and
    ``prediction_day_part``. It can run every day on the same models: nothing is fitted here."""
    daily = read_published(spark, f"{out}/history_daily")
    days, parts = read_published(spark, f"{out}/model_daily"), read_published(spark, f"{out}/model_day_part")
    return (saved(predictions.prediction_from(days, daily, horizon), f"{out}/prediction_daily"),
            saved(predictions.prediction_from(parts, daily, horizon, as_of), f"{out}/prediction_day_part"))


def feed_job(spark: SparkSession, out: str, park_id: int = 952, routes: DataFrame | None = None) -> DataFrame:
    """``prediction_daily`` -> a CSV ``prediction`` table with a header -> the load feed."""
    table = saved(read_published(spark, f"{out}/prediction_daily"), f"{out}/prediction", fmt="csv", options={"header": "true"})
    return saved(load.to_feed(table, park_id=park_id, routes=routes), f"{out}/feed")


def run_all(spark: SparkSession, readings_path: str, weather_path: str, holidays_path: str, out: str, as_of,
            routes_paths: list[str] = (), park_id: int = 952, tz_offset: str = "+02:00", horizon: int = 10,
            config: forecast.ModelConfig = forecast.ModelConfig()) -> DataFrame:
    """All stages in order; returns the load feed."""
    clean_job(spark, readings_path, out, tz_offset)
    enrich_job(spark, weather_path, holidays_path, out, tz_offset)
    routes = None
    for path in routes_paths:
        more = sources.read_routes(spark, path)
        routes = more if routes is None else enrich.stack_routes(routes, more)
    history_job(spark, out, routes, tz_offset)
    model_job(spark, out, config)
    prediction_job(spark, out, as_of, horizon)
    return feed_job(spark, out, park_id)
