"""Forecast -> load ratios and busy/free answers, for all parks, routes and dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import (clamp_negative, exact_sum, literal_table, load_percent, load_ratio, park_class,
                                park_message, route_bucket, route_count_message)
from footfall.functions.labels import PARKS
from footfall.operators.profiles import historic_max


def clamp_visits(df: DataFrame, col: str = "visits_pred") -> DataFrame:
    return df.withColumn(col, clamp_negative(F.col(col)))


def compute_load(fc: DataFrame, hist: DataFrame, pred_col: str = "visits_pred",
                 date_col: str = "date") -> DataFrame:
    """(counterId, date, visits_pred) ⋈ per-counter historic max -> load = pred / (max + 1).

    Counters without history are dropped (inner join). The max table is one row per counter, a
    partial+final aggregate; Spark picks the join.
    """
    stats = historic_max(hist)
    out = fc.join(stats, on="counterId", how="inner")
    return out.select("counterId", F.col(date_col).alias("date"),
                      F.col(pred_col).cast("double").alias("visits_pred"),
                      load_ratio(F.col(pred_col), F.col("visits_max")).alias("load"))


def observed_load(daily: DataFrame, date_col: str = "date_day") -> DataFrame:
    """Each counter-day's visits as a share of the counter's best day (+1), in one pass.

    The per-counter maximum is a window over the daily table (one row per counter and day, so a
    window partition is bounded by the length of the history); the daily table is computed once
    instead of once for the values and once for the maximum.
    """
    from pyspark.sql import Window
    best = F.max("visits").over(Window.partitionBy("counterId"))
    return daily.where(F.col("counterId").isNotNull()).select(
        "counterId", F.col(date_col).alias("date"), F.col("visits").cast("double").alias("visits_pred"),
        load_ratio(F.col("visits"), best).alias("load"))


def park_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PARKS, "parkId BIGINT, park_name STRING")


def to_feed(pred: DataFrame, park_id: int | None = 952, routes: DataFrame | None = None) -> DataFrame:
    """Prediction table -> load feed (counterId, parkId, load, date DATE).

    The park comes from the route dimension when one with ``parkId`` is given, otherwise the
    constant ``park_id``; ``routes`` also restricts the feed to known routes.
    """
    feed = pred.select(F.col("counterId").cast("bigint").alias("counterId"),
                       F.col("load").cast("double").alias("load"),
                       F.to_date(F.col("date")).alias("date"))
    if routes is not None and "parkId" in routes.columns:
        feed = feed.join(unique_dim(routes.select("counterId", "parkId"), "counterId"), "counterId", "inner")
    else:
        feed = feed.withColumn("parkId", F.lit(park_id).cast("bigint"))
        if routes is not None:
            feed = keep_routes(feed, routes)
    return feed.select("counterId", "parkId", "load", "date")


def keep_routes(df: DataFrame, routes: DataFrame, key: str = "counterId") -> DataFrame:
    """Rows whose counter is in the route dimension (left semi join, no duplication)."""
    return df.join(routes.select(key).distinct(), on=key, how="left_semi")


def forecast_on(df: DataFrame, as_of, days: int = 0, date_col: str = "date") -> DataFrame:
    """Rows dated ``as_of + days`` (``as_of`` is an argument, never the wall clock)."""
    target = F.date_add(F.to_date(F.lit(str(as_of))), int(days))
    return df.where(F.col(date_col) == target)


def with_route_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", route_bucket(F.col("load")))


def route_bucket_counts(feed: DataFrame) -> DataFrame:
    """Per (park, date): how many routes to avoid, busy, free, of unknown load, and the summary
    sentence of the known ones.

    ``count_if`` aggregates partially before the shuffle; all four counts are always present.
    """
    b = route_bucket(F.col("load"))
    out = feed.groupBy("parkId", "date").agg(
        F.count_if(b == "avoid").alias("avoid"), F.count_if(b == "busy").alias("busy"),
        F.count_if(b == "free").alias("free"), F.count_if(b.isNull()).alias("unknown"))
    return out.withColumn("message", route_count_message(F.col("avoid"), F.col("busy"), F.col("free")))


def routes_in_bucket(feed: DataFrame, dim: DataFrame, bucket: str, key: str = "counterId", dim_key: str = "id") -> DataFrame:
    """The routes of one bucket with their names and attributes, per park and date."""
    return describe_routes(with_route_bucket(feed).where(F.col("bucket") == F.lit(bucket)), dim, key, dim_key)


def asked_days(parks: DataFrame, as_of, n_days: int) -> DataFrame:
    """Every park × the dates ``as_of .. as_of + n_days`` (generated, no join)."""
    start = F.to_date(F.lit(str(as_of)))
    return parks.select("parkId", F.explode(F.sequence(start, F.date_add(start, int(n_days)))).alias("date"))


def park_state(feed: DataFrame, asked: DataFrame) -> DataFrame:
    """Mean load per asked (park, date), its class, percent and sentence; 'unknown' when the feed
    has no row for that park and date. The mean is taken from an exact decimal sum."""
    agg = feed.groupBy("parkId", "date").agg(
        (exact_sum("load") / F.count("load").cast("double")).alias("mean_load"),
        F.count(F.lit(1)).alias("n_routes"))
    out = asked.join(agg, on=["parkId", "date"], how="left")
    state = F.when(F.col("mean_load").isNull(), F.lit("unknown")).otherwise(park_class(F.col("mean_load")))
    out = (out.withColumn("state", state)
           .withColumn("percent", load_percent(F.col("mean_load")))
           .withColumn("n_routes", F.coalesce(F.col("n_routes"), F.lit(0)).cast("bigint")))
    return out.withColumn("message", park_message(F.col("state"), F.col("percent")))


def unique_dim(dim: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the smallest row (deterministic stand-in for 'first match')."""
    others = [c for c in dim.columns if c != key]
    if not others:
        return dim.distinct()
    first = dim.groupBy(key).agg(F.min(F.struct(*others)).alias("_r"))
    return first.select(key, *[F.col("_r")[c].alias(c) for c in others])


def describe_routes(df: DataFrame, dim: DataFrame, key: str = "counterId", dim_key: str = "id") -> DataFrame:
    """Attach route attributes by id (left outer); unmatched rows keep NULL attributes."""
    d = unique_dim(dim, dim_key).withColumnRenamed(dim_key, key)
    return df.join(d, on=key, how="left")

