"""Roll-ups and profiles over the hourly history (one shuffle each, partial + final aggregation).

Input is the hourly history with calendar columns (``add_calendar``). Group keys that are NULL are
dropped first (a grouped mean over a missing key has no meaning in the source data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators.calendar import add_day_part, add_day_part_label, filter_hours
from footfall.functions import weekday_mon0


def _bool_max(c: str) -> Column:
    return F.coalesce(F.bool_or(F.col(c)), F.lit(False))


def _with_day(df: DataFrame) -> DataFrame:
    """The local date as a DATE: a 4-byte key for the shuffles that see every reading."""
    return df.withColumn("_day", F.to_date("date" if "date" in df.columns else "date_day"))


def _day_text() -> Column:
    return F.date_format("_day", "yyyy-MM-dd").alias("date_day")


def day_part_rollup(df: DataFrame, sort: bool = False) -> DataFrame:
    """Hours 9..20 -> (counterId, date_day, year, month, day_part): visits sum, weather and
    coordSouth means, holiday max; plus the clock label ``hours`` and ``ds``."""
    src = add_day_part(filter_hours(_with_day(df), 9, 20)).dropna(subset=["counterId", "_day", "day_part"])
    out = src.groupBy("counterId", "_day", "day_part").agg(
        F.coalesce(F.sum("visits"), F.lit(0)).cast("bigint").alias("visits"),
        *[F.avg(m).alias(m) for m in schemas.DAY_PART_MEANS],
        _bool_max("holiday").alias("holiday"))
    rest = [c for c in out.columns if c not in ("counterId", "_day", "day_part")]
    out = out.select("counterId", _day_text(), F.year("_day").alias("year"), F.month("_day").alias("month"), "day_part", *rest)
    out = add_day_part_label(out)
    return out.orderBy("date_day", "day_part", "counterId") if sort else out


def daily_rollup(df: DataFrame) -> DataFrame:
    """Hours 9..19 -> (parkCode, counterIdPave, date_day): weather, coordinates, year/month/day
    means, visits sum, holiday max, and the counter id (smallest, for determinism)."""
    keys = ["parkCode", "counterIdPave", "_day"]
    src = filter_hours(_with_day(df), 9, 19).dropna(subset=keys)
    aggs = [F.avg(m).alias(m) for m in schemas.WEATHER_MEASURES]
    aggs.append(F.coalesce(F.sum("visits"), F.lit(0)).cast("bigint").alias("visits"))
    aggs += [F.avg(m).alias(m) for m in ["cordNorth", "coordSouth"]]
    aggs += [_bool_max("holiday").alias("holiday"), F.min("counterId").alias("counterId")]
    out = src.groupBy(*keys).agg(*aggs)
    # year, month and day follow from the date: their means need no aggregate
    parts = [f("_day").cast("double").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))]
    return out.select("parkCode", "counterIdPave", _day_text(), *schemas.WEATHER_MEASURES, "visits", "cordNorth", "coordSouth",
                      *parts, "holiday", "counterId")


def hourly_profile(df: DataFrame, key: str = "counterId") -> DataFrame:
    """Mean visits by (key, hour of day)."""
    return (df.dropna(subset=[key, "hour"]).groupBy(key, "hour")
            .agg(F.avg("visits").alias("visits_mean")))


def weekday_profile(df: DataFrame, key: str = "parkCode", sort: bool = False) -> DataFrame:
    """Mean visits by (key, weekday, 2-hour bin); ``key`` is parkCode or counterId. ``sort`` orders
    the profiles by key and weekday, each in hour order."""
    out = (df.dropna(subset=[key, "weekday", "hour2d"]).groupBy(key, "weekday", "hour2d")
           .agg(F.avg("visits").alias("visits_mean")))
    return out.orderBy(key, "weekday", "hour2d") if sort else out


def historic_max(df: DataFrame, key: str = "counterId", value: str = "visits") -> DataFrame:
    """Per-counter historic maximum of visits (one row per counter)."""
    return df.groupBy(key).agg(F.max(value).alias("visits_max"))


def profile_for_date(requests: DataFrame, profile: DataFrame, key: str = "counterId",
                     date_col: str = "date") -> DataFrame:
    """Each (key, target date) request -> the weekday profile rows of that key and weekday."""
    req = requests.withColumn("weekday", weekday_mon0(F.col(date_col)))
    return req.join(profile, on=[key, "weekday"], how="inner")


def distinct_keys(df: DataFrame, key: str | Sequence[str] = "counterId") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys).distinct()


def row_counts(df: DataFrame, col: str) -> DataFrame:
    """Total rows and rows with a non-NULL ``col``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.col(col)).alias("n_not_null"))


def preview(df: DataFrame, order: Sequence[str], n: int = 5, descending: bool = False) -> DataFrame:
    """First (or last) ``n`` rows in a total order: a top-k (TakeOrderedAndProject), no full sort."""
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return df.orderBy(*cols).limit(n)


def for_counter(df: DataFrame, counter_id, key: str = "counterId") -> DataFrame:
    """Rows of one key (pushed to the scan as a filter)."""
    return df.where(F.col(key) == F.lit(counter_id))
