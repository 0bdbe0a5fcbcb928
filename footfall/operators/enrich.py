"""Enrichment joins: hourly weather, holiday flag, route attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import decimal_comma, epoch_to_local


def join_weather(weather: DataFrame, readings: DataFrame, on: Sequence[str] = ("startDate",)) -> DataFrame:
    """Readings ⋈ hourly weather on the hour start (inner, USING): weather columns first.

    One weather row serves every counter of that hour; duplicate weather rows multiply readings, as
    an equi-join does. Whether the hours are broadcast is Spark's own choice, from its threshold or
    from sizes measured at run time; shuffled, AQE splits hot hours.
    """
    on = list(on)
    return weather.join(readings, on=on, how="inner")


def mark_holidays(df: DataFrame, holidays: DataFrame, tz_offset: str = "+02:00",
                  inclusive_start: bool = False, epoch_col: str = "startDate") -> DataFrame:
    """Append ``holiday``: true iff some holiday midnight ``d`` has ``0 < start - d < 1 day``.

    With ``inclusive_start`` the midnight hour itself counts too. The interval predicate is
    rewritten as an equi-join on the local date against the distinct holiday dates (one row per
    calendar day at most, a proven bound), so the plan is a broadcast hash join, never a nested
    loop, and no reading is duplicated.
    """
    days = holidays.select(F.col("date").alias("_hday")).where(F.col("_hday").isNotNull()).distinct()
    local = epoch_to_local(F.col(epoch_col), tz_offset)
    with_local = df.withColumn("_local", local)
    # Distinct DATE values are bounded by the type itself (years 1..9999: < 3.7 million dates of
    # 4 bytes), so the broadcast is safe whatever the source; shuffling the readings by date
    # instead would put every reading of a busy day into one task.
    joined = with_local.join(F.broadcast(days), F.to_date(F.col("_local")) == F.col("_hday"), "left")
    flag = F.col("_hday").isNotNull()
    if not inclusive_start:
        flag = flag & (F.col("_local") > F.col("_hday").cast("timestamp_ntz"))
    return joined.withColumn("holiday", F.coalesce(flag, F.lit(False))).drop("_local", "_hday")


def rename_route_columns(df: DataFrame) -> DataFrame:
    """CSV names with brackets -> plain names used inside the library."""
    for src, dst in schemas.ROUTE_CSV_NAMES.items():
        if src in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def stack_routes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two parks' route tables by column name; a column missing on one side becomes NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def normalize_routes(routes: DataFrame) -> DataFrame:
    """Route table with a decimal-comma length -> typed ROUTE columns (those present)."""
    out = rename_route_columns(routes)
    if "length_km" in out.columns:
        out = out.withColumn("length_km", decimal_comma("length_km"))
    casts = {"duration_min": "double", "counterId": "bigint", **{f: "bigint" for f in schemas.ROUTE_FLAGS}}
    for name, kind in casts.items():
        if name in out.columns:
            out = out.withColumn(name, F.col(name).try_cast(kind))
    return out


def prepare_routes(raw: DataFrame) -> DataFrame:
    """A park's raw route table -> counterId (from the park-code column), plain names, typed
    decimal-comma length; coordinates dropped."""
    out = raw
    if "ASTA_Counters.NationalParkCode" in out.columns:
        out = out.withColumnRenamed("ASTA_Counters.NationalParkCode", "counterId")
    out = out.drop("EPSG4326_East", "EPSG4326_North")
    return normalize_routes(out)


def attach_routes(df: DataFrame, routes: DataFrame, key: str = "counterId") -> DataFrame:
    """Inner join of a per-counter table with route attributes on ``counterId``."""
    return df.join(routes, on=key, how="inner")
