"""Calendar columns from epoch instants (zone-free: fixed offset, NTZ wall time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import day_part, day_part_label, epoch_to_local, hour_bin2, weekday_mon0


def add_calendar(df: DataFrame, tz_offset: str = "+02:00", epoch_col: str = "startDate") -> DataFrame:
    """Add local ``date`` (NTZ), year, month, day, hour, weekday (Mon = 0), ``hour2d``,
    ``date_day`` ('yyyy-MM-dd') and ``ds`` ('yyyy-MM-dd HH:mm:ss')."""
    local = epoch_to_local(F.col(epoch_col), tz_offset)
    return (df.withColumn("date", local)
            .withColumn("year", F.year("date"))
            .withColumn("month", F.month("date"))
            .withColumn("day", F.dayofmonth("date"))
            .withColumn("hour", F.hour("date"))
            .withColumn("weekday", weekday_mon0("date"))
            .withColumn("hour2d", hour_bin2(F.col("hour")))
            .withColumn("date_day", F.date_format("date", "yyyy-MM-dd"))
            .withColumn("ds", F.date_format("date", "yyyy-MM-dd HH:mm:ss")))


def filter_hours(df: DataFrame, lo: int, hi: int, hour_col: str = "hour") -> DataFrame:
    """Keep hours in the closed range [lo, hi] (9..20 for day parts, 9..19 for daily totals)."""
    return df.where(F.col(hour_col).between(lo, hi))


def add_day_part(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    return df.withColumn("day_part", day_part(F.col(hour_col)))


def add_day_part_label(df: DataFrame) -> DataFrame:
    """``hours`` clock label of the day part and ``ds = date_day || ' ' || hours``."""
    return (df.withColumn("hours", day_part_label(F.col("day_part")))
            .withColumn("ds", F.concat_ws(" ", F.col("date_day"), F.col("hours"))))
