"""Compositions from raw text to the history tables (one lazy plan, no action)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.operators.calendar import add_calendar
from footfall.operators.clean import clean_readings, clean_weather
from footfall.operators.enrich import join_weather, mark_holidays
from footfall.operators.profiles import daily_rollup
from footfall.sources import parse_holidays


def enriched_history(reading_lines: DataFrame, weather_lines: DataFrame, holiday_lines: DataFrame,
                     tz_offset: str = "+02:00", category: str = "National holiday") -> DataFrame:
    """Raw counter lines + raw weather lines + holiday lines -> ENRICHED_HOLIDAY rows."""
    readings = clean_readings(reading_lines, tz_offset)
    weather = clean_weather(weather_lines, tz_offset)
    holidays = parse_holidays(holiday_lines, category)
    return mark_holidays(join_weather(weather, readings), holidays, tz_offset)


def hourly_history(reading_lines: DataFrame, weather_lines: DataFrame, holiday_lines: DataFrame,
                   tz_offset: str = "+02:00") -> DataFrame:
    """The enriched history with calendar columns: input of every roll-up and profile."""
    return add_calendar(enriched_history(reading_lines, weather_lines, holiday_lines, tz_offset), tz_offset)


def daily_history(hourly: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Daily roll-up, joined with route attributes when given."""
    daily = daily_rollup(hourly)
    if routes is None:
        return daily
    from footfall.operators.enrich import attach_routes
    return attach_routes(daily, routes)


def write_weekday_profiles(hourly: DataFrame, path: str, key: str = "parkCode", fmt: str = "parquet") -> None:
    """One folder per (key, weekday) holding that profile's 2-hour bins in hour order — the table
    behind one chart per key and weekday. Readers prune to a single (key, weekday) by path."""
    from footfall.operators.profiles import weekday_profile
    from footfall.sources.sinks import write_partitioned
    write_partitioned(weekday_profile(hourly, key), path, [key, "weekday"], fmt=fmt, order=["hour2d"])
