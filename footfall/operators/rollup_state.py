"""Roll-ups that grow: stored partial states that new readings are merged into.

A state row holds what a roll-up of its key and day needs to go on: sums, counts, minima and flags, no
finished mean. States are added up by key, in any order and any number of pieces, so the roll-up of a year
and the merged roll-ups of its days are the same; sums of measures are exact decimals for that. The state
of a day lies in a part of its own (``publish``), so a run reads and replaces the days that its new
readings fall on, late ones included, and leaves the rest of the history alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import profiles
from footfall.operators.calendar import add_day_part, add_day_part_label, filter_hours
from footfall.session import save_once
from footfall.sources.publish import compact, manifest, publish, read_published, versions

DAY = "day_date"
SUM_TYPE = "decimal(38,12)"
SCATTERED = 64            # versions that a state's parts lie in before it is written as one again


@dataclass(frozen=True)
class RollUp:
    """Keys beside the day, the hours that count, the measures with a mean, and the smallest values kept."""
    keys: tuple[str, ...]
    hours: tuple[int, int]
    means: tuple[str, ...]
    least: tuple[str, ...] = ()


DAILY = RollUp(("parkCode", "counterIdPave"), (9, 19), (*schemas.WEATHER_MEASURES, "cordNorth", "coordSouth"), ("counterId",))
DAY_PARTS = RollUp(("counterId", "day_part"), (9, 20), tuple(schemas.DAY_PART_MEANS))


def state_of(hourly: DataFrame, kind: RollUp) -> DataFrame:
    """The state of some hourly rows (map-side combined); rows without a key or a day are left out."""
    src = filter_hours(hourly.withColumn(DAY, F.to_date("date" if "date" in hourly.columns else "date_day")), *kind.hours)
    if "day_part" in kind.keys:
        src = add_day_part(src)
    src = src.dropna(subset=[*kind.keys, DAY])
    aggs = [F.coalesce(F.sum("visits"), F.lit(0)).cast("bigint").alias("visits")]
    for m in kind.means:
        aggs += [F.sum(F.col(m).cast(SUM_TYPE)).cast(SUM_TYPE).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    aggs += [F.min(c).alias(c) for c in kind.least]
    aggs.append(F.coalesce(F.bool_or("holiday"), F.lit(False)).alias("holiday"))
    return src.groupBy(*kind.keys, DAY).agg(*aggs)


def merge_states(states: DataFrame, kind: RollUp) -> DataFrame:
    """One row a key and day from any number of state rows."""
    aggs = [F.sum("visits").cast("bigint").alias("visits")]
    for m in kind.means:
        aggs += [F.sum(f"{m}_sum").cast(SUM_TYPE).alias(f"{m}_sum"), F.sum(f"{m}_n").cast("bigint").alias(f"{m}_n")]
    aggs += [F.min(c).alias(c) for c in kind.least]
    aggs.append(F.bool_or("holiday").alias("holiday"))
    return states.groupBy(*kind.keys, DAY).agg(*aggs)


def _mean(m: str) -> Column:
    return (F.col(f"{m}_sum").cast("double") / F.nullif(F.col(f"{m}_n"), F.lit(0))).alias(m)


def finish_daily(state: DataFrame) -> DataFrame:
    """The state as ``profiles.daily_rollup`` gives it."""
    parts = [f(DAY).cast("double").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))]
    return state.select("parkCode", "counterIdPave", F.date_format(DAY, "yyyy-MM-dd").alias("date_day"), *[_mean(m) for m in schemas.WEATHER_MEASURES],
                        "visits", _mean("cordNorth"), _mean("coordSouth"), *parts, "holiday", "counterId")


def finish_day_parts(state: DataFrame) -> DataFrame:
    """The state as ``profiles.day_part_rollup`` gives it."""
    out = state.select("counterId", F.date_format(DAY, "yyyy-MM-dd").alias("date_day"), F.year(DAY).alias("year"), F.month(DAY).alias("month"),
                       "day_part", "visits", *[_mean(m) for m in schemas.DAY_PART_MEANS], "holiday")
    return add_day_part_label(out)


def update_state(hourly: DataFrame, path: str, kind: RollUp, batch: int | None = None) -> bool:
    """Merge new hourly rows into the state published at ``path``; false if there was nothing to do.

    ``batch`` is the number of a stream's batch: one that the manifest already names is not merged again,
    so a batch that is run twice counts once."""
    spark = hourly.sparkSession
    before = manifest(path)
    if before and batch is not None and before["notes"].get("batch", -1) >= batch:
        return False
    fresh = save_once(state_of(hourly, kind), "state")
    days = [r[0] for r in fresh.select(DAY).distinct().collect()]      # bounded by the calendar
    if not days and before:
        return False
    known = read_published(spark, path, only=days) if before else None
    merged = merge_states(fresh.unionByName(known), kind) if known is not None else fresh
    publish(merged, path, partition_by=DAY, replace_parts=True, notes=None if batch is None else {"batch": batch})
    if versions(path) > SCATTERED:
        compact(spark, path)
    return True


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path)


def historic_max_of(state: DataFrame) -> DataFrame:
    """Highest daily visits of each counter, from the daily state."""
    return profiles.historic_max(state)
