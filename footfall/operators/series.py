"""Per-counter series operators: windows over one counter's history and generated future frames.

Window partitions are one counter's *rolled-up* history (one row per day or day part), so a
partition is bounded by the length of the history, never by the volume of raw readings.
Future frames are generated with ``sequence``/``explode`` from one row per counter: no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.labels import DAY_PART_LABELS, FUTURE_TEMP_DATES, FUTURE_TEMPS


def _order(order: str | Sequence[str], descending: bool):
    cols = [order] if isinstance(order, str) else list(order)
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def latest_per_counter(df: DataFrame, key: str = "counterId", date_col: str = "date_day") -> DataFrame:
    """Rows on each counter's last date; ties are all kept (rank = 1, planned with a group limit)."""
    w = Window.partitionBy(key).orderBy(F.col(date_col).desc())
    return df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") == 1).drop("_rk")


def last_n_per_counter(df: DataFrame, n: int = 1500, key: str = "counterId",
                       order: str | Sequence[str] = "date_day") -> DataFrame:
    """The last ``n`` rows of each counter (the whole group when it is shorter); rows that tie in
    ``order`` are ranked by a hash of the whole row, so a recomputed task keeps the same ones."""
    w = Window.partitionBy(key).orderBy(*_order(order, True), F.xxhash64(*df.columns))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def ordered_split(df: DataFrame, n: int, key: str = "counterId",
                  order: str | Sequence[str] = "date_day") -> DataFrame:
    """Number each counter's rows in time order (``rn``) and label the first ``n`` 'train', the
    rest 'test' (empty test part when the group has at most ``n`` rows). Ties in ``order`` are
    numbered by a hash of the whole row."""
    w = Window.partitionBy(key).orderBy(*_order(order, False), F.xxhash64(*df.columns))
    rn = F.row_number().over(w)
    return (df.withColumn("rn", rn.cast("bigint"))
            .withColumn("part", F.when(F.col("rn") <= n, F.lit("train")).otherwise(F.lit("test"))))


def train_test(df: DataFrame, n: int, key: str = "counterId", order: str | Sequence[str] = "date_day"):
    s = ordered_split(df, n, key, order)
    return (s.where(F.col("part") == "train").drop("part"), s.where(F.col("part") == "test").drop("part"))


def to_series(df: DataFrame, date_col: str = "date_day", value_col: str = "visits",
              key: str = "counterId") -> DataFrame:
    """(counterId, ds, y) long-format series."""
    return df.select(F.col(key), F.col(date_col).alias("ds"), F.col(value_col).cast("double").alias("y"))


def last_dates(series: DataFrame, key: str = "counterId", ds_col: str = "ds") -> DataFrame:
    return series.groupBy(key).agg(F.max(F.to_date(ds_col)).alias("_last"))


def future_days(series: DataFrame, n: int = 10, include_history: bool = True, key: str = "counterId",
                ds_col: str = "ds") -> DataFrame:
    """(counterId, ds) for the ``n`` days after each counter's own last day, optionally preceded
    by the history dates."""
    last = last_dates(series, key, ds_col)
    fut = last.select(key, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", n))).alias("_d"))
    fut = fut.select(key, F.date_format("_d", "yyyy-MM-dd").alias("ds"))
    if not include_history:
        return fut
    return series.select(key, F.col(ds_col).alias("ds")).unionByName(fut)


def split_horizon(frame: DataFrame, history: DataFrame, key: str = "counterId", ds_col: str = "ds") -> DataFrame:
    """Label rows of a forecast frame 'history' (on or before the counter's last observed date) or
    'future'. The last dates are one row per counter; Spark picks the join."""
    out = frame.join(last_dates(history, key, ds_col), on=key, how="left")
    part = F.when(F.to_date(ds_col) <= F.col("_last"), F.lit("history")).otherwise(F.lit("future"))
    return out.withColumn("part", part).drop("_last")


def future_day_parts(counters: DataFrame, as_of, n: int = 10, key: str = "counterId") -> DataFrame:
    """Every counter × the ``n`` days from ``as_of`` × the three day-part clock labels."""
    start = F.to_date(F.lit(str(as_of)))
    days = counters.select(key, F.explode(F.sequence(start, F.date_add(start, n - 1))).alias("_d"))
    labels = F.array(*[F.lit(x) for x in DAY_PART_LABELS])
    out = days.select(key, "_d", F.posexplode(labels).alias("day_part", "hours"))
    return out.select(key, F.concat_ws(" ", F.date_format("_d", "yyyy-MM-dd"), F.col("hours")).alias("ds"),
                      F.col("day_part").cast("bigint").alias("day_part"))


def future_covariates(counters: DataFrame, dates: Sequence[str] = tuple(FUTURE_TEMP_DATES),
                      temps: Sequence[int] = tuple(FUTURE_TEMPS), key: str = "counterId") -> DataFrame:
    """Every counter × the (date, temperature) outlook, generated per row (no join)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("date"), F.lit(int(t)).cast("bigint").alias("temp"))
                      for d, t in zip(dates, temps)])
    return counters.select(key, F.inline(pairs))
