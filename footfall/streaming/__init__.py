"""Incremental ingestion of counter text files with Structured Streaming.

The cleaning, weather join and holiday flag contain no action, so the batch operators run
unchanged on a streaming DataFrame: new text files in a folder are parsed, enriched with the
(static, broadcast) weather and holiday tables and appended to a Parquet table. Progress and
exactly-once bookkeeping live in the checkpoint folder, so a restarted or failed query resumes
where it stopped. Rejected lines go to their own table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.calendar import add_calendar
from footfall.operators.clean import clean_readings, rejected_readings
from footfall.operators.enrich import join_weather, mark_holidays
from footfall.operators.rollup_state import DAILY, DAY_PARTS, RollUp, update_state


def stream_raw_readings(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def enrich_stream(raw: DataFrame, weather: DataFrame, holidays: DataFrame, tz_offset: str = "+02:00") -> DataFrame:
    """Streaming text lines -> enriched readings (stream-static joins; no state is kept)."""
    return mark_holidays(join_weather(weather, clean_readings(raw, tz_offset)), holidays, tz_offset)


def start_ingest(spark: SparkSession, folder: str, weather: DataFrame, holidays: DataFrame, out_path: str,
                 checkpoint: str, rejects_path: str | None = None, tz_offset: str = "+02:00",
                 available_now: bool = True) -> list[StreamingQuery]:
    """Start the ingestion (and optionally the rejects) query; returns the running queries."""
    raw = stream_raw_readings(spark, folder)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    queries = [enrich_stream(raw, weather, holidays, tz_offset).writeStream.format("parquet")
               .option("checkpointLocation", f"{checkpoint}/readings").outputMode("append")
               .trigger(**trigger).start(out_path)]
    if rejects_path:
        queries.append(rejected_readings(raw, tz_offset).writeStream.format("parquet")
                       .option("checkpointLocation", f"{checkpoint}/rejects").outputMode("append")
                       .trigger(**trigger).start(rejects_path))
    return queries


def start_rollups(spark: SparkSession, folder: str, weather: DataFrame, holidays: DataFrame, out_path: str, checkpoint: str,
                  kinds: dict[str, RollUp] | None = None, tz_offset: str = "+02:00", available_now: bool = True) -> StreamingQuery:
    """Keep roll-up states up to date from new counter files: each batch's readings are merged into the
    published states ``out_path/<name>`` (``rollup_state``), the days that they fall on only. The batch
    number is published with the state, so a batch that is repeated after a failure counts once."""
    kinds = kinds or {"daily": DAILY, "day_parts": DAY_PARTS}

    def merge(batch: DataFrame, number: int) -> None:
        hourly = add_calendar(batch, tz_offset)
        for name, kind in kinds.items():
            update_state(hourly, f"{out_path.rstrip('/')}/{name}", kind, number)

    raw = stream_raw_readings(spark, folder)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (enrich_stream(raw, weather, holidays, tz_offset).writeStream.foreachBatch(merge)
            .option("checkpointLocation", f"{checkpoint}/rollups").trigger(**trigger).start())
