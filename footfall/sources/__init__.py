"""Sources: every reader takes a path and an explicit schema (no inference pass).

Text formats are read with ``spark.read.text`` and parsed by Column expressions, so a file is split
across tasks by the reader and no line ever goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall import schemas
from footfall.operators.clean import clean_readings, clean_weather
from footfall.operators.enrich import prepare_routes
from footfall.operators.load import to_feed


def read_raw_readings(spark: SparkSession, path: str) -> DataFrame:
    """Raw tab-separated counter lines (one ``value`` column); parse with ``clean_readings``."""
    return spark.read.text(path)


def read_readings(spark: SparkSession, path: str, tz_offset: str = "+02:00") -> DataFrame:
    return clean_readings(read_raw_readings(spark, path), tz_offset)


def read_json_lines(spark: SparkSession, path: str, schema: StructType = schemas.READING) -> DataFrame:
    """JSON lines with a declared schema; columns come out in schema order."""
    return spark.read.schema(schema).json(path).select(*schema.names)


def read_weather(spark: SparkSession, path: str, tz_offset: str = "+02:00") -> DataFrame:
    """Headerless weather text -> WEATHER rows (bad rows dropped, see ``rejected_weather``)."""
    return clean_weather(spark.read.text(path), tz_offset)


def parse_holidays(lines: DataFrame, category: str | None = "National holiday",
                   value_col: str = "value") -> DataFrame:
    """Lines ``dd/MM/yyyy,<x>,<y>,<category>`` -> (date, category) of one category.

    The category is compared trimmed, so a last line without a newline is kept.
    """
    f = F.split(F.col(value_col), ",", -1)
    out = lines.select(F.try_to_date(F.get(f, 0), "d/M/yyyy").alias("date"),
                       F.trim(F.get(f, 3)).alias("category"))
    out = out.where(F.col("date").isNotNull())
    if category is not None:
        out = out.where(F.col("category") == F.lit(category))
    return out


def read_holidays(spark: SparkSession, path: str, category: str | None = "National holiday") -> DataFrame:
    return parse_holidays(spark.read.text(path), category)


def read_csv_table(spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",",
                   encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """CSV with a header line and a declared schema; without one every column is text (the header
    names them, nothing is inferred)."""
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", False).csv(path)


def read_routes(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A park's route table (``;``-separated, Latin-1): counter id from the park-code column, plain
    column names, decimal-comma lengths parsed, coordinates dropped."""
    return prepare_routes(read_csv_table(spark, path, None, sep=sep, encoding=encoding))


def read_predictions(spark: SparkSession, path: str, park_id: int = 952,
                     routes: DataFrame | None = None) -> DataFrame:
    """Prediction CSV (counterId, date, visits_pred, load) -> load feed (header skipped)."""
    pred = read_csv_table(spark, path, schemas.PREDICTION)
    return to_feed(pred, park_id=park_id, routes=routes)


def route_dim(spark: SparkSession) -> DataFrame:
    """The built-in route dimension of the first park (id, name, lon, lat, attributes, flags),
    with the decimal-comma length parsed. A small, fixed table: broadcast it in joins."""
    from footfall.functions import decimal_comma, literal_table
    from footfall.functions.labels import PARKS, ROUTES
    flags = ", ".join(f"{f} INT" for f in schemas.ROUTE_FLAGS)
    ddl = (f"id LONG, name STRING, lon DOUBLE, lat DOUBLE, track_name STRING, difficulty STRING, "
           f"length_km STRING, duration_min DOUBLE, {flags}")
    df = literal_table(spark, ROUTES, ddl)
    return (df.withColumn("length_km", decimal_comma("length_km"))
            .withColumn("parkId", F.lit(PARKS[0][0]).cast("long")))


def park_dim(spark: SparkSession) -> DataFrame:
    from footfall.operators.load import park_dim as _park_dim
    return _park_dim(spark)
