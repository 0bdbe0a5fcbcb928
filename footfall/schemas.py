"""Explicit table schemas (no inference pass anywhere in the library)."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DateType, DoubleType, LongType, StringType, StructField,
                               StructType)

# --- fixed values: column contracts of the counter-reading data -------------------------------
# Field names of one raw counter-reading line, in file order (19 tab-separated fields).
RAW_READING_FIELDS = [
    "CounterReadingID", "CounterID_ASTA", "SequenceNumber", "StartTime", "EndTime", "Visits",
    "ASTA_Counters.CounterID_PAVE", "ASTA_Counters.Name_ASTA", "ASTA_Counters.InstallationDate",
    "ASTA_Counters.NationalParkCode", "ASTA_Counters.Municipality", "ASTA_Counters.RegionalUnit",
    "ASTA_Counters.RegionalEntity", "PAVE_Counters.Globalid", "PAVE_Counters.Name", "PAVE_Counters.Manager",
    "PAVE_Counters.AdditionalInfo", "PAVE_Counters.CoordinateNorth", "PAVE_Counters.CoordinateEast",
]
# Hourly weather measures, in file order after the four time fields and one skipped field.
WEATHER_MEASURES = ["cloud", "pressure", "humidity", "percip", "show_depth", "temp", "dewpoint", "visib",
                    "wind_dir", "gust_speed", "wind_speed"]
# Amenity flags of a route, in file order.
ROUTE_FLAGS = ["Fireplace", "Shelter", "Toilet", "InfoHut", "DrinkingWater", "Recycling", "Parking",
               "Restaurant", "BusStop"]
# Route attribute names as they appear in the route CSV files, and the names we use inside.
ROUTE_CSV_NAMES = {"Track_name[starts nearby]": "track_name", "Difficulty": "difficulty",
                   "Length[km]": "length_km", "Duration[min]": "duration_min"}
# -----------------------------------------------------------------------------------------------

N_RAW_READING_FIELDS = len(RAW_READING_FIELDS)

READING = StructType([
    StructField("measurmentId", LongType()),
    StructField("counterId", LongType()),
    StructField("seqNumber", LongType()),
    StructField("startDate", DoubleType()),      # epoch seconds of the hour start
    StructField("endDate", DoubleType()),
    StructField("visits", LongType()),
    StructField("counterIdPave", StringType()),
    StructField("installationDate", DoubleType()),
    StructField("parkCode", LongType()),
    StructField("cordNorth", LongType()),
    StructField("coordSouth", LongType()),       # holds the East coordinate; name kept as in the data
])

WEATHER = StructType([StructField("startDate", DoubleType())]
                     + [StructField(m, DoubleType()) for m in WEATHER_MEASURES])

# weather columns first, then the reading columns without the shared startDate
ENRICHED = StructType(list(WEATHER.fields) + [f for f in READING.fields if f.name != "startDate"])
ENRICHED_HOLIDAY = StructType(list(ENRICHED.fields) + [StructField("holiday", BooleanType())])

HOLIDAY = StructType([StructField("date", DateType()), StructField("category", StringType())])

ROUTE = StructType(
    [StructField("track_name", StringType()), StructField("difficulty", StringType()),
     StructField("length_km", DoubleType()), StructField("duration_min", DoubleType())]
    + [StructField(f, LongType()) for f in ROUTE_FLAGS]
    + [StructField("counterId", LongType())])

PREDICTION = StructType([
    StructField("counterId", LongType()),
    StructField("date", StringType()),
    StructField("visits_pred", DoubleType()),
    StructField("load", DoubleType()),
])

FUTURE_TEMP = StructType([StructField("counterId", LongType()), StructField("date", StringType()),
                          StructField("temp", LongType())])

# day-part roll-up measures (mean) and daily roll-up measures (mean)
DAY_PART_MEANS = WEATHER_MEASURES + ["coordSouth"]
DAILY_MEANS = WEATHER_MEASURES + ["cordNorth", "coordSouth", "year", "month", "day"]


def with_field(schema: StructType, name: str, dtype, nullable: bool = True) -> StructType:
    """A copy of ``schema`` extended by one column."""
    return StructType(list(schema.fields) + [StructField(name, dtype, nullable)])


# raw route table: every field as text, in file order
RAW_ROUTE = StructType([StructField(c, StringType()) for c in
                        ["ASTA_Counters.NationalParkCode", "EPSG4326_East", "EPSG4326_North", *ROUTE_CSV_NAMES, *ROUTE_FLAGS]])
