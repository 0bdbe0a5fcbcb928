import os
import tempfile

from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators.coverage import parse_coverage, read_coverage
from footfall.sources import (read_csv_table, read_holidays, read_json_lines, read_predictions, read_raw_readings,
                              read_readings, read_routes, read_weather)
from footfall.sources.sinks import write_csv_table, write_json_lines, write_partitioned
from footfall.testing import fixtures as fx

from driver_tables import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="footfall-test-")


def test_text_sources_round_trip(spark):
    d = _tmp()
    ev = fx.table(spark, SF_SMALL, "events")
    fx.raw_reading_lines(spark, ev).write.text(f"{d}/readings")
    fx.raw_weather_lines(ev).write.text(f"{d}/weather")
    with open(f"{d}/holidays.csv", "w") as fh:
        fh.write("\n".join(fx.HOLIDAY_LINES))          # no newline after the last line
    readings = read_readings(spark, f"{d}/readings")
    assert read_raw_readings(spark, f"{d}/readings").count() == ev.count() + 1
    assert readings.count() == ev.where((F.col("event_id") % 97 != 0) & (F.col("event_id") % 89 != 0)
                                        & (F.col("event_id") % 83 != 0)).count()
    assert read_weather(spark, f"{d}/weather").count() > 0
    assert sorted(str(r.date) for r in read_holidays(spark, f"{d}/holidays.csv").distinct().collect()) == \
        ["2023-12-25", "2024-01-01", "2024-01-06", "2024-01-20"]
    # JSON lines round trip (the cleaning stage's sink)
    write_json_lines(readings, f"{d}/json")
    back = read_json_lines(spark, f"{d}/json", schemas.READING)
    assert back.columns == schemas.READING.names
    assert back.exceptAll(readings).count() == 0 and readings.exceptAll(back).count() == 0


def test_csv_round_trips_and_partitioned_sink(spark):
    d = _tmp()
    pred = fx.prediction_table(fx.table(spark, SF_SMALL, "orders"))
    write_csv_table(pred, f"{d}/pred")
    back = read_csv_table(spark, f"{d}/pred", schemas.PREDICTION)
    assert back.exceptAll(pred).count() == 0 and pred.count() == back.count()
    feed = read_predictions(spark, f"{d}/pred", park_id=952)
    assert feed.count() == pred.count() and feed.where(F.col("parkId") != 952).count() == 0
    write_partitioned(pred.withColumn("weekday", F.dayofweek(F.to_date("date"))), f"{d}/parts",
                      ["counterId", "weekday"])
    one = spark.read.parquet(f"{d}/parts").where((F.col("counterId") == 3) & (F.col("weekday") == 2))
    assert one.count() == pred.where((F.col("counterId") == 3)
                                     & (F.dayofweek(F.to_date("date")) == 2)).count()
    assert os.path.isdir(f"{d}/parts/counterId=3")


def test_route_files_semicolon_latin1(spark):
    d = _tmp()
    os.makedirs(f"{d}/routes")
    with open(f"{d}/routes/a.csv", "w", encoding="latin-1") as fh:
        fh.write("ASTA_Counters.NationalParkCode;EPSG4326_East;EPSG4326_North;Track_name[starts nearby];"
                 "Difficulty;Length[km];Duration[min];Parking\n")
        fh.write("1043;24.5;60.3;Haukkalampi-Solvalla käyntireitti;Extreme;4,6;120;1\n")
        fh.write("1225;24.4;60.2;Other short track;;3;;0\n")
    out = {r.counterId: r for r in read_routes(spark, f"{d}/routes/a.csv").collect()}
    assert out[1043].length_km == 4.6 and out[1225].length_km == 3.0
    assert out[1043].track_name.startswith("Haukkalampi-Solvalla kä")
    assert "EPSG4326_East" not in read_routes(spark, f"{d}/routes/a.csv").columns


def test_coverage_three_positions_two_tuples(spark):
    xml = (fx.COVERAGE_HEAD + fx.COVERAGE_MEMBER + "1 2 1573900000\n1 2 1573986400\n1 2 1574072800" + fx.COVERAGE_MID
           + "3.5 NaN\n4.0 2.0" + fx.COVERAGE_TAIL + fx.COVERAGE_MEMBER + "7 8 1573900000" + fx.COVERAGE_MID
           + "1.0 1.5" + fx.COVERAGE_TAIL + fx.COVERAGE_END)
    docs = spark.createDataFrame([("d", xml)], "doc STRING, xml STRING")
    out = parse_coverage(docs, fx.COVERAGE_FIELDS, keep=["doc"]).orderBy("member", "point").collect()
    assert [(r.member, r.point, r.x) for r in out] == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 7.0)]
    assert out[0].time == "2019-11-16 10:26:40" and out[0].Temperature == 3.5
    assert out[0].WindSpeedMS != out[0].WindSpeedMS   # NaN kept
    d = _tmp()
    with open(f"{d}/f.xml", "w") as fh:
        fh.write(xml)
    assert sorted((r.member, r.point, r.x) for r in read_coverage(spark, d, fx.COVERAGE_FIELDS).collect()) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 7.0)]


def test_weekday_profiles_one_folder_per_key_and_weekday(spark):
    from footfall.plans.history import hourly_history, write_weekday_profiles
    d = _tmp()
    ev = fx.table(spark, SF_SMALL, "events")
    hourly = hourly_history(fx.raw_reading_lines(spark, ev), fx.raw_weather_lines(ev), fx.holiday_lines(spark))
    write_weekday_profiles(hourly, f"{d}/prof", "parkCode")
    one = spark.read.parquet(f"{d}/prof").where((F.col("parkCode") == 952) & (F.col("weekday") == 0))
    bins = [r.hour2d for r in one.collect()]
    assert bins and all(b % 2 == 0 for b in bins) and len(bins) == len(set(bins))
    assert os.path.isdir(f"{d}/prof/parkCode=952/weekday=0")


def test_route_table_round_trip_restores_external_names(spark):
    from footfall import schemas
    from footfall.operators.enrich import prepare_routes, stack_routes
    d = _tmp()
    c = fx.table(spark, SF_SMALL, "customer")
    routes = prepare_routes(stack_routes(fx.routes_a(c), fx.routes_b(c)))
    external = {v: k for k, v in schemas.ROUTE_CSV_NAMES.items()}
    write_csv_table(routes, f"{d}/routes", header_names=external)
    raw = read_csv_table(spark, f"{d}/routes")                  # header names, inferred types
    assert "Length[km]" in raw.columns and "length_km" not in raw.columns
    back = prepare_routes(raw)
    assert back.count() == routes.count()
    assert back.select("counterId", "length_km").exceptAll(routes.select("counterId", "length_km")).count() == 0
