"""Adapters from the driver's tables to the inputs of this library (see FIXTURES.md).

Each adapter derives its rows from the given tables with Spark, so the work of every query grows
with them. Text inputs are built as a DataFrame with one ``value`` column, exactly what
``spark.read.text`` yields, and then go through the same parsers a file would.

The DuckDB twins of these adapters live in ``footfall.testing.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import literal_table

# --- fixed values: fixture constants -----------------------------------------------------------
TZ = "+02:00"
HOUR_ZERO = "2024-01-01 00:00:00"          # h = whole hours since this wall time
INSTALLATION_TEXT = "1/1/2015 00:00"
PARK_EVEN, PARK_ODD = 952, 34361
FILLERS = ["Espoo", "Uusimaa", "South", None, "Counter", "Manager", ""]   # None -> 'G' || event_id
HOLIDAY_LINES = [
    "01/01/2024,Mon,New Year's Day,National holiday",
    "06/01/2024,Sat,Epiphany,National holiday",
    "14/01/2024,Sun,Day of Remembrance,Observance",
    "20/01/2024,Sat,Test Day,National holiday",
    "06/01/2024,Sat,Epiphany,National holiday",
    "25/12/2023,Mon,Christmas Day,National holiday",
]
AS_OF = "2024-01-01"
ROWS_PER_FILE = 2000                       # of a folder that is written in parts
# ------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> Column:
    return c.cast("string")


def raw_reading_lines(spark: SparkSession, events: DataFrame) -> DataFrame:
    """One tab-separated counter line per event, some corrupted, plus a header line."""
    e = events.select("event_id", "user_id", "value", F.date_trunc("HOUR", F.col("ts")).alias("t"))
    start = F.date_format("t", "M/d/yyyy HH:mm")
    end = F.date_format(F.col("t") + F.expr("INTERVAL 1 HOUR"), "M/d/yyyy HH:mm")
    bad_month = F.concat(F.lit("68/"), F.date_format("t", "d/yyyy HH:mm"))
    eid = F.col("event_id")
    start = F.when(eid % 97 == 0, bad_month).otherwise(start)
    visits = F.when((eid % 97 != 0) & (eid % 89 != 0) & (eid % 83 == 0), F.lit("n/a")) \
        .otherwise(_s(F.floor("value").cast("bigint")))
    uid = F.col("user_id")
    fillers = [F.concat(F.lit("G"), _s(eid)) if f is None else F.lit(f) for f in FILLERS]
    fields = [_s(eid), _s(uid), _s(eid % 1000), start, end, visits,
              F.concat(F.lit("P"), _s(uid)), F.concat(F.lit("N"), _s(uid)), F.lit(INSTALLATION_TEXT),
              _s(F.when(uid % 2 == 0, F.lit(PARK_EVEN)).otherwise(F.lit(PARK_ODD))),
              *fillers, _s(F.lit(6680000) + uid), _s(F.lit(370000) + uid)]
    full = F.concat_ws("\t", *fields)
    short = F.concat_ws("\t", *fields[:-1])
    line = F.when((eid % 97 != 0) & (eid % 89 == 0), short).otherwise(full)
    header = literal_table(spark, [("\t".join(schemas.RAW_READING_FIELDS),)], "value STRING")
    return e.select(line.alias("value")).unionByName(header)


def _weather_hours(events: DataFrame) -> DataFrame:
    t = F.date_trunc("HOUR", F.col("ts"))
    hours = events.select(t.alias("t")).distinct()
    h = ((F.unix_timestamp("t") - F.unix_timestamp(F.lit(HOUR_ZERO).cast("timestamp_ntz"))) / 3600)
    return hours.withColumn("h", h.cast("bigint"))


def raw_weather_lines(events: DataFrame) -> DataFrame:
    """One headerless weather line per hour that has events (values are rules of ``h``)."""
    w = _weather_hours(events)
    h = F.col("h")
    temp = (h * 5) % 40 - 19.5
    measures = [
        F.when(h % 13 == 0, F.lit("")).otherwise(_s(h % 9)),
        _s(980 + h % 50), _s(40 + (h * 7) % 60), _s((h % 8) * 0.25), _s(h % 5), _s(temp), _s(temp - 2),
        F.when(h % 101 == 50, F.lit("x")).otherwise(_s(10000 + h)),
        _s((h * 15) % 360), _s(h % 10 + 0.5), _s(h % 10)]
    line = F.concat_ws(",", _s(F.year("t")), _s(F.month("t")), _s(F.dayofmonth("t")),
                       F.when(h % 7 == 3, F.date_format("t", "HH:mm:ss")).otherwise(F.date_format("t", "HH:mm")),
                       F.lit("UTC"), *measures)
    return w.select(line.alias("value"))


def holiday_lines(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(x,) for x in HOLIDAY_LINES], "value STRING")


def history_daily(lineitem: DataFrame) -> DataFrame:
    """One row per supplier (counter) and ship day: visits = total quantity."""
    g = lineitem.groupBy(F.col("l_suppkey").alias("counterId"), F.to_date("l_shipdate").alias("d")).agg(
        F.sum("l_quantity").cast("bigint").alias("visits"),
        F.sum("l_linenumber").cast("double").alias("temp"))
    return g.select(
        "counterId", (F.col("counterId") % 5).alias("parkCode"),
        F.concat(F.lit("P"), _s(F.col("counterId"))).alias("counterIdPave"),
        F.date_format("d", "yyyy-MM-dd").alias("date_day"), F.year("d").cast("bigint").alias("year"),
        "visits", "temp", (F.dayofmonth("d") == 1).alias("holiday"))


def forecast_standin(orders: DataFrame) -> DataFrame:
    """A stand-in forecast so the load tail is checkable: (counterId, date, yhat)."""
    yhat = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("double")) \
        .otherwise(F.col("o_totalprice") / 1000 - 100)
    return orders.select((F.col("o_custkey") % 25).alias("counterId"),
                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), yhat.alias("yhat"))


def forecast_with_nan(orders: DataFrame) -> DataFrame:
    """The stand-in forecast with some yhat NaN, as a numeric library leaves missing values."""
    yhat = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("double")) \
        .when(F.col("o_orderkey") % 53 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000 - 100)
    return orders.select((F.col("o_custkey") % 25).alias("counterId"),
                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), yhat.alias("yhat"))


def prediction_table(orders: DataFrame) -> DataFrame:
    """Prediction rows (counterId, date 'yyyy-MM-dd', visits_pred, load); some loads are missing."""
    k = F.col("o_orderkey")
    d = F.date_add(F.to_date(F.lit(AS_OF)), (k % 10).cast("int"))
    return orders.select((F.col("o_custkey") % 25).alias("counterId"),
                         F.date_format(d, "yyyy-MM-dd").alias("date"),
                         (F.col("o_totalprice") / 1000).alias("visits_pred"),
                         F.when(k % 53 != 0, (k % 101).cast("double") / 100).alias("load"))


def load_feed(orders: DataFrame) -> DataFrame:
    """Load feed (counterId, parkId, load, date) for the answers."""
    p = prediction_table(orders)
    park = F.when(F.col("counterId") % 2 == 0, F.lit(PARK_EVEN)).otherwise(F.lit(PARK_ODD)).cast("bigint")
    return p.select("counterId", park.alias("parkId"), "load", F.to_date("date").alias("date"))


def route_dim(nation: DataFrame) -> DataFrame:
    """Route dimension: id, name, lon, lat, region."""
    k = F.col("n_nationkey").cast("bigint")
    return nation.select(k.alias("id"), F.col("n_name").alias("name"),
                         (F.lit(24.0) + k.cast("double") / 8).alias("lon"),
                         (F.lit(60.0) + k.cast("double") / 16).alias("lat"),
                         F.col("n_regionkey").cast("bigint").alias("region"))


def _route_rows(customer: DataFrame, parity: int, with_restaurant: bool) -> DataFrame:
    k = F.col("c_custkey")
    cols = [k.alias("ASTA_Counters.NationalParkCode"),
            (F.lit(24.0) + (k % 100) / 100).alias("EPSG4326_East"),
            (F.lit(60.0) + (k % 50) / 100).alias("EPSG4326_North"),
            F.col("c_name").alias("Track_name[starts nearby]"),
            F.col("c_mktsegment").alias("Difficulty"),
            F.regexp_replace(_s(F.col("c_acctbal")), r"\.", ",").alias("Length[km]"),
            (F.col("c_nationkey") * 10).cast("double").alias("Duration[min]")]
    for i, flag in enumerate(schemas.ROUTE_FLAGS):
        if flag == "Restaurant" and not with_restaurant:
            continue
        cols.append((F.shiftright(k, i) % 2).cast("bigint").alias(flag))
    return customer.where(k % 2 == parity).select(*cols)


def routes_a(customer: DataFrame) -> DataFrame:
    return _route_rows(customer, 0, True)


def routes_b(customer: DataFrame) -> DataFrame:
    return _route_rows(customer, 1, False)


# --- fixed values: coverage document fixture -----------------------------------------------------
COVERAGE_FIELDS = ["Temperature", "WindSpeedMS"]
COVERAGE_HEAD = ('<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" '
                 'xmlns:om="http://www.opengis.net/om/2.0" '
                 'xmlns:omso="http://inspire.ec.europa.eu/schemas/omso/3.0" '
                 'xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:gmlcov="http://www.opengis.net/gmlcov/1.0" '
                 'xmlns:swe="http://www.opengis.net/swe/2.0">\n')
COVERAGE_MEMBER = ('<wfs:member><omso:GridSeriesObservation><om:result><gmlcov:MultiPointCoverage>\n'
                 '<gml:domainSet><gmlcov:SimpleMultiPoint><gmlcov:positions>\n')
COVERAGE_MID = ('\n</gmlcov:positions></gmlcov:SimpleMultiPoint></gml:domainSet>\n'
                '<gml:rangeSet><gml:DataBlock><gml:doubleOrNilReasonTupleList>\n')
COVERAGE_TAIL = ('\n</gml:doubleOrNilReasonTupleList></gml:DataBlock></gml:rangeSet>\n'
                 '<gmlcov:rangeType><swe:DataRecord>'
                 + "".join(f'<swe:field name="{n}"/>' for n in COVERAGE_FIELDS)
                 + '</swe:DataRecord></gmlcov:rangeType>\n'
                 '</gmlcov:MultiPointCoverage></om:result></omso:GridSeriesObservation></wfs:member>\n')
COVERAGE_END = '</wfs:FeatureCollection>\n'
# ---------------------------------------------------------------------------------------------------


def coverage_docs(events: DataFrame) -> DataFrame:
    """One coverage document per (user, day) with a member each for its even and odd event ids: a
    position (user, event, epoch) and a value tuple (value, event % 7) per event in event order; odd
    users lose the last value tuple of each member. A document is bounded by a user's day."""
    e = events.select(
        "user_id", "event_id", F.to_date("ts").alias("day"), (F.col("event_id") % 2).alias("odd"),
        F.concat_ws(" ", _s(F.col("user_id")), _s(F.col("event_id")), _s(F.unix_timestamp("ts"))).alias("pos"),
        F.concat_ws(" ", _s(F.col("value")), _s(F.col("event_id") % 7)).alias("val"))
    g = e.groupBy("user_id", "day", "odd").agg(F.array_sort(F.collect_list(F.struct("event_id", "pos", "val"))).alias("it"))
    pos = F.transform("it", lambda r: r["pos"])
    val = F.transform("it", lambda r: r["val"])
    val = F.when(F.col("user_id") % 2 == 1, F.slice(val, 1, F.size("it") - 1)).otherwise(val)
    member = F.concat(F.lit(COVERAGE_MEMBER), F.array_join(pos, "\n"), F.lit(COVERAGE_MID),
                      F.array_join(val, "\n"), F.lit(COVERAGE_TAIL))
    docs = g.select("user_id", "day", "odd", member.alias("xml")).groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("odd", "xml"))).alias("members"))   # two at most
    xml = F.concat(F.lit(COVERAGE_HEAD), F.array_join(F.transform("members", lambda m: m["xml"]), ""), F.lit(COVERAGE_END))
    return docs.select(F.concat_ws("-", _s(F.col("user_id")), F.date_format("day", "yyyyMMdd")).alias("doc"), xml.alias("xml"))
