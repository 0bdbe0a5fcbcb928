import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from footfall.functions import offset_seconds
from footfall.operators.enrich import mark_holidays, stack_routes, normalize_routes
from footfall.sources import parse_holidays

EPOCH = dt.datetime(1970, 1, 1)


def local_epoch(y, mo, d, h=0, mi=0, s=0, tz="+02:00"):
    return (dt.datetime(y, mo, d, h, mi, s) - EPOCH).total_seconds() - offset_seconds(tz)


def hol(spark, *dates):
    return spark.createDataFrame([(dt.date.fromisoformat(d), "National holiday") for d in dates],
                                 "date DATE, category STRING")


def test_holiday_boundaries(spark):
    starts = [local_epoch(2019, 12, 6), local_epoch(2019, 12, 6, 0, 0, 1), local_epoch(2019, 12, 6, 23, 59, 59),
              local_epoch(2019, 12, 7)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "i INT, startDate DOUBLE")
    flags = [r.holiday for r in mark_holidays(df, hol(spark, "2019-12-06")).orderBy("i").collect()]
    assert flags == [False, True, True, False]
    flags = [r.holiday for r in mark_holidays(df, hol(spark, "2019-12-06"), inclusive_start=True).orderBy("i").collect()]
    assert flags == [True, True, True, False]


def test_holiday_plan_is_hash_join_not_nested_loop(spark):
    df = spark.createDataFrame([(1.0,)], "startDate DOUBLE")
    plan = mark_holidays(df, hol(spark, "2019-12-06"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=60 * 48), min_size=1, max_size=40))
def test_holiday_flag_keeps_row_count(spark, minutes):
    base = local_epoch(2024, 1, 5, 12)
    df = spark.createDataFrame([(base + 60 * m,) for m in minutes], "startDate DOUBLE")
    out = mark_holidays(df, hol(spark, "2024-01-06", "2024-01-06", "2024-01-05"))
    assert out.count() == len(minutes)


def test_parse_holidays_keeps_last_line_without_newline(spark):
    lines = spark.createDataFrame([("06/12/2019,x,y,National holiday",), ("24/12/2019,x,y,Observance",),
                                   ("31/12/2019,x,y,National holiday",)], "value STRING")
    out = sorted(str(r.date) for r in parse_holidays(lines).collect())
    assert out == ["2019-12-06", "2019-12-31"]


def test_stack_routes_and_decimal_comma(spark):
    a = spark.createDataFrame([(1, "4,6", 1)], "counterId INT, `Length[km]` STRING, Restaurant INT")
    b = spark.createDataFrame([(2, "3")], "counterId INT, `Length[km]` STRING")
    out = {r.counterId: r for r in normalize_routes(stack_routes(a, b)).collect()}
    assert out[1].length_km == 4.6 and out[2].length_km == 3.0
    assert out[2].Restaurant is None
