import datetime as dt

from pyspark.sql import functions as F

from footfall.functions import day_part, decimal_comma
from footfall.operators import load
from footfall.operators.calendar import filter_hours


def test_day_part_and_hour_filters(spark):
    df = spark.createDataFrame([(h,) for h in [8, 9, 12, 13, 16, 17, 19, 20, 21]], "hour INT")
    parts = {r.hour: r.p for r in df.select("hour", day_part("hour").alias("p")).collect()}
    assert [parts[h] for h in [9, 12, 13, 16, 17, 20]] == [0, 0, 1, 1, 2, 2]
    assert sorted(r.hour for r in filter_hours(df, 9, 20).collect()) == [9, 12, 13, 16, 17, 19, 20]
    assert sorted(r.hour for r in filter_hours(df, 9, 19).collect()) == [9, 12, 13, 16, 17, 19]


def test_decimal_comma(spark):
    df = spark.createDataFrame([("4,6",), ("3",), ("3.0",), (None,)], "x STRING")
    assert [r.v for r in df.select(decimal_comma("x").alias("v")).collect()] == [4.6, 3.0, 3.0, None]


def test_clamp_and_load(spark):
    fc = spark.createDataFrame([(1, "d", -1.0), (1, "e", 0.0), (1, "f", None), (1, "g", 2.5)],
                               "counterId LONG, date STRING, visits_pred DOUBLE")
    assert [r.visits_pred for r in load.clamp_visits(fc).orderBy("date").collect()] == [0.0, 0.0, None, 2.5]
    pred = spark.createDataFrame([(1, "d", 10.0), (2, "d", 10.0), (3, "d", 10.0)],
                                 "counterId LONG, date STRING, visits_pred DOUBLE")
    hist = spark.createDataFrame([(1, 0), (2, 9), (2, 3)], "counterId LONG, visits LONG")
    out = {r.counterId: r.load for r in load.compute_load(pred, hist).collect()}
    assert out == {1: 10.0, 2: 1.0}


def test_park_state_classes_and_unknown(spark):
    d = dt.date(2024, 1, 1)
    loads = {1: 0.7, 2: 0.71, 3: 0.5, 4: 0.3, 5: 0.31}
    feed = spark.createDataFrame([(p, v, d) for p, v in loads.items()], "parkId LONG, load DOUBLE, date DATE")
    asked = spark.createDataFrame([(p, d) for p in [1, 2, 3, 4, 5, 6]], "parkId LONG, date DATE")
    out = {r.parkId: r for r in load.park_state(feed, asked).collect()}
    assert [out[p].state for p in range(1, 7)] == ["very busy", "extremely busy", "moderate", "almost empty",
                                                   "moderate", "unknown"]
    assert out[2].percent == 71 and "(71)" in out[2].message
    assert out[6].percent is None and "no idea" in out[6].message


def test_route_buckets(spark):
    d = dt.date(2024, 1, 1)
    feed = spark.createDataFrame([(i, 1, v, d) for i, v in enumerate([0.7, 0.71, 0.5, 0.51])],
                                 "counterId LONG, parkId LONG, load DOUBLE, date DATE")
    b = [r.bucket for r in load.with_route_bucket(feed).orderBy("counterId").collect()]
    assert b == ["busy", "avoid", "free", "busy"]
    c = load.route_bucket_counts(feed).collect()[0]
    assert (c.avoid, c.busy, c.free) == (1, 2, 1)
    assert c.message.startswith("Currently there are:\n+ 1 routes you should avoid")


def test_forecast_on_and_keep_routes(spark):
    feed = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 4)), (9, dt.date(2024, 1, 4))],
                                 "counterId LONG, date DATE")
    assert [r.counterId for r in load.forecast_on(feed, "2024-01-01", 3).orderBy("counterId").collect()] == [2, 9]
    routes = spark.createDataFrame([(1,), (2,), (2,)], "counterId LONG")
    assert sorted(r.counterId for r in load.keep_routes(feed, routes).collect()) == [1, 2]


def test_describe_routes_first_match_and_unmatched(spark):
    feed = spark.createDataFrame([(1,), (5,)], "counterId LONG")
    dim = spark.createDataFrame([(1, "b"), (1, "a")], "id LONG, name STRING")
    out = {r.counterId: r.name for r in load.describe_routes(feed, dim).collect()}
    assert out == {1: "a", 5: None}


def test_builtin_route_dimension(spark):
    from footfall.sources import route_dim
    d = {r.id: r for r in route_dim(spark).collect()}
    assert sorted(d) == [912, 922, 1043, 1050, 1225, 1246]
    assert d[1043].length_km == 4.6 and d[912].length_km is None and d[1050].parkId == 952


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

loads = st.lists(st.one_of(st.none(), st.floats(min_value=0, max_value=2, allow_nan=False)), min_size=1,
                 max_size=30)


@settings(max_examples=10, deadline=None)
@given(loads)
def test_route_buckets_partition_the_feed(spark, values):
    d = dt.date(2024, 1, 1)
    feed = spark.createDataFrame([(i, 1, v, d) for i, v in enumerate(values)],
                                 "counterId LONG, parkId LONG, load DOUBLE, date DATE")
    c = load.route_bucket_counts(feed).collect()[0]
    assert c.avoid + c.busy + c.free + c.unknown == len(values)
    assert c.unknown == sum(v is None for v in values)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.floats(-50, 500, allow_nan=False))),
                min_size=1, max_size=30),
       st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1000)), min_size=1, max_size=30))
def test_load_is_non_negative_when_visits_are(spark, preds, hist):
    fc = spark.createDataFrame([(c, "d", v) for c, v in preds], "counterId LONG, date STRING, visits_pred DOUBLE")
    h = spark.createDataFrame(hist, "counterId LONG, visits LONG")
    out = load.compute_load(load.clamp_visits(fc), h).collect()
    assert all(r.load is None or r.load >= 0 for r in out)
    assert all((r.visits_pred is None) == (r.load is None) for r in out)
    assert len(out) == sum(1 for c, _ in preds if c in {k for k, _ in hist})
