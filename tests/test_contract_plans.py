import os
import tempfile
import time

from footfall.testing import fixtures as fx

from driver_tables import SF_SMALL


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"counterId", "date", "visits_pred", "load"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    rows_only = {n for n in set(qs) - set(sql) if not n.startswith("op") and n != "pipeline"}
    assert rows_only <= {"fit_forecast", "backcast", "evaluate_holdout", "daily_prediction",
                         "day_part_prediction", "day_part_prediction_pooled", "fit_visits_gbt",
                         "feature_importance", "gbt_future_prediction", "keyed_gbt_prediction"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_the_forecast(spark):
    import __spark_entry__ as E
    for name in ["daily_load", "day_part_rollup", "park_state", "parse_coverage", "stack_routes"]:
        p = _plan(E.queries()[name](spark, SF_SMALL))
        assert "Python" not in p and "ArrowEval" not in p, name
    p = _plan(E.queries()["fit_forecast"](spark, SF_SMALL))
    assert "FlatMapGroupsInPandas" in p or "FlatMapCoGroupsInPandas" in p


def test_scan_prunes_columns(spark):
    import __spark_entry__ as E
    p = E.queries()["compute_load"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in p and "o_orderstatus" not in p


def test_streaming_ingest_matches_batch(spark):
    from footfall.operators.clean import clean_weather
    from footfall.plans.history import enriched_history
    from footfall.sources import parse_holidays
    from footfall.streaming import start_ingest
    d = tempfile.mkdtemp(prefix="footfall-stream-")
    ev = fx.table(spark, SF_SMALL, "events")
    lines = fx.raw_reading_lines(spark, ev)
    lines.write.text(f"{d}/in")
    weather = clean_weather(fx.raw_weather_lines(ev))
    holidays = parse_holidays(fx.holiday_lines(spark))
    qs = start_ingest(spark, f"{d}/in", weather, holidays, f"{d}/out", f"{d}/ckpt", f"{d}/rej")
    for q in qs:
        q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/out")
    batch = enriched_history(lines, fx.raw_weather_lines(ev), fx.holiday_lines(spark), fx.TZ)
    assert out.count() == batch.count()
    assert out.exceptAll(batch.select(*out.columns)).count() == 0
    assert spark.read.parquet(f"{d}/rej").count() > 0


def test_key_filter_reaches_the_scan(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["for_counter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,7)]" in p


def test_rollups_aggregate_before_the_shuffle(spark):
    """A counter holding most readings is combined map-side: partial aggregate below the exchange."""
    import __spark_entry__ as E
    for name in ["daily_rollup", "day_part_rollup", "route_bucket_counts", "park_state"]:
        p = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in p, name


def test_streaming_ingest_resumes_from_its_checkpoint(spark):
    """A second run over the same folder only picks up the files that arrived since the first."""
    from pyspark.sql import functions as F
    from footfall.operators.clean import clean_weather
    from footfall.sources import parse_holidays
    from footfall.streaming import start_ingest
    d = tempfile.mkdtemp(prefix="footfall-resume-")
    ev = fx.table(spark, SF_SMALL, "events")
    lines = fx.raw_reading_lines(spark, ev)
    weather = clean_weather(fx.raw_weather_lines(ev))
    holidays = parse_holidays(fx.holiday_lines(spark))
    lines.where(F.col("value").startswith("1")).write.text(f"{d}/in/a")
    for q in start_ingest(spark, f"{d}/in/*", weather, holidays, f"{d}/out", f"{d}/ckpt"):
        q.awaitTermination(120)
    first = spark.read.parquet(f"{d}/out").count()
    lines.where(~F.col("value").startswith("1")).write.text(f"{d}/in/b")
    for q in start_ingest(spark, f"{d}/in/*", weather, holidays, f"{d}/out", f"{d}/ckpt"):
        q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/out")
    assert 0 < first < out.count()
    assert out.count() == out.dropDuplicates(["measurmentId"]).count()     # nothing ingested twice
