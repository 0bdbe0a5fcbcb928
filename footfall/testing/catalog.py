"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the adapters in ``fixtures`` and runs over whole
tables. Output columns are BIGINT, DOUBLE, VARCHAR or BOOLEAN so that the DuckDB twins in
``oracle`` compare value for value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from footfall import schemas, sources
from footfall.functions import literal_table
from footfall.operators import clean, enrich, load, places, profiles
from footfall.plans import history
from footfall.session import save_once, work_folder
from footfall.testing import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ints_to_bigint(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, IntegerType)
                       else F.col(f.name) for f in df.schema.fields])


# ---- shared inputs -------------------------------------------------------------------------------

def _events(spark, sf_dir):
    return fx.table(spark, sf_dir, "events")


def _reading_lines(spark, sf_dir):
    return fx.raw_reading_lines(spark, _events(spark, sf_dir))


def _weather_lines(spark, sf_dir):
    return fx.raw_weather_lines(_events(spark, sf_dir))


def _hourly(spark, sf_dir):
    return history.hourly_history(_reading_lines(spark, sf_dir), _weather_lines(spark, sf_dir),
                                  fx.holiday_lines(spark), fx.TZ)


def _saved_hourly(spark, sf_dir):
    """The hourly table written once, where two roll-ups read it."""
    return save_once(_hourly(spark, sf_dir), "hourly")


def _daily(spark, sf_dir):
    return profiles.daily_rollup(_hourly(spark, sf_dir))


def _history_daily(spark, sf_dir):
    return fx.history_daily(fx.table(spark, sf_dir, "lineitem"))


def _feed(spark, sf_dir):
    return fx.load_feed(fx.table(spark, sf_dir, "orders"))


# ---- step 1: clean -> weather -> holidays -> daily -> load -----------------------------------------

@query
def clean_readings(spark, sf_dir):
    return clean.clean_readings(_reading_lines(spark, sf_dir), fx.TZ)


@query
def rejected_readings(spark, sf_dir):
    return clean.rejected_readings(_reading_lines(spark, sf_dir), fx.TZ)


@query
def clean_weather(spark, sf_dir):
    return clean.clean_weather(_weather_lines(spark, sf_dir), fx.TZ)


@query
def rejected_weather(spark, sf_dir):
    return clean.rejected_weather(_weather_lines(spark, sf_dir), fx.TZ)


@query
def json_round_trip(spark, sf_dir):
    """Readings encoded as JSON records and decoded with the declared schema (the hand-off format
    between the cleaning and the enrichment stage)."""
    readings = clean.clean_readings(_reading_lines(spark, sf_dir), fx.TZ)
    enc = readings.select(F.to_json(F.struct(*readings.columns)).alias("json"))
    return enc.select(F.from_json("json", schemas.READING).alias("r")).select("r.*")


@query
def join_weather(spark, sf_dir):
    readings = clean.clean_readings(_reading_lines(spark, sf_dir), fx.TZ)
    weather = clean.clean_weather(_weather_lines(spark, sf_dir), fx.TZ)
    return enrich.join_weather(weather, readings)


@query
def mark_holidays(spark, sf_dir):
    return history.enriched_history(_reading_lines(spark, sf_dir), _weather_lines(spark, sf_dir),
                                    fx.holiday_lines(spark), fx.TZ)


@query
def daily_rollup(spark, sf_dir):
    return _daily(spark, sf_dir)


@query
def daily_load(spark, sf_dir):
    """Flagship: observed daily visits per counter as a share of its best day (+1)."""
    return load.observed_load(_daily(spark, sf_dir))


# ---- step 2: roll-ups and profiles ---------------------------------------------------------------

@query
def add_calendar(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return _ints_to_bigint(h.select("measurmentId", "counterId", "startDate", "year", "month", "day", "hour",
                                    "weekday", "hour2d", "date_day", "ds"))


@query
def day_part_rollup(spark, sf_dir):
    return _ints_to_bigint(profiles.day_part_rollup(_hourly(spark, sf_dir)))


@query
def hourly_profile(spark, sf_dir):
    return _ints_to_bigint(profiles.hourly_profile(_hourly(spark, sf_dir)))


@query
def weekday_profile_park(spark, sf_dir):
    return _ints_to_bigint(profiles.weekday_profile(_hourly(spark, sf_dir), "parkCode"))


@query
def weekday_profile_counter(spark, sf_dir):
    return _ints_to_bigint(profiles.weekday_profile(_hourly(spark, sf_dir), "counterId"))


@query
def distinct_keys(spark, sf_dir):
    return profiles.distinct_keys(_hourly(spark, sf_dir), ["parkCode", "counterId"])


@query
def row_counts(spark, sf_dir):
    return profiles.row_counts(clean.clean_weather(_weather_lines(spark, sf_dir), fx.TZ), "cloud")


@query
def drop_incomplete(spark, sf_dir):
    h = history.enriched_history(_reading_lines(spark, sf_dir), _weather_lines(spark, sf_dir),
                                 fx.holiday_lines(spark), fx.TZ)
    return clean.drop_incomplete(h, ["cloud", "visits"])


@query
def for_counter(spark, sf_dir):
    """Key equality is the operator: the daily history of one counter."""
    return profiles.for_counter(_history_daily(spark, sf_dir), 7)


@query
def preview(spark, sf_dir):
    """Top 20 hours by visits (ties broken by reading id): a top-k, the limit is the feature."""
    h = clean.clean_readings(_reading_lines(spark, sf_dir), fx.TZ)
    return profiles.preview(h.select("measurmentId", "counterId", "startDate", "visits"),
                            ["visits", "measurmentId"], n=20, descending=True)


@query
def profile_for_date(spark, sf_dir):
    """Each (route, date) of the load feed -> that route's weekday profile for the date's weekday."""
    prof = profiles.weekday_profile(_hourly(spark, sf_dir), "counterId")
    req = _feed(spark, sf_dir).select("counterId", "date").distinct()
    out = profiles.profile_for_date(req, prof, "counterId", "date")
    return _ints_to_bigint(out.withColumn("date", F.date_format("date", "yyyy-MM-dd")))


# ---- step 3: load answers --------------------------------------------------------------------------

def _date_str(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd"))


def _park_routes(spark, sf_dir):
    """Route dimension of one park: the nations of regions 0 and 1."""
    return fx.route_dim(fx.table(spark, sf_dir, "nation")).where(F.col("region") <= 1)


@query
def clamp_visits(spark, sf_dir):
    fc = fx.forecast_standin(fx.table(spark, sf_dir, "orders")).withColumnRenamed("yhat", "visits_pred")
    return load.clamp_visits(fc)


@query
def historic_max(spark, sf_dir):
    return profiles.historic_max(_history_daily(spark, sf_dir))


@query
def compute_load(spark, sf_dir):
    fc = fx.forecast_standin(fx.table(spark, sf_dir, "orders")).withColumnRenamed("yhat", "visits_pred")
    return load.compute_load(load.clamp_visits(fc), _history_daily(spark, sf_dir))


@query
def prediction_feed(spark, sf_dir):
    pred = fx.prediction_table(fx.table(spark, sf_dir, "orders"))
    routes = _park_routes(spark, sf_dir).select(F.col("id").alias("counterId"))
    return _date_str(load.to_feed(pred, park_id=fx.PARK_EVEN, routes=routes))


@query
def keep_routes(spark, sf_dir):
    routes = _park_routes(spark, sf_dir).select(F.col("id").alias("counterId"))
    return _date_str(load.keep_routes(_feed(spark, sf_dir), routes))


@query
def forecast_on(spark, sf_dir):
    return _date_str(load.forecast_on(_feed(spark, sf_dir), fx.AS_OF, 3))


@query
def route_bucket_counts(spark, sf_dir):
    return _date_str(load.route_bucket_counts(_feed(spark, sf_dir)))


@query
def park_state(spark, sf_dir):
    asked = load.asked_days(load.park_dim(spark), fx.AS_OF, 10)
    return _date_str(load.park_state(_feed(spark, sf_dir), asked))


@query
def describe_routes(spark, sf_dir):
    return _date_str(load.describe_routes(_feed(spark, sf_dir), _repeated_dim(spark, sf_dir)))


def _repeated_dim(spark, sf_dir):
    """The route dimension with every id twice, so that the choice of one row matters."""
    dim = fx.route_dim(fx.table(spark, sf_dir, "nation"))
    return dim.unionByName(dim.withColumn("name", F.concat(F.lit("~"), F.col("name"))))


@query
def routes_in_bucket(spark, sf_dir):
    """The routes to avoid, with their names, per park and date."""
    return _date_str(load.routes_in_bucket(_feed(spark, sf_dir), _repeated_dim(spark, sf_dir), "avoid"))


@query
def built_in_routes_feed(spark, sf_dir):
    """Feed of the built-in route dimension's counters, restricted by it and described from it."""
    from footfall.functions.labels import ROUTES
    dim = sources.route_dim(spark)
    ids = F.array(*[F.lit(r[0]) for r in ROUTES])
    pred = fx.prediction_table(fx.table(spark, sf_dir, "orders"))
    pred = pred.withColumn("counterId", F.get(ids, (F.col("counterId") % (len(ROUTES) + 1)).cast("int")).cast("bigint"))
    feed = load.to_feed(pred.where(F.col("counterId").isNotNull()), routes=dim.select(F.col("id").alias("counterId"), "parkId"))
    return _date_str(load.describe_routes(feed, dim.select("id", "name", "difficulty", "length_km", "duration_min")))


# ---- step 4: series windows, future frames, routes ---------------------------------------------------

from footfall.operators import series  # noqa: E402


@query
def latest_per_counter(spark, sf_dir):
    h = _history_daily(spark, sf_dir)
    return series.latest_per_counter(h.unionByName(h.withColumn("visits", F.col("visits") + 1)))   # every date ties


@query
def last_n_per_counter(spark, sf_dir):
    return series.last_n_per_counter(_history_daily(spark, sf_dir), n=200)


@query
def ordered_split(spark, sf_dir):
    return series.ordered_split(_history_daily(spark, sf_dir), n=400)


@query
def to_series(spark, sf_dir):
    return series.to_series(_history_daily(spark, sf_dir))


@query
def future_days(spark, sf_dir):
    return series.future_days(series.to_series(_history_daily(spark, sf_dir)), 10, include_history=False)


@query
def split_horizon(spark, sf_dir):
    s = series.to_series(_history_daily(spark, sf_dir))
    return series.split_horizon(series.future_days(s, 10, include_history=True), s)


@query
def future_day_parts(spark, sf_dir):
    counters = profiles.distinct_keys(_history_daily(spark, sf_dir), "counterId")
    return series.future_day_parts(counters, "2024-02-01", 10)


def _routes(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return enrich.prepare_routes(enrich.stack_routes(fx.routes_a(c), fx.routes_b(c)))


@query
def future_covariates(spark, sf_dir):
    return series.future_covariates(_routes(spark, sf_dir).select("counterId"))


@query
def stack_routes(spark, sf_dir):
    return _routes(spark, sf_dir)


@query
def attach_routes(spark, sf_dir):
    return enrich.attach_routes(_daily(spark, sf_dir), _routes(spark, sf_dir))


# ---- step 5: forecasts (rows-only: the model has no SQL twin) and the error report ---------------------

from footfall.operators import forecast as fcst  # noqa: E402
from footfall.plans import predictions  # noqa: E402


@query
def fit_forecast(spark, sf_dir):
    s = series.to_series(_history_daily(spark, sf_dir))
    return fcst.fit_forecast(s, horizon=10, unique=True)


@query
def backcast(spark, sf_dir):
    s = series.to_series(_history_daily(spark, sf_dir))
    return fcst.backcast(s, fcst.fit_forecast(s, horizon=0, include_history=True))


@query
def evaluate_holdout(spark, sf_dir):
    return fcst.evaluate_holdout(series.to_series(_history_daily(spark, sf_dir)), 400)


@query
def daily_prediction(spark, sf_dir):
    return predictions.daily_prediction(_history_daily(spark, sf_dir))


@query
def day_part_prediction(spark, sf_dir):
    hourly = _saved_hourly(spark, sf_dir)
    return predictions.day_part_prediction(hourly, profiles.daily_rollup(hourly), "2024-02-01")


@query
def day_part_prediction_pooled(spark, sf_dir):
    hourly = _saved_hourly(spark, sf_dir)
    return predictions.day_part_prediction(hourly, profiles.daily_rollup(hourly), "2024-02-01", pooled=True)


@query
def forecast_error(spark, sf_dir):
    """Error report on the stand-in forecast against the daily history (per counter)."""
    hist = _history_daily(spark, sf_dir).select("counterId", F.col("date_day").alias("date"),
                                                F.col("visits").alias("y"))
    fc = fx.forecast_with_nan(fx.table(spark, sf_dir, "orders"))
    return fcst.forecast_error(hist.join(fc, on=["counterId", "date"], how="inner"), "y", "yhat", "counterId")


# ---- step 6: features and boosted trees (rows-only for the model outputs) ------------------------------

from footfall.operators import regress  # noqa: E402


def _daily_with_routes(spark, sf_dir):
    return enrich.attach_routes(_daily(spark, sf_dir), _routes(spark, sf_dir))


@query
def feature_table(spark, sf_dir):
    return _ints_to_bigint(regress.feature_table(_daily_with_routes(spark, sf_dir)))


def _gbt_inputs(spark, sf_dir):
    """Daily features with the forecast as one of them, split per counter in time order; the forecast
    is fit on the training part. One saved table feeds training and validation."""
    daily = save_once(_daily_with_routes(spark, sf_dir), "daily")
    feats = save_once(predictions.split_features(daily, 14), "features")
    names = regress.feature_names(feats, "visits", exclude=["counterId"])
    train = feats.where(F.col("part") == "train").drop("part")
    valid = feats.where(F.col("part") == "test").drop("part")
    return train, valid, names


@query
def fit_visits_gbt(spark, sf_dir):
    train, valid, names = _gbt_inputs(spark, sf_dir)
    model = regress.fit_visits_gbt(train, names, "visits", valid=None, max_iter=7, step_size=0.05,
                                   max_depth=4, key_feature="counterId")
    return regress.predict_visits(model, valid).select("counterId", "date_day", "visits", "visits_pred")


@query
def feature_importance(spark, sf_dir):
    train, valid, names = _gbt_inputs(spark, sf_dir)
    model = regress.fit_visits_gbt(train, names, "visits", valid=valid, max_iter=20, step_size=0.05,
                                   max_depth=5)
    return regress.feature_importance(spark, model, names)


@query
def gbt_future_prediction(spark, sf_dir):
    """Boosted trees for the ten days after each counter's last day, with the temperature outlook."""
    daily = save_once(_daily_with_routes(spark, sf_dir), "daily")
    outlook = predictions.outlook_by_offset(series.future_covariates(profiles.distinct_keys(daily)))
    holidays = sources.parse_holidays(fx.holiday_lines(spark))
    return predictions.gbt_future_prediction(daily, outlook, holidays, max_iter=7, max_depth=4)


# ---- step 6b: model queries whose values SQL can state --------------------------------------------------

TREND = fcst.ModelConfig(n_changepoints=0, yearly=False, weekly=False, daily=False, trend_prior=1e6)


@query
def trend_forecast(spark, sf_dir):
    """A straight line per counter (no changepoints, no seasons, wide priors), ten days on."""
    fc = fcst.fit_forecast(series.to_series(_history_daily(spark, sf_dir)), horizon=10, config=TREND, unique=True)
    return fc.select("counterId", "ds", F.round("yhat", 2).alias("yhat"))


@query
def trend_backcast(spark, sf_dir):
    s = series.to_series(_history_daily(spark, sf_dir))
    fc = fcst.fit_forecast(s, horizon=0, include_history=True, config=TREND)
    return fcst.backcast(s, fc).select("counterId", "ds", "y", F.round("yhat", 2).alias("yhat"))


@query
def trend_holdout(spark, sf_dir):
    e = fcst.evaluate_holdout(series.to_series(_history_daily(spark, sf_dir)), 400, config=TREND)
    return e.select("counterId", "n", F.round("y_mean", 4).alias("y_mean"), F.round("mse", 2).alias("mse"), F.round("rmse", 3).alias("rmse"))


def _rounded_load(df):
    return df.select("counterId", "date", F.round("visits_pred", 2).alias("visits_pred"), F.round("load", 5).alias("load"))


@query
def trend_daily_prediction(spark, sf_dir):
    return _rounded_load(predictions.daily_prediction(_history_daily(spark, sf_dir), config=TREND))


@query
def trend_day_part_prediction(spark, sf_dir):
    hourly = _saved_hourly(spark, sf_dir)
    return _rounded_load(predictions.day_part_prediction(hourly, profiles.daily_rollup(hourly), "2024-02-01", config=TREND))


@query
def trend_day_part_prediction_pooled(spark, sf_dir):
    hourly = _saved_hourly(spark, sf_dir)
    return _rounded_load(predictions.day_part_prediction(hourly, profiles.daily_rollup(hourly), "2024-02-01", config=TREND, pooled=True))


def _stump(spark, sf_dir):
    """One boosting step of depth 1 on the holiday flag: the two group means."""
    feats = save_once(regress.feature_table(_history_daily(spark, sf_dir), keep=["counterId"]).select("counterId", "holiday", "visits"), "stump")
    return feats, regress.fit_visits_gbt(feats, ["holiday"], "visits", max_iter=1, max_depth=1)


@query
def stump_prediction(spark, sf_dir):
    feats, model = _stump(spark, sf_dir)
    pred = regress.predict_visits(model, feats)
    return pred.groupBy(F.col("holiday").cast("bigint").alias("holiday")).agg(
        F.count("*").alias("n"), F.round(F.min("visits_pred"), 4).alias("low"), F.round(F.max("visits_pred"), 4).alias("high"))


@query
def stump_error(spark, sf_dir):
    """RMSE of the stump and the importance of its only feature."""
    feats, model = _stump(spark, sf_dir)
    error = regress.regression_error(regress.predict_visits(model, feats))
    importance = float(model.stages[-1].featureImportances[0])
    return error.select("n", F.round("rmse", 4).alias("rmse"), F.lit("holiday").alias("feature"), F.lit(importance).alias("importance"))


def _finite(c):
    return F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12), F.lit(False))


def _framed(df, keys, value, non_negative):
    """Keys of a model's output and whether its values are usable numbers."""
    ok = _finite(value) & (F.col(value) >= 0) if non_negative else _finite(value)
    return df.select(*keys, ok.alias("usable"))


@query
def fit_forecast_frame(spark, sf_dir):
    return _framed(fit_forecast(spark, sf_dir), ["counterId", "ds"], "yhat", False)


@query
def backcast_frame(spark, sf_dir):
    return _framed(backcast(spark, sf_dir), ["counterId", "ds", "y"], "yhat", False)


@query
def evaluate_holdout_frame(spark, sf_dir):
    return _framed(evaluate_holdout(spark, sf_dir).withColumn("y_mean", F.round("y_mean", 4)), ["counterId", "n", "y_mean"], "mse", True)


@query
def daily_prediction_frame(spark, sf_dir):
    return _framed(daily_prediction(spark, sf_dir), ["counterId", "date"], "load", True)


@query
def day_part_prediction_frame(spark, sf_dir):
    return _framed(day_part_prediction(spark, sf_dir), ["counterId", "date"], "load", True)


@query
def day_part_prediction_pooled_frame(spark, sf_dir):
    return _framed(day_part_prediction_pooled(spark, sf_dir), ["counterId", "date"], "load", True)


@query
def fit_visits_gbt_frame(spark, sf_dir):
    return _framed(fit_visits_gbt(spark, sf_dir), ["counterId", "date_day", "visits"], "visits_pred", False)


@query
def gbt_future_prediction_frame(spark, sf_dir):
    return _framed(gbt_future_prediction(spark, sf_dir), ["counterId", "date"], "load", True)


@query
def feature_importance_frame(spark, sf_dir):
    """The features, with the sum of all importances (1 when any tree split)."""
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))   # one row per feature
    return feature_importance(spark, sf_dir).select("feature", (F.col("importance") >= 0).alias("usable"), F.round(total, 6).alias("total"))


# ---- step 6c: text forms and orders ----------------------------------------------------------------------

def _ddl(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _csv_lines(df, **options):
    """The rows as CSV lines with a header line first, as a file holds them."""
    lines = df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("value"))
    header = options.get("sep", ",").join(df.columns)
    return lines.unionByName(literal_table(df.sparkSession, [(header,)], "value STRING")), header


def _csv_rows(lines, header, schema, **options):
    return lines.where(F.col("value") != header).select(F.from_csv("value", F.lit(_ddl(schema)), options).alias("r")).select("r.*")


@query
def enriched_csv_round_trip(spark, sf_dir):
    """Enriched, holiday-marked history as CSV lines with a header, read back with its schema."""
    schema = schemas.with_field(schemas.ENRICHED, "holiday", BooleanType())
    lines, header = _csv_lines(mark_holidays(spark, sf_dir).select(*schema.names))
    return _csv_rows(lines, header, schema)


@query
def route_csv_round_trip(spark, sf_dir):
    """Route lines (';', decimal comma) read as text columns, then typed."""
    raw = fx.routes_a(fx.table(spark, sf_dir, "customer"))
    lines, header = _csv_lines(raw, sep=";")
    schema = type(schemas.RAW_ROUTE)([f for f in schemas.RAW_ROUTE.fields if f.name in raw.columns])
    return enrich.prepare_routes(_csv_rows(lines, header, schema, sep=";"))


@query
def prediction_csv_feed(spark, sf_dir):
    """Prediction lines with a header -> load feed."""
    lines, header = _csv_lines(fx.prediction_table(fx.table(spark, sf_dir, "orders")).select(*schemas.PREDICTION.names))
    routes = _park_routes(spark, sf_dir).select(F.col("id").alias("counterId"))
    return _date_str(load.to_feed(_csv_rows(lines, header, schemas.PREDICTION), park_id=fx.PARK_EVEN, routes=routes))


@query
def weekday_profile_sorted(spark, sf_dir):
    """The profiles in their order, with places: no task sees the whole table."""
    profile = profiles.weekday_profile(_hourly(spark, sf_dir), "parkCode")
    return places.with_places(_ints_to_bigint(profile), ["parkCode", "weekday", "hour2d"])


@query
def day_part_rollup_sorted(spark, sf_dir):
    out = _ints_to_bigint(profiles.day_part_rollup(_hourly(spark, sf_dir)).select("counterId", "date_day", "day_part", "visits"))
    return places.with_places(out, ["date_day", "day_part", "counterId"])


# ---- step 7: coverage documents -------------------------------------------------------------------------

from footfall.operators import coverage  # noqa: E402
from footfall.sources.sinks import write_text_files  # noqa: E402


@query
def parse_coverage(spark, sf_dir):
    docs = fx.coverage_docs(_events(spark, sf_dir))
    return coverage.parse_coverage(docs, fx.COVERAGE_FIELDS, "xml", keep=["doc"])


@query
def read_coverage_files(spark, sf_dir):
    """Coverage files with many members each (one a user, in day order), read and numbered by the tasks."""
    docs = fx.coverage_docs(_events(spark, sf_dir)).withColumn("user", F.split("doc", "-")[0])
    folder = work_folder(spark, "coverage")
    write_text_files(docs, folder, "user", "xml", order=["doc"])
    out = coverage.read_coverage(spark, folder, fx.COVERAGE_FIELDS)
    user = F.regexp_extract("source", "user=([0-9]+)", 1).cast("bigint").alias("user")
    return out.select(user, "member", "point", "x", "y", "time", *fx.COVERAGE_FIELDS)


# ---- step 8: coefficient tables, sparse trends, trees per counter ----------------------------------------

from footfall.operators import keyed_trees, model_table  # noqa: E402


@query
def trend_model(spark, sf_dir):
    """The fitted coefficients of a straight line, one row a counter."""
    model = model_table.fit_coefficients(series.to_series(_history_daily(spark, sf_dir)), TREND, unique=True)
    first = F.date_add(F.lit("1970-01-01").cast("date"), F.col("t0").cast("int"))
    return model.select("counterId", "n", "last_day", F.date_format(first, "yyyy-MM-dd").alias("first_day"),
                        F.round(F.col("trend")[0] * F.col("scale"), 2).alias("start"),
                        F.round(F.col("trend")[1] * F.col("scale") / F.col("span"), 5).alias("slope"))


@query
def trend_model_forecast(spark, sf_dir):
    """Predictions from a saved coefficient table, in generated code."""
    model = save_once(model_table.fit_coefficients(series.to_series(_history_daily(spark, sf_dir)), TREND, unique=True), "model")
    return model_table.predict_from(model, horizon=10).select("counterId", "ds", F.round("yhat", 2).alias("yhat"))


@query
def trend_model_prediction(spark, sf_dir):
    """The load of the days to come from a saved coefficient table."""
    daily = _history_daily(spark, sf_dir)
    model = save_once(model_table.fit_coefficients(series.to_series(daily), TREND, unique=True), "model")
    return _rounded_load(predictions.prediction_from(model, daily))


# eight places for changes, at 0.1 ... 0.8 of a history
BROKEN = fcst.ModelConfig(n_changepoints=8, yearly=False, weekly=False, daily=False, trend_prior=1e6, changepoint_prior=10.0)


def _broken_lines(spark, sf_dir):
    """The dates of each counter's history with a line that changes its slope from 2 to 5 in the middle."""
    days = _history_daily(spark, sf_dir).select("counterId", F.to_date("date_day").alias("d"))
    ends = days.groupBy("counterId").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    t = F.datediff("d", "lo")
    half = F.datediff("hi", "lo") / 2
    return days.join(ends, "counterId").select("counterId", F.date_format("d", "yyyy-MM-dd").alias("ds"), (100 + 2 * t + 3 * F.greatest(F.lit(0.0), t - half)).alias("y"))


@query
def sparse_trend_changes(spark, sf_dir):
    """A series without noise with one break: the changes of the trend that are not zero."""
    model = model_table.fit_coefficients(_broken_lines(spark, sf_dir), BROKEN, unique=True)
    return model_table.changes(model).select("counterId", "day", F.round("change", 2).alias("change"))


@query
def sparse_trend_forecast(spark, sf_dir):
    model = model_table.fit_coefficients(_broken_lines(spark, sf_dir), BROKEN, unique=True)
    return model_table.predict_from(model, horizon=10).select("counterId", "ds", F.round("yhat", 1).alias("yhat"))


def _holiday_features(spark, sf_dir):
    return regress.feature_table(_history_daily(spark, sf_dir), keep=["counterId", "date_day"]).select("counterId", "date_day", "holiday", "visits")


@query
def keyed_boosting(spark, sf_dir):
    """Seven rounds of boosting per counter on the holiday flag: each round closes 5 % of what is left."""
    feats = _holiday_features(spark, sf_dir)
    config = keyed_trees.TreeConfig(depth=1, min_rows=1)
    pred = keyed_trees.predict_keyed(keyed_trees.fit_keyed_trees(feats, ["holiday"], config=config), feats, ["holiday"], config=config)
    return pred.groupBy("counterId", F.col("holiday").cast("bigint").alias("holiday")).agg(
        F.count("*").alias("n"), F.round(F.min("visits_pred"), 4).alias("low"), F.round(F.max("visits_pred"), 4).alias("high"))


@query
def keyed_gbt_prediction(spark, sf_dir):
    """An ensemble per counter for the ten days after its last day, combined into one table."""
    daily = save_once(_daily_with_routes(spark, sf_dir), "daily")
    outlook = predictions.outlook_by_offset(series.future_covariates(profiles.distinct_keys(daily)))
    holidays = sources.parse_holidays(fx.holiday_lines(spark))
    return predictions.keyed_gbt_prediction(daily, outlook, holidays, trees=keyed_trees.TreeConfig(min_rows=2))


@query
def patient_boosting(spark, sf_dir):
    """Boosting on the holiday flag with patience: the first tree holds the group means, later ones gain
    nothing on the later days, so one round is kept."""
    parts = save_once(series.ordered_split(_holiday_features(spark, sf_dir), 400), "patient")
    train, valid = (parts.where(F.col("part") == p).drop("part", "rn") for p in ("train", "test"))
    model, errors = regress.fit_patient_gbt(train, valid, ["holiday"], max_iter=8, max_depth=1)
    error = regress.regression_error(regress.predict_visits(model, valid))
    return error.select("n", F.round("rmse", 4).alias("rmse"), F.lit(model.stages[-1].getNumTrees).cast("bigint").alias("rounds"),
                        F.lit(len(errors)).cast("bigint").alias("trained"))


# ---- step 9: tables that grow and tables that are replaced -----------------------------------------------

from footfall.operators import rollup_state  # noqa: E402
from footfall.sources.publish import publish, read_published  # noqa: E402
from footfall.sources.sinks import write_partitioned  # noqa: E402


def _in_batches(spark, sf_dir, kind):
    """The published state after three batches of readings: early days, later days, and late readings of
    all days."""
    hourly = _saved_hourly(spark, sf_dir)
    path = work_folder(spark, "state")
    late = F.col("measurmentId") % 5 == 0
    for batch, rows in enumerate([hourly.where(~late & (F.col("day") < 15)), hourly.where(~late & (F.col("day") >= 15)), hourly.where(late)]):
        rollup_state.update_state(rows, path, kind, batch)
    return rollup_state.read_state(spark, path)


@query
def incremental_daily_rollup(spark, sf_dir):
    return rollup_state.finish_daily(_in_batches(spark, sf_dir, rollup_state.DAILY))


@query
def incremental_day_part_rollup(spark, sf_dir):
    return _ints_to_bigint(rollup_state.finish_day_parts(_in_batches(spark, sf_dir, rollup_state.DAY_PARTS)))


@query
def incremental_historic_max(spark, sf_dir):
    return rollup_state.historic_max_of(_in_batches(spark, sf_dir, rollup_state.DAILY))


@query
def republished_days(spark, sf_dir):
    """A published daily table whose even days are replaced by a second version; the odd ones stay."""
    daily = save_once(_daily(spark, sf_dir).select("parkCode", "counterIdPave", "visits", "date_day"), "daily")
    path = work_folder(spark, "published")
    even = F.dayofmonth(F.to_date("date_day")) % 2 == 0
    publish(daily.withColumn("visits", F.when(even, -1).otherwise(F.col("visits")).cast("bigint")), path, partition_by="date_day")
    publish(daily.where(even), path, partition_by="date_day", replace_parts=True)
    return read_published(spark, path)


@query
def partitioned_readings(spark, sf_dir):
    """Readings in one folder a park (each holds half of all rows), read back: rows, visits, and whether a
    folder with more rows than a file should hold is several files."""
    readings = save_once(clean_readings(spark, sf_dir), "readings")
    folder = work_folder(spark, "by-park")
    write_partitioned(readings, folder, ["parkCode"], order=["counterId", "startDate"], rows_per_file=fx.ROWS_PER_FILE)
    back = spark.read.parquet(folder).withColumn("file", F.input_file_name())
    return back.groupBy(F.col("parkCode").cast("bigint").alias("parkCode")).agg(
        F.count("*").alias("n"), F.sum("visits").alias("visits"), (F.countDistinct("file") > 1).alias("several_files"))


@query
def partitioned_profiles(spark, sf_dir):
    """Weekday profiles in a folder per counter and weekday, read back."""
    folder = work_folder(spark, "profiles")
    history.write_weekday_profiles(_saved_hourly(spark, sf_dir), folder, key="parkCode")
    return _ints_to_bigint(spark.read.parquet(folder).select(F.col("parkCode").cast("bigint").alias("parkCode"), "weekday", "hour2d", "visits_mean"))
