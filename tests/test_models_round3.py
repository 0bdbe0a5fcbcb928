"""Sparse trend changes, coefficient tables, patience and trees per counter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import forecast as fcst
from footfall.operators import keyed_trees, model_table, regress
from footfall.operators import series as ser
from footfall.plans import predictions


def coordinate_descent(q, b, weight, sweeps=100000):
    """A plain solver of the same problem."""
    x = np.zeros(len(b))
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(b)):
            r = b[i] - q[i] @ x + q[i, i] * x[i]
            x[i] = np.sign(r) * max(abs(r) - weight, 0) / q[i, i]
        if np.abs(x - before).max() < 1e-13:
            break
    return x


@pytest.mark.parametrize("seed", range(8))
def test_active_set_search_equals_coordinate_descent(seed):
    draw = np.random.default_rng(seed)
    for _ in range(10):
        k = int(draw.integers(1, 10))
        x = draw.standard_normal((25, k))
        q, b, weight = x.T @ x, x.T @ draw.standard_normal(25) * 3, float(draw.choice([0.01, 1, 5, 20]))
        got, want = fcst.sparse_minimum(q, b, weight), coordinate_descent(q, b, weight)
        assert np.abs(got - want).max() < 1e-7 and ((got == 0) == (np.abs(want) < 1e-11)).all()


def test_most_changes_of_a_series_with_one_break_are_zero():
    draw = np.random.default_rng(5)
    t = np.arange(900.0)
    y = 50 + 0.2 * t - 0.5 * np.maximum(0, t - 430) + draw.normal(0, 3, 900)
    cfg = fcst.ModelConfig(yearly=False, weekly=False, daily=False)
    lay, beta, scale = fcst.fit_arrays(t, y, np.ones(900), y * y, cfg)
    delta = beta[lay.changes]
    assert len(delta) == 25 and (delta == 0).sum() >= 15
    near = np.abs(lay.cps * lay.span + lay.t0 - 430) < 60
    assert np.abs(delta[~near]).max() < 0.1 * np.abs(delta[near]).max()
    dense = fcst.fit_arrays(t, y, np.ones(900), y * y, fcst.ModelConfig(yearly=False, weekly=False, daily=False, sparse_changes=False))[1]
    assert (dense[lay.changes] != 0).all()
    future = np.arange(900.0, 910.0)
    assert np.abs(lay.predict(future, beta, scale)[0] - (50 + 0.2 * future - 0.5 * (future - 430))).max() < 8


def test_the_whole_problem_is_at_its_minimum():
    """No coefficient, sparse or not, can be moved to a smaller objective."""
    draw = np.random.default_rng(2)
    t = np.arange(400.0)
    y = np.sin(t / 30) * 20 + t * 0.1 + draw.normal(0, 2, 400)
    cfg = fcst.ModelConfig()
    lay = fcst.Layout(t, cfg)
    x, scale = lay.design(t), np.abs(y).max()
    gram, moment, squares = x.T @ x, x.T @ (y / scale), float(y @ y) / scale**2
    beta = fcst.solve(gram, moment, squares, 400, lay)
    flat = np.linalg.solve(gram + 1e-8 * np.eye(len(moment)) + 1e-6 * np.diag(lay.precision), moment)
    sigma2 = max((squares - 2 * flat @ moment + flat @ gram @ flat) / 400, 1e-6)
    slope = gram @ beta - moment
    rest = np.setdiff1d(np.arange(len(beta)), lay.changes)
    assert np.abs(slope[rest] + sigma2 * lay.precision[rest] * beta[rest]).max() < 1e-6
    weight = sigma2 / cfg.changepoint_prior
    for i in lay.changes:
        assert abs(slope[i] + weight * np.sign(beta[i])) < 1e-6 if beta[i] else abs(slope[i]) <= weight * (1 + 1e-6)


def long_series(spark, days=420, counters=(1, 2)):
    rows = [(c, str(np.datetime64("2022-03-01") + d), 20.0 + c * d * 0.1 + 5 * (d % 7 == 2) + (d * 37 % 11)) for c in counters for d in range(days)]
    return spark.createDataFrame([*rows, (3, "2022-03-05", 4.0), (4, "2022-03-05", None)], "counterId long, ds string, y double")


def test_predictions_from_the_coefficient_table_equal_the_fit(spark):
    s = long_series(spark)
    model = model_table.fit_coefficients(s)
    key = ["counterId", "ds"]
    for kw in ({"horizon": 10}, {"horizon": 4, "as_of": "2023-06-01"}):
        a = fcst.fit_forecast(s, **kw).toPandas().set_index(key).sort_index()
        b = model_table.predict_from(model, **kw).toPandas().set_index(key).sort_index()
        assert a.index.equals(b.index) and len(a) in (40, 48)
        for c in ("yhat", "trend"):
            assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)
    assert b.loc[4].yhat.isna().all() and (b.loc[3].yhat == 4).all()
    frame = spark.createDataFrame([(1, "2022-05-01"), (1, "2030-01-01 13:00"), (9, "2022-05-01")], "counterId long, ds string")
    got = {(r.counterId, r.ds): r.yhat for r in model_table.predict_from(model, frame).collect()}
    want = {(r.counterId, r.ds): r.yhat for r in fcst.fit_forecast(s, frame=frame).collect()}
    assert got[(9, "2022-05-01")] is None
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in got if k[0] == 1)


def test_day_part_models_carry_the_daily_season(spark):
    rows = [(1, f"{np.datetime64('2023-01-01') + d} {h}", 10.0 + d * 0.1 + v) for d in range(60) for h, v in (("01:00", 3.0), ("09:00", 9.0), ("17:00", 0.0))]
    s = spark.createDataFrame(rows, "counterId long, ds string, y double")
    model = model_table.fit_coefficients(s)
    assert len(model.first().daily) == 8
    a, b = (x.orderBy("ds").toPandas() for x in (fcst.fit_forecast(s, horizon=3, as_of="2023-03-02"), model_table.predict_from(model, horizon=3, as_of="2023-03-02")))
    assert (a.ds == b.ds).all() and np.allclose(a.yhat, b.yhat, rtol=1e-9)


def test_scoring_a_saved_table_runs_no_python(spark, tmp_path):
    model_table.fit_coefficients(long_series(spark)).write.parquet(str(tmp_path / "m"))
    model = spark.read.parquet(str(tmp_path / "m"))
    daily = long_series(spark).select("counterId", F.col("y").alias("visits"))
    daily.write.parquet(str(tmp_path / "d"))
    daily = spark.read.parquet(str(tmp_path / "d"))
    for df in (model_table.predict_from(model), predictions.prediction_from(model, daily, as_of="2023-06-01")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert predictions.prediction_from(model, daily).count() == 40


def test_patience_keeps_the_best_prefix():
    assert regress.patient_rounds([5, 4, 3, 3.5, 3.4, 3.2, 3.1, 3.3]) == 3
    assert regress.patient_rounds([5, 4, 3, 3.5, 3.4, 3.2, 3.1, 3.3, 1.0]) == 3         # too late
    assert regress.patient_rounds([5, 4, 3, 3.5, 3.4, 1.0]) == 6
    assert regress.patient_rounds([2, 2, 2, 2]) == 1 and regress.patient_rounds([]) == 0


def test_boosting_with_rising_validation_error_is_cut(spark, tmp_path):
    """Noise is learnt: the error on other rows rises, and the model kept is the one before."""
    draw = np.random.default_rng(1)
    x = draw.random((300, 3))
    y = 10 * (x[:, 0] > 0.5) + draw.normal(0, 6, 300)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    train, valid = (spark.createDataFrame(part, "a double, b double, c double, visits double") for part in (rows[:150], rows[150:]))
    model, errors = regress.fit_patient_gbt(train, valid, ["a", "b", "c"], max_iter=15, step_size=0.5, max_depth=3)
    kept = regress.patient_rounds(errors)
    assert len(errors) == 15 and kept < 15 and errors[-1] > errors[kept - 1]
    assert model.stages[-1].getNumTrees == kept and len(model.stages[-1].featureImportances) == 3
    whole = regress.fit_visits_gbt(train, ["a", "b", "c"], max_iter=15, step_size=0.5, max_depth=3)
    assert whole.stages[-1].getNumTrees == 15
    error = regress.regression_error(regress.predict_visits(model, valid)).first().rmse ** 2
    assert error == pytest.approx(min(errors[:kept + 5]), rel=1e-6) == pytest.approx(errors[kept - 1], rel=1e-6)
    model.write().overwrite().save(str(tmp_path / "model"))


def walk(trees, x, cfg):
    """Predictions of one ensemble, row by row."""
    inner, leaves = (1 << cfg.depth) - 1, 1 << cfg.depth
    out = []
    for row in x:
        value = trees["base"]
        for r in range(cfg.rounds):
            node = 0
            for _ in range(cfg.depth):
                f = trees["feature"][r * inner + node]
                node = 2 * node + 1 + int(f >= 0 and row[f] > trees["threshold"][r * inner + node])
            value += trees["leaf"][r * leaves + node - inner]
        out.append(value)
    return np.array(out)


def test_trees_per_counter(spark):
    draw = np.random.default_rng(3)
    cfg = keyed_trees.TreeConfig(rounds=30, depth=3, learning_rate=0.3, min_rows=5)
    frames = []
    for key in (1, 2, None):
        x = draw.random((200, 2))
        y = (x[:, 0] > 0.3) * (5 if key == 1 else -5) + x[:, 1] * 2 + draw.normal(0, 0.1, 200)
        frames.append(pd.DataFrame({"counterId": key, "a": x[:, 0], "b": x[:, 1], "visits": y}))
    rows = [(None if pd.isna(r.counterId) else int(r.counterId), float(r.a), float(r.b), float(r.visits)) for f in frames for r in f.itertuples()]
    rows += [(5, 0.1, 0.2, 7.0), (6, 0.1, 0.2, None), (5, None, float("nan"), 7.0)]
    df = spark.createDataFrame(rows, "counterId long, a double, b double, visits double").repartition(5)
    trees = keyed_trees.fit_keyed_trees(df, ["a", "b"], config=cfg)
    fitted = {r.counterId: r.asDict() for r in trees.collect()}
    assert set(fitted) == {1, 2, None, 5} and fitted[5]["n"] == 2
    pred = keyed_trees.predict_keyed(trees, df, ["a", "b"], config=cfg)
    plan = pred.select("visits_pred")._jdf.queryExecution().optimizedPlan().toString()
    assert "visits_pred" in plan
    got = pred.toPandas()
    for key, own in got.groupby("counterId", dropna=False):
        key = None if pd.isna(key) else int(key)
        if key == 6:
            assert own.visits_pred.isna().all()
            continue
        want = walk(fitted[key], own[["a", "b"]].fillna(0).to_numpy(), cfg)
        assert np.allclose(own.visits_pred, want)
        if key != 5:
            assert ((own.visits_pred - own.visits) ** 2).mean() < 0.2
    again = {r.counterId: r.asDict() for r in keyed_trees.fit_keyed_trees(df.repartition(2), ["a", "b"], config=cfg).collect()}
    assert again == fitted                                # in any order of the rows
    splits = {(r.counterId, r.feature): r.splits for r in keyed_trees.keyed_importance(trees, ["a", "b"]).collect()}
    assert splits[(1, "a")] > 0 and (5, "a") not in splits


def test_one_split_is_the_group_means(spark):
    df = spark.createDataFrame([(c, i % 2, float(10 * c + 4 * (i % 2) + i)) for c in (1, 2) for i in range(30)], "counterId long, flag int, visits double")
    cfg = keyed_trees.TreeConfig(rounds=1, depth=1, learning_rate=1.0, min_rows=1)
    pred = keyed_trees.predict_keyed(keyed_trees.fit_keyed_trees(df, ["flag"], config=cfg), df, ["flag"], config=cfg)
    got = {(r.counterId, r.flag): r.m for r in pred.groupBy("counterId", "flag").agg(F.avg("visits_pred").alias("m")).collect()}
    want = {(r.counterId, r.flag): r.m for r in df.groupBy("counterId", "flag").agg(F.avg("visits").alias("m")).collect()}
    assert got == pytest.approx(want)
    none = keyed_trees.TreeConfig(rounds=0)
    flat = keyed_trees.predict_keyed(keyed_trees.fit_keyed_trees(df, ["flag"], config=none), df, ["flag"], config=none)
    assert {r.counterId: round(r.visits_pred, 9) for r in flat.collect()} == {r.counterId: round(r.m, 9) for r in df.groupBy("counterId").agg(F.avg("visits").alias("m")).collect()}


def test_future_frames_of_a_model_match_the_series(spark):
    s = long_series(spark, days=30)
    model = model_table.fit_coefficients(s)
    a = {(r.counterId, r.ds) for r in model_table.predict_from(model, horizon=5).collect()}
    b = {(r.counterId, r.ds) for r in ser.future_days(s, 5, include_history=False).collect()}
    assert a == b and model_table.predict_from(model, horizon=0).count() == 0


def test_counters_share_fitting_calls_and_keep_models_of_their_own(spark, monkeypatch):
    """Some counters are fitted in one call; NULL is a counter, and no model sees another's rows."""
    import numpy as np
    from footfall.operators import forecast, keyed_trees
    big = (1 << 60) + 1                                       # no float holds this id
    rows = [(c, f"2024-01-{d:02d}", float((d * (c or 7)) % 11 + d * d % 5), float(d % 4), float(d)) for c in (3, None, big, 8) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "counterId long, ds string, y double, a double, b double")
    monkeypatch.setattr(forecast, "BUCKETS", 1)
    monkeypatch.setattr(keyed_trees, "BUCKETS", 1)
    got, name = {}, lambda c: None if c == -1 << 63 else c
    for r in forecast.fit_forecast(df, horizon=3).collect():
        got.setdefault(name(r.counterId), []).append((r.ds, r.yhat))
    assert set(got) == {3, None, big, 8}
    frame = df.select("counterId", "ds").where("ds < '2024-01-04'").unionByName(spark.createDataFrame([(99, "2024-01-05")], "counterId long, ds string"))
    asked = {(name(r.counterId), r.ds): r.yhat for r in forecast.fit_forecast(df, frame=frame).collect()}
    assert len(asked) == 13 and asked[99, "2024-01-05"] is None
    for c in got:
        own = [r for r in rows if r[0] == c]
        t, y = forecast._days(forecast.pd.Series([r[1] for r in own])), np.array([r[2] for r in own])
        want, _ = forecast.fit_predict_arrays(t, y, np.ones(20), y * y, np.concatenate([t[-1] + 1 + np.arange(3), t[:3]]), y_amax=np.abs(y))
        assert [d for d, _ in sorted(got[c])] == ["2024-01-21", "2024-01-22", "2024-01-23"]
        assert np.allclose([v for _, v in sorted(got[c])], want[:3], rtol=1e-6)
        assert np.allclose([asked[c, r[1]] for r in own[:3]], want[3:], rtol=1e-6)
    config = keyed_trees.TreeConfig(min_rows=2)
    trees = {r.counterId: r for r in keyed_trees.fit_keyed_trees(df, ["a", "b"], "y", config=config).collect()}
    assert set(trees) == set(got) and all(r.n == 20 for r in trees.values())
    for c, r in trees.items():
        own = np.array(sorted(x[2:] for x in rows if x[0] == c))
        base, feature, threshold, leaf, _ = keyed_trees.fit_arrays(own[:, 1:], own[:, 0], config)
        assert r.base == base and r.feature == feature.tolist() and r.threshold == threshold.tolist() and r.leaf == leaf.tolist()


def test_patience_trains_in_more_tasks_than_the_table_has_splits(spark, tmp_path, monkeypatch):
    from footfall.operators import regress
    spark.range(200).selectExpr("id % 2 AS holiday", "id AS visits").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows, seen = spark.read.parquet(str(tmp_path / "t")), []

    class Watched(regress.Pipeline):
        def fit(self, data):
            seen.append((data.rdd.getNumPartitions(), data.count()))
            return super().fit(data)

    monkeypatch.setattr(regress, "Pipeline", Watched)
    regress.fit_patient_gbt(rows, rows, ["holiday"], max_iter=2, max_depth=1)
    assert seen == [(regress.SPREAD * rows.rdd.getNumPartitions(), 200)] and regress.SPREAD > 1
