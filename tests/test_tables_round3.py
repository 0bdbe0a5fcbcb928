"""Published tables, roll-ups that grow, places, numbered coverage members, folders in parts."""

import glob
import os

import pytest
from driver_tables import SF_SMALL
from pyspark.sql import functions as F

from footfall.operators import places, profiles
from footfall.operators import rollup_state as rs
from footfall.operators.coverage import parse_coverage, read_coverage
from footfall.sources import publish as pub
from footfall.sources.sinks import write_partitioned
from footfall.testing import catalog
from footfall.testing import fixtures as fx


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def test_a_job_that_dies_before_the_manifest_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        pub.read_published(spark, path)
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert pub.publish(old, path) == 0
    open_before = pub.read_published(spark, path)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(pub, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            pub.publish(spark.createDataFrame([(9, "z")], "k long, v string"), path)
    assert rows(pub.read_published(spark, path)) == rows(old)
    assert pub.publish(spark.createDataFrame([(3, "c")], "k long, v string"), path) == 1
    assert rows(pub.read_published(spark, path)) == [(3, "c")]
    assert rows(open_before) == rows(old)                    # what a reader has open stays readable


def test_two_writers_cannot_publish_the_same_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "k long")
    pub.publish(df, path)
    stale = pub.manifest(path)
    pub.publish(df, path)
    monkeypatch.setattr(pub, "manifest", lambda p: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        pub.publish(df, path)


def test_only_the_parts_that_changed_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), (None, 3), ("a/b=c d", 4)], "day string, v long")
    pub.publish(first, path, partition_by="day")
    before = pub.manifest(path)["parts"]
    pub.publish(spark.createDataFrame([("2024-01-02", 20), ("2024-01-03", 30)], "day string, v long"), path, partition_by="day", replace_parts=True)
    after = pub.manifest(path)["parts"]
    want = [("2024-01-01", 1), ("2024-01-02", 20), ("2024-01-03", 30), ("a/b=c d", 4), (None, 3)]
    assert rows(pub.read_published(spark, path)) == rows(spark.createDataFrame(want, "day string, v long"))
    assert sum(before.get(k) == v for k, v in after.items()) == 3
    one = pub.read_published(spark, path, only=["2024-01-02", None, "2030-01-01"])
    assert rows(one) == rows(spark.createDataFrame([("2024-01-02", 20), (None, 3)], "day string, v long"))
    assert len(one.inputFiles()) == 2
    assert pub.read_published(spark, path, only=[]).count() == 0
    pub.publish(pub.read_published(spark, path).limit(0), path, partition_by="day")
    assert pub.read_published(spark, path).count() == 0


def test_states_merge_to_the_whole_rollup(spark, tmp_path):
    hourly = catalog._saved_hourly(spark, SF_SMALL)
    thirds = [hourly.where(F.pmod("measurmentId", F.lit(3)) == k) for k in range(3)]
    for kind, finish, whole in ((rs.DAILY, rs.finish_daily, profiles.daily_rollup), (rs.DAY_PARTS, rs.finish_day_parts, profiles.day_part_rollup)):
        path = str(tmp_path / ("d" if kind is rs.DAILY else "p"))
        for k, part in enumerate(thirds):
            assert rs.update_state(part, path, kind, batch=k)
        assert not rs.update_state(thirds[2], path, kind, batch=2)      # a batch that is repeated counts once
        assert not rs.update_state(hourly.limit(0), path, kind)
        got, want = finish(rs.read_state(spark, path)), whole(hourly)
        assert set(got.columns) == set(want.columns)
        assert rows(got.select(*want.columns)) == rows(want)


def test_an_update_touches_only_the_days_of_its_readings(spark, tmp_path):
    hourly = catalog._saved_hourly(spark, SF_SMALL)
    path = str(tmp_path / "s")
    rs.update_state(hourly, path, rs.DAILY)
    before = pub.manifest(path)["parts"]
    late = hourly.where(F.col("date_day") == hourly.agg(F.min("date_day")).first()[0])
    rs.update_state(late, path, rs.DAILY)
    after = pub.manifest(path)["parts"]
    assert set(before) == set(after) and sum(before[k] != after[k] for k in after) == 1
    assert rs.historic_max_of(rs.read_state(spark, path)).count() == profiles.historic_max(profiles.daily_rollup(hourly)).count()


def test_a_stream_keeps_the_states_up_to_date(spark, tmp_path):
    from footfall.operators.clean import clean_weather
    from footfall.sources import parse_holidays
    from footfall.streaming import start_rollups
    ev = fx.table(spark, SF_SMALL, "events")
    lines = fx.raw_reading_lines(spark, ev).cache()
    weather, holidays = clean_weather(fx.raw_weather_lines(ev)), parse_holidays(fx.holiday_lines(spark))
    late = F.col("value").startswith("1")
    for k, part in enumerate((lines.where(~late), lines.where(late))):    # the second batch falls on the same days
        part.coalesce(1).write.text(f"{tmp_path}/in/{k}")
        start_rollups(spark, f"{tmp_path}/in/*", weather, holidays, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination(120)
    want = profiles.daily_rollup(catalog._hourly(spark, SF_SMALL))
    got = rs.finish_daily(rs.read_state(spark, f"{tmp_path}/out/daily"))
    assert rows(got.select(*want.columns)) == rows(want)
    assert pub.manifest(f"{tmp_path}/out/day_parts")["notes"] == {"batch": 1}


def test_places_of_ties_nulls_and_skew(spark):
    data = [(7, "x")] * 400 + [(None, "n")] * 3 + [(k, str(k)) for k in range(200)]
    df = spark.createDataFrame(data, "a long, b string").repartition(7)
    out = places.with_places(df, ["a"], partitions=6)
    got = sorted((r.place, r.a) for r in out.collect())
    assert [p for p, _ in got] == list(range(1, 604))
    want = [None] * 3 + sorted([7] * 400 + list(range(200)))
    assert [a for _, a in got] == want
    assert places.with_places(df.limit(0), ["a"]).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_places_are_spread_over_tasks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    out = places.with_places(df, ["a"], partitions=8)
    tasks = places.numbered_rows(df.repartitionByRange(8, "a", F.xxhash64("a", "b"))).groupBy("_part").count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2000     # three values, eight tasks
    assert {(r.a, r.place) for r in out.groupBy("a").agg(F.min("place").alias("place")).collect()} == {(0, 1), (1, 1668), (2, 3335)}


def test_one_large_coverage_file_is_many_tasks_and_numbered(spark, tmp_path):
    docs = fx.coverage_docs(fx.table(spark, SF_SMALL, "events")).orderBy("doc").collect()
    for name, part in (("a.xml", docs), ("b.xml", docs[:3])):
        (tmp_path / name).write_text("\n".join(d.xml for d in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        out = read_coverage(spark, str(tmp_path), fx.COVERAGE_FIELDS)
        assert spark.read.text(str(tmp_path / "a.xml"), lineSep="</wfs:member>").rdd.getNumPartitions() > 4
        got = sorted((r.source[-5:], r.member, r.point, r.x, r.y) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all("_xml" not in line for line in plan.splitlines() if line.strip().startswith("+- Window") or "Window [" in line)
    want = []
    for name, part in (("a.xml", docs), ("b.xml", docs[:3])):
        before = [sum(d.xml.count("<wfs:member") for d in part[:i]) for i in range(len(part))]
        parsed = parse_coverage(spark.createDataFrame([(i, d.xml) for i, d in enumerate(part)], "doc long, xml string"), fx.COVERAGE_FIELDS, keep=["doc"])
        want += [(name, before[r.doc] + r.member, r.point, r.x, r.y) for r in parsed.collect()]
    assert got == sorted(want)


def test_a_hot_folder_is_several_files_of_bounded_size(spark, tmp_path):
    hot = [("hot", 1, "same")] * 600 + [("hot", k, "own") for k in range(600)]
    cold = [(f"k{k}", k, "cold") for k in range(20)] + [(None, 5, "none"), ("", 6, "none")]
    df = spark.createDataFrame(hot + cold, "key string, n long, v string").repartition(6)
    path = str(tmp_path / "t")
    write_partitioned(df, path, ["key"], order=["n"], rows_per_file=200)
    files = glob.glob(f"{path}/key=hot/*.parquet")
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(files) >= 5 and sum(sizes) == 1200 and max(sizes) <= 200
    assert all(len(glob.glob(f"{path}/key=k{k}/*.parquet")) == 1 for k in range(20))
    back = spark.read.schema("n long, v string, key string").parquet(path).select(F.nullif("key", F.lit("")).alias("key"), "n", "v")
    assert rows(back) == rows(df.select(F.nullif("key", F.lit("")).alias("key"), "n", "v"))
    in_order = [r.n for r in spark.read.parquet(files[0]).collect()]
    assert in_order == sorted(in_order)
    write_partitioned(df, str(tmp_path / "b"), ["key"], buckets=4, rows_per_file=200)
    assert rows(spark.read.schema("key string, n long, v string, bucket int").parquet(str(tmp_path / "b")).drop("bucket")) == rows(df)
    assert len([d for d in os.listdir(tmp_path / "b") if d.startswith("bucket=")]) <= 5


def test_scattered_versions_are_compacted_and_old_ones_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, v: spark.createDataFrame([(d, v)], "day string, v long")
    for k in range(6):
        pub.publish(day(f"d{k % 4}", k), path, partition_by="day", replace_parts=True)
    want = [("d0", 4), ("d1", 5), ("d2", 2), ("d3", 3)]
    assert pub.versions(path) == 4 and rows(pub.read_published(spark, path)) == want
    assert pub.compact(spark, path) == 6 and pub.versions(path) == 1
    assert rows(pub.read_published(spark, path)) == want
    before = len(os.listdir(f"{path}/data"))
    gone = pub.expire(path, keep=2)
    # the manifest before the compacted one still lists four versions
    assert len(gone) == before - 5 and rows(pub.read_published(spark, path)) == want
    assert len(pub.expire(path, keep=1)) == 4 and rows(pub.read_published(spark, path)) == want
    assert pub.publish(day("d9", 9), path, partition_by="day", replace_parts=True) == 7


def test_a_state_of_many_batches_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rs, "SCATTERED", 2)
    hourly = catalog._saved_hourly(spark, SF_SMALL)
    first = sorted(r[0] for r in hourly.select("date_day").distinct().collect())[:4]
    path = str(tmp_path / "s")
    for k, d in enumerate(first):
        rs.update_state(hourly.where(F.col("date_day") == d), path, rs.DAILY, batch=k)
    assert pub.versions(path) <= 2 and pub.manifest(path)["notes"] == {"batch": 3}
    want = profiles.daily_rollup(hourly.where(F.col("date_day").isin(first)))
    assert rows(rs.finish_daily(rs.read_state(spark, path)).select(*want.columns)) == rows(want)


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 40)).alias("day"), F.rand(1).alias("x"))
        pub.publish(df, str(tmp_path / "t"), partition_by="day")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    now = pub.manifest(str(tmp_path / "t"))
    files = {name: len([f for f in os.listdir(tmp_path / "t" / part) if f.startswith("part-")]) for name, part in now["parts"].items()}
    assert files["day=hot"] > 2 and sum(files.values()) < 3 * len(files)
    assert pub.read_published(spark, str(tmp_path / "t")).count() == 60_000
