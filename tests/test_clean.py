from hypothesis import given, settings
from hypothesis import strategies as st

from footfall import schemas
from footfall.operators.clean import clean_readings, clean_weather, rejected_readings, rejected_weather


def line(start="7/29/2018 19:00", visits="5", n=19):
    f = ["1", "912", "3", start, "7/29/2018 20:00", visits, "P1", "N1", "1/1/2015 00:00", "952",
         "a", "b", "c", "d", "e", "f", "", "6680000", "370000"]
    return "\t".join((f + ["extra"])[:n])


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value STRING")


def test_clean_readings_edge_rows(spark):
    good = line()
    rows = [good, line(start="68/3/2017 11:00"), line(n=18), line(n=20), line(visits=""),
            line(visits=" 5 "), "\t".join(schemas.RAW_READING_FIELDS)]
    out = clean_readings(lines_df(spark, rows)).collect()
    assert len(out) == 2
    assert all(r.startDate == 1532883600.0 and r.visits == 5 for r in out)
    assert out[0].endDate == 1532887200.0
    rej = {r.value: r.reason for r in rejected_readings(lines_df(spark, rows)).collect()}
    assert rej[line(start="68/3/2017 11:00")] == "startDate"
    assert rej[line(n=18)] == "field_count" and rej[line(n=20)] == "field_count"
    assert rej[line(visits="")] == "visits"
    assert rej["\t".join(schemas.RAW_READING_FIELDS)] == "measurmentId"


def test_clean_readings_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = clean_readings(lines_df(spark, [line()])).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.startDate == 1532883600.0


def test_clean_weather_edge_rows(spark):
    base = ["2024", "1", "5", "13:00", "UTC"] + ["1"] * 11
    blank = list(base); blank[5] = ""
    bad = list(base); bad[8] = "x"
    month13 = list(base); month13[1] = "13"
    rows = [",".join(base), ",".join(blank), ",".join(bad), ",".join(month13)]
    out = clean_weather(lines_df(spark, rows)).orderBy("cloud").collect()
    assert len(out) == 2
    assert out[0].cloud is None and out[1].cloud == 1.0
    # 2024-01-05 13:00 at +02:00
    assert out[1].startDate == 1704452400.0
    reasons = sorted(r.reason for r in rejected_weather(lines_df(spark, rows)).collect())
    assert reasons == ["percip", "time"]


texts = st.lists(st.one_of(
    st.builds(line, start=st.sampled_from(["7/29/2018 19:00", "13/1/2018 00:00", "1/1/2019 5:7", "x"]),
              visits=st.sampled_from(["1", "", "n/a", "12", "-3"]), n=st.sampled_from([18, 19, 19, 20])),
    st.text(alphabet="ab\t1/:", max_size=30)), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None)
@given(texts)
def test_clean_and_rejected_partition_the_input(spark, rows):
    df = lines_df(spark, rows)
    assert clean_readings(df).count() + rejected_readings(df).count() == len(rows)


def test_nan_measure_is_missing(spark):
    row = ",".join(["2024", "1", "5", "13:00", "UTC", "NaN"] + ["1"] * 10)
    out = clean_weather(lines_df(spark, [row])).collect()
    assert len(out) == 1 and out[0].cloud is None
