"""Coverage files of very many users: how they are written, listed and read."""

import glob
import os

from pyspark.sql import functions as F

from footfall.operators.coverage import NAMES_AT_ONCE, parse_coverage, read_coverage
from footfall.session import ensure_checkpoint_dir
from footfall.sources.sinks import FOLDERS, write_text_files
from footfall.testing import fixtures as fx
from footfall.testing.catalog import QUERIES

SF_SMALL = "/root/testdata/sf0.001"
HEAD, MEMBER, MID, END = fx.COVERAGE_HEAD, fx.COVERAGE_MEMBER, fx.COVERAGE_MID, fx.COVERAGE_END
CLOSE = "</gmlcov:MultiPointCoverage></om:result></omso:GridSeriesObservation></wfs:member>\n"


def member(points, tuples, names):
    fields = "".join(f"<swe:field name=\"{n}\"/>" for n in names)
    return (MEMBER + "\n".join(points) + MID + "\n".join(tuples) + "\n</gml:doubleOrNilReasonTupleList></gml:DataBlock></gml:rangeSet>\n"
            + f"<gmlcov:rangeType><swe:DataRecord>{fields}</swe:DataRecord></gmlcov:rangeType>\n" + CLOSE)


def test_users_are_files_not_folders(spark):
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/**/coverage-*", recursive=True))
    out = QUERIES["read_coverage_files"](spark, SF_SMALL)
    folder, = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/**/coverage-*", recursive=True)) - before
    users = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().count()
    assert len([d for d in glob.glob(f"{folder}/*") if os.path.isdir(d)]) <= FOLDERS
    assert not [d for d in glob.glob(f"{folder}/**/user=*", recursive=True) if os.path.isdir(d)]
    assert len(glob.glob(f"{folder}/*/user=*.txt")) == users == out.select("user").distinct().count()


def test_one_text_file_a_key_in_few_folders(spark, tmp_path):
    rows = [(f"k{k}", n, f"{k}-{n}") for n in (3, 1, 2) for k in range(40)] + [(None, 1, "none"), ("", 2, None), ("a/b", 1, "bar"), ("k", 1, "h\u00e4\nj")]
    df = spark.createDataFrame(rows, "key string, n long, v string").repartition(5)
    path = str(tmp_path / "t")
    write_text_files(df, path, "key", "v", order=["n"], folders=4)
    files = {os.path.basename(f): open(f, encoding="utf-8").read() for f in glob.glob(f"{path}/folder=*/*")}
    assert files.pop("key=.txt") == "none\n\n" and files.pop("key=a%2Fb.txt") == "bar\n" and files.pop("key=k.txt") == "h\u00e4\nj\n"
    assert files == {f"key=k{k}.txt": f"{k}-1\n{k}-2\n{k}-3\n" for k in range(40)}
    assert len(os.listdir(path)) <= 4 and not glob.glob(f"{path}/*/.*.tmp")
    write_text_files(df, path, "key", "v", order=["n"], folders=4)     # as a task that runs again does
    assert spark.read.text(path).count() == 40 * 3 + 5
    write_text_files(df.limit(0), str(tmp_path / "none"), "key", "v")
    assert read_coverage(spark, str(tmp_path / "none"), fx.COVERAGE_FIELDS).count() == 0


def test_coverage_files_are_opened_once(spark, tmp_path):
    docs = fx.coverage_docs(fx.table(spark, SF_SMALL, "events")).withColumn("user", F.split("doc", "-")[0])
    write_text_files(docs, str(tmp_path), "user", "xml", order=["doc"])
    out = read_coverage(spark, str(tmp_path), fx.COVERAGE_FIELDS)
    assert out.count() > 0
    counted = out.groupBy("source").agg(F.max("member").alias("last"))
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan


def test_members_with_any_number_of_field_names(spark):
    most = [f"f{k}" for k in range(NAMES_AT_ONCE + 3)]
    cases = [[], ["f0"], most[:NAMES_AT_ONCE], most[:NAMES_AT_ONCE + 1], most, ["a|b", "f2", "f1 f0"]]
    xml = HEAD + "".join(member(["1 2 1573900000"], [" ".join(str(float(i)) for i in range(len(c) or 1))], c) for c in cases) + END
    wanted = [*most, "a|b", "f1 f0"]
    out = parse_coverage(spark.createDataFrame([("d", xml)], "doc STRING, xml STRING"), wanted, keep=["doc"]).orderBy("member").collect()
    assert [{n: r[n] for n in wanted if r[n] is not None} for r in out] == [{n: float(i) for i, n in enumerate(c)} for c in cases]
