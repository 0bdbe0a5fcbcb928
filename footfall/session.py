"""Session construction and the shared checkpoint folder.

The library never creates a session inside an operator; callers (tests, bench, the driver) own it.
``build_session`` is the one place where local runs pick their settings.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every run of ours uses. AQE re-plans joins and partition counts from runtime sizes,
# coalesces tiny shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows per Arrow batch between the JVM and Python workers (bounds transfer buffers)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "footfall",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared, fault-tolerant folder and is used as is. Only when it
    is unset (local tests) do we create a scratch folder of our own under the system temp dir.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared, fault-tolerant folder on a cluster")
    local = tempfile.mkdtemp(prefix="footfall-ckpt-")
    sc.setCheckpointDir(local)
    return local


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run under the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def save_once(df, name: str = "table"):
    """Write a table as Parquet into the shared checkpoint folder and read it back: every plan built
    on the result reads the saved columns it needs instead of computing the table again."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per session, when it is run from a source folder.

    The zip lies in the shared checkpoint folder. An installed package (``pip install .``) or one
    passed with ``--py-files`` needs no shipping; sending it again does no harm."""
    sc = spark.sparkContext
    if getattr(sc, "_footfall_shipped", False):
        return
    import io
    import zipfile
    from pathlib import Path

    from pyarrow import fs
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_text())
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/footfall.zip", compression=None) as out:
        out.write(buffer.getvalue())
    sc.addPyFile(f"{uri}/footfall.zip")
    sc._footfall_shipped = True
