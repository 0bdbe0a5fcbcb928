"""Sinks: distributed writers (one file per task), never a driver-side collect."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import save_once

FOLDERS = 256             # of a table with one file a key: listed by as many tasks


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv_table(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",",
                    header_names: dict[str, str] | None = None) -> None:
    """CSV with a header line; ``header_names`` restores external column names (e.g. brackets)."""
    out = df
    for src, dst in (header_names or {}).items():
        if src in out.columns:
            out = out.withColumnRenamed(src, dst)
    out.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", mode: str = "overwrite",
                      order: Sequence[str] = (), buckets: int | None = None, rows_per_file: int = 1_000_000) -> None:
    """One folder per key combination (e.g. per counter and weekday); readers prune by key.

    The rows of each folder are counted first, and a folder is given as many write tasks, and so files, as
    it holds ``rows_per_file`` rows, which no file exceeds: a small folder is one file, one with a third of all rows is many. Rows
    go to a folder's files by a hash of the whole row and of the task that read it (so equal rows spread
    too), and ``order`` sorts the rows of a file (e.g. by hour). ``df`` is read twice: give it a saved
    table where it is costly. With ``buckets`` the first key, when it has very many values, is replaced as
    a folder by a hash bucket of it (column ``bucket``) and stays in the files.
    """
    keys, columns = list(keys), df.columns
    folders = keys
    if buckets:
        df = df.withColumn("bucket", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int"))
        folders = ["bucket", *keys[1:]]
    sizes = save_once(df.groupBy(*folders).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")), "sizes")
    tasks = max(1, sizes.agg(F.sum("_files")).first()[0] or 0)       # a number of its own: not coalesced by bytes
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(folders)], "_files")
    same = [df[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(folders)]
    spread = df.withColumn("_row", F.xxhash64(*columns, F.spark_partition_id()))
    dealt = spread.join(named, same).withColumn("_file", F.pmod("_row", F.col("_files")))
    (dealt.repartition(tasks, *folders, "_file").sortWithinPartitions(*folders, *keys, *order).drop("_row", "_files", "_file", *[f"_k{i}" for i in range(len(folders))])
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).format(fmt).save(path))


def write_text_files(df: DataFrame, path: str, key: str, value: str, order: Sequence[str] = (), folders: int = FOLDERS) -> None:
    """One text file a key (NULL and empty keys share one), ``folder=<n>/<key column>=<key>.txt``, with the
    lines ``value`` of its rows in the order ``order``.

    A folder a key costs the driver a listing and a file a handful of process starts on file systems that
    set permissions by a command, so very many keys share ``folders`` folders and the tasks write the files
    themselves. Rows are streamed: a task holds one open file and one Arrow batch. A file takes its name by a
    rename once it is complete, and a task that runs again writes the same files, so readers see whole ones."""
    def opened():
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        store.create_dir(root, recursive=True)
        return store, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, root = opened()
        attempt = TaskContext.get().taskAttemptId()
        made, now, out, files = set(), None, None, 0
        names = "", ""

        def close():
            if out is not None:
                out.close()
                store.move(*names)

        for b in batches:
            for folder, k, line in zip(*(c.to_pylist() for c in b.columns)):
                if (folder, k) != now:
                    close()
                    now, own, files = (folder, k), f"{root}/folder={folder}", files + 1
                    if own not in made:
                        store.create_dir(own, recursive=True)
                        made.add(own)
                    names = f"{own}/.{attempt}-{files}.tmp", f"{own}/{key}={quote(k, safe=' -_.+,@()')}.txt"
                    out = store.open_output_stream(names[0], compression=None, buffer_size=1 << 16)
                out.write(f"{line or ''}\n".encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    opened()                                              # also of a table without rows there is a folder
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(value).alias("_value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = rows.withColumn("_folder", F.pmod(F.xxhash64("_key"), F.lit(folders)).cast("int"))
    (rows.repartition("_key").sortWithinPartitions("_folder", "_key", *[f"_o{i}" for i in range(len(order))])
     .select("_folder", "_key", "_value").mapInArrow(run, "files long").agg(F.sum("files")).collect())
