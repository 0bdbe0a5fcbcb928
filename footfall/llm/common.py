"""Shared folder, committed files and small Arrow helpers of the llm operators."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables, under the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later jobs start from it, and a lost
    executor costs no earlier work."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column, k: int):
    """crc32 of an id written as text, modulo k (a null id counts as empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % k


def file_system(uri: str):
    """(file system, path) of a folder; a bare path is local, other schemes are those pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class Committer:
    """Writes whole files under names of one task attempt. A file takes its final name by a rename
    once it is complete; only files that a successful task lists in the manifest count, so a lost,
    retried or speculative attempt leaves nothing that a reader would take."""

    def __init__(self, uri: str):
        from pyspark import TaskContext
        self.fs, self.path = file_system(uri)
        self.attempt = TaskContext.get().taskAttemptId()
        self.fs.create_dir(self.path, recursive=True)

    def put(self, name: str, data: bytes) -> dict:
        final = f"{self.attempt}-{name}"
        temporary = f"{self.path}/.{final}.tmp"
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.path}/{final}")
        return {"file": final, "file_bytes": len(data), "file_sha256": hashlib.sha256(data).hexdigest()}


def get(uri: str, name: str, sha256: str | None = None) -> bytes:
    store, path = file_system(uri)
    with store.open_input_stream(f"{path}/{name}", compression=None) as source:
        data = source.read()
    if sha256 and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{name} differs from its manifest")
    return data


_CACHES: dict[str, list] = {}  # operator kind -> functions that clear its worker's caches
_OWNER = ""


def owns_worker(kind: str, *clear) -> None:
    """Called at the start of a task: a worker that goes on to another kind of operator drops what the
    one before kept between tasks."""
    global _OWNER
    if kind != _OWNER:
        for f in _CACHES.pop(_OWNER, []):
            f()
        _OWNER = kind
        relax()
    if clear:
        _CACHES[kind] = list(clear)


def relax() -> None:
    """Give memory that a finished slice or group has freed back to the system: workers live on
    between tasks, and what they keep counts against the executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
