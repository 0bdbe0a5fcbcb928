"""Publishing tables that others read while they are replaced.

A published table is a folder with the written parts under ``data/`` and numbered manifests beside them. A
new version is written completely into a folder of its own; then a manifest that lists the parts of the new
table takes its name by one rename. Readers follow the newest manifest, so a job that dies before the
rename leaves the table as it was, and nothing that a reader has open is deleted.

``replace_parts`` publishes only the partitions that the new rows hold (e.g. the days that changed): the
manifest keeps the others where they are. Two writers at once cannot take the same number: the second
one's rename finds it taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PATTERN = "manifest-%012d.json"


def _store(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def manifest(path: str) -> dict | None:
    """The newest manifest of a published table: its number, format, schema, partition column, parts and
    notes. None where nothing is published."""
    from pyarrow import fs
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    if not names:
        return None
    with store.open_input_stream(f"{root}/{names[-1]}") as source:
        return json.loads(source.read())


def _commit(path: str, number: int, content: dict) -> None:
    """Give a manifest its final name; fails if another writer took the number."""
    from pyarrow import fs
    store, root = _store(path)
    final = f"{root}/{PATTERN % number}"
    temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(json.dumps(content).encode())
    if store.get_file_info(final).type != fs.FileType.NotFound:
        raise RuntimeError(f"version {number} of {path} was published by another writer")
    store.move(temporary, final)


def publish(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet", replace_parts: bool = False,
            options: dict | None = None, notes: dict | None = None) -> int:
    """Write ``df`` as the next version of the table at ``path``; returns its number.

    With ``partition_by`` each value of that column is a part; with ``replace_parts`` the parts that the
    new rows do not hold stay those of the version before. ``notes`` are kept in the manifest (e.g. the
    last batch of a stream)."""
    spark = df.sparkSession
    before = manifest(path)
    version = f"data/{uuid.uuid4().hex[:16]}"
    target = f"{path.rstrip('/')}/{version}"
    writer = df.write.format(fmt).options(**(options or {}))
    if partition_by:
        # rows of a part together; a part with very many rows is split over tasks by its measured size
        writer = df.hint("rebalance", partition_by).write.format(fmt).options(**(options or {})).partitionBy(partition_by)
    writer.save(target)
    parts = {"": version} if not partition_by else {name: f"{version}/{name}" for name in _folders(target)}
    kept = dict(before["parts"]) if before and replace_parts and partition_by else {}
    number = before["number"] + 1 if before else 0
    _commit(path, number, {"number": number, "format": fmt, "options": options or {}, "schema": df.schema.json(), "partition_by": partition_by,
                           "parts": kept | parts, "notes": ((before or {}).get("notes") or {}) | (notes or {})})
    return number


def _folders(target: str) -> list[str]:
    from pyarrow import fs
    store, root = _store(target)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and "=" in f.base_name)


def _part_name(column: str, value) -> str:
    from urllib.parse import quote
    return f"{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else quote(str(value), safe=' -_.+,@()')}"


def read_published(spark: SparkSession, path: str, only: Iterable | None = None) -> DataFrame:
    """The newest version of a published table. ``only`` reads the parts of these partition values and
    opens no other. Columns come in the order in which they were written; a table that was never
    published raises FileNotFoundError."""
    now = manifest(path)
    if now is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    schema, column = StructType.fromJson(json.loads(now["schema"])), now["partition_by"]
    parts = now["parts"]
    if only is not None and column:
        wanted = {_part_name(column, v) for v in only}
        parts = {k: v for k, v in parts.items() if k in wanted}
    if not parts:
        return spark.createDataFrame([], schema)
    reader = lambda s: spark.read.format(now["format"]).options(**now["options"]).schema(s)
    root = path.rstrip("/")
    if not column:
        return reader(schema).load([f"{root}/{p}" for p in parts.values()])
    # parts of several versions: each is read below its own version, which gives the partition column
    by_version: dict[str, list[str]] = {}
    for p in parts.values():
        by_version.setdefault(p.rsplit("/", 1)[0], []).append(f"{root}/{p}")
    out = None
    for version, paths in sorted(by_version.items()):
        rows = reader(schema).option("basePath", f"{root}/{version}").load(paths).select(*[F.col(f"`{c}`") for c in schema.names])
        out = rows if out is None else out.unionByName(rows)
    return out


def versions(path: str) -> int:
    """In how many versions the parts of the newest manifest were written."""
    now = manifest(path)
    return len({p.split("/")[1] for p in now["parts"].values()}) if now else 0


def compact(spark: SparkSession, path: str) -> int:
    """Publish the table again as one version, where many small replacements have scattered its parts:
    a reader plans one scan a version."""
    now = manifest(path)
    return publish(read_published(spark, path), path, now["partition_by"], now["format"], options=now["options"])


def expire(path: str, keep: int = 10) -> list[str]:
    """Delete the versions that none of the newest ``keep`` manifests lists, and the manifests before them;
    returns the deleted versions. Run it when no reader is older than these manifests and no writer is at
    work: what a writer has written but not yet published is listed nowhere."""
    from pyarrow import fs
    store, root = _store(path)
    found = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))
    used = set()
    for name in found[-max(keep, 1):]:
        with store.open_input_stream(f"{root}/{name}") as source:
            used |= {p.split("/")[1] for p in json.loads(source.read())["parts"].values()}
    for name in found[:-max(keep, 1)]:
        store.delete_file(f"{root}/{name}")
    old = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/data")) if f.type == fs.FileType.Directory and f.base_name not in used)
    for version in old:
        store.delete_dir(f"{root}/data/{version}")
    return old
