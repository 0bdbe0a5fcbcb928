"""WARC archives: deterministic shards, rolled files, regenerated headers and digests, safe commit.

Records are dealt by ranges of page id that follow from the data alone (counts of bytes per cell of
the id range, refined where a cell is too full), and sorted within a range; so the same table gives
the same archives whatever the cluster. A writer streams its range, compresses each record as its
own gzip member and starts a new file once the file reaches the size limit. Files are written under
temporary names, renamed when complete and listed in a manifest that is saved last; the reader takes
only what the manifest lists and checks digests and lengths.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page id is
a response; the others are revisits that refer to it. Null html is an empty payload, a null url an
empty one; a null page id sorts first and has an empty record name; of repeated ids with one payload
the first is the response. An empty table gives an empty manifest and no records. Other columns are
ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import Committer, batch, get, saved, tasks, work_dir

MIN_REVISIT = 100
CELLS = 1024  # cells of an id range that one pass counts
REFINED = 64  # cells that one pass counts again
MOST_RANGES = 100_000  # tasks of the writer; a range is sorted and written as a stream
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
DATE = "2000-01-01T00:00:00Z"  # the tables have no crawl time; a fixed one keeps archives equal


def id_ranges(sizes: DataFrame, target: int) -> list[int]:
    """Upper bounds of id ranges with about ``target`` bytes each, from (page_id, bytes).

    Counts bytes in equal cells of the id range; a cell with more than the target is counted again
    in finer cells, REFINED such cells a pass, until all cells fit or hold one id. At most CELLS rows
    come to the driver for each range that a pass refines.
    """
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    todo, waiting, cells = [(low, high)], [], []
    while todo:
        cell = F.lit(None).cast("struct<k:int,c:long>")
        for k, (a, b) in enumerate(todo):
            step = max(1, -(-(b - a + 1) // CELLS))
            cell = F.when(F.col("page_id").between(a, b), F.struct(F.lit(k).alias("k"), ((F.col("page_id") - a) / step).cast("long").alias("c"))).otherwise(cell)
        rows = sizes.select(cell.alias("cell"), "bytes").where("cell is not null").groupBy("cell").agg(F.sum("bytes").alias("n")).collect()
        again = []
        for r in rows:
            a, b = todo[r.cell.k]
            step = max(1, -(-(b - a + 1) // CELLS))
            lo = a + r.cell.c * step
            span = (lo, min(b, lo + step - 1))
            if r.n > target and step > 1:
                again.append(span)
            else:
                cells.append((*span, r.n))
        waiting += again
        todo, waiting = waiting[:REFINED], waiting[REFINED:]
    bounds, total = [], 0
    for _, b, n in sorted(cells):
        if total and total + n > target:
            bounds.append(last)
            total = 0
        total, last = total + n, b
    return bounds


def range_of(bounds: list[int]):
    """Column function: number of the range that an id falls into (at most MOST_RANGES bounds)."""
    upper = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(upper, ids.to_numpy(), "left").astype(np.int32))

    return place


def record(page_id, url: str, payload: bytes, refers_to, digest: str) -> bytes:
    """One WARC record; a revisit has the headers of the full payload and no body."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
             f"WARC-Block-Digest: sha256:{EMPTY_DIGEST if revisit else digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of an archive file."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        raw = member.decompress(view[at:])
        at = len(data) - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not member.eof or lines[0] != "WARC/1.1":
            raise ValueError("damaged WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("record length differs from its header")
        yield headers, rest[:size]


MANIFEST = "part long, number long, file string, file_bytes long, file_sha256 string, records long"
_MANIFEST = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("file_bytes", pa.int64()), ("file_sha256", pa.string()), ("records", pa.int64())])


def write_warc(pages: DataFrame, folder: str, file_bytes: int = 8 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages and return the manifest, saved beside the archives."""
    spark = pages.sparkSession
    table = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                         F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digests = saved(table.select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes")), f"{folder}/digests")
    # equal payloads: partial sums before the shuffle, so a payload of very many pages is one row a task
    shared = (digests.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "first_id"))
    marks = (digests.where(F.col("bytes") >= MIN_REVISIT).select("page_id", "digest").join(shared, "digest")
             .groupBy("page_id", "digest").agg(F.min("first_id").alias("first_id")))
    total = digests.agg(F.sum("bytes")).first()[0] or 0
    bounds = id_ranges(digests, max(range_bytes, total // MOST_RANGES))
    place = range_of(bounds)(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))))
    pieces = (table.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first_id"))
              .unionByName(marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first_id")))
    # a mark (kind 0) precedes its page in a range's order, so the writer streams
    dealt = (pieces.withColumn("place", place).repartition(max(tasks(spark), len(bounds) + 1), "place")
             .sortWithinPartitions("place", "page_id", "kind", "payload", "url"))
    archives = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, buffer, size, records, part, number = None, [], 0, 0, None, 0
        marked: dict[str, int] = {}
        marked_id, written = None, set()

        def flush():
            nonlocal out, size, records, number
            out = out or Committer(archives)
            row = {"part": part, "number": number, "records": records} | out.put(f"{part:06d}-{number:05d}.warc.gz", b"".join(buffer))
            buffer.clear()
            size, records, number = 0, 0, number + 1
            return batch({k: [v] for k, v in row.items()}, _MANIFEST)

        for b in batches:
            for page_id, kind, url, payload, digest, first_id, at in zip(*(c.to_pylist() for c in b.columns)):
                if at != part:
                    if records:
                        yield flush()
                    part, number = at, 0
                if page_id != marked_id or not (marked or written):
                    marked, written, marked_id = {}, set(), page_id
                if kind == 0:
                    marked[digest] = first_id
                    continue
                digest = hashlib.sha256(payload).hexdigest()
                first = marked.get(digest)
                refers_to = first if first is not None and (first != page_id or digest in written) else None
                written.add(digest) if first is not None else None
                member = gzip.compress(record(page_id, url, payload, refers_to, digest), 6, mtime=0)
                buffer.append(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    yield flush()
        if records:
            yield flush()

    return saved(dealt.mapInArrow(run, MANIFEST), f"{folder}/manifest")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the committed archives; digests are computed from the blocks read and
    compared with the headers; html is null for revisits."""
    archives = f"{folder}/archives"

    def number(name: str):
        return int(x) if (x := name.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sha in zip(*(c.to_pylist() for c in b.columns)):
                rows: dict[str, list] = {f.name: [] for f in _ROWS}
                for headers, block in parse(get(archives, name, sha)):
                    revisit = headers["WARC-Type"] == "revisit"
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    if not revisit and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, size):
                        raise ValueError("payload differs from its digest")
                    for k, v in (("page_id", number(headers["WARC-Record-ID"])), ("payload_bytes", size), ("payload_digest", digest), ("record_type", "revisit" if revisit else "response"),
                                 ("refers_to", number(headers["WARC-Refers-To"]) if revisit else None), ("url", headers["WARC-Target-URI"]), ("html", None if revisit else block.decode())):
                        rows[k].append(v)
                    if len(rows["page_id"]) == 500:
                        yield batch(rows, _ROWS)
                        rows = {k: [] for k in rows}
                yield batch(rows, _ROWS)

    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "file_sha256")
    return listed.repartition(tasks(spark), "file").mapInArrow(run, ROWS)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages as WARC and read the archives back."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder)
