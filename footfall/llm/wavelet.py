"""Token files as wavelet matrices: one succinct, compressed file per shard.

A shard holds the token ids of consecutive documents as bit-planes, highest bit first; after each
plane the sequence is dealt stably by its bit, zeros first. With rank samples over the planes this
answers which token stands at a place (``access``), how often a token occurs up to a place
(``rank``, ``count``) and where its k-th occurrence is (``select``) from the one file.

File format (little endian, the whole zstd-compressed): magic ``WVM1``; uint64 documents, tokens,
planes; int64 document ids with a null flag byte each; uint64 end of each document; per plane uint64
zeros, the packed 64-bit words, uint32 ones before every 8th word.

Null and empty texts are one end id; a null document id sorts first; repeated ids and rows are encoded
each, in the order of their texts; a text of any length is one document of one shard. An empty table gives
no shard and no rows. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.bpe import END_ID, SLICE, piece_ids
from footfall.llm.common import Committer, batch, get, saved, tasks, work_dir
from footfall.llm.textops import text_slices

MAGIC = b"WVM1"
BLOCK = 8  # words between two rank samples


class WaveletMatrix:
    def __init__(self, words: list[np.ndarray], samples: list[np.ndarray], zeros: list[int], n: int):
        self.words, self.samples, self.zeros, self.n = words, samples, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray, planes: int | None = None) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        planes = planes or max(1, top.bit_length())
        if top >> planes:
            raise ValueError("an id needs more bits than there are planes")
        seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        words, samples, zeros = [], [], []
        for level in range(planes - 1, -1, -1):
            bit = (seq & seq.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            word = np.zeros((len(seq) + 63) // 64, np.uint64)
            word.view(np.uint8)[:len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.uint32)])
            words.append(word)
            samples.append(ones[::BLOCK].astype(np.uint32))
            if level:
                low = seq[~bit]
                zeros.append(len(low))
                seq = np.concatenate([low, seq[bit]])
            else:
                zeros.append(int(len(seq) - ones[-1]))
        return cls(words, samples, zeros, len(ids))

    def ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a plane before each place."""
        word, sample = self.words[plane], self.samples[plane]
        full = at >> 6
        total = sample[full // BLOCK].astype(np.int64)
        for k in range(BLOCK - 1):
            w = full // BLOCK * BLOCK + k
            use = w < full
            total += np.where(use, np.bitwise_count(word[np.minimum(w, len(word) - 1)]), 0) if len(word) else 0
        rest = (at & 63).astype(np.uint64)
        if len(word):
            last = word[np.minimum(full, len(word) - 1)] & ((np.uint64(1) << rest) - np.uint64(1))
            total += np.bitwise_count(last)
        return total

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64).copy()
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the shard")
        out = np.zeros(len(at), np.int64)
        for plane, word in enumerate(self.words):
            bit = (word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) if len(at) else np.zeros(0, np.uint64)
            before = self.ones(plane, at)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[plane] + before, at - before)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi, planes = 0, end, len(self.words)
        if token >> planes:
            return 0, 0
        for plane in range(planes):
            a, b = self.ones(plane, np.array([lo, hi])).tolist()
            if token >> (planes - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before a place."""
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, counted from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError("no such occurrence")
        at, planes = lo + k, len(self.words)
        for plane in range(planes - 1, -1, -1):
            one = token >> (planes - 1 - plane) & 1
            want = at - self.zeros[plane] if one else at
            a, b = 0, self.n  # smallest end with want + 1 such bits before it
            while a < b:
                mid = (a + b) // 2
                seen = int(self.ones(plane, np.array([mid + 1]))[0])
                if (seen if one else mid + 1 - seen) > want:
                    b = mid
                else:
                    a = mid + 1
            at = a
        return at

    def decode(self) -> np.ndarray:
        """All tokens, by undoing the deal of each plane from the last to the first."""
        seq = np.zeros(self.n, np.uint16 if len(self.words) <= 16 else np.uint32)
        planes = len(self.words)
        for plane in range(planes - 1, -1, -1):
            bit = np.unpackbits(self.words[plane].view(np.uint8), count=self.n, bitorder="little").view(bool)
            if plane < planes - 1:
                before = np.empty_like(seq)
                before[~bit] = seq[:self.zeros[plane]]
                before[bit] = seq[self.zeros[plane]:]
                seq = before
            seq |= bit.astype(seq.dtype) << seq.dtype.type(planes - 1 - plane)
        return seq


def to_bytes(matrix: WaveletMatrix, doc_ids: list, ends: np.ndarray) -> bytes:
    import zstandard
    parts = [MAGIC, np.array([len(doc_ids), matrix.n, len(matrix.words)], "<u8").tobytes(),
             np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), ends.astype("<u8").tobytes()]
    for word, sample, zeros in zip(matrix.words, matrix.samples, matrix.zeros):
        parts += [np.array([zeros], "<u8").tobytes(), word.astype("<u8").tobytes(), sample.astype("<u4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    if raw[:4] != MAGIC:
        raise ValueError("not a wavelet token file")
    docs, n, planes = np.frombuffer(raw, "<u8", 3, 4).tolist()
    at = 28
    ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    missing = raw[at + 8 * docs:at + 9 * docs]
    ends = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    size = (n + 63) // 64
    blocks = (size + 1 + BLOCK - 1) // BLOCK
    words, samples, zeros = [], [], []
    for _ in range(planes):
        zeros.append(int(np.frombuffer(raw, "<u8", 1, at)[0]))
        words.append(np.frombuffer(raw, "<u8", size, at + 8))
        samples.append(np.frombuffer(raw, "<u4", blocks, at + 8 + 8 * size))
        at += 8 + 8 * size + 4 * blocks
    return WaveletMatrix(words, samples, zeros, n), [None if m else i for i, m in zip(ids, missing)], ends


MANIFEST = "part long, shard long, file string, file_bytes long, file_sha256 string, docs long, tokens long"
_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("file_bytes", pa.int64()),
                       ("file_sha256", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, shard_tokens: int = 2_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order (a null id first; equal ids by text) and return the
    manifest, saved beside the shards. A shard ends with the document that reaches ``shard_tokens``.

    Null and empty texts are one end id. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = table.repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder, out, part = piece_ids(tokenizer), None, TaskContext.get().partitionId()
        planes = max(1, (len(coder.opens) - 1).bit_length())
        ids_of: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        number = 0

        def flush():
            nonlocal out, number
            out = out or Committer(shards)
            seq = np.concatenate(parts)
            put = out.put(f"{part:06d}-{number:05d}.wvm", to_bytes(WaveletMatrix.build(seq, planes), ids_of, np.cumsum(lengths)))
            row = {"part": part, "shard": number, "docs": len(ids_of), "tokens": len(seq)} | put
            number += 1
            for x in (ids_of, parts, lengths):
                x.clear()
            return batch({k: [v] for k, v in row.items()}, _MANIFEST)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, j, raw, off in text_slices(b.column(1), SLICE):
                ids, at = coder.encode(raw, off)
                # an end id after each document's ids
                n = j - i
                full = np.insert(ids, at[1:], END_ID)
                ends = at[1:] + np.arange(1, n + 1)
                done = 0
                while done < n:
                    base = ends[done - 1] if done else 0
                    room = shard_tokens - sum(len(x) for x in parts)
                    stop = min(n, int(np.searchsorted(ends, base + room)) + 1)
                    ids_of += doc_ids[i + done:i + stop]
                    lengths += np.diff(ends[done:stop], prepend=base).tolist()
                    parts.append(full[base:ends[stop - 1]])
                    done = stop
                    if sum(len(x) for x in parts) >= shard_tokens:
                        yield flush()
        if ids_of:
            yield flush()

    return saved(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Read the shards back: per document doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 of its ids as little-endian unsigned 32-bit integers, and its shard file."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # a row per task that wrote
    before, total = [], 0
    for r in parts:
        before.append((r.part, total))
        total += r.n
    spans = spark.createDataFrame(before, "part long, base long")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = (manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(spans, "part")
              .select("file", "file_sha256", (F.col("base") + F.col("inside")).alias("start")))
    shards = f"{folder}/shards"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard_file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sha, start in zip(*(c.to_pylist() for c in b.columns)):
                matrix, ids_of, ends = from_bytes(get(shards, name, sha))
                seq = matrix.decode().astype("<u4").view(np.uint8)
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(seq[4 * a:4 * e]) for a, e in zip(begin.tolist(), ends.tolist())]
                yield batch({"doc_id": ids_of, "start": begin + start, "n_tokens": ends - begin, "ids_crc32": crc, "shard_file": [name] * len(crc)}, schema)

    return (listed.repartition(tasks(spark), "file")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_file string"))


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids into wavelet files and read them back."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    write_tokens(docs, folder, tokenizer, **options)
    return read_tokens(spark, folder)
