"""Exact top-k by inner product over a bit-sliced index.

Every component of a vector is quantised to an integer. The index holds blocks of rows; in a block, bit b
of component c of all rows is one bitmap (a slice), taken from the component's least value on, so that a
slice index is as wide as the block's values. The score of a query is a weighted sum of components: each
weight is written in signed binary digits, and a digit 2^s adds the component's slices s places higher
(a negative digit adds their complements). All these bitmaps are summed by carry-save adders, 64 rows a
machine word, into the slices of the score.

Search first adds only the upper places: the places left out amount to at most 1/64 of the range, an
error that is known exactly. From the most significant score slice downward, the rows with a one are
taken as long as they are fewer than k, else the search goes on among them; this gives the k-th largest
rough score. Rows within the known error of it are the boundary rows; their exact scores are read from all
slices. Where a block has many boundary rows (copies of one vector), all places are added and the walk is
repeated exactly; of the rows that then still tie, the first by id fill the places.

The query rows are stored in chunks of at most CHUNK rows; each chunk is broadcast in turn and meets every
block. A task keeps k rows a query over all its blocks, and a window takes the best k of all tasks. Work
is queries x rows, whatever the data; nothing is pruned away that could be among the k.

Edge cases: vectors that are null, empty, hold a null or non-finite entry, or differ in length from most
take no part (`vectors`). Quantised entries beyond sqrt(2^62 / length) or an int count as that bound, so that scores fit a
long. A row never finds a row of its own id; a null id is never a query, and stands last among ties. Each
row of a repeated id is a query of its own. Ties go to the smaller id. Fewer candidates than k give fewer
rows. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import owns_worker, saved, work_dir
from footfall.llm.vectors import ids_of, matrix, of_one_length, usable

BLOCK_ROWS = 16384   # rows of a block: a slice of 2 KB stays in a core's cache
CHUNK = 8192         # queries broadcast at once
ROUGH = 64           # the first sum may leave out 1 / ROUGH of the range
FEW = 1024           # boundary rows of a block that are scored one by one
RESULT = "query_id long, rank int, vec_id long, score long"
_NULL_ID = np.iinfo(np.int64).max


class Block:
    """Slices of a block of rows, in ascending id order, null ids last."""

    def __init__(self, ids: np.ndarray, base: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.ids, self.base, self.width, self.slices = ids, base, width, slices
        self.first = np.concatenate([[0], np.cumsum(width)[:-1]])     # a component's first slice
        self.place = np.arange(len(slices)) - np.repeat(self.first, width)
        self.of = np.repeat(np.arange(len(width)), width)
        self.valid = bitmap(np.ones(len(ids), bool))

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order].astype(np.int64)
        base = values.min(0)
        above = (values - base).T
        width = np.array([int(x).bit_length() for x in above.max(1)], np.int64)
        rows = [bitmap(row >> b & 1) for row, w in zip(above, width) for b in range(w)]
        words = -(-len(ids) // 64)
        return cls(ids, base, width, np.stack(rows) if rows else np.zeros((0, words), np.uint64))

    def parts(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.ids, self.base, self.width, self.slices))

    @classmethod
    def of_parts(cls, ids: bytes, base: bytes, width: bytes, slices: bytes) -> Block:
        known = [np.frombuffer(x, np.int64) for x in (ids, base, width)]
        return cls(*known, np.frombuffer(slices, np.uint64).reshape(int(known[2].sum()), -(-len(known[0]) // 64)))


def bitmap(flags: np.ndarray) -> np.ndarray:
    """64 rows a word, the first row in the lowest bit."""
    packed = np.packbits(flags.astype(np.uint8), bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<u8")


def positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def signed_digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, place, negative) of the weights in non-adjacent form, which has the fewest digits."""
    out, left, place = [], query.astype(np.int64).copy(), 0
    while left.any():
        odd = left & 1
        digit = np.where(odd == 1, 2 - (left & 3), 0)
        at = np.flatnonzero(digit)
        out.append(np.stack([at, np.full(len(at), place), digit[at] < 0]))
        left, place = (left - digit) >> 1, place + 1
    return tuple(np.concatenate(out, 1).astype(np.int64)) if out else (np.zeros(0, np.int64),) * 3


class Query:
    """A query's terms in one block: which slice is added at which place, complemented or not."""

    def __init__(self, block: Block, query: np.ndarray, digits: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.block, self.query = block, query
        component, place, negative = digits
        width = block.width[component]
        edge = np.concatenate([[0], np.cumsum(width)])
        row = np.repeat(np.arange(len(component)), width)
        b = np.arange(edge[-1]) - edge[row]
        place = place[row] + b
        order = np.argsort(place, kind="stable")
        self.slice, self.place = (block.first[component[row]] + b)[order], place[order]
        self.flip = np.where(negative[row][order] == 1, ~np.uint64(0), np.uint64(0))
        self.many = np.bincount(self.place) if len(place) else np.zeros(0, np.int64)

    def cut(self) -> tuple[int, int]:
        """(lowest place of the rough sum, the most that the places below it can add)."""
        amount = np.cumsum([int(n) << p for p, n in enumerate(self.many)] or [0], dtype=object)
        low = 0
        while low < len(self.many) and amount[low] * ROUGH <= amount[-1]:
            low += 1
        return low, int(amount[low - 1]) if low else 0

    def total(self, low: int) -> list[np.ndarray]:
        """Slices of the sum of all terms at places from ``low`` on, the lowest first."""
        edge = np.searchsorted(self.place, np.arange(low, len(self.many) + 1))
        out, carried, p = [], [], low
        while p < len(self.many) or carried:
            stack = carried
            if p < len(self.many):
                at = slice(edge[p - low], edge[p - low + 1])
                stack = [*stack, self.block.slices[self.slice[at]] ^ self.flip[at, None]]
            here = np.concatenate(stack)
            carried = []
            while len(here) > 2:
                t = len(here) // 3
                a, b, c = here[:t], here[t:2 * t], here[2 * t:3 * t]
                x = a ^ b
                carried.append((a & b) | (x & c))
                here = np.concatenate([x ^ c, here[3 * t:]])
            if len(here) == 2:
                carried.append((here[0] & here[1])[None])
                here = (here[0] ^ here[1])[None]
            out.append(here[0] if len(here) else np.zeros_like(self.block.valid))
            p += 1
        return out

    def scores(self, at: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, from all slices."""
        block = self.block
        bits = block.slices[:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        weight = self.query[block.of] << block.place
        return weight @ bits.astype(np.int64) + int(self.query @ block.base)

    def best(self, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k largest scores among the rows of other ids, ties by row."""
        block = self.block
        allowed = block.valid
        a, b = np.searchsorted(block.ids, [own_id, own_id + 1])
        if b > a:
            allowed = allowed.copy()
            for row in range(a, b):
                allowed[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        at = self._boundary(allowed, k)
        score = self.scores(at)
        top = np.lexsort((at, -score))[:k]
        return at[top], score[top]

    def _boundary(self, allowed: np.ndarray, k: int) -> np.ndarray:
        if ones(allowed) <= k:
            return positions(allowed)
        low, error = self.cut()
        total = self.total(low)
        sure, tied, least = largest(total, allowed, k)
        if error:
            rough = at_least(total, allowed, -(-max(0, (least << low) - error) >> low))
            if ones(rough) <= FEW:
                return positions(rough)
            sure, tied, _ = largest(self.total(0), allowed, k)
        found = positions(sure)
        return np.concatenate([found, positions(tied)[:k - len(found)]])


def largest(total: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Walk from the most significant slice down: (rows above the k-th largest value, rows that have it,
    that value)."""
    sure, tied, need, value = np.zeros_like(among), among, k, 0
    for s in reversed(total):
        one = tied & s
        n = ones(one)
        value <<= 1
        if n >= need:
            tied, value = one, value | 1
        else:
            sure, tied, need = sure | one, tied & ~s, need - n
    return sure, tied, value


def at_least(total: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
    """Rows whose value is at least ``value``."""
    above, same = np.zeros_like(among), among
    for p in range(len(total) - 1, -1, -1):
        if value >> p & 1:
            same = same & total[p]
        else:
            above, same = above | (same & total[p]), same & ~total[p]
    return (above | same) if value >> len(total) == 0 else np.zeros_like(among)


def _build(d: int):
    schema = pa.schema([(n, pa.binary()) for n in ("ids", "base", "width", "slices")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("bits")
        held, n = [], 0

        def block() -> pa.RecordBatch:
            made = Block.build(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made.parts()], schema=schema)

        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                piece = b.slice(i, BLOCK_ROWS)
                held.append((ids_of(piece.column(0))[0], matrix(piece.column(1), d)))
                n += piece.num_rows
                if n > 2 * BLOCK_ROWS:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return run


def _search(queries, k: int):
    schema = pa.schema([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("bits")
        own, vectors = queries.value
        digits = [signed_digits(v) for v in vectors]
        held: list[list[tuple[int, int]]] = [[] for _ in own]
        met = False
        for b in batches:
            for ids, base, width, slices in zip(*(b.column(c) for c in range(4))):
                block, met = Block.of_parts(ids.as_py(), base.as_py(), width.as_py(), slices.as_py()), True
                for q, (own_id, v) in enumerate(zip(own.tolist(), vectors)):
                    at, score = Query(block, v, digits[q]).best(own_id, k)
                    held[q] = sorted([*held[q], *zip((-score).tolist(), block.ids[at].tolist())])[:k]
        if met:
            rows = [(q, own_id, None if x == _NULL_ID else x, -s) for q, own_id in enumerate(own.tolist()) for s, x in held[q]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def top_k(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest integer inner products of every row whose id is divisible by ``every`` with all
    rows of other ids; entries are floor(scale * x)."""
    spark = df.sparkSession
    asks = F.col("vec_id") % every == 0
    rows, d, n, n_queries = of_one_length(usable(df, id_col, vector_col), asks)
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    folder = work_dir(spark, "bit-sliced")
    limit = float(min(int((2**62 / d) ** 0.5), 2**31 - 1))
    entry = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(limit)), F.lit(-limit))).cast("int")
    rows = rows.select("vec_id", F.transform("v", entry).alias("v"))
    index = saved(rows.repartition(-(-n // BLOCK_ROWS)).mapInArrow(_build(d), "ids binary, base binary, width binary, slices binary"), f"{folder}/index")
    chunks = -(-n_queries // CHUNK)
    asked = rows.where(asks).repartition(chunks).withColumn("chunk", F.spark_partition_id())
    asked.write.partitionBy("chunk").parquet(f"{folder}/queries")
    asked = spark.read.schema("vec_id long, v array<int>, chunk int").parquet(f"{folder}/queries")
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    done = []
    for c in range(chunks):
        part = asked.where(F.col("chunk") == c).select("vec_id", "v").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        column = lambda name: pa.concat_arrays(part.column(name).chunks)
        shared = spark.sparkContext.broadcast((ids_of(column("vec_id"))[0], matrix(column("v"), d).astype(np.int64)))
        hits = index.mapInArrow(_search(shared, k), "query int, query_id long, vec_id long, score long")
        (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/top/part={c}"))
        shared.unpersist()
        done.append(f"{folder}/top/part={c}")
    return spark.read.schema(RESULT).parquet(*done)
