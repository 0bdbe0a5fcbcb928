"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle windows, exact links.

A document is the set of its distinct 5-word shingles; documents with equal sets are one class. Two
classes link when 100 * intersection >= 75 * union, that is at Jaccard distance 0.25 at most.

Classes without a partner go first, exactly: a linked class shares at least 3 in 4 of its shingles
with other classes, and the number of classes of every shingle is counted (an exchange of packed,
sorted hashes between slices and parts; hashes are cut short there, which can only count too many).

Pivots. Of a class's shingles in the order of rarity, the first quarter and one more must meet those
of every partner, so each such shingle is a seed. The class with the commonest content among those
that a seed touches is the seed's pivot, and a class belongs to the region of each of its pivots: its
Voronoi cells, where ties and the classes near a border are in all the cells that they touch. Any two
linked classes share a seed, hence a region. Inside a region the distances to the pivot are known,
and by the triangle inequality a class can only link within 0.25 of its own distance; classes whose
window holds nothing but their own component need no comparison. A region that is too large for a
task first links its members to the pivot in a distributed join; the members that do not link are
then compared, in blocks of bounded size, with blocks of all members inside their windows.

Links are exact by set intersection of 64-bit shingle hashes. Regions give spanning edges, never all
pairs; components come from alternating stars. Null or wordless texts have empty sets and no links;
texts of fewer words are one shingle; repeated rows and copies are one class; a null id counts last
in a component. An empty table gives no rows; other columns pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from footfall.llm.common import Committer, get, owns_worker, relax, saved, tasks, work_dir
from footfall.llm.graph import components
from footfall.llm.lm import pack, ranges_of, unpack
from footfall.llm.quality_rules import docs_type
from footfall.llm.suffix_dedup import column, packed, read_slice, slice_file, unpacked
from footfall.llm.textops import LOWER, hash_spans, mix, shingle_hashes, text_bytes, text_slices, words

N = 5
PERCENT = 75
REACH = 1 - PERCENT / 100 + 1e-9
SLICE_BYTES = 4 << 20
PART_KEYS = 1 << 20  # shingles of slices that one part of the counts exchange holds, about
REGION_SHINGLES = 4 << 20  # a region beyond either bound is joined in blocks
REGION_DOCS = 4096


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles by text and hash, first shingle of each text, class of each text)."""
    n = len(off) - 1
    low = LOWER[raw]
    starts, ends, first = words(low, off)
    word = hash_spans(low, starts, ends)
    shingle, text = shingle_hashes(word, first, N)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < N))
    whole = np.zeros(len(few), np.uint64)
    for k in range(N - 1):
        has = count[few] > k
        whole[has] = mix(whole[has] + word[first[few][has] + k] + np.uint64(k + 1))
    shingle, text = np.concatenate([shingle, mix(whole)]), np.concatenate([text, few])
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, text = shingle[new], text[new]
    at = np.searchsorted(text, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    cls = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64)))
    return shingle, at, cls


def distinct_classes(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first text of each non-empty class of a slice."""
    _, leader = np.unique(cls, return_index=True)
    return np.sort(leader[np.diff(at)[leader] > 0])


def gathered(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of some rows of a ragged array, and the row of each."""
    size = at[rows + 1] - at[rows]
    end = np.cumsum(size)
    source = np.repeat(at[rows] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    return values[source], np.repeat(rows, size)


def short_counts(shingle: np.ndarray, at: np.ndarray, cls: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shortened shingles of a slice's classes, sorted, and the classes that have each."""
    own, _ = gathered(shingle, at, distinct_classes(cls, at))
    return np.unique(own >> np.uint64(64 - bits), return_counts=True)


ASK = "part int, slice long, file string, keys binary, counts binary"
_ASK = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("file", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = "slice long, file string, part int, counts binary"
_ANSWER = pa.schema([("slice", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("counts", pa.binary())])


def send_shingles(docs: DataFrame, folder: str, bits: int, parts: int, slice_bytes: int) -> DataFrame:
    """Write slice files and send each slice's distinct shingles to the parts of their range."""
    at_text = docs.columns.index("text")
    part_bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        owns_worker("shingles")
        out, number = None, TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j, raw, off in text_slices(b.column(at_text), slice_bytes):
                out = out or Committer(folder)
                put = out.put(f"{number}.slice", slice_file(b.slice(i, j - i), {}))
                keys, counts = short_counts(*shingle_sets(raw, off), bits)
                own, cut = ranges_of(keys, bits, part_bits)
                rows = [(p, pack(np.diff(keys[a:e], prepend=np.uint64(0))), packed(counts[a:e].astype(np.uint32))) for p, a, e in zip(own, cut, cut[1:])]
                rows.append((-1 - number % 16, None, None))  # announces a slice without shingles
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([put["file"]] * len(rows), pa.string()),
                                                  pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=_ASK)
                number += 1
            relax()

    return docs.mapInArrow(run, ASK)


def count_code(n: np.ndarray) -> np.ndarray:
    """A byte that grows with a count: exact below 128, by eighths of a power of two above."""
    return np.where(n < 128, n, np.minimum(127 + np.ceil(8 * np.log2(np.maximum(n, 127) / 127)), 255)).astype(np.uint8)


def total_counts(t: pa.Table) -> pa.Table:
    rows = [r for r in t.to_pylist() if r["keys"] is not None]
    if not rows:
        return pa.Table.from_arrays([t["slice"].combine_chunks(), t["file"].combine_chunks(), t["part"].combine_chunks(), pa.array([None] * t.num_rows, pa.binary())], schema=_ANSWER)
    keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]))
    states = np.split(count_code(n)[inverse], np.cumsum([len(k) for k in keys])[:-1])
    relax()
    return pa.Table.from_arrays([pa.array([r["slice"] for r in rows], pa.int64()), pa.array([r["file"] for r in rows], pa.string()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([packed(s) for s in states], pa.binary())], schema=_ANSWER)


ROWS = "slice long, file string, place int, {id}, n long, cls long, own int, seeds array<long>, shared binary"


def describe(answers: DataFrame, folder: str, bits: int, kind: str, id_type: pa.DataType) -> DataFrame:
    """A row per document (place not null) and a row per active class (place null) of each slice.

    An active class has seeds (its rarest shingles that other classes have), its shared shingles and
    the per mille of shingles that it has alone.
    """
    schema = pa.schema([("slice", pa.int64()), ("file", pa.string()), ("place", pa.int32()), ("doc_id", id_type), ("n", pa.int64()), ("cls", pa.int64()), ("own", pa.int32()), ("seeds", pa.list_(pa.int64())), ("shared", pa.binary())])
    # a slice's answers are small but its work is not: an explicit number of tasks is kept as it is
    by_slice = answers.repartition(tasks(answers.sparkSession), "slice").groupBy("slice").agg(F.min("file").alias("file"), F.array_sort(F.collect_list(F.when(F.col("counts").isNotNull(), F.struct("part", "counts")))).alias("answers"))  # a row per part of a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, file, got in zip(*(c.to_pylist() for c in b.columns)):
                documents, _ = read_slice(get(folder, file))
                raw, off = text_bytes(column(documents, "text"))
                shingle, at, cls = shingle_sets(raw, off)
                size = np.diff(at)
                rows = len(size)
                yield pa.RecordBatch.from_arrays([pa.array([number] * rows, pa.int64()), pa.array([file] * rows, pa.string()), pa.array(np.arange(rows, dtype=np.int32)), column(documents, "doc_id").cast(id_type), pa.array(size),
                                                  pa.array(cls.view(np.int64), mask=size == 0), *(pa.nulls(rows, schema.field(k).type) for k in ("own", "seeds", "shared"))], schema=schema)
                keys, _ = short_counts(shingle, at, cls, bits)
                code = np.concatenate([unpacked(x["counts"], np.uint8) for x in got] or [np.zeros(0, np.uint8)])
                texts = distinct_classes(cls, at)
                values, owner = gathered(shingle, at, texts)
                c = code[np.searchsorted(keys, values >> np.uint64(64 - bits))]
                n_shared = np.bincount(owner[c > 1], minlength=rows)
                active = texts[100 * n_shared[texts] >= PERCENT * size[texts]]
                if not len(active):
                    continue
                live = np.isin(owner, active)
                values, owner, c = values[live], owner[live], c[live]
                order = np.lexsort((values, c, owner))
                rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], "left")
                prefix = size[owner[order]] * (100 - PERCENT) // 100 + 1
                seed = order[(rank < prefix) & (c[order] > 1)]
                seeds = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[seed], np.append(active, rows)), pa.int32()), pa.array(values[seed].view(np.int64)))
                many = c > 1
                cut = np.searchsorted(owner[many], np.append(active, rows))
                kept = values[many]
                m = len(active)
                relax()
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, id_type), pa.array(size[active]), pa.array(cls[active].view(np.int64)),
                                                  pa.array((1000 * (1 - n_shared[active] / size[active])).astype(np.int32)), seeds, pa.array([kept[a:e].tobytes() for a, e in zip(cut, cut[1:])], pa.binary())], schema=schema)

    return by_slice.mapInArrow(run, ROWS.format(id=f"doc_id {kind}"))


def linked(inter: np.ndarray, n: np.ndarray, m) -> np.ndarray:
    return 100 * inter >= PERCENT * (n + m - inter)


class Postings:
    """Which of some sets hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.count = len(sets)

    def overlaps(self, values: np.ndarray) -> np.ndarray:
        """Shingles that each set has in common with the values."""
        if not len(self.keys):
            return np.zeros(self.count, np.int64)
        k = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        k = k[self.keys[k] == values]
        owners, _ = gathered(self.owner, self.first, k)
        return np.bincount(owners, minlength=self.count)


def join_region(cls: np.ndarray, n: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges of a region's links; exact. The pivot is the class with the commonest content."""
    m = len(cls)
    order = np.lexsort((cls, own))
    label = np.arange(m)
    postings = Postings(sets)
    pivot = int(order[0])

    def link(u: int, inter: np.ndarray) -> None:
        near = np.unique(label[linked(inter, n, n[u])])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]

    inter = postings.overlaps(sets[pivot])
    far = 1 - inter / (n + n[pivot] - inter)
    link(pivot, inter)
    by_far = np.argsort(far, kind="stable")
    sorted_far = far[by_far]
    for u in order[1:].tolist():
        if (label == label[0]).all():
            break
        window = by_far[np.searchsorted(sorted_far, far[u] - REACH, "left"):np.searchsorted(sorted_far, far[u] + REACH, "right")]
        if (label[window] == label[u]).all():
            continue  # nothing new within reach
        link(u, postings.overlaps(sets[u]))
    return [(int(cls[k]), int(cls[label[k]])) for k in range(m) if label[k] != k]


EDGES = "u long, v long"


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Rows of sorted batches by runs of equal first columns."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if held:
                    yield held
                held, key = [], row[:keys]
            held.append(row)
    if held:
        yield held


def small_regions(members: DataFrame) -> DataFrame:
    """Edges of regions that fit a task, from rows (region, cls, n, own, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in streamed(batches, 1):
            if len(rows) > 1:
                _, cls, n, own, shared = zip(*rows)
                out += join_region(np.array(cls), np.array(n), np.array(own), [np.frombuffer(x, np.uint64) for x in shared])
            if len(out) > 50_000:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    dealt = members.select("region", "cls", "n", "own", "shared").repartition(tasks(members.sparkSession), "region").sortWithinPartitions("region", "cls")
    return dealt.mapInArrow(run, EDGES)


def to_pivot(members: DataFrame, salts: int) -> DataFrame:
    """(region, cls, n, shared, far, near) of members of large regions: distance to the pivot and
    whether they link to it. The pivot's set goes to a few salted shares of its region."""
    pivots = members.where("cls = region").select("region", F.col("n").alias("pivot_n"), F.col("shared").alias("pivot")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = members.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(salts)).cast("int")).join(pivots, ["region", "salt"])
    schema = pa.schema([("region", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("far", pa.float64()), ("near", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            inter = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64), assume_unique=True)) for x, p in zip(b.column(3).to_pylist(), b.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(1 - inter / (n + m - inter)), pa.array(linked(inter, n, m))], schema=schema)

    return both.select("region", "cls", "n", "shared", "pivot_n", "pivot").mapInArrow(run, "region long, cls long, n long, shared binary, far double, near boolean")


def block_links(placed: DataFrame, block_shingles: int) -> DataFrame:
    """Edges between the members that are not linked to their pivot and all members of a region.

    Both sides are cut into blocks of bounded size; a cell holds one block of each, compares inside
    the windows and gives spanning edges."""
    sizes = (placed.groupBy("region").agg(F.sum("n").alias("all_n"), F.sum(F.when(~F.col("near"), F.col("n"))).alias("query_n"))
             .where("query_n > 0").select("region", F.ceil(F.col("all_n") / block_shingles).cast("int").alias("blocks"), F.ceil(F.col("query_n") / block_shingles).cast("int").alias("query_blocks")))
    rows = placed.join(sizes, "region")
    own = lambda k: F.pmod(F.xxhash64("cls"), F.col(k)).cast("int")
    queries = rows.where(~F.col("near")).select("region", own("query_blocks").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("m"), F.lit(0).alias("kind"), "cls", "n", "far", "shared")
    everyone = rows.select("region", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), own("blocks").alias("m"), F.lit(1).alias("kind"), "cls", "n", "far", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, postings, label = None, [], None, {}

        def find(x):
            while label.setdefault(x, x) != x:
                label[x] = x = label[label[x]]
            return x

        for b in batches:
            out = []
            for region, q, m, kind, cls, n, far, shared in zip(*(c.to_pylist() for c in b.columns)):
                if (region, q, m) != cell:
                    cell, asked, postings, label = (region, q, m), [], None, {}
                values = np.frombuffer(shared, np.uint64)
                if kind == 0:
                    asked.append((cls, n, far, values))
                    continue
                if not asked:
                    continue
                if postings is None:
                    postings = Postings([x[3] for x in asked])
                    ids, sizes_, fars = np.array([x[0] for x in asked]), np.array([x[1] for x in asked]), np.array([x[2] for x in asked])
                inter = postings.overlaps(values)
                for other in ids[linked(inter, sizes_, n) & (np.abs(fars - far) <= REACH) & (ids != cls)].tolist():
                    a, c = find(cls), find(other)
                    if a != c:
                        label[max(a, c)] = min(a, c)
                        out.append((cls, other))
            yield edge_batch(out)

    dealt = queries.unionByName(everyone).repartition(tasks(placed.sparkSession), "region", "q", "m").sortWithinPartitions("region", "q", "m", "kind", "cls")
    return dealt.mapInArrow(run, EDGES)


def classes_and_links(docs: DataFrame, slice_bytes: int = SLICE_BYTES, part_keys: int = PART_KEYS, region_docs: int = REGION_DOCS, region_shingles: int = REGION_SHINGLES) -> tuple[DataFrame, DataFrame, str]:
    """(rows of documents with their class, links as (u, v) of classes, folder of the slice files)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "shingles")
    slices = f"{folder}/slices"
    total = docs.count()
    bytes_ = (docs.select(F.octet_length("text").alias("n")).sample(min(1.0, 20_000 / max(total, 1)), seed=3).agg(F.avg("n")).first()[0] or 0) * total
    shingles = int(bytes_ / 6) + 1
    parts = 1 << (shingles // part_keys).bit_length()
    bits = min(64, max(32, shingles.bit_length() + 13))
    answers = saved(send_shingles(docs, slices, bits, parts, slice_bytes).groupBy("part").applyInArrow(total_counts, ANSWER), f"{folder}/counts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(describe(answers, slices, bits, kind, docs_type(docs)), f"{folder}/rows")
    documents = rows.where("place IS NOT NULL").select("slice", "file", "place", "doc_id", "n", "cls")
    # the same class of several slices has one set, size and seeds
    active = rows.where("place IS NULL").groupBy("cls").agg(F.first("n").alias("n"), F.max("own").alias("own"), F.first("seeds").alias("seeds"), F.first("shared").alias("shared"))
    active = saved(active, f"{folder}/active")
    seeds = active.select("cls", "own", F.explode("seeds").alias("seed"))
    pivots = seeds.groupBy("seed").agg(F.min(F.struct("own", "cls")).alias("pivot"), F.count("*").alias("k")).where("k > 1").select("seed", F.col("pivot.cls").alias("region"))
    cells = saved(seeds.select("cls", "seed").join(pivots, "seed").select("region", "cls").distinct(), f"{folder}/cells")
    sized = cells.join(active.select("cls", "n"), "cls").groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    regions = saved(sized.select("region", ((F.col("k") > region_docs) | (F.col("s") > region_shingles)).alias("large")), f"{folder}/regions")
    members = cells.join(regions, "region").join(active.select("cls", "n", "own", "shared"), "cls")
    edges = small_regions(members.where("NOT large"))
    if regions.where("large").limit(1).count():
        placed = saved(to_pivot(members.where("large"), tasks(spark)), f"{folder}/placed")
        direct = placed.where("near AND cls <> region").select(F.col("cls").alias("u"), F.col("region").alias("v"))
        edges = edges.unionByName(direct).unionByName(block_links(placed, region_shingles))
    return documents, saved(edges, f"{folder}/edges"), slices


def with_components(documents: DataFrame, links: DataFrame) -> DataFrame:
    """The documents' rows with component_id, the smallest doc_id of the component, and label, the
    component itself: its smallest class, whatever its ids (null without shingles)."""
    labels = components(links)
    named = documents.join(labels, documents["cls"] == labels["node"], "left").drop("node")
    named = named.withColumn("label", F.coalesce("label", "cls"))
    first = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "label", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    documents, links, _ = classes_and_links(docs.select("doc_id", "text"), **options)
    return with_components(documents, links).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns."""
    documents, links, slices = classes_and_links(docs, **options)
    named = saved(with_components(documents, links).drop("component_id"), work_dir(docs.sparkSession, "components"))
    # by component, not by its id: ids may repeat or be null; a null id sorts after every other
    best = named.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "slice", "place", "file")).alias("b"))
    # documents without shingles all stay
    stay = (best.select("b.slice", "b.file", "b.place")
            .unionByName(named.where("label IS NULL").select("slice", "file", "place")))
    listed = stay.repartition(tasks(docs.sparkSession), "slice").groupBy("slice").agg(F.min("file").alias("file"), F.array_sort(F.collect_list("place")).alias("places"))  # rows of one slice
    kinds = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, file, places in zip(*(c.to_pylist() for c in b.columns)):
                documents, _ = read_slice(get(slices, file))
                kept = documents.take(pa.array(places))
                yield from (x.cast(kinds) for x in kept.to_batches(max_chunksize=1000))

    return listed.mapInArrow(run, docs.schema)
