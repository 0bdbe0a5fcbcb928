"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier goes.

All suffixes of all texts are too many to sort at scale, so only sampled ones take part, in a way that
loses no match. Each 100-byte window points to the suffix inside it whose first 32 bytes have the
smallest hash (the leftmost of equals); equal windows point to the same place of themselves. A
sampled suffix with the run of windows that point to it is ordered by three leading tokens: its first
LEAD bytes as they are (big-endian, so in the suffixes' own order), the hash of its first 32 bytes, and
the hash of its whole run. Splitters sampled from the documents range-partition the suffixes by these
tokens; a bucket sorts its suffixes by multikey quicksort (only ties of a token go on to the next one,
the last being the text's place) and compares neighbours: of equal runs all but the first are removed
whole. Runs that share only 32 bytes are undecided; so are runs whose 32 bytes stand at a bucket's
boundary, where the neighbour is in another bucket. Their single windows are then partitioned, sorted
and compared in the same way, by 96-bit hashes of their bytes: that is the comparison across boundaries.

Hot content: a slice of texts sends each distinct token pair once, so a passage or a copy that very
many texts hold is one row per slice; nothing is dealt by text content alone, and a hot token
is split by the next. Texts are read once and written as slice files in the shared folder, which
later passes read; what is shuffled are packed arrays of tokens.

Order is by id (a null first), then start; of repeated ids by slice and row. Null texts are empty,
texts under 100 bytes lose nothing, any longer text is cut into blocks of windows; an empty table
gives no rows. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from footfall.llm.common import Committer, get, owns_worker, relax, saved, tasks, work_dir
from footfall.llm.textops import hash_spans, mix, per_text, runs, slices, text_bytes, text_slices

LENGTH = 100
GRAM = 32
LEAD = 4
BLOCK = 1 << 17  # windows of one step, which bounds a task's arrays
SLICE_BYTES = 4 << 20
PART_KEYS = 1 << 19  # token pairs of one bucket, about
SAMPLE_DOCS = 500
KEYS_PER_RANGE = 16  # sampled suffixes that one range stands for at least
UNIQUE, GONE, UNDECIDED = 0, 1, 2


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the 32 bytes from each of the first n places (zeros behind the end)."""
    x = np.zeros(n + GRAM, np.uint64)
    size = min(len(raw), n + GRAM)
    x[:size] = raw[:size]
    for shift in (1, 2, 4):
        x = x[:-shift] | x[shift:] << np.uint64(8 * shift)
    for shift, factor in ((8, 0x9E3779B97F4A7C15), (16, 0xBF58476D1CE4E5B9)):
        x ^= x >> np.uint64(29)
        x *= np.uint64(factor)
        x = (x[:-shift] ^ (x[:-shift] >> np.uint64(32))) + x[shift:]
    return mix(x[:n])


def sampled(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, leading bytes, hash of 32 bytes, hash of the run) of each sampled
    suffix of some texts.

    Blocks of windows bound the arrays; a run that a block's end cuts is two runs, which only leaves
    more to the second comparison.
    """
    out = []
    size = np.diff(off)
    text = 0
    while text < len(size):
        # whole texts of a block, or a block of one long text
        stop = max(text + 1, int(np.searchsorted(off, off[text] + BLOCK, "right")) - 1)
        a, b = int(off[text]), int(off[stop])
        for lo in range(a, max(a + 1, b), BLOCK):
            hi = min(b, lo + BLOCK)  # windows that start here
            end = min(b, hi + LENGTH)
            n = end - lo
            if n < LENGTH:
                continue
            ends = np.repeat(off[text + 1:stop + 1], size[text:stop])[lo - a:end - a] - lo if stop - text > 1 else np.full(n, b - lo)
            h = gram_hashes(raw[lo:end], n)
            place = np.arange(n)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
            key[place + GRAM > ends] = np.uint64(2**64 - 1)
            low = key
            for step in (1, 2, 4, 8, 16, 32, LENGTH - GRAM + 1 - 64):
                low = np.minimum(low[:-step], low[step:])
            low = low[:hi - lo]
            at = np.where(place[:len(low)] + LENGTH <= ends[:len(low)], (low & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.append(first[1:], len(at)) - 1
            real = at[first] >= 0
            first, last = first[real], last[real]
            anchor = at[first]
            second = mix(hash_spans(raw[lo:end], first, last + LENGTH, seed=5) ^ mix((anchor - first).astype(np.uint64)))
            lead = np.lib.stride_tricks.sliding_window_view(raw[lo:end], LEAD)[anchor].view(">u4").ravel().astype(np.uint64)
            out.append((first + lo, last + lo, lead, h[anchor] >> np.uint64(32), second))
        text = stop
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, *[none.astype(np.uint64)] * 3)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Sorted order of rows by several keys; only rows that tie in a key are sorted by the next."""
    order = np.argsort(columns[0], kind="stable")
    value = columns[0][order]
    group = np.cumsum(np.concatenate([[0], (value[1:] != value[:-1]).astype(np.int64)])) if len(value) else np.zeros(0, np.int64)
    for column in columns[1:]:
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        inner = np.lexsort((column[order[tied]], group[tied]))
        order[tied] = order[tied][inner]
        value = column[order]
        group = np.cumsum(np.concatenate([[0], ((group[1:] != group[:-1]) | ((value[1:] != value[:-1]) & same[1:-1])).astype(np.int64)]))
    return order


Splitters = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def part_of(tokens: tuple[np.ndarray, ...], splitters: Splitters) -> np.ndarray:
    """Bucket of each suffix: how many splitters are not above its three tokens, then the equal sub-range of
    the leading bytes between the two splitters, where there are fewer splitters than buckets wanted. All
    rows at once: each token narrows the range of splitters that equal the tokens before it."""
    *columns, sub_ranges = splitters
    rows = np.arange(len(tokens[0]))
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(columns[0]), np.int64)
    edge = np.arange(len(columns[0])) == 0                # where a range of equal earlier tokens begins
    for token, column in zip(tokens, columns):
        open_ = rows[high > low]
        if not len(open_):
            break
        # numbers that order (range, token): between two known values lies room for the unknown ones
        known, group = np.unique(column), np.cumsum(edge) - 1
        rank = np.searchsorted(known, token[open_])
        exact = known[np.minimum(rank, len(known) - 1)] == token[open_]
        wide = 2 * len(known) + 2
        key = group * wide + 2 * np.searchsorted(known, column) + 1
        own = group[low[open_]] * wide + 2 * rank + exact
        low[open_], high[open_] = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
        edge[1:] |= column[1:] != column[:-1]
    part = high                                           # all splitters that are not above
    if sub_ranges == 1:
        return part
    lead = columns[0].astype(np.float64)
    under = np.concatenate([np.zeros(1), lead])[part]
    above = np.concatenate([lead, np.full(1, 2.0**(8 * LEAD))])[part]
    inner = np.floor((tokens[0].astype(np.float64) - under) * sub_ranges / np.maximum(above - under, 1)).astype(np.int64)
    return part * sub_ranges + np.clip(inner, 0, sub_ranges - 1)


def splitters_of(docs: DataFrame, parts: int, total: int) -> Splitters:
    """Splitters from the suffixes of about SAMPLE_DOCS documents, and the sub-ranges of each range;
    they only balance the buckets."""
    chosen = docs.select("text").sample(min(1.0, SAMPLE_DOCS / max(total, 1)), seed=11).limit(4 * SAMPLE_DOCS)
    names = ["lead", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw, off in text_slices(b.column(0)):
                tokens = (x[:: max(1, len(x) // 4096)].view(np.int64) for x in sampled(raw, off)[2:])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in tokens], names=names)

    rows = chosen.mapInArrow(run, "lead long, first long, second long").toArrow()
    tokens = [np.asarray(rows[c].combine_chunks()).astype(np.int64).view(np.uint64) for c in names]
    order = multikey_order(tokens)
    ranges = max(1, min(parts, len(order) // KEYS_PER_RANGE))
    pick = np.unique(np.linspace(0, len(order), ranges + 1)[1:-1].astype(np.int64))
    return *(x[order][pick] for x in tokens), -(-parts // ranges)


ASK = "part int, slice long, file string, lead binary, first binary, second binary, doc binary, mark binary"
_ASK = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("file", pa.string()), *((c, pa.binary()) for c in ("lead", "first", "second", "doc", "mark"))])
ANSWER = "slice long, file string, part int, state binary, undecided long"
_ANSWER = pa.schema([("slice", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("state", pa.binary()), ("undecided", pa.int64())])


def packed(a: np.ndarray, level: int = 1) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def asks(number: int, file: str, part: np.ndarray, lead: np.ndarray | None, first: np.ndarray, second: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A slice's tokens by bucket, in the slice's order; one row without tokens announces the slice.

    ``ids`` are the order values of the slice's texts; a pair carries its text's value."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows: dict[str, list] = {f.name: [] for f in _ASK}
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        own = order[a:b]
        values, index = np.unique(doc[own], return_inverse=True)
        for k, v in (("part", int(part[own[0]])), ("slice", number), ("file", file), ("lead", packed(lead[own].astype(np.uint32)) if lead is not None else None),
                     ("first", packed(first[own].astype(np.uint32) if lead is not None else first[own])), ("second", second[own].tobytes()),
                     ("doc", packed(ids[values])), ("mark", packed(index.astype(np.uint32)))):
            rows[k].append(v)
    for k, v in (("part", -1 - number % 16), ("slice", number), ("file", file), ("lead", None), ("first", None), ("second", None), ("doc", None), ("mark", None)):
        rows[k].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _ASK], schema=_ASK)


def answer(t: pa.Table, boundary: np.ndarray) -> pa.Table:
    """Sort one bucket's suffixes and compare neighbours."""
    rows = [r for r in t.to_pylist() if r["first"] is not None]
    slices_, files = t["slice"].to_pylist(), t["file"].to_pylist()
    if not rows:
        n = len(slices_)
        return pa.Table.from_arrays([pa.array(slices_, pa.int64()), pa.array(files, pa.string()), pa.array(t["part"].to_pylist(), pa.int32()), pa.array([None] * n, pa.binary()), pa.array([0] * n, pa.int64())], schema=_ANSWER)
    narrow = rows[0]["lead"] is not None                  # suffixes have tokens of 32 bits, windows of 64
    first = np.concatenate([unpacked(r["first"], np.uint32 if narrow else np.uint64) for r in rows])
    size = [len(unpacked(r["mark"], np.uint32)) for r in rows]
    second = np.concatenate([np.frombuffer(r["second"], f"<u{len(r['second']) // n}") for r, n in zip(rows, size)])
    doc = np.concatenate([unpacked(r["doc"], np.int64)[unpacked(r["mark"], np.uint32)] for r in rows])
    sender = np.repeat(np.array([r["slice"] for r in rows]), size)
    lead = [np.concatenate([unpacked(r["lead"], np.uint32) for r in rows])] if narrow else []
    order = multikey_order([*lead, first, second, doc, sender])
    f, s = first[order], second[order]
    new_first = np.concatenate([[True], f[1:] != f[:-1]])
    for x in lead:
        new_first[1:] |= x[order][1:] != x[order][:-1]
    new = new_first | np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new_first) - 1
    several = np.bincount(group, new) > 1
    several |= np.isin(f[new_first], boundary)
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(~new, GONE, np.where(several[group], UNDECIDED, UNIQUE))
    states = np.split(state, np.cumsum(size)[:-1])
    relax()
    return pa.Table.from_arrays([pa.array([r["slice"] for r in rows], pa.int64()), pa.array([r["file"] for r in rows], pa.string()), pa.array([r["part"] for r in rows], pa.int32()),
                                 pa.array([packed(x) for x in states], pa.binary()), pa.array([int((x == UNDECIDED).sum()) for x in states], pa.int64())], schema=_ANSWER)


def order_values(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its equals; rows are in order."""
    order = multikey_order([*keys, np.arange(len(keys[0]))])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.ones(len(order), bool)
    out[order[1:][same]] = False
    return out


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def slice_file(documents: pa.RecordBatch, suffixes: dict[str, np.ndarray]) -> bytes:
    a, b = ipc(pa.Table.from_batches([documents])), ipc(pa.table(suffixes))
    return len(a).to_bytes(8, "little") + a + b


def read_slice(data: bytes) -> tuple[pa.Table, dict[str, np.ndarray]]:
    n = int.from_bytes(data[:8], "little")
    documents = pa.ipc.open_stream(pa.py_buffer(data)[8:8 + n]).read_all().combine_chunks()
    suffixes = pa.ipc.open_stream(pa.py_buffer(data)[8 + n:]).read_all().combine_chunks()
    return documents, {c: suffixes[c].to_numpy() for c in suffixes.column_names}


def column(documents: pa.Table, name: str) -> pa.Array:
    x = documents[name].combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def send_suffixes(docs: DataFrame, folder: str, splitters, slice_bytes: int) -> DataFrame:
    """Write slice files and send the slices' distinct token pairs."""
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        owns_worker("suffixes")
        out, number = None, TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            out = out or Committer(folder)
            for i, j in slices(text_bytes(b.column(at))[1], slice_bytes):
                own = b.slice(i, j - i)
                own = own.take(pc.sort_indices(pa.table({"k": own.column(key)}), sort_keys=[("k", "ascending")], null_placement="at_start"))
                ids = order_values(own.column(key))
                raw, off = text_bytes(own.column(at))
                start, last, lead, first, second = sampled(raw, off)
                fresh = first_of(lead, first, second)
                part = part_of((lead, first, second), splitters)
                put = out.put(f"{number}.slice", slice_file(own, {"start": start.astype(np.uint32), "size": (last - start + 1).astype(np.uint32), "fresh": fresh, "part": part.astype(np.int32)}))
                doc = np.searchsorted(off, start, "right") - 1
                yield from asks(number, put["file"], part[fresh], lead[fresh], first[fresh], second[fresh], doc[fresh], ids)
                number += 1
            relax()

    return docs.mapInArrow(run, ASK)


def states_of(answers: list | None, part: np.ndarray) -> np.ndarray:
    """States of a slice's pairs from the answers of its buckets, which keep the slice's order."""
    order = np.argsort(part, kind="stable")
    got = {a["part"]: unpacked(a["state"], np.uint8) for a in answers or [] if a["state"] is not None}
    state = np.zeros(len(part), np.uint8)
    if len(part):
        state[order] = np.concatenate([got[p] for p in np.unique(part).tolist()])
    return state


def undecided_windows(documents: pa.Table, suffixes: dict, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, text, two hashes) of each window of the undecided runs, in the slice's order."""
    raw, off = text_bytes(column(documents, "text"))
    pick = np.flatnonzero(suffixes["fresh"])[state == UNDECIDED]
    size = suffixes["size"][pick].astype(np.int64)
    start = np.repeat(suffixes["start"][pick].astype(np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h1, h2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint32)
    for k in range(0, len(start), BLOCK):
        s = start[k:k + BLOCK]
        h1[k:k + len(s)], h2[k:k + len(s)] = hash_spans(raw, s, s + LENGTH, seed=11), hash_spans(raw, s, s + LENGTH, seed=23) >> np.uint64(32)
    return start, np.searchsorted(off, start, "right") - 1, h1, h2


def send_windows(states: DataFrame, folder: str, parts: int) -> DataFrame:
    """Send the distinct windows of the undecided runs of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, file, answers in zip(*(c.to_pylist() for c in b.columns)):
                documents, suffixes = read_slice(get(folder, file))
                state = states_of(answers, suffixes["part"][suffixes["fresh"]])
                start, doc, h1, h2 = undecided_windows(documents, suffixes, state)
                fresh = first_of(h1, h2)
                part = (h1[fresh] % np.uint64(parts)).astype(np.int64)
                yield from asks(number, file, part, None, h1[fresh], h2[fresh], doc[fresh], order_values(column(documents, "doc_id")))
            relax()

    return states.mapInArrow(run, ASK)


def removed_bytes(documents: pa.Table, suffixes: dict, first_answers, window_answers, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, whether each byte goes) of a slice."""
    raw, off = text_bytes(column(documents, "text"))
    fresh = suffixes["fresh"]
    state = np.full(len(fresh), GONE, np.uint8)
    own = states_of(first_answers, suffixes["part"][fresh])
    state[fresh] = own
    begin = suffixes["start"][state == GONE].astype(np.int64)
    end = begin + suffixes["size"][state == GONE].astype(np.int64) - 1 + LENGTH
    start, _, h1, h2 = undecided_windows(documents, suffixes, own)
    new = first_of(h1, h2)
    gone = ~new
    gone[new] = states_of(window_answers, (h1[new] % np.uint64(parts)).astype(np.int64)) == GONE
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, np.concatenate([begin, start[gone]]), 1)
    np.add.at(change, np.concatenate([end, start[gone] + LENGTH]), -1)
    return raw, off, np.cumsum(change[:-1], dtype=np.int32) > 0


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, digests: bool = False, slice_bytes: int = SLICE_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """The documents without their repeated passages (a cut inside a character drops its rest), or,
    with ``digests``, doc_id and n_bytes, n_removed, n_spans and kept_sha256 of each."""
    spark = docs.sparkSession
    folder = work_dir(spark, "suffixes")
    total = docs.count()
    bytes_ = (docs.select(F.octet_length("text").alias("n")).sample(min(1.0, 20_000 / max(total, 1)), seed=3).agg(F.avg("n")).first()[0] or 0) * total
    parts = int(bytes_ * 2 / (LENGTH - GRAM) / part_keys) + 1
    splitters = splitters_of(docs, parts, total)
    boundary = np.unique(splitters[1])
    slices_folder = f"{folder}/slices"
    answers = saved(send_suffixes(docs, slices_folder, splitters, slice_bytes).groupBy("part").applyInArrow(lambda t: answer(t, boundary), ANSWER), f"{folder}/answers")
    # a slice's answers are small but its work is not: an explicit number of tasks is kept as it is
    by_slice = lambda df, name: df.repartition(tasks(spark), "slice").groupBy("slice").agg(F.min("file").alias("file"), F.collect_list(F.when(F.col("state").isNotNull(), F.struct("part", "state"))).alias(name))  # noqa: E731  a row per bucket of a slice
    windows = (answers.agg(F.sum("undecided")).first()[0] or 0) * (LENGTH - GRAM) // 2
    window_parts = int(windows / part_keys) + 1
    states = by_slice(answers, "first_answers")
    none = np.zeros(0, np.uint64)
    second = saved(send_windows(states, slices_folder, window_parts).groupBy("part").applyInArrow(lambda t: answer(t, none), ANSWER), f"{folder}/windows")
    both = states.join(by_slice(second, "window_answers").drop("file"), "slice", "left")
    kinds = to_arrow_schema(docs.schema)
    out_schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}" if digests else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, file, first_answers, window_answers in zip(*(c.to_pylist() for c in b.columns)):
                documents, suffixes = read_slice(get(slices_folder, file))
                raw, off, gone = removed_bytes(documents, suffixes, first_answers, window_answers, window_parts)
                count = per_text(gone, off)
                kept = raw[~gone].tobytes()
                cut = (off - np.concatenate([[0], np.cumsum(count)])).tolist()
                if digests:
                    begins, _ = runs(gone, off)
                    spans = np.bincount(np.searchsorted(off, begins, "right") - 1, minlength=len(off) - 1)
                    sha = [hashlib.sha256(kept[a:e]).hexdigest() for a, e in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([column(documents, "doc_id"), pa.array(np.diff(off)), pa.array(count), pa.array(spans), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                    continue
                old = column(documents, "text")
                text = [kept[a:e].decode(errors="ignore") if c else None for a, e, c in zip(cut, cut[1:], count.tolist())]
                arrays = {c: column(documents, c) for c in documents.column_names}
                changed = pa.array(count > 0)
                arrays["text"] = pc.if_else(changed, pa.array(text, old.type), old)
                if "n_chars" in arrays:
                    arrays["n_chars"] = pc.if_else(changed, pa.array([len(x) if x is not None else None for x in text], pa.int64()).cast(arrays["n_chars"].type), arrays["n_chars"])
                yield pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in kinds], schema=kinds)

    return both.mapInArrow(run, out_schema)
