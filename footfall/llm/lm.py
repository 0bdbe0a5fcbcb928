"""Language-model scoring with a Brown class-based bigram model.

Every word of the training texts falls into one of CLASSES classes; a text's probability is the product of
class-transition and word-emission probabilities. Classes come from exchange clustering of the whole
vocabulary, in two steps that take turns:

* Frequent words (at least ``CLUSTER_SHARE`` of all training tokens, so at most 1 / CLUSTER_SHARE of them) are
  exchanged one after another: Spark sums every word's left and right class neighbours from the bigram
  counts, and a task moves each to the class that raises the likelihood most, with exact sums.
* All other words are exchanged at once: Spark groups each word's left and right neighbours' classes over
  all texts, and the word takes the class in which they are likeliest (the first-order likelihood change,
  which for rare words is the whole of it), against sums that are counted again in every round.

Rounds go on until words with less than FEW_MOVED of the rare words' tokens change their class, or the
likelihood gains less than LEAST_GAIN, and RARE_ROUNDS at most. The first round starts from classes by
spelling. A word that no training text has belongs to the class that is most frequent among words met once
with its spelling, and shares half a count there with all others unseen, so the probabilities of a class's
words sum to one. Counts of all words are exact.

How it runs. Texts are read once: each slice is written as its distinct word hashes with their counts
and its token sequence as numbers of them, dealt and stored by slice number, so that later rounds bring
a slice its answers without moving it again. The counts exchange is two shuffles of packed arrays: a
slice sends its distinct hashes to the part that owns their range, the part sums them over all slices
and answers each slice in the same order; a round sends the neighbours' classes, one byte each, the same
way. A slice sends a distinct word once. Nothing of the size of the vocabulary is broadcast.

Words are 64-bit hashes of their bytes with A-Z lowered. Null texts are empty (one end token); a null
id is hashed as empty text; repeated rows score alike; an empty table, or one without training
documents, gives defined scores from zero counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import crc_mod, owns_worker, relax, saved, tasks, work_dir
from footfall.llm.quality_rules import docs_type
from footfall.llm.textops import LOWER, hash_spans, text_slices, words

CLUSTER_SHARE = 1e-4
CLASSES = 64
ROUNDS = 6
TURNS = 2  # rounds in which every word moves once
RARE_ROUNDS = 4  # rounds of the rare words at most
FEW_MOVED = 0.03  # rounds end when rare words with less of their tokens move
LEAST_GAIN = 0.002  # or the log likelihood a token gains less
BLOCK_WORDS = 1 << 14  # words of a part whose neighbours are summed at a time
SLICE_BYTES = 8 << 20
PART_WORDS = 1 << 19  # distinct words of slices that one part of the counts exchange holds, about
PRIOR = 4.0  # weight of the class unigram in a class transition
SPELL = 60
END = CLASSES + SPELL  # the end token's class
ALL = END + 1
NONE = 255  # no class: a word that no training text has


def spelling(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class by length, last character and whether there are non-ASCII characters."""
    size = ends - starts
    band = np.searchsorted([3, 5, 7, 10, 14], size, "right")
    last = raw[ends - 1]
    kind = np.full(len(last), 4)
    kind[((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)] = 0
    kind[(last == 46) | (last == 33) | (last == 63)] = 1
    kind[(last == 44) | (last == 59) | (last == 58)] = 2
    kind[(last >= 48) & (last <= 57)] = 3
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    return ((band * 5 + kind) * 2 + (high[ends] > high[starts])).astype(np.uint8)


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def encode(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """One row per slice of texts: ids, training flags, words per text, token numbers, distinct words."""
    table = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(docs_type(docs))), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()),
                        ("hashes", pa.binary()), ("train", pa.binary()), ("spell", pa.binary()), ("n_distinct", pa.int64()), ("train_tokens", pa.int64()), ("train_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        owns_worker("lm")
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            held_all = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, raw, off in text_slices(b.column(2), slice_bytes):
                low = LOWER[raw]
                starts, ends, first = words(low, off)
                h, at, inverse, count = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                held = held_all[i:j]
                sizes = np.diff(first)
                train = np.bincount(inverse[np.repeat(~held, sizes)], minlength=len(h))
                rank = np.empty(len(h), np.uint32)
                rank[np.argsort(-count, kind="stable")] = np.arange(len(h), dtype=np.uint32)
                # tokens as frequency ranks; the rank of each distinct word follows the sorted hashes
                one = lambda x: pa.array([x], pa.binary())
                lists = lambda a: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), lists(b.column(0).slice(i, j - i)), lists(pa.array(held)), lists(pa.array(sizes.astype(np.int32))),
                    one(pack(np.concatenate([rank, rank[inverse]]).astype("<u4"))), one(pack(h)), one(pack(train.astype("<u4"))),
                    one(spelling(low, starts[at], ends[at]).tobytes()), pa.array([len(h)]), pa.array([int(sizes[~held].sum())]), pa.array([int((~held).sum())])], schema=schema)
                number += 1
            relax()

    return table.mapInArrow(run, f"slice long, doc_ids array<{kind}>, held_out array<boolean>, sizes array<int>, tokens binary, hashes binary, train binary, spell binary, n_distinct long, train_tokens long, train_docs long")


def words_of(row_tokens: bytes, n_distinct: int) -> np.ndarray:
    """Token sequence of a slice as numbers of its sorted distinct hashes."""
    both = unpack(row_tokens, "<u4")
    rank, tokens = both[:n_distinct], both[n_distinct:]
    back = np.empty(n_distinct, np.int64)
    back[rank] = np.arange(n_distinct)
    return back[tokens]


def ranges_of(keys: np.ndarray, bits: int, part_bits: int) -> tuple[list[int], list[int]]:
    """Parts that sorted keys of some bits fall into by their first part_bits, and where each begins."""
    if not len(keys):
        return [], [0]
    part = (keys >> np.uint64(bits - part_bits)).astype(np.int64) if part_bits else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return part[begin].tolist(), [*begin.tolist(), len(keys)]


def exchange_counts(encoded: DataFrame, n_tokens: int, parts: int, share: float) -> DataFrame:
    """Answers to slices (slice, part, counts in the order of the slice's hashes of that part) and one
    row per part (slice null): its frequent words and vocabulary."""
    bits = parts.bit_length() - 1
    ask = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("hashes", pa.binary()), ("train", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, hashes, train in zip(*(c.to_pylist() for c in b.columns)):
                h, t = unpack(hashes, np.uint64), unpack(train, "<u4")
                own, cut = ranges_of(h, 64, bits)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([number] * len(own), pa.int64()),
                    *(pa.array([f(x[a:e]) for a, e in zip(cut, cut[1:])], pa.binary()) for x, f in ((h, lambda a: a.tobytes()), (t, pack)))], schema=ask)

    answer = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("head_hash", pa.list_(pa.int64())), ("head_count", pa.list_(pa.int64())),
                        ("vocabulary", pa.int64())])

    def total(t: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        ts = [unpack(x, "<u4") for x in t["train"].to_pylist()]
        h, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(ts)).astype(np.int64)
        seen = c > 0
        head = seen & (c >= share * n_tokens)
        cut = np.cumsum([len(x) for x in hs])
        counts = [pack(x.astype("<i8")) for x in np.split(c[inverse], cut[:-1])]
        n, part = len(hs), t["part"][0].as_py()
        stats = [h[head].view(np.int64).tolist(), c[head].tolist(), int(seen.sum())]
        return pa.Table.from_arrays([pa.array([*t["slice"].to_pylist(), None], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([*counts, None], pa.binary()),
                                     *(pa.array([None] * n + [x], f.type) for x, f in zip(stats, list(answer)[3:]))], schema=answer)

    asked = encoded.select("slice", "hashes", "train").mapInArrow(send, "part int, slice long, hashes binary, train binary")
    return asked.groupBy("part").applyInArrow(total, "slice long, part int, counts binary, head_hash array<long>, head_count array<long>, vocabulary long")


def units_of(tokens: np.ndarray, hashes: np.ndarray, spell: np.ndarray, head: np.ndarray, rare: np.ndarray | None) -> np.ndarray:
    """Unit of each token: the number of a frequent word, or behind these the spelling, or (with the rare
    words' classes) behind spellings and the end token the class."""
    at = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
    hit = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
    other = spell.astype(np.int64) if rare is None else SPELL + 1 + rare.astype(np.int64)
    return np.where(hit, at, len(head) + other)[tokens]


def with_ends(values: np.ndarray, sizes: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values with an end value after each text, and the place of each end."""
    ends = np.cumsum(sizes)
    return np.insert(values, ends, end), ends + np.arange(len(sizes))


def with_answers(slices: DataFrame, answers: DataFrame | None, column: str) -> DataFrame:
    """Slices with the answers of all parts, in the parts' order; null without answers."""
    kind = f"array<struct<part:int,{column}:binary>>"
    if answers is None:
        return slices.withColumn("answers", F.lit(None).cast(kind))
    own = answers.where("slice IS NOT NULL").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("part", column))).alias("answers"))  # a slice's own words
    return slices.join(own, "slice", "left")


def rare_classes(answers: list | None, n: int) -> np.ndarray | None:
    """Class of each of a slice's n distinct words, NONE for those not seen in training."""
    if answers is None:
        return None
    out = np.concatenate([unpack(x["classes"], np.uint8) for x in answers] or [np.zeros(0, np.uint8)])
    if len(out) != n:
        raise ValueError("a slice lacks classes of its words")
    return out


def training_units(row: dict, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers of the training tokens, their sizes by text, units of these tokens) of a slice."""
    h = unpack(row["hashes"], np.uint64)
    sizes, train = np.array(row["sizes"], np.int64), ~np.array(row["held_out"], bool)
    tokens = words_of(row["tokens"], len(h))[np.repeat(train, sizes)]
    unit = units_of(tokens, h, np.frombuffer(row["spell"], np.uint8), head, rare_classes(row["answers"], len(h)))
    return h, tokens, sizes[train], unit


def bigrams(slices: DataFrame, head: np.ndarray, answers: DataFrame | None) -> DataFrame:
    """(u, v, n): neighbouring units in training texts; a text begins after an end token."""
    end, units = len(head) + SPELL, len(head) + SPELL + 1 + CLASSES
    schema = pa.schema([("u", pa.int32()), ("v", pa.int32()), ("n", pa.int64())])
    shared = slices.sparkSession.sparkContext.broadcast(head)  # at most 1 / CLUSTER_SHARE hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns)}
                _, _, sizes, unit = training_units(row, shared.value)
                seq, _ = with_ends(unit, sizes, end)
                pairs, n = np.unique(np.concatenate([[end], seq[:-1]]) * units + seq if len(seq) else seq, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pairs // units).astype(np.int32)), pa.array((pairs % units).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    rows = with_answers(slices.select("slice", "held_out", "sizes", "tokens", "hashes", "spell"), answers, "classes")
    return rows.mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def unit_classes(head_classes: np.ndarray) -> np.ndarray:
    """Class of each unit: heads, spellings (classes of their own), the end token, the rare words' classes."""
    return np.concatenate([head_classes, CLASSES + np.arange(SPELL), [END], np.arange(CLASSES)]).astype(np.int64)


def class_scores(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ALL x CLASSES, ALL x CLASSES): log likelihood change of a word in each class by a left, and by a
    right neighbour of each class."""
    unigram = (matrix.sum(axis=0) + 0.5) / (matrix.sum() + 0.5 * ALL)
    before = (matrix.sum(axis=1) + 0.5) / (matrix.sum() + 0.5 * ALL)
    right = np.log((matrix + PRIOR * unigram) / (matrix.sum(axis=1, keepdims=True) + PRIOR))[:CLASSES].T
    left = np.log((matrix + PRIOR * before[:, None]) / (matrix.sum(axis=0) + PRIOR))[:, :CLASSES]
    return left, right


def reassign(slices: DataFrame, head: np.ndarray, classes: np.ndarray, matrix: np.ndarray, answers: DataFrame | None, parts: int, turn: int) -> DataFrame:
    """A round of the rare words: answers to slices (slice, part, classes) and one row a part (slice null):
    its rare words' tokens, those that moved, tokens and words of each class, and words met once by
    spelling and class. From the second round on one half of the words moves at a time, so that words
    which follow one another do not change places for ever."""
    bits = parts.bit_length() - 1
    ask = pa.schema([("part", pa.int32()), ("slice", pa.int64())] + [(n, pa.binary()) for n in ("hashes", "train", "spell", "old", "left", "right")])
    shared = slices.sparkSession.sparkContext.broadcast((head, classes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = shared.value
        for b in batches:
            for k in range(b.num_rows):
                row = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns)}
                h, tokens, sizes, unit = training_units(row, head)
                seq, at = with_ends(classes[unit].astype(np.uint8), sizes, np.uint8(END))
                place = np.delete(np.arange(len(seq)), at)
                rare = unit >= len(head)
                place, tokens = place[rare], tokens[rare]
                order = np.argsort(tokens, kind="stable")
                place, count = place[order], np.bincount(tokens, minlength=len(h))
                around = np.concatenate([np.array([END], np.uint8), seq])   # a text begins after an end token
                left, right = around[place], seq[place + 1]
                old = rare_classes(row["answers"], len(h))
                spell = np.frombuffer(row["spell"], np.uint8)
                old = spell if old is None else old
                own, cut = ranges_of(h, 64, bits)
                edge = np.concatenate([[0], np.cumsum(count)])
                pieces = list(zip(cut, cut[1:]))
                cells = [[h[a:e].tobytes() for a, e in pieces], [pack(count[a:e].astype("<u4")) for a, e in pieces], [spell[a:e].tobytes() for a, e in pieces],
                         [pack(old[a:e]) for a, e in pieces], *([pack(x[edge[a]:edge[e]]) for a, e in pieces] for x in (left, right))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([row["slice"]] * len(own), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], schema=ask)

    by_left, by_right = class_scores(matrix)
    answer = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("classes", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def choose(t: pa.Table) -> pa.Table:
        hashes, n_slices = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()], len(t)
        spell, old, left, right = (np.concatenate([f(x) for x in t[c].to_pylist()]) for c, f in
                                   (("spell", lambda x: np.frombuffer(x, np.uint8)), ("old", lambda x: unpack(x, np.uint8)), ("left", lambda x: unpack(x, np.uint8)), ("right", lambda x: unpack(x, np.uint8))))
        count = np.concatenate([unpack(x, "<u4") for x in t["train"].to_pylist()]).astype(np.int64)
        distinct, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        of = np.repeat(inverse, count)                        # the word of each neighbour
        order = np.argsort(of, kind="stable")
        of, left, right = of[order], left[order], right[order]
        n = np.bincount(of, minlength=len(distinct))
        was, now = old[first], np.full(len(distinct), NONE, np.uint8)
        edge = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, len(distinct), BLOCK_WORDS):
            e = min(a + BLOCK_WORDS, len(distinct))
            x = slice(edge[a], edge[e])
            score = sum(np.bincount((of[x] - a) * ALL + side[x], minlength=(e - a) * ALL).reshape(e - a, ALL) @ by
                        for side, by in ((left, by_left), (right, by_right)))
            now[a:e] = score.argmax(1)
        if turn:
            stays = (distinct & np.uint64(1)).astype(np.int64) != turn % 2
            now[stays] = was[stays]
        now[n == 0] = NONE
        moved = int(n[(now != was) & (n > 0)].sum()) if turn else int(n.sum())
        seen = n > 0
        once = n == 1
        stats = np.concatenate([[n.sum(), moved], np.bincount(now[seen], n[seen], minlength=CLASSES), np.bincount(now[seen], minlength=CLASSES),
                                np.bincount(spell[first][once].astype(np.int64) * CLASSES + now[once], minlength=SPELL * CLASSES)]).astype(np.int64)
        cut = np.cumsum([len(x) for x in hashes])[:-1]
        return pa.Table.from_arrays([pa.array([*t["slice"].to_pylist(), None], pa.int64()), pa.array([t["part"][0].as_py()] * (n_slices + 1), pa.int32()),
                                     pa.array([*(pack(x) for x in np.split(now[inverse], cut)), None], pa.binary()), pa.array([None] * n_slices + [stats.tolist()], pa.list_(pa.int64()))], schema=answer)

    rows = with_answers(slices.select("slice", "held_out", "sizes", "tokens", "hashes", "spell"), answers, "classes")
    asked = rows.mapInArrow(send, "part int, slice long, hashes binary, train binary, spell binary, old binary, left binary, right binary")
    return asked.groupBy("part").applyInArrow(choose, "slice long, part int, classes binary, stats array<long>")


def plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def apart(a: int, left: np.ndarray, right: np.ndarray, own: float) -> tuple[np.ndarray, np.ndarray]:
    """A word's neighbour counts without its bigrams with itself."""
    here = np.arange(len(left)) == a
    return left - own * here, right - own * here


def shifted(matrix: np.ndarray, c: int, left: np.ndarray, right: np.ndarray, own: float, sign: int) -> np.ndarray:
    """Class bigrams with a word taken out of class c (-1; counts with its own bigrams) or put into it (1; without)."""
    m = matrix.copy()
    m[c] += sign * right
    m[:, c] += sign * left
    m[c, c] += own
    return m


def best_class(matrix: np.ndarray, a: int, left: np.ndarray, right: np.ndarray, own: float) -> tuple[int, float]:
    """Class of a word with the highest likelihood and the gain over its class a.

    matrix counts class bigrams; left and right are the word's neighbours' class counts, own its
    bigrams with itself (counted in both at class a).
    """
    m = np.maximum(shifted(matrix, a, left, right, own, -1), 0)
    left, right = apart(a, left, right, own)
    # a class's totals hold its bigrams with the word wherever the word is
    n_left, n_right = (m.sum(axis=0) + right)[:CLASSES], (m.sum(axis=1) + left)[:CLASSES]
    k = np.arange(CLASSES)
    gain = (plogp(m[:CLASSES] + right) - plogp(m[:CLASSES])).sum(axis=1) + (plogp(m[:, :CLASSES] + left[:, None]) - plogp(m[:, :CLASSES])).sum(axis=0)
    d = m[k, k]
    gain += plogp(d + left[k] + right[k] + own) - plogp(d) - (plogp(d + right[k]) - plogp(d)) - (plogp(d + left[k]) - plogp(d))
    gain -= plogp(n_right + right.sum() + own) - plogp(n_right) + plogp(n_left + left.sum() + own) - plogp(n_left)
    b = int(np.argmax(gain))
    return (b, float(gain[b] - gain[a])) if gain[b] > gain[a] + 1e-9 else (a, 0.0)


def class_of(classes: np.ndarray) -> Column:
    """The classes of all units as one constant array: one literal, not one an element."""
    return F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<int>")


def class_matrix(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts: at most ALL x ALL rows reach the driver."""
    of = class_of(classes)
    rows = pairs.groupBy(of[F.col("u")].alias("a"), of[F.col("v")].alias("b")).agg(F.sum("n").alias("n")).collect()
    m = np.zeros((ALL, ALL))
    for r in rows:
        m[r.a, r.b] = r.n
    return m


def exchange(pairs: DataFrame, n_heads: int, rounds: int = ROUNDS, head_classes: np.ndarray | None = None) -> np.ndarray:
    """Class of each unit. A round moves one in TURNS of the frequent words: Spark sums their class
    neighbours from all bigrams, and one task exchanges them one after another, as each move changes what the
    next word gains (at most 1 / CLUSTER_SHARE words with 2 x ALL sums). Counts are exact again in
    the next round; rounds end early when none of TURNS rounds has moved a word."""
    classes = unit_classes(np.arange(n_heads) % CLASSES if head_classes is None else head_classes)
    still = 0
    if not n_heads:
        return classes
    side = pairs.select(F.col("u").alias("w"), F.lit(1).alias("right"), F.col("v").alias("x"), "n").unionByName(
        pairs.select(F.col("v").alias("w"), F.lit(0).alias("right"), F.col("u").alias("x"), "n"))
    schema = pa.schema([("w", pa.int32()), ("to", pa.int32())])
    for turn in range(rounds):
        matrix = class_matrix(pairs, classes)
        of = class_of(classes)
        moving = side.where((F.col("w") < n_heads) & (F.col("w") % TURNS == turn % TURNS))
        summed = (moving.groupBy("w", "right", of[F.col("x")].alias("c")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("w"), F.col("n")).otherwise(0)).alias("own"))
                  .groupBy("w").agg(F.collect_list(F.struct("right", "c", "n", "own")).alias("near")))  # at most 2 x ALL a word
        now = classes

        def move(batches: Iterator[pa.RecordBatch], matrix=matrix, now=now) -> Iterator[pa.RecordBatch]:
            matrix = matrix.copy()
            for b in batches:
                out = []
                for w, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    left, right, own = np.zeros(ALL), np.zeros(ALL), 0.0
                    for x in near:
                        (right if x["right"] else left)[x["c"]] += x["n"]
                        own += x["own"] if x["right"] else 0
                    a, (to, _) = int(now[w]), best_class(matrix, int(now[w]), left, right, own)
                    if to != a:
                        matrix = np.maximum(shifted(shifted(matrix, a, left, right, own, -1), to, *apart(a, left, right, own), own, 1), 0)
                    out.append(to)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], schema=schema)

        moved = summed.repartition(1).sortWithinPartitions("w").mapInArrow(move, "w int, to int").collect()  # at most 1 / CLUSTER_SHARE rows
        before, classes = classes, classes.copy()
        for r in moved:
            classes[r.w] = r.to
        still = still + 1 if (before == classes).all() else 0
        if still == TURNS:
            break
    return classes


class Model:
    """Class transitions and emissions; ``head`` are the sorted hashes of the frequent words, ``tokens`` and
    ``distinct`` each class's training tokens and words, ``spell_class`` the class of unseen words."""

    def __init__(self, head, head_classes, matrix, tokens, distinct, spell_class, n_tokens, vocabulary, n_docs):
        self.head, self.classes, self.spell_class = head, head_classes, spell_class
        self.n_tokens, self.vocabulary, self.n_docs = n_tokens, vocabulary, n_docs
        # a class that was never seen has half a count, so every transition has a probability
        unigram = (matrix.sum(axis=0) + 0.5) / (matrix.sum() + 0.5 * ALL)
        self.transition = np.log10((matrix + PRIOR * unigram) / (matrix.sum(axis=1, keepdims=True) + PRIOR))
        self.total = tokens + 0.5 * (distinct + 1)            # the last half count is for all unseen words

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n_tokens + 0.5 * (self.vocabulary + 1)))

    def words(self, hashes: np.ndarray, spell: np.ndarray, count: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and log10 emission of each distinct word; unseen words share half a count of their class."""
        at = np.minimum(np.searchsorted(self.head, hashes), max(len(self.head) - 1, 0))
        hit = self.head[at] == hashes if len(self.head) else np.zeros(len(hashes), bool)
        cls = np.where(rare == NONE, self.spell_class[spell], rare).astype(np.int64)
        cls[hit] = self.classes[at[hit]]
        return cls, np.log10((count + 0.5) / self.total[cls])


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for the words' own counts, which no class changes."""
    return float(plogp(matrix).sum() - plogp(matrix.sum(axis=0)).sum() - plogp(matrix.sum(axis=1)).sum())


def fit(slices: DataFrame, answers: DataFrame, n_tokens: int, n_docs: int, parts: int, rounds: int, rare_rounds: int) -> tuple[Model, DataFrame]:
    """(model, answers with the classes of the rare words)."""
    spark = slices.sparkSession
    stats = answers.where("slice IS NULL")
    heads = stats.select(F.explode(F.arrays_zip("head_hash", "head_count")).alias("x")).select("x.*").collect()  # at most 1 / CLUSTER_SHARE
    vocabulary = int(stats.agg(F.sum("vocabulary")).first()[0] or 0)
    hashes = np.array([r.head_hash for r in heads], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    head, count = hashes[order], np.array([r.head_count for r in heads], np.float64)[order]
    head_classes, rare, value = None, None, None
    for turn in range(rare_rounds + 1):
        pairs = saved(bigrams(slices, head, rare), work_dir(spark, "bigrams"))
        classes = exchange(pairs, len(head), rounds if not turn else TURNS, head_classes)
        head_classes = classes[:len(head)]
        matrix = class_matrix(pairs, classes)
        now = likelihood(matrix)
        gain = None if value is None else (now - value) / max(n_tokens, 1)
        value = now if turn else None                       # the first round has classes by spelling besides
        if turn and (turn == rare_rounds or moved <= FEW_MOVED * rare_tokens or (gain is not None and gain < LEAST_GAIN)):
            break
        rare = saved(reassign(slices, head, classes, matrix, rare, parts, turn), work_dir(spark, "classes"))
        sums = np.zeros(2 + 2 * CLASSES + SPELL * CLASSES, np.int64)
        for place, total in rare.where("slice IS NULL").select(F.posexplode("stats").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect():
            sums[place] = total
        rare_tokens, moved = int(sums[0]), int(sums[1])
    tokens = sums[2:2 + CLASSES] + np.bincount(head_classes, count, minlength=CLASSES)
    distinct = sums[2 + CLASSES:2 + 2 * CLASSES] + np.bincount(head_classes, minlength=CLASSES)
    once = sums[2 + 2 * CLASSES:].reshape(SPELL, CLASSES)
    spell_class = np.where(once.any(axis=1), once.argmax(axis=1), int(distinct.argmax()))
    return Model(head, head_classes, matrix, tokens, distinct, spell_class, n_tokens, vocabulary + (n_docs > 0), n_docs), rare


def score_slices(slices: DataFrame, answers: DataFrame, rare: DataFrame, model: Model) -> DataFrame:
    """Join each slice with its answers and score its texts."""
    spark = slices.sparkSession
    shared = spark.sparkContext.broadcast(model)
    both = with_answers(slices.select("slice", "doc_ids", "held_out", "sizes", "tokens", "hashes", "spell"), answers, "counts").withColumnRenamed("answers", "numbers")
    both = with_answers(both, rare, "classes")
    kind = slices.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = docs_type(spark.createDataFrame([], f"doc_id {kind}"))
    schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for k in range(b.num_rows):
                row = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns) if n != "doc_ids"}
                ids = b.column(b.schema.names.index("doc_ids")).slice(k, 1).flatten()
                held, sizes = row["held_out"], np.array(row["sizes"], np.int64)
                h, s = unpack(row["hashes"], np.uint64), np.frombuffer(row["spell"], np.uint8)
                count = np.concatenate([unpack(x["counts"], "<i8") for x in row["numbers"] or []] or [np.zeros(0, np.int64)])
                if len(count) != len(h):
                    raise ValueError("a slice lacks counts of its words")
                word = words_of(row["tokens"], len(h))
                cls, emit = model.words(h, s, count, rare_classes(row["answers"] or [], len(h)))
                seq, at = with_ends(cls[word], sizes, END)
                emitted, _ = with_ends(emit[word], sizes, 0.0)
                known, _ = with_ends(count[word] > 0, sizes, model.n_docs > 0)
                base, _ = with_ends(model.base(count)[word], sizes, float(model.base(np.array(model.n_docs))))
                step = emitted + model.transition[np.concatenate([[END], seq[:-1]]), seq]
                per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)[at]]))
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(sizes + 1), pa.array(per(known.astype(np.int64))), pa.array([model.n_tokens] * n, pa.int64()), pa.array(per(base)), pa.array(per(step))], schema=schema)

    return both.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def by_slice(encoded: DataFrame, path: str) -> DataFrame:
    """Slices dealt and stored by their number, so that joins by slice leave them where they are."""
    spark = encoded.sparkSession
    n, name = tasks(spark), "slices_" + path.rsplit("-", 1)[-1]
    (encoded.repartition(n, "slice").write.bucketBy(n, "slice").sortBy("slice").option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name)


def lm_score(docs: DataFrame, rounds: int = ROUNDS, slice_bytes: int = SLICE_BYTES, share: float = CLUSTER_SHARE, part_words: int = PART_WORDS,
             rare_rounds: int = RARE_ROUNDS) -> DataFrame:
    """Fit on the training documents and score every document."""
    spark = docs.sparkSession
    slices = by_slice(encode(docs, slice_bytes), work_dir(spark, "slices"))
    n_words, n_docs, distinct = (x or 0 for x in slices.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("n_distinct")).first())
    n_tokens = n_words + n_docs
    parts = 1 << max(0, (distinct // part_words)).bit_length()
    answers = saved(exchange_counts(slices, n_tokens, parts, share), work_dir(spark, "counts"))
    model, rare = fit(slices, answers, n_tokens, n_docs, parts, rounds, rare_rounds)
    return score_slices(slices, answers, rare, model)
