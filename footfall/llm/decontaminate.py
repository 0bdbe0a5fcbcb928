"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are characters: A-Z lowered, words (runs without ASCII white space) joined by one
space. The CGK random walk reads a text from a place with a pointer that stays or advances by a
random bit of the character it stands on; two texts at small edit distance resynchronise, so their
walks agree. A table samples the steps of a walk and hashes the characters seen there. Windows of items
and documents start where a hash of three characters is small, one place in EVERY at first: equal content
starts at equal places on both sides. Items fall into classes by size (powers of two). The more steps a key
samples, the rarer it hits: for each class the longest keys are taken with which some walks find the target
share of items of the class that were edited, in the simulation, at random places by as many characters as the
match allows. One more table is for characters replaced at even distances, which leave no long stretch whole:
its walk goes on at every step and leaves out each fourth character (GAPS). If a class needs keys of fewer than LONG steps, all
start twice as often, up to every character; if even then none reach the target, building fails. Long
items are simulated by a stretch of LONGEST characters, which is no easier to find than the whole.
A hit counts when three looks agree, each dearer than the one before: most pairs of characters around it
in the item are in the signature of the text there, most characters have an equal at nearly the same
distance, and 64 characters of the item around it have a small edit distance to the text there. The
simulation finds a try only by hits that count.

Every hit is verified exactly: the item's edit distance, in characters of the words joined by one
space, to the best stretch of the document around the hit must be at most (1 - similarity) of the
item's length. Documents are read once per block of items, without a shuffle.

Null or empty documents and items match nothing; a long text is read whole; repeated rows are judged
alike; repeated items report each id. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import WORD, owns_worker, relax
from footfall.llm.quality_rules import docs_type
from footfall.llm.textops import LOWER, SPACE, mix, text_slices

BLOCK_ITEMS = 20_000  # items that one broadcast holds, about
SIMILARITY = 0.75
WALKS = 2  # tables of a class at most, each with a walk of its own
STEPS = 32  # of a walk at most
LOOK = 10  # steps after which a walk goes on only where an item's does, by the first bits of its key
UNSAMPLED = 5  # one step in so many is not sampled
GAPS = "1110111"  # steps that the keys of the steady walk sample
RECALL = 0.99
EVERY = 4  # one place in so many starts a walk, at first
LONG = 12  # steps of a key that is rare enough to start less often
LONGEST = 512  # characters of an item that are simulated
NEAR, DRIFT, EQUAL = 24, 2, 0.7  # characters looked at on both sides of a hit, distance of an equal, share with one
MISSING = 0.38  # share of an item's pairs around a hit that the text may lack
SEGMENT, APART = 64, 0.45  # characters of the item that are compared by edit distance, and their distance at most
_TRIES = 400
_PAD = 64  # behind the last character
_SIGNED = 32  # places of a signature
_PLACES = 1 << 15  # places that walk at a time
_HITS, _WAITING = 1 << 12, 1 << 20  # hits that are looked at at a time, and that wait for it, about
_FILTER = 20  # bits of the first look at a key
_NONE = 0xFFFFFFFF  # no character: between items


def item_class(n: int) -> int:
    """Class of items of n characters."""
    return n.bit_length()


class Walk:
    """One random walk: the hash bit that each step reads, and the steps that its keys sample. The steady
    walk reads no bit: it is the draw of which every bit is one."""

    def __init__(self, number: int, gaps: str = ""):
        rng = np.random.default_rng(1000 + number)
        self.bits = rng.integers(0, 32, STEPS).astype(np.uint32)
        self.steady, self.look = bool(gaps), LOOK if not gaps else STEPS
        if gaps:
            self.sampled = np.array([c == "1" for c in gaps])
            return
        self.sampled = np.ones(STEPS, bool)
        self.sampled[1 + (number + 1) % UNSAMPLED::UNSAMPLED] = number == 0  # the first walk samples all

    def keys(self, char: np.ndarray, starts: np.ndarray, steps: set[int], look: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(steps, places that still walk, their keys after so many steps); char is padded behind its end."""
        at, key = starts.copy(), np.full(len(starts), 0x9E3779B9, np.uint32)
        for step in range(max(steps, default=0)):
            seen = char[at]
            if self.sampled[step]:
                key ^= seen
                key *= np.uint32(0x85EBCA6B)
                key ^= key >> np.uint32(15)
            if step + 1 in steps:
                yield step + 1, starts, key * np.uint32(0xC2B2AE35)
            if step + 1 == self.look and look is not None:
                on = np.flatnonzero(look[key * np.uint32(0xC2B2AE35) >> np.uint32(32 - _FILTER)])
                starts, at, key, seen = starts[on], at[on], key[on], seen[on]
            at += 1 if self.steady else (seen >> self.bits[step]) & np.uint32(1)


def places(char: np.ndarray, every: int) -> np.ndarray:
    """Places where walks start: one in ``every``, by the three characters there. char is padded."""
    n = len(char) - _PAD
    if every == 1:
        return np.arange(n)
    h = char[:n] + (char[1:n + 1] << np.uint32(1)) + (char[2:n + 2] << np.uint32(2))
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return np.flatnonzero(h < np.uint32((1 << 32) // every))


def signatures(code: np.ndarray) -> np.ndarray:
    """For each place the set of the pairs of characters in the _SIGNED places from it on, as 64 bits."""
    bits = np.zeros(len(code), np.uint64)
    h = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    bits[:-1] = np.uint64(1) << (h >> np.uint32(26)).astype(np.uint64)
    none = code == _NONE
    if none.any():
        bits[none] = 0
        bits[:-1][none[1:]] = 0
    w = 1
    while w < _SIGNED:
        bits[:-w] |= bits[w:]
        w *= 2
    return bits


def mixed(code: np.ndarray) -> np.ndarray:
    """32-bit hashes of characters, padded."""
    return mix(np.concatenate([code, np.zeros(_PAD, code.dtype)]).astype(np.uint64) + np.uint64(1)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts with one space after each word that has white space behind, their code points, their offsets)."""
    low = LOWER[raw]
    space = SPACE[low]
    after = np.concatenate([[False], ~space[:-1]])
    after[off[:-1][off[:-1] < len(low)]] = False
    kept = ~space | after
    low = np.where(space, np.uint8(32), low)
    begin = np.concatenate([[0], np.cumsum(kept & ((low & 0xC0) != 0x80))])
    text = low[kept].tobytes().decode()
    return text, code_points(text), begin[off]


def normal(text: str | None) -> list[str]:
    lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall(WORD, lowered)


class Pattern:
    """Edit distance of an item to its best match inside a stretch of text, by bit vectors."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def best(self, stretch: str) -> tuple[int, int]:
        """(smallest distance, end of that match in the stretch)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best = score, 0
        get = self.masks.get
        for k, c in enumerate(stretch):
            eq = get(c, 0)
            x = eq | minus
            d = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = (minus | ~(d | plus)) & full, plus & d
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus, minus = (down | ~(d | up)) & full, up & d
            if score < best[0]:
                best = score, k + 1
        return best


def edited(code: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """An item after so many substitutions, deletions and insertions of characters at random places."""
    at = np.sort(rng.permutation(len(code))[:edits])
    kind, new = rng.integers(0, 3, len(at)), rng.choice(code, len(at))
    out = np.repeat(code, 1 + np.bincount(at[kind == 2], minlength=len(code)) - np.bincount(at[kind == 1], minlength=len(code)))
    place = at + np.cumsum(kind == 2) - (kind == 2) - np.cumsum(kind == 1)  # of the edited characters in out
    out[place[kind != 1]] = new[kind != 1]
    return out


def spaced(code: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """An item with so many characters at even distances replaced by others."""
    out = code.copy()
    if edits:
        at = np.minimum((np.arange(edits) + rng.random()) * len(code) / edits, len(code) - 1).astype(np.int64)
        out[at] = code[at] + 1 + rng.integers(0, 9, edits).astype(code.dtype)
    return out


class Index:
    """Tables over the characters of a block of items. recalls has each class's simulated recall."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, recall: float = RECALL):
        kept = [(i, w) for i, w in ((i, normal(t)) for i, t in items) if w]
        self.ids = [i for i, _ in kept]
        texts = [" ".join(w) for _, w in kept]
        self.patterns = [Pattern(t) for t in texts]
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in texts]
        codes = [code_points(t) for t in texts]
        self.walks = [*(Walk(r) for r in range(WALKS)), Walk(WALKS, GAPS)]
        gap = np.full(NEAR, _NONE, "<u4")
        self.flat = np.concatenate([gap, *(x for c in codes for x in (c, gap))])
        self.begin = np.cumsum([NEAR] + [len(c) + NEAR for c in codes])[:-1]  # of each item in flat
        self.sign = signatures(self.flat)
        self.tables: dict[tuple[int, int, int], tuple] = {}
        self.recalls: dict[int, float] = {}
        self.steps: list[set[int]] = [set() for _ in self.walks]
        self.look = [np.zeros(1 << _FILTER, bool) for _ in self.walks]
        classes = np.array([item_class(len(c)) for c in codes])
        groups = {c: np.flatnonzero(classes == c) for c in np.unique(classes).tolist()}
        self.every = EVERY
        while True:
            plan = {}
            for c, own in groups.items():
                plan[c] = self._simulated(codes, own, recall)
                if plan[c][0] < LONG and self.every > 1:
                    break
            else:
                break
            self.every //= 2
        for c, own in groups.items():
            steps, walks, self.recalls[c] = plan[c]
            size = np.array([len(codes[k]) + _PAD for k in own])
            end = np.cumsum(size)
            flat = np.concatenate([mixed(codes[k]) for k in own])
            starts = np.concatenate([places(flat[e - n:e], self.every) + e - n for n, e in zip(size, end)])
            which = np.searchsorted(end, starts, "right")
            item, offset = own[which], starts - (end - size)[which]
            for r in [*range(walks), WALKS]:
                last = steps if r < WALKS else len(GAPS)
                keys = {k: key for k, _, key in self.walks[r].keys(flat, starts, {last, LOOK} if r < WALKS else {last})}
                key = keys[last]
                if r < WALKS:
                    self.look[r][keys[LOOK] >> np.uint32(32 - _FILTER)] = True
                order = np.argsort(key, kind="stable")
                first = np.zeros(1 << _FILTER, bool)
                first[key >> np.uint32(32 - _FILTER)] = True
                self.tables[r, last, c] = key[order], item[order].astype(np.int32), offset[order].astype(np.int32), first
                self.steps[r].add(last)

    def _simulated(self, codes: list[np.ndarray], own: np.ndarray, recall: float) -> tuple[int, int, float]:
        """(steps, walks, recall) of a class: most steps, then fewest walks, that find the target share of
        its items edited at the limit. A try is found by a hit that keeps(), as in a document; zero steps
        where no key does, unless walks start everywhere, which fails."""
        rng = np.random.default_rng(7)
        number = rng.choice(own, _TRIES)
        cut = [rng.integers(0, max(1, len(codes[k]) - LONGEST + 1)) for k in number]
        parts = [codes[k][a:a + LONGEST] for k, a in zip(number, cut)]
        share = [self.most[k] / len(codes[k]) for k in number]
        tries = [edited(p, int(x * len(p) + 1e-9), rng) for p, x in zip(parts, share)]
        noise = np.concatenate(parts)
        text = [np.concatenate([rng.choice(noise, NEAR), t, rng.choice(noise, NEAR)]) for t in tries]
        code = np.concatenate(text)
        char, around = mixed(code), np.pad(code, _PAD)
        sign = signatures(around)
        of = np.repeat(np.arange(_TRIES), [len(t) for t in text])
        begin = places(char, self.every)
        length = np.array([len(p) + _PAD for p in parts])
        end = np.cumsum(length)
        flat = np.concatenate([mixed(p) for p in parts])
        starts = np.concatenate([places(flat[e - n:e], self.every) + e - n for n, e in zip(length, end)])
        item_of = np.searchsorted(end, starts, "right")
        offset = starts - (end - length)[item_of] + np.array(cut)[item_of]
        found, best = np.zeros((STEPS + 1, _TRIES), bool), (0, 0, 0.0)
        for every, (r, walk) in ((e, w) for e in (set(range(LOOK, STEPS + 1)), set(range(1, LOOK))) for w in enumerate(self.walks[:WALKS], 1)):
            if best[0] >= max(every) or (self.every > 1 and min(every) < LOOK):
                break
            both = zip(walk.keys(char, begin, every), walk.keys(flat, starts, every))
            for steps, mine, theirs in ((k, a, b) for (k, _, a), (_, _, b) in both):
                theirs = theirs.astype(np.uint64) | item_of.astype(np.uint64) << np.uint64(32)
                order = np.argsort(theirs, kind="stable")
                mine = mine.astype(np.uint64) | of[begin].astype(np.uint64) << np.uint64(32)
                left = np.flatnonzero(~found[steps][of[begin]])
                n, at = matches(theirs[order], mine[left])
                at = order[at]
                place = begin[left[n]]
                good = self._keeps(around, sign, place, number[item_of[at]], offset[at])
                found[steps][of[place[good]]] = True
            for steps in range(STEPS, best[0], -1):
                if found[steps].mean() >= recall:
                    best = steps, r, float(found[steps].mean())
                    break
        if not best[0] and self.every == 1:
            raise ValueError(f"no keys find {recall} of the edited items of {min(map(len, parts))} to {max(map(len, parts))} characters: {found.mean(axis=1).max()}")
        return best

    def _keeps(self, code: np.ndarray, sign: np.ndarray, place: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Numbers of the hits that count; code is padded on both sides, sign has its signatures."""
        good = [np.zeros(0, np.int64)]
        for a in range(0, len(place), 16 * _HITS):
            at = np.arange(a, min(a + 16 * _HITS, len(place)))
            own = self.sign[self.begin[item[at]] + offset[at] - _SIGNED // 2]
            lacks = np.bitwise_count(own & ~sign[place[at] + _PAD - _SIGNED // 2])
            good.append(at[lacks <= MISSING * np.bitwise_count(own)])
        good = np.concatenate(good)
        for step, share in ((3, EQUAL - 0.1), (1, EQUAL)):
            kept = [self._equal(code, place[x], self.begin[item[x]] + offset[x], step, share) for x in np.split(good, range(_HITS, len(good), _HITS))]
            good = good[np.concatenate(kept)]
        kept = [self._close(code, place[x], item[x], offset[x]) for x in np.split(good, range(_HITS, len(good), _HITS))]
        return good[np.concatenate(kept)]

    def _equal(self, code: np.ndarray, place: np.ndarray, own: np.ndarray, step: int, share: float) -> np.ndarray:
        """Of the item's characters within NEAR of the hit, every step-th, a share has an equal one in the
        text at most DRIFT beside its place."""
        equal, there = np.zeros(len(place), np.int16), np.zeros(len(place), np.int16)
        rows: dict[int, np.ndarray] = {}
        for j in range(-NEAR, NEAR + 1, step):
            c = self.flat[own + j]
            same = np.zeros(len(place), bool)
            for d in range(j - DRIFT, j + DRIFT + 1):
                if d not in rows:
                    rows[d] = code[place + _PAD + d]
                same |= rows[d] == c
            rows.pop(j - DRIFT, None)
            equal += same
            there += c != _NONE
        return equal >= share * there

    def _close(self, code: np.ndarray, place: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Edit distance of SEGMENT characters of the item around each hit to the best stretch of the text
        there, all hits at once by bit vectors."""
        size = np.array([self.patterns[k].size for k in item], np.int64)
        first = np.clip(offset - SEGMENT // 2, 0, np.maximum(size - SEGMENT, 0))
        m = np.minimum(size, SEGMENT)
        j = np.arange(SEGMENT)
        segment = np.where(j < m[:, None], self.flat[np.minimum(self.begin[item][:, None] + first[:, None] + j, len(self.flat) - 1)], _NONE)
        slack = SEGMENT // 4
        begin = place + _PAD - (offset - first) - slack          # of the stretch in the padded code
        one, top = np.uint64(1), (m - 1).astype(np.uint64)
        plus, minus = np.full(len(place), ~np.uint64(0)), np.zeros(len(place), np.uint64)
        score = m.copy()
        best = score.copy()
        for k in range(SEGMENT + 2 * slack):
            c = code[np.clip(begin + k, 0, len(code) - 1)]
            eq = np.packbits(segment == c[:, None], axis=1, bitorder="little").view("<u8").ravel()
            x = eq | minus
            d = (((x & plus) + plus) ^ plus) | x
            up, down = minus | ~(d | plus), plus & d
            score += (up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64)
            up, down = up << one, down << one
            plus, minus = down | ~(d | up), up & d
            best = np.minimum(best, score)
        return best <= APART * m

    def find(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item number, distance, first word) of each item found in each text of a slice."""
        text, code, begin = characters(raw, off)
        char, around, hits, waiting, count = mixed(code), np.pad(code, _PAD), [], [], 0
        sign = signatures(around)
        begin_at, step = places(char, self.every), _PLACES * self.every
        for p in range(0, len(code), step):
            starts = begin_at[np.searchsorted(begin_at, p):np.searchsorted(begin_at, p + step)]
            for r, walk in enumerate(self.walks):
                for steps, walking, key in walk.keys(char, starts, self.steps[r], self.look[r]):
                    look = key >> np.uint32(32 - _FILTER)
                    for (w, s, _), (keys, item, offset, first) in self.tables.items():
                        if (w, s) == (r, steps):
                            near = np.flatnonzero(first[look])
                            n, at = matches(keys, key[near])
                            waiting.append((walking[near[n]], item[at], offset[at]))
                            count += len(n)
            if waiting and (count > _WAITING or p + step >= len(code)):
                place, k, o = (np.concatenate(x) for x in zip(*waiting))
                good = self._keeps(around, sign, place, k, o)
                hits.append(np.stack([np.searchsorted(begin, place[good], "right") - 1, k[good], place[good] - o[good]], axis=1))
                waiting, count = [], 0
        if not hits:
            return []
        hits = np.unique(np.concatenate(hits), axis=0)
        out, last = {}, {}
        for t, item, at in hits.tolist():
            size = self.patterns[item].size
            skip = size // 8
            if (t, item) in last and at - last[t, item] <= skip:
                continue  # inside the stretch that was just verified
            last[t, item] = at
            a, b = max(int(begin[t]), at - self.most[item]), min(int(begin[t + 1]), at + size + self.most[item] + skip)
            distance, _ = self.patterns[item].best(text[a:b].rstrip(" ") if b == begin[t + 1] else text[a:b])
            if distance <= self.most[item] and distance < out.get((t, item), (1 << 60, 0))[0]:
                out[t, item] = distance, text.count(" ", int(begin[t]), max(int(begin[t]), at))
        return [(t, item, d, at) for (t, item), (d, at) in sorted(out.items())]


def matches(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in own, number in the sorted keys) of all equal pairs."""
    lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    size = hi - lo
    return np.repeat(np.arange(len(own)), size), np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def blocks(items: DataFrame, similarity: float, block_items: int, **options) -> Iterator[Index]:
    """Indexes of blocks of about ``block_items`` items; each block comes to the driver and is broadcast."""
    table = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.length("text") > 0)
    n = -(-table.count() // block_items)
    for k in range(n):
        block = table.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted((r.item_id, r.text) for r in block if r.item_id is not None), similarity, **options)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, **options) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, distance, similarity, first_word."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", docs_type(docs)), ("item_id", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])
    ddl = f"doc_id {kind}, item_id long, distance long, similarity double, first_word long"
    out = spark.createDataFrame([], ddl)
    for index in blocks(items, similarity, block_items, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for i, _, raw, off in text_slices(b.column(1)):
                    found = index.find(raw, off)
                    if found:
                        text, item, distance, at = zip(*found)
                        size = [index.patterns[k].size for k in item]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + t for t in text])), pa.array([index.ids[k] for k in item], pa.int64()), pa.array(distance, pa.int64()),
                                                          pa.array([1 - d / s for d, s in zip(distance, size)]), pa.array(at, pa.int64())], schema=schema)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, ddl))
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in blocks(items, similarity, block_items, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            owns_worker("leaks")
            for b in batches:
                good = np.ones(b.num_rows, bool)
                for i, _, raw, off in text_slices(b.column(at)):
                    good[[i + f[0] for f in shared.value.find(raw, off)]] = False
                relax()
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
