"""Periodic run detection in word sequences, by seed-and-extend on diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2q) words that no
neighbouring word extends with period q. On the diagonal of lag q (word i against word i + q) it is a
stretch of equal pairs, of at least max(12 - q, q) pairs: no shorter than 6 for q < 12, and no shorter
than k for k <= q < 2k. So lags fall into classes (1 to 11, then 12 to 23, 24 to 47, ...), and every run
of a class holds an equal pair of k-grams (k = 6, 12, 24, ...), the smallest overlap the class guarantees.

For each class the k-grams of a text that occur twice in it are indexed (names of 2k-grams are pairs of
names of k-grams), and their occurrence pairs within reach are enumerated. A pair whose left neighbours
are equal too lies on a diagonal that an earlier pair has covered: the walk over occurrences skips such
stretches whole, and a table of the furthest covered word of each (text, lag) drops what is left, so a
diagonal is extended once. By the periodicity lemma an occurrence then has a bounded number of partners
besides the first one of a periodic stretch, so seeds grow as n log n, also for one word said n times.
Extension to the right reads the names from the longest k-grams down. Of stretches with the same ends
the smallest period wins.

Edge cases: a null or empty text has no words, no run and the digests of empty texts; a null doc_id
counts as the empty text in its checksum. Repeated rows are treated row by row. Words are compared by
64-bit hashes, within one text only. One text is read whole in one task; texts are dealt in slices of
2 MB, so that a longer text alone sets the memory. An empty table gives an empty result; only the named
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.common import owns_worker, relax
from footfall.llm.textops import hash_spans, mix, text_slices, words

SEED = 6        # words of the smallest seeds: lags below 2 * SEED
LEAST = 12      # words of a run at least
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
_ARROW = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in
                    ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")])


class Seeds:
    """Names of repeated k-grams: ``levels[a][i]`` is the name of the (6 * 2^a)-gram at word i of its
    text, or -1 where no other place of the same text has the same one."""

    def __init__(self, word: np.ndarray, text: np.ndarray):
        """``word``: hashes of words, each text followed by a word of its own that no other text has."""
        self.word, self.text = word, text
        self.levels: list[np.ndarray] = []
        n = len(word) - SEED
        if n <= 0:
            return
        gram = word[:n + 1].copy()
        for k in range(1, SEED):
            gram = mix(gram) + word[k:n + 1 + k]
        gram = mix(gram) ^ mix(text[:n + 1].astype(np.uint64))
        at = np.flatnonzero(text[:n + 1] == text[SEED - 1:])  # the closing word repeats nowhere
        self._add(at, gram[at])

    def _add(self, at: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        value = key[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
        alone = fresh & np.concatenate([fresh[1:], [True]]) if len(value) else fresh
        if alone.all():
            return
        name = np.full(len(self.word), -1, np.int32 if len(self.word) < 1 << 31 else np.int64)
        name[at[order[~alone]]] = (np.cumsum(fresh) - 1)[~alone]
        self.levels.append(name)

    def deepen(self) -> bool:
        """Names of k-grams twice as long as the last ones; false if none repeats."""
        name, k = self.levels[-1], SEED << (len(self.levels) - 1)
        at = np.flatnonzero(name >= 0)
        at = at[at + k < len(name)]
        at = at[name[at + k] >= 0]
        before = len(self.levels)
        if len(at):
            self._add(at, name[at].astype(np.int64) << 32 | name[at + k] if name.dtype == np.int32 else
                      np.unique(np.stack([name[at], name[at + k]], 1), axis=0, return_inverse=True)[1].ravel())
        return len(self.levels) > before

    def matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j, both in one text)."""
        done, last = np.zeros(len(i), np.int64), len(self.word) - 1
        for a in range(len(self.levels) - 1, -1, -1):
            x = self.levels[a][np.minimum(i + done, last)]
            done += np.where((x >= 0) & (x == self.levels[a][np.minimum(j + done, last)]), SEED << a, 0)
        for _ in range(SEED):  # what is left is shorter than the smallest seeds
            same = (j + done <= last) & (self.word[np.minimum(i + done, last)] == self.word[np.minimum(j + done, last)])
            if not same.any():
                break
            done += same
        return done

    def pairs(self, a: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of equal k-grams of class a whose left neighbours differ, lag in the class's range."""
        name, k = self.levels[a], SEED << a
        low, high = (1 if a == 0 else k), 2 * k
        at = np.flatnonzero(name >= 0)
        at = at[np.argsort(name[at], kind="stable")]          # by name, then place
        group = name[at]
        left = np.where(at > 0, self.word[at - 1], np.uint64(0))
        left_text = np.where(at > 0, self.text[at - 1], -1)    # the text before ends in a word of its own
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (left[1:] != left[:-1]) | (left_text[1:] != left_text[:-1])
        streak = np.cumsum(new) - 1                            # places in a row with the same left neighbour
        first = np.append(np.flatnonzero(new), len(at))
        row = np.arange(len(at))
        nxt = streak + 1
        while len(row):
            inside = nxt < len(first) - 1
            row, nxt = row[inside], nxt[inside]
            head = first[nxt]
            reach = (group[head] == group[row]) & (at[head] - at[row] < high)
            row, nxt, head = row[reach], nxt[reach], head[reach]
            own = first[streak[row]]
            use = (left[head] != left[own]) | (left_text[head] != left_text[own])
            yield from self._expand(at, row[use], head[use], first[nxt[use] + 1], low, high)
            nxt = nxt + 1

    @staticmethod
    def _expand(at, row, head, tail, low, high, step: int = 1 << 20):
        """Pairs of each row with the places of one streak, as far as the lag lies in the range."""
        size = tail - head
        edge = np.concatenate([[0], np.cumsum(size)])
        b = 0
        while b < len(row):
            e = max(b + 1, int(np.searchsorted(edge, edge[b] + step, "right")) - 1)
            r = np.repeat(np.arange(b, e), size[b:e])
            j = at[head[r] + np.arange(len(r)) + edge[b] - edge[r]]
            i = at[row[r]]
            keep = (j - i >= low) & (j - i < high)
            yield i[keep], j[keep]
            b = e


def find_runs(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, sorted by start, then period. ``word`` holds the hashes of
    all words of several texts, ``text`` the number of each word's text; each text ends in a word of
    its own that stands nowhere else."""
    seeds = Seeds(word, text)
    found = []
    while seeds.levels and seeds.deepen():
        pass
    for a in range(len(seeds.levels)):
        furthest: dict[str, np.ndarray] = {"key": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)}
        for i, j in seeds.pairs(a):
            i, j = uncovered(i, j, text, furthest)
            if not len(i):
                continue
            pairs = seeds.matched(i, j)
            cover(i, j, pairs, text, furthest)
            long = pairs >= np.maximum(LEAST - (j - i), j - i)
            found.append(np.stack([i[long], pairs[long] + (j - i)[long], (j - i)[long]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))                # same ends: the smallest period
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _diagonal(i, j, text):
    return text[i].astype(np.int64) << 36 | (j - i)


def uncovered(i, j, text, furthest):
    """The seeds that start beyond the furthest covered word of their text and lag; of several seeds at
    the same place one stays."""
    key = _diagonal(i, j, text)
    if len(furthest["key"]):
        at = np.minimum(np.searchsorted(furthest["key"], key), len(furthest["key"]) - 1)
        # earlier seeds may lie further right: a seed is covered only inside a stretch
        fresh = (furthest["key"][at] != key) | (i >= furthest["end"][at]) | (i < furthest["start"][at])
        i, j = i[fresh], j[fresh]
    return i, j


def cover(i, j, pairs, text, furthest):
    """Note the furthest stretch of each text and lag."""
    key = np.concatenate([furthest["key"], _diagonal(i, j, text)])
    start = np.concatenate([furthest.get("start", np.zeros(0, np.int64)), i])
    end = np.concatenate([furthest["end"], i + pairs])
    order = np.lexsort((end, key))
    last = np.ones(len(key), bool)
    last[:-1] = key[order][1:] != key[order][:-1]
    furthest.update(key=key[order][last], start=start[order][last], end=end[order][last])


def dropped(start: np.ndarray, length: np.ndarray, period: np.ndarray, n: int) -> np.ndarray:
    """Words that some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step)[:n] > 0


def repeated_order(doc_id, n: int) -> np.ndarray | None:
    """The contract's rewriting of one text in ten: word i >= a becomes word a + (i - a) % p; None where
    the words stay as they are."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _of_slice(ids: list, raw: np.ndarray, off: np.ndarray, rewrite: bool) -> pa.RecordBatch:
    starts, ends, first = words(raw, off)
    n_texts, count = len(off) - 1, np.diff(first)
    source = np.arange(len(starts))
    if rewrite:
        for t in range(n_texts):
            if (order := repeated_order(ids[t], int(count[t]))) is not None:
                source[first[t]:first[t + 1]] = first[t] + order
    # each text's words, then one closing word
    text = np.repeat(np.arange(n_texts), count + 1)
    close = first[1:] + np.arange(n_texts)
    own = np.ones(len(text), bool)
    own[close] = False
    word = np.empty(len(text), np.uint64)
    word[own] = hash_spans(raw, starts, ends)[source]
    word[close] = mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    start, length, period = find_runs(word, text)
    gone = dropped(start, length, period, len(text))[own]
    of = text[start] if len(start) else start
    edge = np.searchsorted(of, np.arange(n_texts + 1))
    data, rows = raw.tobytes(), {n: [] for n in _ARROW.names}
    empty = _sha(b"")
    for t in range(n_texts):
        a, b = int(edge[t]), int(edge[t + 1])
        said = data[off[t]:off[t + 1]].split()                 # ASCII white space, as `words` has it
        span = slice(int(first[t]), int(first[t + 1]))
        best = (None, None, None, None)
        if b > a:
            s, m, q = start[a:b] - (first[t] + t), length[a:b], period[a:b]
            kept = (source[span] - first[t])[~gone[span]].tolist()
            said = [said[x] for x in kept]
            top = int(np.lexsort((q, s, -m))[0])
            best = int(s[top]), int(m[top]), int(q[top]), int(1000 * m[top] // q[top])
            runs = _sha("".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), m.tolist(), q.tolist())).encode())
        else:
            runs = empty
            if source[span.start:span.stop].size and source[span.stop - 1] != span.stop - 1:
                said = [said[x] for x in (source[span] - first[t]).tolist()]
        for name, value in zip(_ARROW.names, (ids[t], b - a, *best, runs, _sha(b" ".join(said)))):
            rows[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _ARROW], schema=_ARROW)


def periodic_runs(docs: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its number of runs, its longest run, and the digests of all runs and of the
    text without repetitions (words that a run holds after its first period are dropped). ``rewrite``
    first makes one text in ten periodic, as the contract of the query says."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("runs")
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, raw, off in text_slices(b.column(1)):
                yield _of_slice(ids[i:j], raw, off, rewrite)
                relax()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
