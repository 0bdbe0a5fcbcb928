"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Byte-level BPE never merges over a space that stands between two visible characters, so a text is
the concatenation of pieces cut before such spaces, and the ids of a text are the ids of its pieces.
Pieces repeat a lot; a worker keeps the ids of those it has seen and asks the tokenizer only for new
ones; beyond ``KEEP`` pieces it forgets those that it met once.

An empty text (and so a null one) has no ids; a text without a place to cut is one piece, however long;
no texts give no ids.
"""

from __future__ import annotations

import functools

import numpy as np

from footfall.llm.common import owns_worker
from footfall.llm.textops import hash_spans

KEEP = 2_000_000
SLICE = 4 << 20  # larger slices than elsewhere: a piece is looked up once in each
END_ID = 0
_JOIN = 1 << 16  # bytes of new pieces given to the tokenizer as one text
_VISIBLE = np.zeros(256, bool)  # one-byte characters that are not white space or control
_VISIBLE[0x21:0x7F] = True


@functools.cache
def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@functools.cache
def kept_ids(path: str) -> PieceIds:
    return PieceIds(path)


def piece_ids(path: str) -> PieceIds:
    """The worker's encoder, kept between its tasks."""
    owns_worker("tokens", kept_ids.cache_clear, tokenizer.cache_clear)
    return kept_ids(path)


class PieceIds:
    def __init__(self, path: str):
        self.tok = tokenizer(path)
        space = self.tok.encode(" ", add_special_tokens=False).tokens[0][0]  # how the vocabulary writes a space
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith(space)
        self.clear()

    def clear(self):
        none = np.zeros(0, np.uint64)
        self.known = [(none, none.astype(np.int32)), (none, none.astype(np.int32))]  # large and small: hashes, piece numbers
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.opens) <= 1 << 16 else np.int32)
        self.first = np.zeros(1 << 14, np.int32)  # of piece k: its ids are ids[first[k]:first[k + 1]]
        self.uses = np.zeros(1 << 14, np.uint8)
        self.count = 0

    def forget(self):
        """Drop the pieces that only one slice has had."""
        keep = np.flatnonzero(self.uses[:self.count] > 1)
        if len(keep) > KEEP // 2:
            self.clear()
            return
        ids, size = self._ids_of(keep)
        number = np.full(self.count, -1, np.int32)
        number[keep] = np.arange(len(keep), dtype=np.int32)
        both = [(h, number[v]) for h, v in self.known]
        self.known = [(h[v >= 0], v[v >= 0]) for h, v in both]
        self.ids[:len(ids)] = ids
        self.first[1:len(keep) + 1] = np.cumsum(size)
        self.uses[:len(keep)] = 1
        self.count = len(keep)

    def _ids_of(self, piece):
        """Ids of pieces, one after another, and how many each has."""
        begin = self.first[piece].astype(np.int64)
        size = self.first[piece + 1] - begin
        end = np.cumsum(size)
        source = np.repeat(begin - (end - size), size)
        source += np.arange(len(source))
        return self.ids[source], size

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); no end ids yet."""
        starts, ends, plain = pieces(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.count > KEEP:
            self.forget()
        keys, at, inverse = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._add(raw, starts[at[new]], ends[at[new]], plain[at[new]], keys[new])
        self.uses[number] = np.minimum(self.uses[number], 254) + 1
        ids, size = self._ids_of(number[inverse])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids.astype(np.int32), total[np.searchsorted(starts, offsets)]

    def _find(self, keys):
        number = np.full(len(keys), -1, np.int32)
        for have, value in self.known:
            if len(have):
                k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[k] == keys
                number[hit] = value[k[hit]]
        return number

    def _add(self, raw, starts, ends, plain, keys):
        data = raw.tobytes()
        size = np.zeros(len(starts), np.int64)
        parts: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        # pieces of one space and visible characters: joined; a token that opens with a space opens a piece
        texts, have = [], 0
        begin = 0
        bound = np.cumsum(ends[order[:n]] - starts[order[:n]])
        while begin < n:
            stop = max(begin + 1, int(np.searchsorted(bound, (bound[begin - 1] if begin else 0) + _JOIN, "right")))
            texts.append(b"".join(data[a:b] for a, b in zip(starts[order[begin:stop]].tolist(), ends[order[begin:stop]].tolist())).decode())
            begin = stop
        if texts:
            got = np.concatenate([np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            opens = np.flatnonzero(self.opens[got])
            if len(opens) != n:
                raise ValueError("the tokenizer merges over piece boundaries; it is not byte-level BPE without a prefix space")
            size[order[:n]] = np.diff(np.append(opens, len(got)))
            parts.append(got)
        odd = [data[a:b].decode() for a, b in zip(starts[order[n:]].tolist(), ends[order[n:]].tolist())]
        if odd:
            coded = [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(odd, add_special_tokens=False)]
            size[order[n:]] = [len(x) for x in coded]
            parts += coded
        number = np.empty(len(starts), np.int32)
        number[order] = np.arange(self.count, self.count + len(order))
        added, before = int(size.sum()), int(self.first[self.count])
        self.ids = grown(self.ids, before + added)
        self.first, self.uses = grown(self.first, self.count + len(order) + 1), grown(self.uses, self.count + len(order))
        if parts:
            self.ids[before:before + added] = np.concatenate(parts)
        self.first[self.count + 1:self.count + 1 + len(order)] = before + np.cumsum(size[order])
        self.uses[self.count:self.count + len(order)] = 0
        self.count += len(order)
        (big, bigv), (small, smallv) = self.known
        small, smallv = merged(small, smallv, keys, number)
        if len(small) * 4 > len(big):
            big, bigv = merged(big, bigv, small, smallv)
            small, smallv = small[:0], smallv[:0]
        self.known = [(big, bigv), (small, smallv)]
        return number


def grown(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, len(a) * 3 // 2), a.dtype)
    out[:len(a)] = a
    return out


def merged(a, av, b, bv):
    keys, values = np.concatenate([a, b]), np.concatenate([av, bv])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and whether a piece is one space and visible characters only."""
    n = len(raw)
    texts = offsets[:-1][np.diff(offsets) > 0]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ascii_ = _VISIBLE[raw]
    latin = raw == 0xC3  # lead byte of accented letters, none of which is white space
    before = ascii_.copy()  # this byte ends a visible character
    before[1:] |= latin[:-1]
    opens = ascii_ | latin
    cut = np.zeros(n, bool)
    cut[1:-1] = (raw[1:-1] == 32) & before[:-2] & opens[2:] & ~edge[1:n - 1] & ~edge[2:n]
    cut[texts] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    odd = ~(ascii_ | (raw >= 0x80))  # white space and control bytes
    plain = (raw[starts] == 32) & (np.add.reduceat(odd, starts, dtype=np.int32) == 1) & ~edge[starts]
    # a multi-byte character that is white space may stand inside: only accented letters are plain
    return starts, ends, plain & ~np.logical_or.reduceat((raw >= 0xC0) & ~latin, starts)
