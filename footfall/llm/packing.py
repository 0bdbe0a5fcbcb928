"""Packing of documents into training sequences: vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments (pieces) and loss-bearing tokens. Documents longer
than a sequence are cut into full sequences; what is left of each document is an item with three
sizes. The open sequence takes, of the items that fit, the one whose sizes have the largest dot
product with what the sequence has left of each limit (both as shares of the limits); when nothing
fits and the gap is worth it, the item whose head fills most of it within the limits is cut: a sequence
that is full of loss-bearing tokens takes the prompt of another document. Each task packs its own documents from a
bounded pool, so there is no shuffle and each task pads at most its last sequence noticeably. A
sequence is padded to the token limit, except where its length is a power of two.

Null and empty texts are one end id; texts of any length are cut; repeated rows are packed each.
An empty table gives no rows. Columns other than the id, text and loss columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.bpe import END_ID, SLICE, piece_ids
from footfall.llm.common import relax
from footfall.llm.textops import text_slices

POOL = 4096  # unpacked remainders that a task holds
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long, padded_tokens long")
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class Packer:
    """Packs items of one task; ``done`` holds finished pieces as rows."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, min_cut: int, base: int):
        self.limit = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.min_cut = max_tokens, min_cut
        self.next_id = base
        self.size = np.zeros((0, 3))  # tokens, segments, loss-bearing tokens of each waiting item
        self.items: list[tuple] = []  # (doc_id, start, ids, doc_tokens, first loss-bearing position)
        self.done: list[tuple] = []

    @staticmethod
    def loss(start: int, length: int, loss_from: int) -> int:
        """Loss-bearing tokens of a piece: those from loss_from on, without the piece's first token,
        which has nothing before it to be predicted from."""
        return max(0, start + length - max(start + 1, loss_from))

    def add(self, doc_id, ids: np.ndarray, loss_from: int) -> None:
        n, at = len(ids), 0
        while n - at >= self.max_tokens and self.loss(at, self.max_tokens, loss_from) <= self.limit[2]:
            self.emit([(doc_id, at, ids[at:at + self.max_tokens], n, loss_from)])
            at += self.max_tokens
        while at < n:  # more than one piece only where the loss limit is the tighter one
            size = min(n - at, self.max_tokens)
            if self.loss(at, size, loss_from) > self.limit[2]:
                size = min(size, max(int(self.limit[2]) + 1, loss_from - at))
            self.items.append((doc_id, at, ids[at:at + size].copy(), n, loss_from))
            at += size

    def emit(self, pieces: list[tuple]) -> None:
        total = sum(len(p[2]) for p in pieces)
        padded = total if total & (total - 1) == 0 else self.max_tokens
        offset = 0
        for doc_id, start, ids, n, _ in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset, total, padded))
            offset += len(ids)
        self.next_id += 1

    def pack(self, leave: int) -> None:
        """Fill sequences until at most ``leave`` items wait."""
        if len(self.items) <= leave:
            return
        items, self.items = self.items, []
        size = np.array([[len(x[2]), 1, self.loss(x[1], len(x[2]), x[4])] for x in items], np.float64)
        prompt = np.array([max(0, x[4] - x[1]) for x in items], np.float64)  # tokens of an item before its first loss-bearing one
        share = size / self.limit
        alive = np.ones(len(items), bool)
        waiting = len(items)
        while waiting > leave:
            room, chosen = self.limit.copy(), []
            while waiting:
                fits = alive & (size <= room).all(axis=1)
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, share @ (room / self.limit), -1.0)))
                chosen.append(items[k])
                room -= size[k]
                alive[k] = False
                waiting -= 1
            gap = int(room[0])
            if waiting and gap >= self.min_cut and room[1] >= 1:
                # nothing fits whole: cut the item whose head fills most of the gap, of these the longest
                heads = np.minimum(np.minimum(gap, size[:, 0] - 1), np.maximum(prompt, 1) + room[2])
                k = int(np.argmax(np.where(alive, heads * (self.max_tokens + 1) + size[:, 0], -1.0)))
                doc_id, start, ids, n, loss_from = items[k]
                head = int(heads[k])
                if head >= self.min_cut:
                    chosen.append((doc_id, start, ids[:head], n, loss_from))
                    items[k] = (doc_id, start + head, ids[head:], n, loss_from)
                    size[k] = len(ids) - head, 1, self.loss(start + head, len(ids) - head, loss_from)
                    share[k], prompt[k] = size[k] / self.limit, max(0, loss_from - start - head)
            self.emit(chosen)
        self.items = [x for x, a in zip(items, alive) if a]

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)] if done else [pa.array([], pa.int64())] * len(_ARROW), schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, max_segments: int = 512, max_loss: int = 1024,
         min_cut: int = 8, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, loss_share: float = 1.0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    sequence's tokens and padded length.

    ``loss_col`` counts a document's loss-bearing tokens, which are its last ones (the answer of an
    instruction pair); without it the last ``loss_share`` of a document's tokens bear loss.
    """
    if min(max_tokens, max_segments, max_loss, min_cut) < 1:
        raise ValueError("limits must be at least 1")
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder = piece_ids(tokenizer)
        packer = Packer(max_tokens, max_segments, max_loss, min_cut, TaskContext.get().partitionId() << 40)
        for b in batches:
            ids_of, losses = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, j, raw, off in text_slices(b.column(1), SLICE):
                ids, at = coder.encode(raw, off)
                for k in range(i, j):
                    own = np.append(ids[at[k - i]:at[k - i + 1]], np.int32(END_ID))
                    bearing = losses[k]
                    packer.add(ids_of[k], own, max(0, len(own) - (int(loss_share * len(own)) if bearing is None else bearing)))
                    if len(packer.items) >= POOL:
                        packer.pack(POOL // 2)
                yield packer.rows()
        packer.pack(0)
        relax()
        yield packer.rows()

    return table.mapInArrow(run, SCHEMA)
