"""Packing (4): vector bin packing of token streams into training sequences.

Every item is a vector (tokens, one segment, loss-bearing tokens) and every sequence has a
limit in each dimension. The open sequence takes the item whose vector has the largest dot
product with what is left of the limits (Panigrahy et al., 2011, "Heuristics for vector bin
packing"); when nothing fits any more, the best item is cut to fill the sequence.

Each task packs its own partition in one pass over a bounded pool of remainders: token ids are
never shuffled, and no task waits for another one.

A document is the text of one row, or of several: instruction data are the turns of a conversation,
of which only some roles bear loss (pack_turns).

Defined results: null text is an empty document (its only id is the end id); repeated rows are
packed once each; a null doc_id stays null; of equal scores the item that came first is taken; very
long texts are cut into as many whole sequences as they fill; an empty table gives no pieces; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe_codec import json_encoder
from graphloom.llm.common import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Documents whose remainders are considered together.
POOL = 1024
#: Ids of a conversation from which on it goes on as another document.
LONG = 1 << 18


class VectorPacker:
    """Packs a stream of (doc_id, ids, loss) into sequences under three simultaneous limits. loss: 0 or 1 for each id."""

    def __init__(self, first_sequence: int, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("every limit has to be 1 at least")
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.sequence, self.pool_size = first_sequence, pool
        self.pool: list[tuple] = []  # (doc_id, ids, loss flags, start)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, loss: np.ndarray) -> None:
        size, at = int(self.limits[0]), 0
        while len(ids) - at >= size and loss[at : at + size].sum() <= self.limits[2]:
            self._emit([(doc_id, ids, loss, at, size)])
            at += size
        if at < len(ids):
            self.pool.append((doc_id, ids, loss, at))
        if len(self.pool) >= self.pool_size:
            self._pack(self.pool_size // 4)

    def finish(self) -> None:
        self._pack(0)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _pack(self, keep: int) -> None:
        """Fill sequences until only `keep` remainders are left (0: all of them)."""
        items = self.pool
        left = np.array([[len(x[1]) - x[3], 1, x[2][x[3] :].sum()] for x in items], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(items), dtype=bool)
        while alive.sum() > keep:
            if not keep and left[alive, 0].sum() < self.limits[0]:
                self._last([items[i] for i in np.flatnonzero(alive)])
                alive[:] = False
                break
            room, bin_ = self.limits.copy(), []
            while room[0] > 0 and room[1] > 0 and alive.any():
                score = (left / self.limits) @ (room / self.limits)
                fits = alive & (left <= room).all(axis=1)
                best = int(np.argmax(np.where(fits if fits.any() else alive, score, -1.0)))
                doc_id, ids, loss, at = items[best]
                n = len(ids) - at
                if not fits.any():
                    n = int(min(n, room[0]))
                    n = int(np.searchsorted(np.cumsum(loss[at : at + n]), room[2], side="right"))
                    if n == 0:
                        break
                bin_.append((doc_id, ids, loss, at, n))
                room -= (n, 1, loss[at : at + n].sum())
                if at + n == len(ids):
                    alive[best] = False
                else:
                    items[best] = (doc_id, ids, loss, at + n)
                    left[best] = (len(ids) - at - n, 1, loss[at + n :].sum())
            self._emit(bin_)
        self.pool = [items[i] for i in np.flatnonzero(alive)]

    def _last(self, items: list[tuple]) -> None:
        """The end of the stream fills no whole sequence: cut it at powers of two, which need no padding.
        Where another limit ends a sequence before, it is cut at the power of two below."""
        pieces = [(d, ids, loss, at, len(ids) - at) for d, ids, loss, at in items]
        while pieces:
            most, taken, loss_left = 0, 0, self.limits[2]
            # How far the sequence could go under the limits on segments and loss.
            for _, _, loss, at, n in pieces[: int(self.limits[1])]:
                bears = np.cumsum(loss[at : at + n])
                most += (got := int(np.searchsorted(bears, loss_left, side="right")))
                if got < n:
                    break
                loss_left -= bears[-1]
            room, bin_ = 1 << (min(most, int(self.limits[0])).bit_length() - 1), []
            while taken < room:
                d, ids, loss, at, n = pieces.pop(0)
                got = min(n, room - taken)
                bin_.append((d, ids, loss, at, got))
                if got < n:
                    pieces.insert(0, (d, ids, loss, at + got, n - got))
                taken += got
            self._emit(bin_)

    def _emit(self, bin_: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, loss, at, n in bin_:
            part = ids[at : at + n]
            self.rows.append((doc_id, at, n, zlib.crc32(part.tobytes()), len(ids), self.sequence, offset, int(loss[at : at + n].sum())))
            offset += n
        self.sequence += 1


def _pack(rows: DataFrame, docs_of: Callable[[Iterator[pd.DataFrame], Callable], Iterator[tuple]], limits: tuple[int, int, int], tokenizer_file: str | None) -> DataFrame:
    """docs_of(batches, encode) gives doc_id, ids and loss flags of each document."""
    small_batches(rows.sparkSession)
    VectorPacker(0, *limits)  # limits that cannot be met fail here and not in a task
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = VectorPacker(TaskContext.get().partitionId() << 36, *limits)

        def out() -> pd.DataFrame:
            got = pd.DataFrame(packer.take(), columns=names, dtype=object)
            for c in names[1:]:
                got[c] = got[c].astype("int64")
            got["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in got["doc_id"]], dtype="Int64")
            return got

        for doc_id, ids, loss in docs_of(batches, json_encoder(tokenizer_file)):
            packer.add(doc_id, ids, loss)
            if len(packer.rows) >= 4096:
                yield out()
        packer.finish()
        yield out()

    return rows.mapInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, end_id: int = 1, tokenizer_file: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences. Every id of plain text bears loss."""

    def docs_of(batches: Iterator[pd.DataFrame], encode: Callable) -> Iterator[tuple]:
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array(encode(text or "") + [end_id], dtype="<u4")
                yield doc_id, ids, np.ones(len(ids), dtype=np.int64)

    return _pack(docs.select("doc_id", "text"), docs_of, (max_tokens, max_segments, max_loss), tokenizer_file)


def pack_turns(
    turns: DataFrame, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1024, end_id: int = 1, loss_roles: tuple[str, ...] = ("assistant",), tokenizer_file: str | None = None
) -> DataFrame:
    """Pieces of all conversations (conv_id, turn, role, text) in sequences; doc_id is the conv_id.

    A conversation is its turns by number, then role and text, each with end_id after it; ids of
    loss_roles bear loss, those of a null role do not. The turns are sorted over all tasks and read in
    order, so none has to hold a conversation whole: one of more than LONG ids, or at the border of two
    tasks, goes on as another document. Turns without a conv_id are one conversation each."""
    bears = F.coalesce(F.col("role").isin(list(loss_roles)), F.lit(False)).alias("bears")
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*keys, bears).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def docs_of(batches: Iterator[pd.DataFrame], encode: Callable) -> Iterator[tuple]:
        now, parts, flags, n = None, [], [], 0
        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["conv_id"]]
            for conv_id, text, loss in zip(ids, b["text"], b["bears"]):
                if parts and (conv_id is None or conv_id != now or n > LONG):
                    yield now, np.concatenate(parts), np.concatenate(flags)
                    parts, flags, n = [], [], 0
                now = conv_id
                parts.append(np.array(encode(text or "") + [end_id], dtype="<u4"))
                flags.append(np.full(len(parts[-1]), int(loss), dtype=np.int64))
                n += len(parts[-1])
        if parts:
            yield now, np.concatenate(parts), np.concatenate(flags)

    return _pack(rows, docs_of, (max_tokens, max_segments, max_loss), tokenizer_file)
