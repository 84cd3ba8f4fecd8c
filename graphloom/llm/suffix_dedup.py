"""Suffix-array dedup (1): distributed prefix doubling over a sparse set of suffixes.

A rank is a name of a substring of fixed length: two positions have equal ranks if and only if
the substrings are equal. Inside a task ranks double locally (the name of 2L bytes at i mixes the
names of L bytes at i and i + L); across documents Spark sorts (rank, position) rows by rank, drops
what is unique, and reranks the rest by a longer substring, until a position is unique or the
substring is past the threshold.

A suffix array over every byte would shuffle many times the input. Every window of `min_bytes`
bytes therefore names one of its own positions, its anchor: the leftmost of its `gram`-byte
substrings of least rank. Equal windows have equal anchors at equal offsets, so only anchors have
to be sorted, less than 2 % of the positions of ordinary text:

1. rank the anchors by `gram` bytes: an anchor whose rank is unique has no repeated window;
2. rerank the rest by the block of all windows that share an anchor. An equal pair (gram rank,
   block rank) elsewhere: every window of the block repeats. A single block in its gram: none does;
3. rerank what is still open in steps of `step` windows at one offset from the anchor, by the pair
   (rank of the bytes that these windows share, rank of all their bytes), with the same rule;
4. rerank what is then open window by window, past the threshold.

Each step keeps one example of every distinct pair of ranks, so large groups of copies shrink to
one row, and no step makes pairs within a group.

Ranks are 64-bit mixes of bytes, and every decision takes two of them, 128 bits; bytes that were made to
collide with these public constants are not guarded against.

Defined results: null text is the empty text; repeated rows count as occurrences of each other;
overlapping occurrences count; texts under `min_bytes` keep every byte; very long texts are ranked in
overlapping segments, whole; a null doc_id stays null; an empty table gives no rows; other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, keyed, materialize, rejoin, small_batches

#: Bytes that are ranked at once; longer texts are ranked in overlapping segments.
CHUNK = 1 << 19
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
_LOW = np.uint64(0xFFFFFF)


def mix(a: np.ndarray, b) -> np.ndarray:
    x = a * _A
    x ^= x >> _S32
    x += np.asarray(b).astype(np.uint64)
    x *= _B
    x ^= x >> _S29
    return x


class Ranks:
    """Names of substrings of a buffer, made by doubling."""

    def __init__(self, buf: np.ndarray, base: int, also: int):
        h, n = _BYTE[buf], 1
        self.gram = h if also == 1 else None
        while n < base:
            h = mix(h[:-n], h[n:]) if len(h) > n else h[:0]
            n *= 2
            if n == also:
                self.gram = h
        self.h, self.base = h, n

    def of(self, length: int) -> np.ndarray:
        """Names of all substrings of base <= length <= 2 * base bytes."""
        gap = length - self.base
        return mix(self.h[: len(self.h) - gap], self.h[gap:]) if len(self.h) > gap else self.h[:0]


def _power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m, n = a, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if n < width else m


def anchor_blocks(texts: list[bytes], t: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, gram rank, block rank, first window, last window, anchor of every block.

    A block is a run of windows of t bytes with one anchor; positions are counted in the text."""
    parts = [(i, at, text[at : at + CHUNK + t - 1]) for i, text in enumerate(texts) for at in range(0, max(len(text) - t + 1, 0), CHUNK)]
    found, group, size = [], [], 0
    for k, part in enumerate(parts):
        group.append(part)
        size += len(part[2])
        if size < CHUNK and k + 1 < len(parts):
            continue
        buf = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
        ends = np.cumsum([len(p[2]) for p in group])
        begins = ends - [len(p[2]) for p in group]
        ranks = Ranks(buf, _power(t), gram)
        window = ranks.of(t)
        key = (ranks.gram & ~_LOW) | np.arange(len(ranks.gram), dtype=np.uint64)
        anchor = (sliding_min(key, t - gram + 1) & _LOW).astype(np.int64)
        inside = np.zeros(len(buf) + 1, dtype=np.int64)
        inside[begins] += 1
        inside[ends - t + 1] -= 1
        p = np.flatnonzero(np.cumsum(inside)[: len(window)] > 0)
        a = anchor[p]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        lo, hi, a = p[first], p[np.r_[first[1:] - 1, len(p) - 1]], a[first]
        block = mix(mix(window[lo], window[hi]), (hi - lo) * 1024 + (a - lo))
        of = np.searchsorted(ends, lo, side="right")
        shift = np.array([g[1] for g in group])[of] - begins[of]
        found.append((np.array([g[0] for g in group])[of], ranks.gram[a], block, lo + shift, hi + shift, a + shift))
        group, size = [], 0
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    text, g, b, lo, hi, a = (np.concatenate(x) for x in zip(*found))
    return text, g.view(np.int64), b.view(np.int64), lo, hi, a


def _pack(lo, hi, a):
    return lo << 20 | (hi - lo) << 10 | (a - lo)


def _unpack(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = where >> 20
    return lo, lo + (where >> 10 & 1023), lo + (where & 1023)


def _anchors(docs: DataFrame, t: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, g, block, lo, hi, a = anchor_blocks([(x or "").encode() for x in b["text"]], t, gram)
            yield pd.DataFrame({"id": b["id"].to_numpy()[text], "h": b["h"].to_numpy()[text], "gram": g, "block": block, "at": _pack(lo, hi, a)})

    return docs.mapInPandas(run, "id long, h long, gram long, block long, at long")


def _several(rows: DataFrame, *ranks: str) -> DataFrame:
    """Ranks that occur more than once. Written, so that in a join on a hot rank both sides come from a plain shuffle, which Spark can split."""
    return materialize(rows.groupBy(*ranks).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*ranks))


def _rerank(rows: DataFrame, outer: str, inner: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs of ranks that occur again; one example row of each pair that stays open: the pairs whose
    outer rank occurs with other inner ranks too; and the tables that both read."""
    pairs = materialize(rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "at")).alias("row")), release=True)
    several = _several(pairs, outer)
    return pairs.filter("n > 1").select(outer, inner), pairs.join(several, outer, "left_semi").select(outer, "row.*"), [pairs, several]


def _cut_blocks(docs: DataFrame, open_: DataFrame, t: int) -> DataFrame:
    """The bytes of open blocks. One join brings the texts to them."""
    lists = open_.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "at")).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, h, text, grams, ats in zip(b["id"], b["h"], b["text"], b["grams"], b["ats"]):
                data = text.encode()
                lo, hi, _ = _unpack(ats)
                rows += [(id_, h, g, at, data[x : y + t]) for g, at, x, y in zip(grams, ats, lo, hi)]
            yield pd.DataFrame(rows, columns=["id", "h", "gram", "at", "bytes"])

    return docs.join(lists, ["id", "h"]).select("id", "h", "text", F.col("blocks.gram").alias("grams"), F.col("blocks.at").alias("ats")).mapInPandas(run, "id long, h long, gram long, at long, bytes binary")


def _steps(blocks: DataFrame, t: int, step: int) -> DataFrame:
    """Blocks cut at every `step`-th offset from the anchor: core and full ranks of each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([len(x) for x in b["bytes"]], dtype=np.int64)
            base = np.cumsum(sizes) - sizes
            ranks = Ranks(np.frombuffer(b"".join(b["bytes"]), dtype=np.uint8), _power(t - step + 1), 0)
            cores, fulls = ranks.of(t - step + 1), ranks.of(t + step - 1) if t + step - 1 <= 2 * ranks.base else ranks.of(t)
            lo, hi, a = _unpack(b["at"].to_numpy())
            low, high = (a - hi) // step, (a - lo) // step
            n = high - low + 1
            row = np.repeat(np.arange(len(n)), n)
            j = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            last = a[row] - step * j  # its windows begin at last - step + 1 to last
            whole = (last <= hi[row]) & (last - step + 1 >= lo[row])
            core = mix(mix(cores[base[row] + last - lo[row]], b["gram"].to_numpy().view(np.uint64)[row]), j)
            start = np.where(whole, base[row] + last - step + 1 - lo[row], 0)
            if t + step - 1 <= 2 * ranks.base:
                all_ = fulls[np.minimum(start, max(len(fulls) - 1, 0))] if len(fulls) else core
            else:
                all_ = mix(fulls[start], fulls[np.minimum(start + step - 1, len(fulls) - 1)])
            own = mix(mix(b["id"].to_numpy().view(np.uint64)[row], b["h"].to_numpy().view(np.uint64)[row]), b["at"].to_numpy()[row] * 1024 + j)
            full = np.where(whole, mix(all_, j), mix(own, 1))
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "h": b["h"].to_numpy()[row], "at": b["at"].to_numpy()[row] * 1024 + j, "core": core.view(np.int64), "full": full.view(np.int64)})

    return blocks.mapInPandas(run, "id long, h long, at long, core long, full long")


def _windows(open_: DataFrame, blocks: DataFrame, t: int, step: int) -> DataFrame:
    """Every window of the pieces that are still open, with its rank. Equal windows have one core rank, as their anchors have one offset."""
    pieces = open_.select("core", "id", "h", F.shiftright("at", 10).alias("at"), F.col("at").bitwiseAND(1023).alias("j"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([len(x) for x in b["bytes"]], dtype=np.int64)
            base = np.cumsum(sizes) - sizes
            window = Ranks(np.frombuffer(b"".join(b["bytes"]), dtype=np.uint8), _power(t), 0).of(t)
            lo, hi, a = _unpack(b["at"].to_numpy())
            last = a - step * b["j"].to_numpy()
            begin, end = np.maximum(last - step + 1, lo), np.minimum(last, hi)
            n = end - begin + 1
            row = np.repeat(np.arange(len(n)), n)
            p = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "h": b["h"].to_numpy()[row], "core": b["core"].to_numpy()[row], "p": p, "w": window[base[row] + p - lo[row]].view(np.int64)})

    return pieces.join(blocks, ["id", "h", "at"]).select("id", "h", "core", "at", "j", "bytes").mapInPandas(run, "id long, h long, core long, p long, w long")


def repeated_spans(docs: DataFrame, min_bytes: int = 200, gram: int = 32, step: int = 16) -> DataFrame:
    """keyed() documents with spans: [start, end) of repeated bytes, unmerged, or null."""
    t = min_bytes
    if not (0 < gram <= t - step + 1 and t <= 1000 and gram == _power(gram)):
        raise ValueError("gram has to be a power of two of at most min_bytes - step + 1, min_bytes at most 1000")
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    slim = rows.select("id", "h", "text")
    anchors = materialize(_anchors(slim.filter(F.octet_length("text") >= t), t, gram))
    again = _several(anchors, "gram")
    shared = materialize(anchors.join(again, "gram", "left_semi"), release=True)
    drop_written(anchors, again)
    equal, open_, old = _rerank(shared, "gram", "block")
    blocks = materialize(_cut_blocks(slim, open_, t))
    pieces = materialize(_steps(blocks, t, step), release=True)
    equal_pieces, open_pieces, old_pieces = _rerank(pieces, "core", "full")
    windows = materialize(_windows(open_pieces, blocks, t, step), release=True)
    same = _several(windows, "core", "w")
    repeated = windows.join(same, ["core", "w"], "left_semi")

    lo, first = F.shiftright("at", 20), F.shiftright("at", 10)
    width = F.shiftright("at", 10).bitwiseAND(1023)
    whole_blocks = shared.join(equal, ["gram", "block"], "left_semi").select("id", "h", lo.alias("s"), (lo + width + t).alias("e"))
    piece_of = pieces.join(equal_pieces, ["core", "full"], "left_semi").select("id", "h", first.alias("at"), F.col("at").bitwiseAND(1023).alias("j"))
    last = lo + F.col("at").bitwiseAND(1023) - F.col("j") * step
    # Of a repeated row even pieces that are not whole are equal: they end where their block does.
    whole_pieces = piece_of.select("id", "h", F.greatest(last - step + 1, lo).alias("s"), (F.least(last, lo + width) + t).alias("e"))
    single = repeated.select("id", "h", F.col("p").alias("s"), (F.col("p") + t).alias("e"))
    spans = whole_blocks.unionByName(whole_pieces).unionByName(single)
    # A set, so that a row repeated any number of times has the spans of one.
    spans = materialize(spans.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans")), release=True)
    drop_written(shared, blocks, pieces, windows, same, *old, *old_pieces)
    return rows.join(spans, ["id", "h"], "left")


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans sorted, disjoint and not touching."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist()))


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside all spans, and the merged spans."""
    cut = merge(starts, ends)
    edges = [0, *(x for span in cut for x in span), len(data)]
    return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])), cut


def remove_repeats(docs: DataFrame, min_bytes: int = 200, gram: int = 32, step: int = 16) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that stay)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, starts, ends in zip(b["doc_id"], b["text"], b["starts"], b["ends"]):
                data = (text or "").encode()
                kept, cut = kept_bytes(data, starts, ends) if starts is not None else (data, [])
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            yield out

    found = repeated_spans(docs, min_bytes, gram, step).select("doc_id", "text", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"))
    return found.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, min_bytes: int = 200) -> DataFrame:
    """docs with the repeated bytes taken out of the text; what is left of a cut character goes too."""
    names = docs.columns
    found = repeated_spans(docs, min_bytes)

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_bytes((t or "").encode(), s, e)[0].decode(errors="ignore") for t, s, e in zip(text, starts, ends)])

    return rejoin(found, names, cut("text", F.col("spans.s"), F.col("spans.e")))
