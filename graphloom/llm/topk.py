"""Exact top-k search (3) by Fagin's threshold algorithm (Fagin, Lotem, Naor 2003).

Candidates are dealt into blocks, queries into blocks of at most QUERY_BLOCK rows, and every
pair of blocks is one group: a stated query set against all rows, in blocks. Inside a group the
candidates are sorted once per dimension; a query walks its lists from the end that helps its
score, scores what it meets, and stops when the threshold (the score of an imaginary vector made
of the list positions reached) cannot beat its k-th result. Each group returns k rows a query;
a ranked window with a partial limit merges them.

Components become floor(scale * x), so scores are exact integers: in floating point where no score of a
group can reach 2^53, else as Python integers. One that a long cannot hold is an error.

In many dimensions the bound hardly ever beats the k-th score before every row is met (README).

Defined results: vectors that are null or hold nulls or non-finite components, and rows
without an id, take no part; vectors are only compared with vectors of their length; rows with
the query's id are its own; equal rows (id and vector) count once; ties go to the smaller id; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
SCHEMA = "query_id long, vec_id long, score long"


def threshold_search(q: np.ndarray, vectors: np.ndarray, order: np.ndarray, ids: np.ndarray, own: int, k: int, step: int = 32) -> list[tuple[int, int]]:
    """The k best (score, id) of one query. order: row numbers by rising component, a column for each dimension; ids must rise with the row number."""
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    n, weights = len(ids), q.astype(vectors.dtype)
    open_ = np.ones(n, dtype=bool)
    open_[np.searchsorted(ids, own) : np.searchsorted(ids, own, side="right")] = False
    score = np.full(n, -np.inf, dtype=vectors.dtype)
    best, at = np.empty(0, dtype=np.int64), 0
    while open_.any():
        end = min(at + step, n)
        met = np.zeros(n, dtype=bool)
        met[order[n - end : n - at, up]] = True
        met[order[at:end, down]] = True
        new = np.flatnonzero(met & open_ if len(up) or len(down) else open_)
        open_[new] = False
        score[new] = vectors[new] @ weights
        if len(best) >= k:
            new = new[score[new] >= score[best[-1]]]
        pool = np.concatenate([best, new])
        best = pool[np.lexsort((ids[pool], -score[pool]))[:k]]
        # Whatever is unseen has no component beyond the list positions reached.
        bound = vectors[order[n - end, up], up] @ weights[up] + vectors[order[end - 1, down], down] @ weights[down]
        if len(best) >= k and bound < score[best[-1]]:  # at a tie a smaller id may be unseen
            break
        at, step = end, 2 * step
    return [(int(score[i]), int(ids[i])) for i in best]


def _search(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        numbers = [np.array(x["v"].tolist(), dtype=np.int64) for x in (queries, rows)]
        # Of -2^63 the absolute value is no long.
        largest = [max(int(x.max()), -int(x.min())) for x in numbers]
        vectors = numbers[1].astype(np.float64 if largest[0] * largest[1] * numbers[1].shape[1] < 1 << 53 else object)
        ids = rows["vec_id"].to_numpy()
        keep = np.ones(len(ids), dtype=bool)
        seen: set = set()
        for i in np.flatnonzero(np.r_[False, ids[1:] == ids[:-1]]):
            seen |= {(ids[i - 1], numbers[1][i - 1].tobytes())}
            keep[i] = (one := (ids[i], numbers[1][i].tobytes())) not in seen
            seen.add(one)
        vectors, ids = vectors[keep], ids[keep]
        order = np.argsort(vectors, axis=0, kind="stable")
        done: set = set()
        for query_id, q in zip(queries["query_id"], numbers[0]):
            if (one := (query_id, q.tobytes())) not in done:
                done.add(one)
                found = threshold_search(q, vectors, order, ids, query_id, k)
                if any(abs(score) >= 1 << 63 for score, _ in found):
                    raise OverflowError(f"a score of query {query_id} is no long")
                out += [(query_id, vec_id, score) for score, vec_id in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query."""
    usable = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("a component is no long")).cast("long"))
    rows = vectors.filter(usable & (F.size("embedding") > 0)).select(
        "vec_id", F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"), F.size("embedding").alias("dim"), is_query.alias("is_query")
    )
    n, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    block_rows = block_rows or max(512, min(8192, n // 24))
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    keys = ["dim", "block", "query_block"]
    candidates = rows.select("vec_id", "v", "dim", part(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "v", "dim", part(query_blocks).alias("query_block"), every(blocks).alias("block"))
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(lambda key, a, b: _search(key, a, b, k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
