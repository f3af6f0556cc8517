"""Approximate nearest neighbours by collision counting over query-centred windows.

Each projection sorts a block's vectors once. A query's window in a projection is centred on its own value, and virtual
rehashing widens it by a factor at a time without a new index. A vector that falls into enough of a query's windows is
verified with its exact cosine; the search widens until enough vectors have been verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import stored
from tidemark.llm.vectors import cosine, takes_part, unit

K = 5
PROJECTIONS = 128
#: Share of the projections whose windows must hold a vector for it to be verified.
THRESHOLD = 0.86
#: First reach of a window to either side, in standard deviations of the projected values, and the factor of widening.
#: Near vectors of a cloud without clusters differ little in any projection, so wide windows tell them best apart.
REACH, WIDEN = 1.3, 1.1
#: The search of a block stops when it has verified this share of the block, and at least so many vectors.
VERIFY_SHARE, VERIFY_LEAST = 0.06, 128
#: Vectors of a block, and queries that are searched in it together.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
SEED = 11


class SortedProjections:
    """The index of one block: projected values in order, for each of a fixed set of random directions.

    Directions come in orthogonal sets, which makes collision counts vary less than independent ones do.
    """

    def __init__(self, units: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.units = units
        rng, dim = np.random.default_rng(seed), units.shape[1]
        sets = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
        self.directions = np.concatenate(sets, axis=1)[:, :projections]
        values = units @ self.directions
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(values, axis=0).T)
        self.step = max(float(values.std()), 1e-12)

    def candidates(self, queries: np.ndarray, threshold: float = THRESHOLD, share: float = VERIFY_SHARE, least: int = VERIFY_LEAST) -> Iterator[np.ndarray]:
        """For each query the vectors that collide with it often enough."""
        m, n = self.values.shape
        centre = (queries @ self.directions).T
        want, often = min(n, max(least, int(share * n))), max(1, int(np.ceil(threshold * m)))
        levels: list[tuple[np.ndarray, np.ndarray]] = []

        def windows(level: int) -> tuple[np.ndarray, np.ndarray]:
            while len(levels) <= level:
                reach = self.step * REACH * WIDEN ** len(levels)
                lo = [np.searchsorted(v, c - reach, "left") for v, c in zip(self.values, centre, strict=True)]
                hi = [np.searchsorted(v, c + reach, "right") for v, c in zip(self.values, centre, strict=True)]
                levels.append((np.array(lo).T, np.array(hi).T))
            return levels[level]

        def count(parts: list[np.ndarray]) -> np.ndarray:
            return np.bincount(np.concatenate(parts), minlength=n)

        for q in range(len(queries)):
            level, (lo, hi) = 0, windows(0)
            at, to = lo[q].tolist(), hi[q].tolist()
            # First windows hold most of a block, so what lies outside is counted and taken off.
            outside = [o[:a] for o, a in zip(self.order, at, strict=True)] + [o[b:] for o, b in zip(self.order, to, strict=True)]
            counts = m - count(outside)
            while True:
                found = np.flatnonzero(counts >= often)
                if len(found) >= want:
                    break
                level += 1
                lo, hi = windows(level)
                wider, wider_to = lo[q].tolist(), hi[q].tolist()
                # Only what the wider window adds on either side is counted.
                new = [o[w:a] for o, w, a in zip(self.order, wider, at, strict=True)]
                new += [o[b:w] for o, b, w in zip(self.order, to, wider_to, strict=True)]
                counts += count(new)
                at, to = wider, wider_to
            yield found


def search_block(
    ids: np.ndarray, units: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in a block, its own id left out."""
    index = SortedProjections(units)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, found in enumerate(index.candidates(queries)):
        found = found[ids[found] != query_ids[q]]
        score = cosine(units[found], np.broadcast_to(queries[q], (len(found), queries.shape[1])))
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[found][best], score[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors of largest cosine found for each query row, nearest first.

    ``vectors(vec_id, embedding, ...)``; queries are rows of the same table, and a query's own id is no candidate. Blocks
    of vectors meet blocks of queries, so no task holds more than one of each. Equal scores go to the smaller vec_id.
    Rows with a null vec_id, and vectors that are null, zero or hold null or non-finite components, take no part; vectors
    of another length than the query's are no candidates. Rows that repeat a vec_id count once, with the smallest
    embedding. Other columns are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & takes_part())
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    queries = rows.where(is_query)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, groups = -(-counts.n // block_rows) or 1, -(-counts.q // query_rows) or 1

    def spread(df: DataFrame, salt: str, own: int, other: int, name: str, copies: str) -> DataFrame:
        # Both sides of a cogroup are dealt by the hash of these keys, so their types must be the same.
        mine = F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(own)).cast("int").alias(name)
        return df.select("dim", "vec_id", "embedding", mine, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(copies))

    left = spread(rows, "block", blocks, groups, "block", "part").groupBy("dim", "block", "part")
    right = spread(queries, "query", groups, blocks, "part", "block").groupBy("dim", "block", "part")

    def search(block: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(query):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        block = block.sort_values("vec_id")
        units = unit(np.stack(block["embedding"].to_numpy()))
        q = unit(np.stack(query["embedding"].to_numpy()))
        found = search_block(block["vec_id"].to_numpy(), units, query["vec_id"].to_numpy(), q, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
