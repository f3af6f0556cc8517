"""Embedding near-duplicates: an exact metric range join inside pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stored
from tidemark.llm.components import Forest, connected_components
from tidemark.llm.vectors import cosine, matrix, norms, takes_part, unit

MIN_COSINE = 0.93
#: Vectors that a cell should hold; labels with more get pivots.
CELL_ROWS = 2048
#: Pivots that the driver may read, over all labels. Beyond them cells are larger and are compared in parts.
MAX_PIVOTS = 4096
#: Vectors of a cell that a task holds; larger cells are dealt out as pairs of parts.
PART_ROWS = 16_384
#: Products made at a time, and the distance from the threshold within which a product is made anew in a fixed order.
BLOCK, CLOSE = 1 << 22, 1e-9


def _pivots(classes: DataFrame, cell_rows: int, max_pivots: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivot vectors of each large (label, length), chosen by a hash."""
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    large = large.orderBy(F.desc("n"), "label", "dim").limit(max_pivots // 2).collect()
    if not large:
        return {}
    total = sum(r["n"] for r in large)
    scale = min(1.0 / cell_rows, max_pivots / total)
    shares = classes.sparkSession.createDataFrame(
        [(r["label"], r["dim"], min(1.0, max(2.0 / r["n"], scale))) for r in large], "label long, dim int, share double"
    )
    spot = F.xxhash64(F.lit("pivot"), "class_id").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    rows = classes.join(shares, ["label", "dim"]).where(spot < F.col("share"))
    rows = rows.orderBy("class_id").limit(2 * max_pivots).select("label", "dim", "embedding").collect()
    out: dict[tuple[int, int], list] = {}
    for r in rows:
        out.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    return {k: unit(np.array(v, float)) for k, v in out.items()}


#: Vectors whose distances to all pivots are held at a time.
VISIT_ROWS = 512


def _visits(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, home): the cell of the nearest pivot, and each earlier cell that can hold a vector within radius.

    If y lies within the radius of x and is nearest to pivot q, then by the triangle inequality
    d(x, q) <= d(x, p) + 2 radius for x's own pivot p; in Euclidean space the bisector of p and q bounds it further.
    """
    homes, guests = [], []
    for at in range(0, len(units), VISIT_ROWS):
        rows = units[at : at + VISIT_ROWS]
        d2 = np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T))
        own = d2.argmin(axis=1)
        least = d2[np.arange(len(rows)), own]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (pivots[own] @ pivots.T)))
        near = np.sqrt(d2) <= np.sqrt(least)[:, None] + 2 * radius + CLOSE
        near &= d2 - least[:, None] <= 2 * radius * apart + CLOSE
        near &= np.arange(len(pivots))[None, :] < own[:, None]
        x, cell = np.nonzero(near)
        homes.append(own)
        guests.append((x + at, cell))
    own = np.concatenate([*homes, np.zeros(0, np.int64)]).astype(np.int64)
    x, cell = (np.concatenate([*(g[i] for g in guests), np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
    return np.r_[np.arange(len(units)), x], np.r_[own, cell], np.r_[np.ones(len(units), bool), np.zeros(len(x), bool)]


def links_within(vectors: np.ndarray, home: np.ndarray, weight: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and spanning roots among vectors; pairs of two guests are another cell's.

    ``side``: None, or 0 and 1 if only pairs across the two sides are wanted.
    """
    n = len(vectors)
    units, forest, links = unit(vectors), Forest(n), np.zeros(n, np.int64)
    size = norms(vectors)
    step = max(1, BLOCK // max(1, n))
    for at in range(0, n, step):
        rows = np.arange(at, min(at + step, n))
        c = units[rows] @ units[at:].T
        mask = c >= least + CLOSE
        i, j = np.nonzero(np.abs(c - least) < CLOSE)
        if len(i):
            mask[i, j] = cosine(vectors[rows[i]], vectors[at + j]) / (size[rows[i]] * size[at + j]) >= least
        mask &= np.arange(at, n)[None, :] > rows[:, None]
        mask &= home[rows][:, None] | home[at:][None, :]
        if side is not None:
            mask &= side[rows][:, None] != side[at:][None, :]
        i, j = np.nonzero(mask)
        np.add.at(links, rows[i], weight[at + j])
        np.add.at(links, at + j, weight[rows[i]])
        forest.add(rows[i], at + j)
    return links, forest.roots()


def similar_components(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label, ...)``.

    Rows of one label link if their cosine is ``min_cosine`` or more. Equal vectors of a label form one class, which is
    compared once and counts as often as it occurs; classes report link counts and a spanning tree, never all pairs.

    Rows with a null label, and vectors that are null, zero or hold null or non-finite components, link with nothing;
    nor do vectors of different lengths. Repeated rows are vectors of their own: they link with each other and share the
    component of their vec_id. A null vec_id takes part and is ignored by the minimum. Other columns are not read. An
    empty table gives an empty result.
    """
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * min_cosine)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    joins = F.col("label").isNotNull() & takes_part()
    classes = rows.where(joins).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    # Written with its ids, which are then fixed.
    classes = stored(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("class_id")), "vector-classes")
    pivots = _pivots(classes, cell_rows, max_pivots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pd.Series(list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)), dtype=object)
            for key, at in keys.groupby(keys).indices.items():
                part = b.take(pa.array(at))
                if key in pivots:
                    x, cell, home = _visits(unit(matrix(part.column("embedding"))), pivots[key], radius)
                else:
                    x, cell, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for lo in range(0, len(x), 10_000):
                    s = slice(lo, lo + 10_000)
                    piece = part.take(pa.array(x[s]))
                    cols = [piece.column(c) for c in ("label", "dim", "class_id", "n", "embedding")]
                    cols += [pa.array(cell[s].astype(np.int32)), pa.array(home[s])]
                    yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "class_id", "n", "embedding", "cell", "home"])

    kind = "label long, dim int, class_id long, n long, embedding array<double>, cell int, home boolean"
    routed = stored(classes.select("label", "dim", "class_id", "n", "embedding").mapInArrow(route, kind), "vector-cells")
    cells = routed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    # Written tables on this side of a join leave adaptive execution free to split a hot key on the other.
    cells = stored(cells, "cell-parts")
    dealt = routed.join(cells, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("class_id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        across = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        ids = pdf["class_id"].to_numpy()
        links, root = links_within(
            np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["home"].to_numpy(), pdf["n"].to_numpy(),
            (pdf["part"] == pdf["hi"]).to_numpy(np.int8) if across else None, min_cosine,
        )
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"class_id": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    found = dealt.select("label", "dim", "cell", "lo", "hi", "part", "home", "class_id", "n", "embedding")
    found = found.groupBy("label", "dim", "cell", "lo", "hi").applyInPandas(compare, "class_id long, links long, root long")
    found = stored(found, "vector-links")
    roots = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.withColumn("root", F.coalesce("root", "class_id"))
    least = stored(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    known = known.join(least, "root").select(
        "label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")
    )
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    linked = rows.where(joins).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id", kept)
    alone = rows.where(~joins).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionAll(alone)
