"""SimHash near-duplicates: fingerprints, an exact Hamming join over a vantage-point tree, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import row_key, stored, utf8
from tidemark.llm.components import Forest, connected_components

SHINGLE = 3
MAX_BITS = 3
HASH_SEED = 42
#: Distinct fingerprints that one task should hold; trees are cut at this size.
SHARD_ROWS = 32_768
#: Fingerprints that the driver reads to place the vantage points: so many, and of so few a share of all, at most.
#: Only balance depends on them.
SAMPLE_ROWS, SAMPLE_SHARE = 32_768, 1 / 16
#: Below this many pairs a comparison is made directly.
DIRECT_PAIRS = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one UTF-8 text; null, and a text without words, give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingle = min(shingle, len(words))
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    spans = map(slice, starts, [e - 1 for e in ends[shingle - 1 :]])
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, spans), repeat(HASH_SEED)), ">u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, key long, fp long)`` for each row of ``docs``; the unsigned fingerprint is stored as a signed long.

    ``key`` is the `row_key`, which tells texts of one doc_id apart.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in utf8(b.column("text"))), np.uint64, b.num_rows)
            cols = [b.column("doc_id"), b.column("key"), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(key=F.col("doc_id").cast("long")).alias("key"), "text")
    return rows.mapInArrow(of, "doc_id long, key long, fp long")


def _split(points: np.ndarray, tried: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point among ``points`` and a cut distance that leave few points near the boundary."""
    best = None
    for p in points[:: max(1, len(points) // tried)][:tried]:
        d = np.bitwise_count(points ^ p)
        cut = int(np.median(d))
        inner = int((d <= cut).sum())
        if inner < len(d) and (best is None or max(inner, len(d) - inner) < best[0]):
            best = (max(inner, len(d) - inner), p, cut)
    return best and best[1:]


def _tree(a: np.ndarray, b: np.ndarray | None, scale: float, radius: int, shard_rows: int, ids: Iterator[int]) -> dict:
    """Vantage-point tree for a set against itself, or for two sets against each other, cut at the shard size.

    The triangle inequality makes it exact: points on two sides of a boundary can only be near each other if both
    lie within ``radius`` of it.
    """
    small = len(a) * scale <= shard_rows if b is None else len(a) * len(b) * scale * scale <= shard_rows**2
    both = a if b is None else np.concatenate([a, b])
    split = None if small or len(both) < 16 else _split(both)
    if split is None:
        return {"leaf": next(ids)}
    vp, cut = split

    def parts(x: np.ndarray) -> tuple[np.ndarray, ...]:
        d = np.bitwise_count(x ^ vp).astype(np.int64)
        return x[d <= cut], x[d > cut], x[(d <= cut) & (d > cut - radius)], x[(d > cut) & (d <= cut + radius)]

    def grow(x: np.ndarray, y: np.ndarray | None) -> dict:
        return _tree(x, y, scale, radius, shard_rows, ids)

    (al, ar, aln, arn) = parts(a)
    if b is None:
        return {"vp": vp, "cut": cut, "next": [grow(al, None), grow(ar, None), grow(aln, arn)]}
    (bl, br, bln, brn) = parts(b)
    return {"vp": vp, "cut": cut, "next": [grow(al, bl), grow(ar, br), grow(aln, brn), grow(arn, bln)]}


def _route(node: dict, x: np.ndarray, idx: np.ndarray, side: int | None, radius: int, out: list) -> None:
    """Append (leaf, indices, side) for the points ``x[idx]``; side None: the set meets itself."""
    if not len(idx):
        return
    if "leaf" in node:
        out.append((node["leaf"], idx, -1 if side is None else side))
        return
    d = np.bitwise_count(x[idx] ^ node["vp"]).astype(np.int64)
    cut = node["cut"]
    left, right = idx[d <= cut], idx[d > cut]
    near_left, near_right = idx[(d <= cut) & (d > cut - radius)], idx[(d > cut) & (d <= cut + radius)]
    nexts = node["next"]
    if side is None:
        _route(nexts[0], x, left, None, radius, out)
        _route(nexts[1], x, right, None, radius, out)
        _route(nexts[2], x, near_left, 0, radius, out)
        _route(nexts[2], x, near_right, 1, radius, out)
    else:
        _route(nexts[0], x, left, side, radius, out)
        _route(nexts[1], x, right, side, radius, out)
        _route(nexts[2 if side == 0 else 3], x, near_left, side, radius, out)
        _route(nexts[3 if side == 0 else 2], x, near_right, side, radius, out)


def _compare(x: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int, links: Forest) -> None:
    """Link all near pairs within ``a``, or between ``a`` and ``b`` (indices into x), by tree descent."""
    work: list[tuple[np.ndarray, np.ndarray | None, int]] = [(a, b, 0)]
    while work:
        a, b, depth = work.pop()
        other = a if b is None else b
        if not len(a) or not len(other):
            continue
        split = None
        if len(a) * len(other) > DIRECT_PAIRS and depth < 64:
            pool = a if b is None else np.concatenate([a, b])
            split = _split(x[pool], 3)
        if split is None:
            step = max(1, (8 * DIRECT_PAIRS) // len(other))
            for at in range(0, len(a), step):
                block = a[at : at + step]
                i, j = np.nonzero(np.bitwise_count(x[block][:, None] ^ x[other][None, :]) <= radius)
                links.add(block[i], other[j])
            continue
        vp, cut = split
        da = np.bitwise_count(x[a] ^ vp).astype(np.int64)
        if b is None:
            ball = da <= radius
            if ball.sum() * 4 >= len(a):
                # A dense ball: its points link through the vantage point, which is one of them, without pairs.
                inside, ring = a[ball], a[~ball & (da <= 2 * radius)]
                links.add(inside, np.full(len(inside), inside[np.argmin(da[ball])]))
                work += [(inside, ring, depth + 1), (a[~ball], None, depth + 1)]
                continue
            work += [(a[da <= cut], None, depth + 1), (a[da > cut], None, depth + 1)]
            work.append((a[(da <= cut) & (da > cut - radius)], a[(da > cut) & (da <= cut + radius)], depth + 1))
            continue
        db = np.bitwise_count(x[b] ^ vp).astype(np.int64)
        work += [(a[da <= cut], b[db <= cut], depth + 1), (a[da > cut], b[db > cut], depth + 1)]
        work.append((a[(da <= cut) & (da > cut - radius)], b[(db > cut) & (db <= cut + radius)], depth + 1))
        work.append((a[(da > cut) & (da <= cut + radius)], b[(db <= cut) & (db > cut - radius)], depth + 1))


def shard_links(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, fingerprint) of one shard; side -1: all against all, else side 0 against side 1."""
    links, at = Forest(len(fp)), np.arange(len(fp))
    if (side < 0).all():
        _compare(fp, at, None, radius, links)
    else:
        _compare(fp, at[side == 0], at[side == 1], radius, links)
    root = links.roots()
    linked = np.flatnonzero(root != at)
    return fp[linked], fp[root[linked]]


def hamming_links(reps: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that span the components of distinct fingerprints ``reps(fp)`` within ``radius`` bits."""
    n = reps.count()
    tree: dict = {"leaf": 0}
    if n > shard_rows:
        share = min(SAMPLE_SHARE, sample_rows / n)
        pick = F.xxhash64("fp").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))
        sample = np.array([r.fp for r in reps.where(pick).select("fp").limit(2 * sample_rows).collect()], np.int64)
        sample = np.sort(sample).view(np.uint64)
        tree = _tree(sample, None, n / max(1, len(sample)), radius, shard_rows, iter(range(1 << 40)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            out: list = []
            _route(tree, fp.view(np.uint64), np.arange(len(fp)), None, radius, out)
            for leaf, idx, side in out:
                cols = [np.full(len(idx), leaf), fp[idx], np.full(len(idx), side, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "fp", "side"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = reps.select("fp").mapInArrow(route, "shard long, fp long, side int")
    return routed.groupBy("shard").applyInPandas(within, "a long, b long")


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Rows link if their fingerprints differ in ``max_bits`` bits or fewer; ``component_id`` is the smallest doc_id
    reachable by links. Exact copies meet in one aggregate row; only distinct fingerprints are compared.

    Null text, empty text and text without words have fingerprint zero, which links like any other. Repeated rows
    each give a row. A null doc_id takes part and is ignored by the minimum (null if a component has no other).
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    prints, of_fp = _components(docs, shingle, max_bits, shard_rows)
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, shingle: int, max_bits: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """The `fingerprints`, and ``(fp, root, component_id)``: ``root`` names a component by one of its fingerprints."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    comp = connected_components(hamming_links(reps, max_bits, shard_rows))
    linked = comp.withColumnRenamed("node", "fp").join(reps, "fp")
    # Written tables on this side of a join leave adaptive execution free to split a hot key on the other.
    least = stored(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    of_fp = linked.join(least, "root").select("fp", "root", "component_id")
    own = F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    return prints, stored(reps.join(of_fp, "fp", "left").select("fp", *own), "fingerprint-components")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: of the rows with its smallest doc_id the one with the smallest key (id and text hashed).

    A doc_id that repeats with other texts counts in each of their components. A component keeps one of its rows with a
    null doc_id too, by the same rule, since such a row cannot be named by a component.
    """
    prints, of_fp = _components(docs, shingle, max_bits, SHARD_ROWS)
    first = prints.join(of_fp, "fp").where("doc_id is null or doc_id = component_id")
    first = first.groupBy("root", F.col("doc_id").isNull().alias("unnamed")).agg(F.min("key").alias("kept_key"))
    first = stored(first.select("kept_key"), "kept-keys")
    whole = docs.select(row_key(key=F.col("doc_id").cast("long")).alias("kept_key"), F.struct("*").alias("kept_row"))
    return whole.join(first, "kept_key").dropDuplicates(["kept_key"]).select("kept_row.*")
