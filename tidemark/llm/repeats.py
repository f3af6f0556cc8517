"""Removal of passages that occur elsewhere: maximal repeats of a sparse enhanced suffix array.

Every string of ``SPAN`` bytes contains an anchor: the gram of ``GRAM`` bytes with the smallest hash, the leftmost of
equals. It is a function of the string alone, so equal strings have equal anchors at equal offsets, and repeats need to
be sought only among the texts around equal anchors. The suffixes that start at the anchors of a gram are sorted with
their common prefix lengths; a stack scan walks the tree of common-prefix intervals, and in each interval the
extensions to the left are told apart the same way. An interval whose left and right parts add up to ``SPAN`` bytes is a
maximal repeat group, given with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm._shared import mix64, row_key, stored

SPAN = 400
GRAM = 64
#: Windows that are scanned at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 20
#: Different contexts of one gram that a task may hold; beyond it their windows are matched by aggregates.
MAX_BUCKET = 50_000

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def _anchors(text: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, the hash of each gram, and the hash of the context around it."""
    n, width = len(text), span - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for base in range(0, n - span + 1, CHUNK):
        windows = min(CHUNK, n - span + 1 - base)
        lo, hi = max(0, base - (span - gram)), min(n, base + windows + 2 * span)
        v = _BYTE[text[lo:hi]]
        up, down = _powers(len(v) + 1)
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[:-1], out=sums[1:])
        grams = mix64((sums[gram:] - sums[:-gram]) * down[: len(v) - gram + 1])
        here = grams[base - lo : base - lo + windows + width - 1]
        keys = (here >> np.uint64(32) << np.uint64(32)) | np.arange(len(here), dtype=np.uint64)
        pos = (_sliding_min(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pos = pos[np.r_[True, pos[1:] != pos[:-1]]] + (base - lo)
        s, e = np.maximum(0, pos + lo - (span - gram)) - lo, np.minimum(n, pos + lo + span) - lo
        context = (sums[e] - sums[s]) * down[s]
        context = mix64(context ^ mix64(((pos - s) << 32 | (e - pos)).astype(np.uint64)))
        found.append((pos + lo, grams[pos], context))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pos, g, c = (np.concatenate(x) for x in zip(*found, strict=True))
    pos, first = np.unique(pos, return_index=True)
    return pos, g[first], c[first]


# An anchor's place in one long: start in the text, bytes of context to its left and to its right.
def _pack(pos: np.ndarray, n: int, span: int, gram: int) -> np.ndarray:
    return pos << 24 | np.minimum(pos, span - gram) << 12 | np.minimum(n - pos, span)


def _start(place: Column) -> Column:
    return F.shiftright(place, 24)


def _left(place: Column) -> Column:
    return F.shiftright(place, 12).bitwiseAND(4095).cast("int")


def _right(place: Column) -> Column:
    return place.bitwiseAND(4095).cast("int")


def anchors(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(k, place, g, c)`` for each anchor in ``texts(k long, text binary)``: row, place, gram hash, context hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for k, text in zip(b.column("k").to_pylist(), b.column("text"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                pos, g, c = _anchors(data, span, gram)
                out.append((np.full(len(pos), k), _pack(pos, len(data), span, gram), g.view(np.int64), c.view(np.int64)))
                size += len(pos)
                if size > 100_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], list("kpgc"))

    return texts.mapInArrow(of, "k long, p long, g long, c long").withColumnRenamed("p", "place")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    differ = int.from_bytes(a) ^ int.from_bytes(b)
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: ``(length, first, last)`` of each interval of a sorted list whose members share a prefix.

    ``lcp[i]`` is the common prefix of members i - 1 and i; ``lcp[0]`` is not read. Inner intervals come first.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now > 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_groups(lefts: list[bytes], rights: list[bytes], span: int = SPAN) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups ``(left, right, members)`` of at least ``span`` bytes among contexts of one anchor.

    ``lefts`` are the bytes before the anchor, reversed; ``rights`` those from it on. Members of an interval of the
    sorted rights differ in the byte after it; of those, members of an interval of the sorted lefts differ in the byte
    before it (or one of them has none), so a group cannot be extended either way.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common_prefix(rights[i], rights[j]) for i, j in zip(order, order[1:], strict=False)]
    for right, first, last in prefix_intervals(lcp):
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        need = max(0, span - right)
        shared = [0] + [common_prefix(lefts[i], lefts[j]) for i, j in zip(members, members[1:], strict=False)]
        if need == 0 and min(shared[1:]) == 0:
            yield 0, right, members
        for left, lo, hi in prefix_intervals(shared):
            if left >= need:
                yield left, right, members[lo : hi + 1]


#: Members of an interval that are compared one by one.
_FEW = 12


class _RangeMin:
    """Smallest value of any range of a list, by minima of ranges of a power of two."""

    def __init__(self, values: list[int]):
        self.levels = [np.array(values, np.int32)]
        while 2 * len(self.levels[0]) > 1 << (len(self.levels) + 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), np.int32)
        for n in np.unique(level):
            at = level == n
            out[at] = np.minimum(self.levels[n][lo[at]], self.levels[n][hi[at] - (1 << n) + 1])
        return out


def cover(lefts: list[bytes], rights: list[bytes], span: int = SPAN) -> list[tuple[int, int]]:
    """For each context how far maximal repeat groups reach left and right of the anchor; (0, 0) without one.

    The same scan as `maximal_groups`, without listing a group's members: in each interval of the rights, a member's
    longest common left extension is the one with a neighbour in the order of the lefts.
    """
    m = len(rights)
    order = sorted(range(m), key=rights.__getitem__)
    lcp = [0] + [common_prefix(rights[i], rights[j]) for i, j in zip(order, order[1:], strict=False)]
    by_left = sorted(range(m), key=lefts.__getitem__)
    left_lcp = [0] + [common_prefix(lefts[i], lefts[j]) for i, j in zip(by_left, by_left[1:], strict=False)]
    longest, best = max(left_lcp), [(0, 0)] * m
    rank = [0] * m
    for place, i in enumerate(by_left):
        rank[i] = place
    ranks = [rank[i] for i in order]
    large: tuple | None = None
    for right, first, last in prefix_intervals(lcp):
        need = max(0, span - right)
        if longest < need:
            continue
        if last - first < _FEW:
            members = [by_left[r] for r in sorted(ranks[first : last + 1])]
            near = [0, *(common_prefix(lefts[i], lefts[j]) for i, j in zip(members, members[1:], strict=False)), 0]
            for n, i in enumerate(members):
                left = max(near[n], near[n + 1])
                if left >= need:
                    best[i] = (max(best[i][0], left), max(best[i][1], right))
            continue
        if large is None:
            large = np.array(ranks), np.array(by_left), _RangeMin(left_lcp), np.zeros((m, 2), np.int32)
        members = np.sort(large[0][first : last + 1])
        near = large[2](members[:-1] + 1, members[1:])
        left = np.maximum(np.append(near, 0), np.append(0, near))
        at, left = large[1][members[left >= need]], left[left >= need]
        large[3][at, 0] = np.maximum(large[3][at, 0], left)
        large[3][at, 1] = np.maximum(large[3][at, 1], right)
    if large is not None:
        best = [(max(a, c), max(b, d)) for (a, b), (c, d) in zip(best, large[3].tolist(), strict=True)]
    return best


def _contexts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``(g, c, left binary reversed, right binary)`` of the ``wanted(k, items[place, g, c])`` contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, items in zip(b.column("text"), b.column("items"), strict=True):
                data, rows = text.as_buffer(), items.as_py()
                data = memoryview(data)
                cols: tuple = ([], [], [], [])
                for x in rows:
                    at, left, right = x["place"] >> 24, x["place"] >> 12 & 4095, x["place"] & 4095
                    cols[0].append(x["g"])
                    cols[1].append(x["c"])
                    cols[2].append(bytes(data[at - left : at])[::-1])
                    cols[3].append(bytes(data[at : at + right]))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["g", "c", "l", "r"])

    joined = texts.join(wanted, "k").select("text", "items")
    return joined.mapInArrow(cut, "g long, c long, l binary, r binary")


def _by_gram(contexts: DataFrame, of: Callable[[list[bytes], list[bytes]], Iterator[tuple]], names: list[str]) -> DataFrame:
    """Rows ``of(lefts, rights)`` (a member's place, then ints named ``names``) of the contexts of each gram."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        gram, held = None, {}
        for b in batches:
            for g, c, left, right in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if g != gram:
                    yield gram, held
                    gram, held = g, {}
                held[c] = (left, right)
        yield gram, held

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for gram, held in buckets(batches):
            if len(held) > 1:
                c = list(held)
                for member, *values in of([held[x][0] for x in c], [held[x][1] for x in c]):
                    out.append((gram, c[member], *values))
                    if len(out) >= 20_000:
                        yield batch(out)
                        out = []
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * len(names)]
        cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["g", "c", *names])

    dealt = contexts.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(rows, "g long, c long, " + ", ".join(f"{x} int" for x in names))


def _bucket_groups(contexts: DataFrame, span: int) -> DataFrame:
    """``(g, c, grp, left, right)``: members of the maximal repeat groups among different contexts of each gram."""

    def of(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple]:
        for n, (left, right, members) in enumerate(maximal_groups(lefts, rights, span)):
            sides = [rights[m] for m in members]
            if common_prefix(min(sides), max(sides)) > right:
                continue  # all of them go on alike: part of the group of a longer right side
            for m in members:
                yield m, n, left, right

    return _by_gram(contexts, of, ["grp", "left", "right"]).withColumn("grp", F.col("grp").cast("long"))


def _bucket_cover(contexts: DataFrame, span: int) -> DataFrame:
    """``(g, c, left, right)``: how far repeats reach around each anchor, for contexts with any."""

    def of(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple]:
        return ((n, *x) for n, x in enumerate(cover(lefts, rights, span)) if x[1])

    return _by_gram(contexts, of, ["left", "right"])


def _windows(contexts: DataFrame, span: int) -> DataFrame:
    """``(g, c, o, h, before)``: each window of a context, by the bytes of it before the anchor and its hash; ``before``
    is the byte ahead of it, -1 if the context has none."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, c, left, right in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                v = _BYTE[data]
                up, down = _powers(len(v) + 1)
                sums = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(v * up[:-1], out=sums[1:])
                at = np.arange(len(v) - span + 1)
                h = mix64((sums[span:] - sums[:-span]) * down[at])
                before = np.concatenate([[-1], data])[at].astype(np.int32)
                cols = [np.full(len(at), g), np.full(len(at), c), (len(left) - at).astype(np.int32), h.view(np.int64), before]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["g", "c", "o", "h", "before"])

    return contexts.mapInArrow(windows, "g long, c long, o int, h long, before int")


def _window_cover(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """The same cover as `_bucket_cover` for grams of too many contexts: each window of a context is a key, and
    windows that two contexts share are found by an aggregate, one row a window and no bucket in any task."""
    keyed = stored(_windows(contexts.dropDuplicates(["g", "c"]), span).drop("before"), "windows")
    shared = keyed.groupBy("g", "o", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(shared, ["g", "o", "h"]).selectExpr("g", "c", "o left", f"cast({span} - o as int) right")


def _window_groups(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """The same groups as `_bucket_groups` for grams of too many contexts, found among the contexts that share a window.

    All members of a group share the window that begins where the group does (at most ``span - gram`` bytes before the
    anchor), and the contexts that share it hold the whole group; of the windows that a group covers only that one
    reports it. Contexts that all have the same byte before a window begin no group there.
    """
    contexts = stored(contexts.dropDuplicates(["g", "c"]), "hot-contexts")
    keyed = stored(_windows(contexts, span).where(f"o between 0 and {span - gram}"), "windows")
    shared = keyed.groupBy("g", "o", "h").agg(F.count("*").alias("n"), F.min("before").alias("a"), F.max("before").alias("b"))
    shared = shared.where(f"n > 1 and (a < b or a < 0 or o = {span - gram})").select("g", "o", "h", F.xxhash64("g", "o", "h").alias("part"))
    shared = stored(shared, "shared-windows")
    parts = keyed.join(shared, ["g", "o", "h"]).select("g", "c", "part").join(contexts, ["g", "c"])
    found = _bucket_groups(parts.select(F.col("part").alias("g"), "c", "l", "r"), span).withColumnRenamed("g", "part")
    found = found.join(shared.select("part", "g", "o"), "part").where(f"o = least(left, {span - gram})")
    return found.select("g", "c", F.xxhash64("part", "grp").bitwiseAND((1 << 62) - 1).alias("grp"), "left", "right")


def _repeated(
    texts: DataFrame, span: int, gram: int, max_bucket: int, among: Callable[[DataFrame, int], DataFrame],
    among_many: Callable[[DataFrame, int, int], DataFrame],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors that occur again ``(k, place, g, c)``; contexts that occur again as a whole ``(g, c, left, right)``; and
    what ``among`` finds among the different contexts of each gram, ``among_many`` for more than ``max_bucket``."""
    if not gram < span < 4096:
        raise ValueError("gram < span < 4096 is needed")
    every = stored(anchors(texts, span, gram), "anchors")
    # Written tables on this side of a join leave adaptive execution free to split a hot key on the other.
    again = stored(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeated-grams")
    every = stored(every.join(again, "g").select("k", "place", "g", "c"), "repeated-anchors")
    contexts = every.groupBy("g", "c").agg(
        F.count("*").alias("n"), F.min("k").alias("k"), F.min_by("place", "k").alias("place")
    )
    contexts = stored(contexts, "contexts")
    whole = contexts.where("n > 1").select("g", "c", _left(F.col("place")).alias("left"), _right(F.col("place")).alias("right"))
    # Contexts meet if the gram has several and one of them is not repeated as a whole.
    grams = contexts.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    grams = stored(grams.select("g", "m"), "open-grams")
    open_ = contexts.join(grams.select("g", (F.col("m") > max_bucket).alias("big")), "g")

    def part(rows: DataFrame) -> DataFrame:
        return _contexts(rows.groupBy("k").agg(F.collect_list(F.struct("place", "g", "c")).alias("items")), texts)

    if grams.where(F.col("m") > max_bucket).isEmpty():
        return every, whole, among(part(open_), span)
    windows = among_many(part(open_.where("big")), span, gram)
    found = among(part(open_.where("not big")), span)
    return every, whole, found.unionAll(windows.select(*found.columns))


def maximal_repeats(texts: DataFrame, span: int = SPAN, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(g, grp, k, s, e)``: every occurrence of every maximal repeat group of at least ``span`` bytes around an anchor.

    ``texts(k long, text binary)``; an occurrence is the bytes ``s`` to ``e`` of row k's text. Group -1 of a gram and
    context is a context that occurs again as a whole. Parts longer than a context appear around each of their anchors.
    """
    every, whole, found = _repeated(texts, span, gram, max_bucket, _bucket_groups, _window_groups)
    groups = whole.select("g", "c", F.lit(-1).cast("long").alias("grp"), "left", "right").unionAll(found)
    start = _start(F.col("place"))
    return every.join(groups, ["g", "c"]).select(
        "g", "grp", "k", (start - F.col("left")).alias("s"), (start + F.col("right")).alias("e")
    )


def repeat_spans(texts: DataFrame, span: int = SPAN, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(k, spans array<struct<s long, e long>>)``: byte ranges of a text that repeats cover, for texts with any."""
    every, whole, found = _repeated(texts, span, gram, max_bucket, _bucket_cover, _window_cover)
    # Ranges of one context all hold its anchor, so their union is one range.
    reach = whole.unionAll(found).groupBy("g", "c").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    reach = stored(reach, "reach")
    start = _start(F.col("place"))
    ranges = every.join(reach, ["g", "c"]).select("k", (start - F.col("left")).alias("s"), (start + F.col("right")).alias("e"))
    return ranges.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs: ranges that overlap or touch become one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of ``text`` outside the runs."""
    ends = [0, *(e for _, e in runs)]
    starts = [*(s for s, _ in runs), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def long_texts(docs: DataFrame, span: int) -> DataFrame:
    """Key and bytes of the texts that can hold a repeat."""
    return docs.where(F.octet_length("text") >= span).select(row_key().alias("k"), F.col("text").cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs(doc_id, text, ...)``.

    A byte goes if a string of ``span`` bytes that covers it starts anywhere else too, in any row. Null text counts as
    empty; texts shorter than ``span`` stay whole; repeated rows repeat their whole texts, so long ones go entirely.
    Null doc_ids are kept as such. Other columns are not read. An empty table gives an empty result.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple = ([], [], [], [])
            for k, text, spans in zip(b.column("k").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                runs = merged(spans.as_py())
                kept = cut(text.as_py(), runs)
                for col, v in zip(cols, (k, sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["k", "removed", "spans", "sha"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    texts = long_texts(docs, span)
    hit = texts.join(repeat_spans(texts, span, gram, max_bucket), "k").mapInArrow(
        digest, "k long, removed long, spans long, sha string"
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", row_key().alias("k"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha_all")
    )
    zero = F.lit(0).cast("long")
    return rows.join(hit.dropDuplicates(["k"]), "k", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", zero).alias("n_removed"),
        F.coalesce("spans", zero).alias("n_spans"),
        F.coalesce("sha", "sha_all").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, words: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut from the texts and n_chars set anew; all rows and columns stay.

    A run of fewer than ``words`` words stays, unless it has ``SPAN`` bytes. A cut can fall inside a character; what is
    left of it goes too.
    """

    def shorten_one(text: bytes, spans: list[dict]) -> str:
        runs = [(s, e) for s, e in merged(spans) if e - s >= SPAN or len(text[s:e].split()) >= words]
        return cut(text, runs).decode(errors="ignore")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                t.as_py() if not s.is_valid else shorten_one(t.as_py().encode(), s.as_py())
                for t, s in zip(b.column("cut_text"), b.column("cut_spans"), strict=True)
            ]
            yield b.select(["kept_row"]).append_column("cut_text", pa.array(texts, pa.string()))

    spans = repeat_spans(long_texts(docs, span), span, gram).withColumnRenamed("spans", "cut_spans")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(row_key().alias("k"), F.struct(*rest).alias("kept_row"), F.col("text").alias("cut_text"))
    rows = rows.join(spans, "k", "left").select("kept_row", "cut_text", "cut_spans")
    made = rows.mapInArrow(shorten, StructType([rows.schema["kept_row"], StructField("cut_text", StringType())]))
    text = {"text": F.col("cut_text")} | ({"n_chars": F.length("cut_text").cast("long")} if "n_chars" in rest else {})
    return made.select(*(text[c].alias(c) if c in text else F.col(f"kept_row.`{c}`") for c in docs.columns))
