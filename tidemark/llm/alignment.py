"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers spell a text byte for byte, so each is an incidence matrix of tokens by bytes, kept as compressed sparse
rows. Gustavson's row products make what follows from them: tokens of A times the transpose of B's gives the links, token
pairs whose bytes overlap, with the number of bytes they share; tokens by groups times the transpose gives the pairs that
share a group, where groups are cut at the bytes at which tokens of both end. Rows are multiplied in ranges, so that a
product needs bounded memory beside its result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._shared import prepared, stored, utf8

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose pairs share a dictionary.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose tokens are multiplied together.
SLICE_BYTES = 1 << 18
#: Non-zeros of the left matrix in one range of rows.
RANGE = 1 << 18

#: Fixed value: how the byte-level vocabulary cuts texts before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has its columns at ``cols[start[i]:start[i + 1]]``, with counts beside them."""

    start: np.ndarray
    cols: np.ndarray
    counts: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def incidence(owner_starts: np.ndarray, cols: np.ndarray, width: int) -> Csr:
    return Csr(owner_starts, cols, np.ones(len(cols), np.int64), width)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """How many terms each row of a x b adds up: the rows of b that a's row names, counted before they are merged."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.start)[a.cols])])
    return terms[a.start[1:]] - terms[a.start[:-1]]


def product(a: Csr, b: Csr, limit: int = RANGE) -> Csr:
    """Gustavson's product: each row of a x b is the sum of the rows of b that a's row names.

    Row ranges of at most ``limit`` terms (or one row) are expanded at a time; equal columns of a row are then added up.
    """
    n, sizes = len(a.start) - 1, row_sizes(a, b)
    ends = np.cumsum(sizes)
    cols, counts, lengths = [], [], []
    lo = 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        s, e = a.start[lo], a.start[hi]
        named = a.cols[s:e]
        width = b.start[named + 1] - b.start[named]
        before = np.cumsum(width) - width
        at = np.repeat(b.start[named] - before, width) + np.arange(int(width.sum()))
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(a.start[lo : hi + 1])), width)
        key, value = row * b.width + b.cols[at], np.repeat(a.counts[s:e], width) * b.counts[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        cols.append(key[first] % b.width)
        counts.append(np.add.reduceat(value, first) if len(first) else value)
        lengths.append(np.bincount(key[first] // b.width, minlength=hi - lo))
        lo = hi
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cols, counts, lengths)]
    return Csr(np.concatenate([[0], np.cumsum(joined[2])]).astype(np.int64), joined[0], joined[1], b.width)


class Bytes(NamedTuple):
    """Strings of bytes end to end: string i is ``data[start[i]:start[i] + size[i]]``."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Bytes:
        size = np.array([len(s) for s in strings], np.int64)
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray, cut: np.ndarray | int = 0) -> np.ndarray:
        """The strings of ids, one after another, each without its last ``cut`` bytes."""
        size = self.size[ids] - cut
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its character if that can be seen, else as one of those from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their entries. Control strings in a text are ordinary text."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(a)["model"]
        letters = _byte_letters()
        entries = {i: bytes(letters[c] for c in s) for s, i in model["vocab"].items() if set(s) <= letters.keys()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # An entry's id is the order of its merge, so ids serve as ranks.
        if any(model["vocab"][x + y] != 256 + n for n, (x, y) in enumerate(merges)):
            raise ValueError("ids of the byte-level vocabulary are not in the order of its merges")
        ranks = {entries[i]: i for i in range(256 + len(merges))}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = Bytes.of([entries.get(i, b"") for i in range(max(entries) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [(self.b.id_to_piece(i), i) for i in range(self.b.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for p, i in pieces]
        self.b_bytes = Bytes.of(spelt)
        longest = max(len(self.a_bytes.size), len(spelt))
        self.digits = Bytes.of([b"%d," % i for i in range(longest)])

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A, with a space ahead, and by B, which adds that space itself.

        A text that is empty, or whose tokens by A or by B do not spell the space and the text, has none."""
        none = np.zeros(0, np.int64)
        found: tuple[list, list] = ([], [])
        for text in texts:
            a = b = none
            if text:
                said = text.decode()
                a = self.a.encode_to_numpy(" " + said, disallowed_special=()).astype(np.int64)
                b = np.array(self.b.encode(said, num_threads=1), np.int64)
                want = np.frombuffer(b" " + text, np.uint8)
                if not all(np.array_equal(table.joined(ids), want) for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                    a = b = none
            found[0].append(a)
            found[1].append(b)
        return found


def read_files(a: str = A_FILE, b: str = B_FILE) -> tuple[bytes, bytes]:
    """Both vocabulary files, read by the driver and sent with the job (about two megabytes)."""
    made = []
    for path in (a, b):
        with open(path, "rb") as f:
            made.append(f.read())
    return made[0], made[1]


class Aligned:
    """The tokens of several texts, end to end, with their groups and links."""

    def __init__(self, tools: Tokenizers, texts: list[bytes]):
        a, b = tools.encode(texts)
        self.tools = tools
        self.sizes = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64).reshape(2, len(texts))
        self.a, self.b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
        self.doc_a, self.doc_b = (np.repeat(np.arange(len(texts)), n) for n in self.sizes)
        sizes = tools.a_bytes.size[self.a], tools.b_bytes.size[self.b]
        self.a_end, self.b_end = (np.cumsum(n) for n in sizes)
        n_bytes = int(sizes[0].sum())
        # Both spell the same bytes, so the end of each text is an end in both.
        ends = np.zeros(n_bytes + 1, bool)
        ends[self.a_end] = True
        self.cuts = self.b_end[ends[self.b_end]]
        ends[:] = False
        ends[self.cuts] = True
        ahead = np.cumsum(ends) - ends
        self.group_a, self.group_b = ahead[self.a_end], ahead[self.b_end]
        by_byte = incidence(np.arange(n_bytes + 1), np.repeat(np.arange(len(self.b)), sizes[1]), len(self.b))
        rows = incidence(np.r_[0, self.a_end], np.arange(n_bytes), n_bytes)
        self.links = product(rows, by_byte)

    def groups(self) -> tuple[Csr, Csr]:
        """Tokens of A by groups, and groups by tokens of B. Their product is the pairs that share a group."""
        of_b = np.searchsorted(self.group_b, np.arange(len(self.cuts) + 1))
        return (
            incidence(np.arange(len(self.a) + 1), self.group_a, len(self.cuts)),
            incidence(of_b, np.arange(len(self.b)), len(self.b)),
        )

    def per_text(self) -> dict[str, np.ndarray]:
        """Counts of each text: tokens, groups, links, and pairs that share a group."""
        n = self.sizes.shape[1]
        of = self.groups()
        group_text = self.doc_a[np.searchsorted(self.group_a, np.arange(len(self.cuts)))] if len(self.cuts) else self.doc_a
        shared = np.bincount(self.doc_a, weights=row_sizes(*of), minlength=n) if len(self.a) else np.zeros(n)
        return {
            "n_a": self.sizes[0],
            "n_b": self.sizes[1],
            "n_groups": np.bincount(group_text, minlength=n),
            "n_links": np.bincount(self.doc_a, weights=np.diff(self.links.start), minlength=n).astype(np.int64),
            "n_shared": shared.astype(np.int64),
        }

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs that are linked (A's id in the upper half), and for each text's pairs: text, pair, links."""
        row = self.links.rows()
        pairs, which = np.unique(self.a[row] << 32 | self.b[self.links.cols], return_inverse=True)
        keys, times = np.unique(self.doc_a[row] * max(1, len(pairs)) + which, return_counts=True)
        return pairs, *np.divmod(keys, max(1, len(pairs))), times

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        hashes = [hashlib.sha256() if n else None for n in self.sizes[0]]
        key = np.concatenate([self.group_a * 2, self.group_b * 2 + 1])
        order = np.argsort(key, kind="stable")
        ids, key, text = np.concatenate([self.a, self.b])[order], key[order], np.concatenate([self.doc_a, self.doc_b])[order]
        last = np.r_[text[1:] != text[:-1], True][: len(text)]
        mark = np.full(len(ids), ord(","), np.uint8)
        ends = np.r_[key[1:] != key[:-1], True][: len(key)]
        mark[ends] = np.where(key[ends] % 2, ord(";"), ord("|"))
        for lo in range(0, len(ids), RANGE):
            hi = min(len(ids), lo + RANGE)
            said = self.tools.digits.joined(ids[lo:hi], last[lo:hi])
            stops = np.cumsum(self.tools.digits.size[ids[lo:hi]] - last[lo:hi])
            marked = ~last[lo:hi]
            said[stops[marked] - 1] = mark[lo:hi][marked]
            first = np.flatnonzero(np.r_[True, text[lo + 1 : hi] != text[lo : hi - 1]])
            bounds = [0, *stops[first[1:] - 1].tolist(), len(said)]
            for t, s, e in zip(text[lo:hi][first].tolist(), bounds, bounds[1:], strict=False):
                hashes[t].update(said[s:e])
        return [h.hexdigest() if h else "" for h in hashes]


def _chunks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, a: str = A_FILE, b: str = B_FILE) -> DataFrame:
    """Tokens, groups and links of each row of ``docs(doc_id, text, ...)``, in one pass without a shuffle.

    ``(doc_id, a, b array<int>, a_end, b_end, cuts array<long>, links array<struct<a int, b int, bytes int>>)``: ids by both
    tokenizers, the bytes at which tokens end, those at which both end (one a group), and the token pairs that overlap, by
    their places. Offsets count from the space ahead of the text. Texts that are null, empty, or not spelt by both byte
    for byte have empty lists. Null doc_ids stay, repeated rows repeat, other columns are not read, an empty table gives
    an empty result.
    """
    files = read_files(a, b)
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
    names = ["doc_id", "a", "b", "a_end", "b_end", "cuts", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tokenizers(*files)
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            for lo, hi in _chunks(texts, SLICE_BYTES):
                x = Aligned(tools, texts[lo:hi])
                first = [np.cumsum(n) - n for n in x.sizes]
                size = np.bincount(x.doc_a, weights=tools.a_bytes.size[x.a], minlength=hi - lo).astype(np.int64)
                base, count = np.cumsum(size) - size, x.per_text()
                row = x.links.rows()
                made = [x.a.astype(np.int32), x.b.astype(np.int32), x.a_end - base[x.doc_a], x.b_end - base[x.doc_b]]
                cols = [_lists(v, n) for v, n in zip(made, [*x.sizes, *x.sizes], strict=True)]
                cols.append(_lists(x.cuts - np.repeat(base, count["n_groups"]), count["n_groups"]))
                places = row - first[0][x.doc_a[row]], x.links.cols - first[1][x.doc_b[x.links.cols]], x.links.counts
                links = pa.StructArray.from_arrays([pa.array(p.astype(np.int32)) for p in places], fields=list(link))
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count["n_links"])].astype(np.int32)), links))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols], names)

    prepared(docs.sparkSession)
    lists = "a array<int>, b array<int>, a_end array<long>, b_end array<long>, cuts array<long>"
    spec = f"doc_id long, {lists}, links array<struct<a:int,b:int,bytes:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, spec)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _tokenized(docs: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """One row a chunk of documents: what is known of each of them, the chunk's id pairs, and in how many of its
    documents each is linked; then, as the bytes of 32-bit numbers, which Spark moves whole, for each document how many
    pairs it has, their places in that list, and their links."""
    longs = ("doc_id", *_COUNTS)
    kinds = {"chunk": pa.int64(), **{n: pa.list_(pa.int64()) for n in longs}, "sha": pa.list_(pa.string())}
    kinds |= {"pairs": pa.list_(pa.int64()), "freqs": pa.list_(pa.int32())}
    kinds |= {n: pa.binary() for n in ("n_pairs", "at", "times")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, number = Tokenizers(*files), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            for lo, hi in _chunks(texts, CHUNK_BYTES):
                row = {"chunk": number, "doc_id": batch.column("doc_id").slice(lo, hi - lo).to_pylist(), **chunk(tools, texts[lo:hi])}
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in kinds.items()], list(kinds))

    def chunk(tools: Tokenizers, texts: list[bytes]) -> dict:
        parts, columns = [], {n: [] for n in (*_COUNTS, "sha", "n_pairs", "times")}
        for lo, hi in _chunks(texts, SLICE_BYTES):
            x = Aligned(tools, texts[lo:hi])
            pairs, text, at, times = x.pairs()
            parts.append((pairs, at.astype(np.int32)))
            found = {**x.per_text(), "sha": x.digests(), "n_pairs": np.bincount(text, minlength=hi - lo), "times": times}
            for n, values in found.items():
                columns[n].append(values)
        row = {n: np.concatenate(v) for n, v in columns.items()}
        row["pairs"] = np.unique(np.concatenate([p for p, _ in parts]))
        row["at"] = np.concatenate([np.searchsorted(row["pairs"], p).astype(np.int32)[at] for p, at in parts])
        row["freqs"] = np.bincount(row["at"], minlength=len(row["pairs"])).astype(np.int32)
        return row | {n: row[n].astype("<i4").tobytes() for n in ("n_pairs", "at", "times")}

    arrays = "".join(f", {n} array<long>" for n in longs) + ", sha array<string>, pairs array<long>"
    arrays += ", freqs array<int>" + "".join(f", {n} binary" for n in ("n_pairs", "at", "times"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"chunk long{arrays}")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many documents an id pair is linked, and whether that is the most of its A id."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "freqs")).alias("x")).select("x.pairs", "x.freqs")
    counts = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("freqs").alias("n"))
    # At most as many rows of an A id as B has entries.
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def report(docs: DataFrame, a: str = A_FILE, b: str = B_FILE) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256)`` for each row of ``docs``.

    Tokens by A and B, groups, links, and pairs that share a group; links whose id pair is, over all documents, linked in
    as many of them as any pair of its A id; the sum of those document counts over links; the digest of the groups' ids.
    Texts are tokenized once, in chunks of several megabytes that are stored; id pairs are counted by chunk before they
    are shuffled, and each chunk gets the counts of its own pairs back, so a common pair is one row a chunk. Rows count
    as documents, also repeated ones; null and empty texts and those not spelt by both have zeros and an empty digest.
    Null doc_ids stay, other columns are not read, an empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    chunks = stored(_tokenized(docs, read_files(a, b)), "tokens")
    counts = stored(pair_counts(chunks), "pair-counts")
    named = ["chunk", *("doc_id", *_COUNTS), "sha", "n_pairs", "at", "times"]
    places = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields}
    places = places.select("chunk", "pos", "n", "best", *(none[n] for n in named[1:]))
    whole = chunks.select("chunk", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *named[1:])  # noqa: E501
    dealt = places.unionByName(whole).repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("pos"))
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            begin = 0
            # A chunk's own row follows the counts of its pairs.
            for end in [*np.flatnonzero(batch.column("pos").is_null().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                part = batch.slice(begin, end - begin)
                n, best = part.column("n").to_numpy(zero_copy_only=False), part.column("best").to_numpy(zero_copy_only=False)
                held.append((n.astype(np.int64), best.astype(bool)))
                if end < batch.num_rows:
                    yield finished(batch.slice(end, 1), *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                begin = end + 1

    def finished(chunk: pa.RecordBatch, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        value = {c: chunk.column(c)[0].values for c in ("doc_id", *_COUNTS, "sha")}
        numbers = (np.frombuffer(chunk.column(c)[0].as_buffer(), "<i4") for c in ("n_pairs", "at", "times"))
        n_pairs, at, times = (x.astype(np.int64) for x in numbers)
        ends = np.r_[0, np.cumsum(n_pairs)]
        best_sum, count_sum = (np.r_[0, np.cumsum(x)] for x in (times * best[at], times * n[at]))
        sums = [pa.array(x[ends[1:]] - x[ends[:-1]], pa.int64()) for x in (best_sum, count_sum)]
        return pa.RecordBatch.from_arrays([value["doc_id"], *(value[c] for c in _COUNTS), *sums, value["sha"]], names)

    spec = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return dealt.select("pos", "n", "best", *named[1:]).mapInArrow(rows, spec)
