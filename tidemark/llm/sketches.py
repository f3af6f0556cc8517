"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text's, the sketch of
a union is the union of the sketches, and what share of a short text stands in a long one can be read from their
sketches. Texts with few hashes below that threshold keep their ``FLOOR`` smallest ones instead, which raises the
threshold of that sketch alone: two sketches are always compared below the lower of their two thresholds, where both hold
every hash. A text of fewer shingles than that is kept whole and compared exactly.

Hashes are the first 16 hex digits of a shingle's MD5 (UTF-8), so that any SQL engine can compute them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import prepared, utf8

WORDS = 5
#: Hashes below this are always kept: one in sixteen.
LIMIT = "1000000000000000"
#: A sketch holds that many hashes at least, if its text has them.
FLOOR = 64

_DIGITS = 16


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """Runs of ``words`` words joined by one space; the whole sequence if there are fewer; none without a word."""
    found = text.split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)]


def hashed(text: bytes, words: int = WORDS, *known: dict[bytes, bytes]) -> dict[bytes, bytes]:
    """The hash of each different shingle of a text, taken from ``known`` tables where it stands in one."""
    found = {}
    for s in set(shingles(text, words)):
        for table in known:
            if s in table:
                found[s] = table[s]
                break
        else:
            found[s] = hashlib.md5(s, usedforsecurity=False).digest()[: _DIGITS // 2]
    return found


def sketched(found: dict[bytes, bytes], limit: str = LIMIT, floor: int = FLOOR) -> list[str]:
    """The sketch of a text's hashes, in ascending order."""
    hashes, top = sorted(set(found.values())), bytes.fromhex(limit)
    n = next((i for i in range(floor, len(hashes)) if hashes[i] >= top), len(hashes))
    return [h.hex() for h in hashes[:n]]


def threshold(sketch: list[str], limit: str = LIMIT, floor: int = FLOOR) -> str:
    """The largest hash up to which a sketch holds all of its text's hashes."""
    if len(sketch) < floor:
        return "f" * _DIGITS
    return max(sketch[-1], limit)


def overlap(a: list[str], b: list[str], limit: str = LIMIT, floor: int = FLOOR) -> tuple[int, int, int]:
    """Hashes of a, of b and of both, below what both sketches cover."""
    top = min(threshold(a, limit, floor), threshold(b, limit, floor))
    x, y = {h for h in a if h <= top}, {h for h in b if h <= top}
    return len(x), len(y), len(x & y)


def likeness(a: list[str], b: list[str], limit: str = LIMIT, floor: int = FLOOR) -> float:
    """Estimated Jaccard likeness of the texts' shingle sets; 1 for two texts without words, 0 if only one has any."""
    x, y, both = overlap(a, b, limit, floor)
    return both / (x + y - both) if x or y else 1.0


def containment(a: list[str], b: list[str], limit: str = LIMIT, floor: int = FLOOR) -> float:
    """Estimated share of a's shingles that b has too; 1 for a text without words."""
    x, _, both = overlap(a, b, limit, floor)
    return both / x if x else 1.0


def packed(sketch: list[str]) -> str:
    """A sketch as one string, the fingerprint."""
    return ",".join(sketch)


def hashes(fingerprint: Column | str) -> Column:
    """The hashes of a fingerprint, as an array; empty for an empty or null one."""
    column = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")


def fingerprinted(docs: DataFrame, words: int = WORDS, limit: str = LIMIT, floor: int = FLOOR) -> DataFrame:
    """``(doc_id, fingerprint)`` for each row of ``docs(doc_id, text, ...)``, in one pass without a shuffle.

    Null texts count as empty; a text without words has the empty fingerprint. Null doc_ids stay, repeated rows repeat,
    other columns are not read, an empty table gives an empty result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [packed(sketched(hashed(t or b"", words), limit, floor)) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fingerprint string")


def merged(fingerprints: DataFrame, *by: str, limit: str = LIMIT) -> DataFrame:
    """``(*by, hash)``: the sketch of the union of each group's texts, one row a hash, from ``(fingerprint, *by)``.

    Only hashes below the fixed threshold merge, since every fingerprint holds all of its own there. A group's sketch is
    spread over rows, so a group may hold any share of the corpus; repeats are dropped before they are shuffled. Merging
    merged sketches again (``dropDuplicates`` of their union) gives the same rows as merging all at once.
    """
    rows = fingerprints.select(*by, F.explode(hashes("fingerprint")).alias("hash"))
    return rows.where(F.col("hash") < limit).dropDuplicates()


def contained(fingerprints: DataFrame, sketches: DataFrame, key: str, *by: str, limit: str = LIMIT) -> DataFrame:
    """``(key, *by, n_hashes, n_shared, share)``: how much of each text stands in each group of ``merged`` sketches.

    ``fingerprints(key, fingerprint)`` has one row a text; texts and groups without a common hash give no row. Texts may
    be of any length against groups of any size: only the text's own hashes below the fixed threshold count.
    """
    own = fingerprints.select(key, F.filter(hashes("fingerprint"), lambda x: x < limit).alias("own"))
    rows = own.select(key, F.size("own").cast("long").alias("n_hashes"), F.explode("own").alias("hash"))
    shared = rows.join(sketches.select(*by, "hash"), "hash").groupBy(key, "n_hashes", *by).agg(F.count("*").alias("n_shared"))
    return shared.select(key, *by, "n_hashes", "n_shared", (F.col("n_shared") / F.col("n_hashes")).alias("share"))


def _place() -> list[Column]:
    """Columns whose ascending order is descending doc_id, nulls last; rows that tie in all of them are equal."""
    text = F.coalesce("text", F.lit(""))
    return [
        F.col("doc_id").isNull().cast("long").alias("p0"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("p1"),
        F.xxhash64(text).alias("p2"),
        F.xxhash64(text, F.lit(1)).alias("p3"),
    ]


def in_order(docs: DataFrame) -> DataFrame:
    """``(part, guard, doc_id, text)``: rows dealt into ranges of descending doc_id, each range ending with a guard.

    The guard of a range is a copy of the row that follows it, the first row of all after the last range. So a task that
    reads a range in order sees each row's successor. Ranges start at rows of the table found in a first, narrow pass;
    the driver holds one key a range. Whole texts are shuffled once.
    """
    spark = docs.sparkSession
    names = ["p0", "p1", "p2", "p3"]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(*_place()).repartitionByRange(parts, *names)
    narrow = narrow.select(F.spark_partition_id().alias("part"), F.struct(*names).alias("own"))
    bounds = sorted(tuple(r.own) for r in narrow.groupBy("part").agg(F.min("own").alias("own")).collect())
    if not bounds:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("guard"), "doc_id", "text", *_place())
    struct = "struct<p0:bigint,p1:bigint,p2:bigint,p3:bigint>"
    at = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(b, names, strict=True))) for b in bounds)).cast(f"array<{struct}>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    own = F.struct(*names)

    def closer(found: Column, step: Column) -> Column:
        """One step of a binary search for the last bound that is not above the row."""
        to = found + step
        return F.when((to < len(bounds)) & (F.get(F.col("bounds"), to) <= F.col("own")), to).otherwise(found)

    placed = rows.select("*", *_place()).select("*", own.alias("own"), at.alias("bounds"))
    placed = placed.withColumn("part", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), closer))
    guard = F.struct(((F.col("part") + (len(bounds) - 1)) % len(bounds)).alias("part"), F.lit(1).alias("guard"))
    here = F.struct(F.col("part"), F.lit(0).alias("guard"))
    copies = F.when(F.get("bounds", "part") == F.col("own"), F.array(here, guard)).otherwise(F.array(here))
    dealt = placed.select("doc_id", "text", *names, F.explode(copies).alias("to")).select("to.part", "to.guard", "doc_id", "text", *names)
    return dealt.repartitionById(len(bounds), "part").sortWithinPartitions("part", "guard", *names)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_likeness(docs: DataFrame, words: int = WORDS, limit: str = LIMIT, floor: int = FLOOR) -> DataFrame:
    """Each text's fingerprint against that of an edited version of it and of the next document, by descending doc_id.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_edited)``: likeness
    to the edited text and to the next document, and the share of the text's shingles that the edited text still holds.
    Null texts count as empty. Null doc_ids come last; rows of one doc_id follow each other by a hash of their texts; a
    table of one row is its own successor. Other columns are not read. An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, closed = None, None, False
        for b in batches:
            out = []
            columns = (b.column(n).to_pylist() for n in ("part", "guard", "doc_id", "text"))
            for now, guard, doc_id, text in zip(*columns, strict=True):
                if now != part:
                    part, before, closed = now, None, False
                if closed:  # further copies of the guard
                    continue
                found = hashed(text.encode(), words, *before[3:] if before else ())
                own = sketched(found, limit, floor)
                if before is not None:
                    last_id, last, last_own, last_found = before
                    made = edited(last, text).encode()
                    other = sketched(hashed(made, words, last_found, found), limit, floor)
                    near = likeness(last_own, other, limit, floor), likeness(last_own, own, limit, floor)
                    held = containment(last_own, other, limit, floor)
                    sha = hashlib.sha256(made).hexdigest()
                    out.append((last_id, len(last), sha, packed(last_own), packed(other), *near, held))
                before, closed = (doc_id, text, own, found), bool(guard)
            if out:
                yield batch(out)

    prepared(docs.sparkSession)
    spec = ", ".join(f"{n} {'long' if k == pa.int64() else k}" for n, k in zip(names, kinds, strict=True))
    return in_order(docs).select("part", "guard", "doc_id", "text").mapInArrow(read, spec)
