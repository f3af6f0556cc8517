import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame
from tidemark.llm import sketches as op


def all_hashes(text, words=op.WORDS):
    w = text.encode().split()
    runs = [w] if 0 < len(w) <= words else [w[i : i + words] for i in range(len(w) - words + 1)]
    return {hashlib.md5(b" ".join(r)).hexdigest()[:16] for r in runs}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(seed, n, vocabulary=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 40, 68, 300, 5000])
def test_a_sketch_is_the_text_s_smallest_hashes(n):
    text = prose(n, n)
    want = sorted(all_hashes(text))
    got = op.sketched(op.hashed(text.encode()))
    assert got == [h for i, h in enumerate(want) if h < op.LIMIT or i < op.FLOOR]
    top = op.threshold(got)
    assert [h for h in want if h <= top] == [h for h in got if h <= top]


def test_short_texts_are_compared_exactly_and_long_ones_closely():
    for n, slack in ((10, 0), (60, 0), (400, 0.12), (20_000, 0.04)):
        words = prose(1, n).split()
        other = " ".join(words[: n // 2] + prose(2, n - n // 2).split())
        a, b = (op.sketched(op.hashed(t.encode())) for t in (" ".join(words), other))
        x, y = all_hashes(" ".join(words)), all_hashes(other)
        assert abs(op.likeness(a, b) - jaccard(x, y)) <= slack
        assert abs(op.containment(a, b) - len(x & y) / len(x)) <= 2 * slack


def test_a_short_text_in_a_long_one():
    long = prose(3, 30_000, 5000)
    part = " ".join(long.split()[9000:11_000])
    a, b = (op.sketched(op.hashed(t.encode())) for t in (part, long))
    assert op.containment(a, b) == 1.0 and op.containment(b, a) < 0.12


def brute(rows):
    """What edited_likeness returns, for rows whose doc_ids differ."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        made = text[: len(text) - half] + after[:half]
        f, e, g = (op.sketched(op.hashed(t.encode())) for t in (text, made, after))
        sha = hashlib.sha256(made.encode()).hexdigest()
        out[doc_id] = (len(text), sha, op.packed(f), op.packed(e), op.likeness(f, e), op.likeness(f, g), op.containment(f, e))
    return out


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_edited_texts_follow_the_order_of_ids(spark, parts):
    rows = [(i * 7 % 31, prose(i, i * 9, 30) + (" é😀" if i % 3 else "")) for i in range(31)]
    rows += [(100, None), (101, ""), (None, "x y"), (-5, " \n\t "), (2**63 - 1, "a"), (-(2**63), prose(9, 3000))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = op.edited_likeness(docs_frame(spark, rows, extra=True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_repeated_rows_one_row_and_none(spark):
    one = op.edited_likeness(docs_frame(spark, [(4, "ab cd")])).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(4, 1.0, hashlib.sha256(b"ab ab").hexdigest())]
    rows = [(1, "a b c")] * 5 + [(None, "q r")] * 4 + [(2, "z")]
    got = op.edited_likeness(docs_frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 1) == 4
    assert op.edited_likeness(docs_frame(spark, [])).collect() == []
    assert op.fingerprinted(docs_frame(spark, [])).collect() == []


def test_fingerprints_merge_and_hold(spark):
    texts = [(i, prose(i, 2500, 4000), "en", "s" + str(i % 3)) for i in range(9)]
    docs = docs_frame(spark, texts, extra=True)
    prints = op.fingerprinted(docs).join(docs.select("doc_id", "source"), "doc_id")
    whole = op.merged(prints, "source")
    got = {(r.source, r.hash) for r in whole.collect()}
    assert got == {(s, h) for _, t, _, s in texts for h in all_hashes(t) if h < op.LIMIT}
    halves = op.merged(prints.where("doc_id < 5"), "source").union(op.merged(prints.where("doc_id >= 5"), "source"))
    assert {tuple(r) for r in halves.dropDuplicates().collect()} == got
    part = docs_frame(spark, [(50, " ".join(texts[4][1].split()[:900]))])
    held = op.contained(op.fingerprinted(part), whole, "doc_id", "source").collect()
    assert {r.source: r.share for r in held}["s1"] == 1.0 and all(r.share < 0.2 for r in held if r.source != "s1")
    assert docs.where(F.size(op.hashes(F.lit(""))) != 0).count() == 0
