import math
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SF, docs_frame
from tidemark.llm import pieces as op

TEXTS = ["", " ", "a", "the cat", "a\n▁b  \U0001f600c\t", " lead and trail ", "x" * 3000, "é" * 50, "\n\n", "漢字 and ▁▁", "\x00\x01"]


@pytest.fixture(scope="module")
def lattices():
    return op.Lattices(op.Vocabulary(op.read_model()))


def test_round_trip_and_distinct(lattices):
    for text, rows in zip(TEXTS, op.sampled(lattices, TEXTS, list(range(len(TEXTS))), 4), strict=True):
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) >= 1
        assert [op.decode(lattices.vocabulary, list(x)) for x in ids] == [text] * len(ids)
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(0 <= r[3] <= 1 and r[1] <= 1e-6 for r in rows)


def every_segmentation(lattices, text):
    """All segmentations of a short text, with their probabilities by direct enumeration."""
    vocabulary = lattices.vocabulary
    total = Counter()
    words = op.words_of(text)

    def paths(word):
        if not word:
            yield (), 1.0
        for n in range(1, len(word) + 1):
            p = word[:n]
            if n == 1:
                i, w = int(vocabulary.single[ord(p)]), float(vocabulary.single_weight[ord(p)])
            else:
                node = 0
                for c in p:
                    node = int(vocabulary.child[node, vocabulary.char_class[ord(c)]]) if node < vocabulary.inner else 0
                    if not node:
                        break
                if not node or vocabulary.piece[node] < 0:
                    continue
                i, w = int(vocabulary.piece[node]), float(vocabulary.weight[node])
            for rest, v in paths(word[n:]):
                yield (i, *rest), w * v

    whole = [((), 1.0)]
    for word in words:
        whole = [(a + b, v * w) for a, v in whole for b, w in paths(word)]
    for ids, v in whole:
        total[ids] += v
    mass = sum(total.values())
    return {k: v / mass for k, v in total.items()}


def test_masses_and_sampling_order(lattices):
    text = "the cat"
    p = every_segmentation(lattices, text)
    found = {tuple(r[0].tolist()): r for r in op.sampled(lattices, [text], [5], len(p) + 5)[0]}
    assert set(found) == set(p)
    assert all(math.isclose(math.exp(found[x][1]), p[x], rel_tol=1e-4) for x in p)
    assert all(found[x][3] == 1.0 for x in p)
    n, first, second, weighted = 3000, Counter(), Counter(), Counter()
    for seed in range(n):
        a, b = op.sampled(lattices, [text], [seed * 104_729 + 7], 2)[0]
        first[tuple(a[0].tolist())] += 1
        second[tuple(b[0].tolist())] += 1
        for r in (a, b):
            weighted[tuple(r[0].tolist())] += math.exp(r[1]) / r[3]
    want = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for x in p:
        assert abs(first[x] / n - p[x]) < 0.04 and abs(second[x] / n - want[x]) < 0.04
        # Inclusion scores make an unbiased estimate of every probability.
        if p[x] > 0.03:
            assert abs(weighted[x] / n - p[x]) < 0.05


def test_cache_limit_does_not_change_results(lattices, monkeypatch):
    words = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(10)]
    want = op.sampled(lattices, words, list(range(10)), 2)
    small = op.Lattices(lattices.vocabulary)
    keep = op.Lattices.trimmed
    monkeypatch.setattr(op.Lattices, "trimmed", lambda self, new: keep(self, new, 30))
    got = [op.sampled(small, [w], [i], 2)[0] for i, w in enumerate(words)]
    assert [[r[0].tolist() for r in x] for x in got] == [[r[0].tolist() for r in x] for x in want]


def test_texts_are_scanned_together(lattices, monkeypatch):
    texts = [*TEXTS, *("word " * n + "end" for n in range(1, 40)), "a longer text, of many words. " * 200]
    alone = [op.sampled(lattices, [t], [i], 3)[0] for i, t in enumerate(texts)]
    calls, below = [], op._below
    monkeypatch.setattr(op, "_below", lambda *x: calls.append(len(x[0])) or below(*x))
    together = op.sampled(lattices, texts, list(range(len(texts))), 3)
    # A text of 3,000 characters is scanned in six steps at most, thrice, whatever stands beside it.
    assert len(calls) <= 3 * 6
    plain = [[[(x[0].tolist(), *x[1:]) for x in rows] for rows in found] for found in (alone, together)]
    assert plain[0] == plain[1]


def test_open_nodes_of_a_long_path(lattices, monkeypatch):
    texts = ["a longer text, of many words. " * 300, "short", "x" * 2000]
    want = op.sampled(lattices, texts, [1, 2, 3], 4)
    monkeypatch.setattr(op, "_SCAN", 7)
    got = op.sampled(lattices, texts, [1, 2, 3], 4)
    assert [[(x[0].tolist(), *x[1:]) for x in rows] for rows in got] == [[(x[0].tolist(), *x[1:]) for x in rows] for rows in want]


def test_decode_all(lattices):
    v = lattices.vocabulary
    rows = [[], [v.byte_id[0xE6]], [v.byte_id[0xBC], v.byte_id[0xA2]], op.sampled(lattices, ["a \U0001f600"], [1], 1)[0][0][0].tolist(), [], [5, 900, 31_000]]
    offsets = np.cumsum([0, *map(len, rows)])
    flat = np.array(sum(rows, []), np.int32)
    assert op.decode_all(v, flat, offsets) == [op.decode(v, x) for x in rows]
    assert op.decode_all(v, flat[:0], offsets[:1]) == [] and op.decode_all(v, flat[:0], np.zeros(3, np.int32)) == ["", ""]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op.segmented(docs.select("doc_id", "text"), decode_to="back").join(docs.select("doc_id", "text"), "doc_id")
    assert rows.where("not (back <=> text)").count() == 0
    assert rows.count() == rows.select("doc_id", "ids").distinct().count() >= docs.count()
    again = op.decoded(op.segmented(docs.select("doc_id", "text")))
    assert again.exceptAll(op.segmented(docs.select("doc_id", "text"), decode_to="text")).isEmpty()


def test_edge_rows(spark):
    df = docs_frame(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "y " * 40_000)], extra=True)
    rows = op.segmented(df, decode_to="back").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [len(by[i][0].ids) for i in (1, 2)] == [0, 0] and {r.back for r in by[4]} == {"y " * 40_000}
    assert len(by[3]) == 2 * len({tuple(r.ids) for r in by[3]})
    assert op.segmented(docs_frame(spark, [])).collect() == []
    clash = docs_frame(spark, [(3, "a b")]).selectExpr("*", "7 AS draw_seed", "8 AS draw_seed_", "9 AS Text2")
    again = [tuple(r.ids) for r in by[3][: len(by[3]) // 2]]
    assert {(tuple(r.ids), r.draw_seed, r.draw_seed_) for r in op.segmented(clash).collect()} == {(x, 7, 8) for x in again}
