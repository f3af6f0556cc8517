import hashlib
import random

import pytest

from tests.llm.helpers import SF, docs_frame, repeats
from tidemark.llm import repeats as op


def found(df, **options):
    rows = op.remove_repeats(df, **options).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def brute(rows, span):
    return sorted((str(d), *x) for (d, _), x in zip(rows, repeats([t for _, t in rows], span), strict=True))


def test_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()], 400)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(4)]
        rows.append((i, " ".join(parts)))
    return rows + [(100, "ab" * 300), (101, "x" * 500), (102, "y" * 41), (103, None), (104, ""), (105, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("max_bucket", [50_000, 2])
def test_generated_passages_against_brute_force(spark, seed, max_bucket):
    rows = passages(seed)
    assert found(docs_frame(spark, rows, extra=True), span=40, gram=12, max_bucket=max_bucket) == brute(rows, 40)


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 64)
    import numpy as np

    text = np.frombuffer(("".join(map(str, range(400)))).encode(), np.uint8)
    pos, g, c = op._anchors(text, 40, 12)
    monkeypatch.setattr(op, "CHUNK", 1 << 20)
    for got, want in zip((pos, g, c), op._anchors(text, 40, 12), strict=True):
        assert (got == want).all()


def test_groups_hold_all_occurrences():
    rights = [b"abcXX", b"abcYY", b"abcXZ", b"qqq"]
    lefts = [b"mn", b"mo", b"mn", b"mn"]
    got = {(left, right, tuple(sorted(m))) for left, right, m in op.maximal_groups(lefts, rights, span=4)}
    assert got == {(2, 4, (0, 2)), (1, 3, (0, 1, 2)), (2, 3, (0, 2))}


def test_empty_table_and_short_texts(spark):
    assert found(docs_frame(spark, [])) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert found(docs_frame(spark, [(1, None), (2, "")])) == [("1", 0, 0, 0, empty), ("2", 0, 0, 0, empty)]


def test_texts_keep_their_other_columns(spark):
    rows = [(1, "é" * 30 + "A"), (2, "é" * 30 + "B"), (3, "short"), (4, None)]
    df = docs_frame(spark, rows, extra=True)
    out = op.without_repeats(df, span=40, gram=12)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(1, "A", 1), (2, "B", 1), (3, "short", 5)]


@pytest.mark.parametrize("seed", range(20))
def test_cover_is_the_reach_of_the_groups(seed, monkeypatch):
    monkeypatch.setattr(op, "_FEW", seed % 5)
    rng = random.Random(seed)
    text = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
    pairs = list({(text(), b"g" + text()) for _ in range(rng.randint(2, 40))})
    lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [(0, 0)] * len(pairs)
    for left, right, members in op.maximal_groups(lefts, rights, span=7):
        for m in members:
            want[m] = (max(want[m][0], left), max(want[m][1], right))
    brute = [(0, 0)] * len(pairs)
    for i in range(len(pairs)):
        for j in range(len(pairs)):
            left, right = op.common_prefix(lefts[i], lefts[j]), op.common_prefix(rights[i], rights[j])
            if i != j and left + right >= 7:
                brute[i] = (max(brute[i][0], left), max(brute[i][1], right))
    assert op.cover(lefts, rights, span=7) == want == brute


def test_occurrences_of_groups(spark):
    rows = [(1, "abcdefghij" * 3 + "XXXXX"), (2, "YY" + "abcdefghij" * 3 + "Z"), (3, "nothing of the kind here, is there?")]
    texts = op.long_texts(docs_frame(spark, rows), 20)
    found = {(r.k, r.s, r.e) for r in op.maximal_repeats(texts, span=20, gram=6).collect()}
    of = {r.k: r.text for r in texts.collect()}
    strings = {bytes(of[k][s:e]) for k, s, e in found}
    assert all(len(x) >= 20 for x in strings) and any(x == b"abcdefghij" * 3 for x in strings)
    for x in strings:
        assert sum(t[i:].startswith(x) for t in of.values() for i in range(len(t))) > 1


def test_groups_do_not_depend_on_the_bucket_size(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 25))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(2, 8))) + str(i % 7)) for i in range(60)]
    texts = op.long_texts(docs_frame(spark, rows), 20)

    def groups(max_bucket):
        out = {}
        for r in op.maximal_repeats(texts, span=20, gram=6, max_bucket=max_bucket).collect():
            out.setdefault((r.g, r.grp), []).append((r.k, r.s, r.e))
        return sorted(sorted(x) for (_, grp), x in out.items() if grp != -1)

    whole = groups(50_000)
    assert len(whole) > 50 and max(e - s for x in whole for _, s, e in x) > 20
    assert groups(2) == groups(0) == whole


def test_pipeline_cuts_passages_of_little_over_fifty_words_and_leaves_shorter_ones(spark):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short = text(54), text(45)
    assert 240 < len(short) < len(passage) < op.SPAN
    rows = [(i, f"{text(40)}. {passage} {text(40)}") for i in range(3)] + [(i, f"{text(60)}. {short} {text(30)}") for i in (3, 4)] + [(5, text(120))]
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs_frame(spark, rows, extra=True), "").collect()}
    for i, before in rows:
        if i < 3:
            assert passage[5:-5] not in out[i] and before[:180] == out[i][:180] and before[-180:] == out[i][-180:]
        else:
            assert out[i] == before
