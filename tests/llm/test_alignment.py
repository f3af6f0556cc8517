import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import SF, docs_frame
from tidemark.llm import alignment as op

TEXTS = [
    None, "", " ", "a", "The cat sat.", "x" * 5000, "é漢字😀 \n\n\t tab", "two  spaces   three", "<|endoftext|> </s> <s> <unk>", "▁mark▁",
    "don't we'll I'VE", "\x00\x01", "1234567890 12.5%", " lead", "trail ", "ﬁ ﬂ ½ Å", "ha" * 300, "\r\n a b",
]


@pytest.fixture(scope="module")
def tools():
    return op.Tokenizers(*op.read_files())


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as their own libraries load them, and the bytes of their entries."""
    a = Tokenizer.from_file(op.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=op.B_FILE)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in shown}
    table |= {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in shown)}

    def spell(text):
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(table[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        want = (" " + text).encode()
        return (list(zip(ia, ba)), list(zip(ib, bb))) if text and b"".join(ba) == want == b"".join(bb) else ([], [])

    return spell


def brute(spell, texts):
    """Rows of the report, by comparing every token of A with every token of B."""
    found, count = [], Counter()
    for text in texts:
        ends, tokens = [], spell(text or "")
        for side in tokens:
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            ends.append(spans)
        links = [(x[0], y[0]) for x in ends[0] for y in ends[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in ends[0]} & {y[2] for y in ends[1]})
        groups, shared = [], 0
        for lo, hi in zip([0, *cuts], cuts):
            sides = [[x[0] for x in s if lo < x[2] <= hi] for s in ends]
            shared += len(sides[0]) * len(sides[1])
            groups.append("|".join(",".join(map(str, s)) for s in sides))
        count.update(set(links))
        found.append((len(ends[0]), len(ends[1]), len(groups), links, shared, ";".join(groups)))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (na, nb, ng, len(links), shared, sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(s.encode()).hexdigest() if na else "")
        for na, nb, ng, links, shared, s in found
    ]


def dense(m):
    out = np.zeros((len(m.start) - 1, m.width), np.int64)
    np.add.at(out, (m.rows(), m.cols), m.counts)
    return out


@pytest.mark.parametrize("limit", [1, 7, 1 << 18])
def test_products_of_sparse_rows(limit):
    rng = np.random.default_rng(limit)
    for n, m, k in ((0, 3, 2), (4, 1, 5), (9, 8, 7), (30, 20, 25)):
        x, y = (rng.random(s) < 0.2 for s in ((n, m), (m, k)))
        a, b = (op.incidence(np.r_[0, np.cumsum(z.sum(1))], np.nonzero(z)[1], z.shape[1]) for z in (x, y))
        got = op.product(a, b, limit)
        assert (dense(got) == x.astype(int) @ y.astype(int)).all()
        assert (op.row_sizes(a, b) == (x.astype(int) @ y.astype(int)).sum(1)).all()
        again = op.product(got, op.incidence(np.arange(k + 1), np.arange(k)[::-1].copy(), k), limit)
        assert (dense(again) == dense(got)[:, ::-1]).all()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_vocabulary_s_own_library(tools, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    a, b = tools.encode([text.encode()])
    want = plain(text)
    assert [a[0].tolist(), b[0].tolist()] == [[i for i, _ in side] for side in want]


def test_groups_and_links_of_texts(tools, plain):
    texts = [t or "" for t in TEXTS]
    x = op.Aligned(tools, [t.encode() for t in texts])
    want = brute(plain, texts)
    got = x.per_text()
    assert list(zip(*(got[n].tolist() for n in ("n_a", "n_b", "n_groups", "n_links", "n_shared")))) == [w[:5] for w in want]
    assert x.digests() == [w[-1] for w in want]
    shared = op.product(*x.groups())
    assert np.bincount(x.doc_a, np.diff(shared.start), len(texts)).astype(int).tolist() == [w[4] for w in want]
    # A link is a pair that shares a group, and bytes of the links of a token add up to its own.
    assert set(zip(x.links.rows().tolist(), x.links.cols.tolist())) <= set(zip(shared.rows().tolist(), shared.cols.tolist()))
    assert (np.add.reduceat(x.links.counts, x.links.start[:-1]) == tools.a_bytes.size[x.a]).all()


@pytest.mark.parametrize("chunk,piece", [(1, 1 << 18), (50, 20), (1 << 22, 30), (1 << 22, 1 << 18)])
def test_report(spark, plain, chunk, piece, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(op, "SLICE_BYTES", piece)
    texts = [*TEXTS, "The cat sat.", "The cat", "cat The sat. don't"]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in op.report(docs_frame(spark, rows, extra=True)).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(plain, texts), strict=True))


def test_real_output_and_empty_tables(spark, plain):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    want = brute(plain, [t for _, t in rows])
    for r in op.aligned(docs_frame(spark, rows)).collect():
        n = want[r.doc_id]
        assert (len(r.a), len(r.b), len(r.cuts), len(r.links)) == n[:4]
        for x in r.links:
            lo, hi = (max(e[i - 1] if i else 0 for e, i in ((r.a_end, x.a), (r.b_end, x.b))), min(r.a_end[x.a], r.b_end[x.b]))
            assert hi - lo == x.bytes > 0
    none = docs_frame(spark, [])
    assert op.report(none).collect() == [] and op.aligned(none).collect() == []


def test_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute_of_table(plain, [r.text for r in rows]), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in op.report(docs).collect()} == want


def brute_of_table(spell, texts):
    """As `brute`, for texts of thousands of tokens: links from the owners of each byte."""
    found, count = [], Counter()
    for text in texts:
        sides = spell(text or "")
        owners, ends = [], []
        for side in sides:
            owners.append([n for n, (_, x) in enumerate(side) for _ in x])
            ends.append(np.cumsum([len(x) for _, x in side]).tolist())
        links = [(sides[0][i][0], sides[1][j][0]) for i, j in dict.fromkeys(zip(*owners))]
        groups, shared, i, j = [], 0, 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            shared += (i2 - i) * (j2 - j)
            groups.append("|".join(",".join(str(t) for t, _ in s) for s in (sides[0][i:i2], sides[1][j:j2])))
            i, j = i2, j2
        count.update(set(links))
        found.append((len(sides[0]), len(sides[1]), len(groups), links, shared, ";".join(groups)))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (na, nb, ng, len(x), sh, sum(count[y] == most[y[0]] for y in x), sum(count[y] for y in x), hashlib.sha256(s.encode()).hexdigest() if na else "")
        for na, nb, ng, x, sh, s in found
    ]
