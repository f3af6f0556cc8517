import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from tests.llm.helpers import SF
from tidemark.llm import repair as op

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ("system", "user", "assistant")


def faults(rows):
    """(fault, initial) of each (role, text) row."""
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(op.SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((fault, role[:1]))
    return out


def cheapest(kinds):
    """Least (cost, audit) by trying every edit at every place; the repaired rows as (role, row or None)."""

    @lru_cache(None)
    def best(at, last, inserts):
        # last: initial behind which the conversation goes on, '' at its start.
        ways = []
        if at == len(kinds):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            fault, initial = kinds[at]

            def go(edit, cost, role):
                if role is None or role == {"": "u", "s": "u", "u": "a", "a": "u"}[last] or (role == "s" and last == ""):
                    rest = best(at + 1, role or last, 0)
                    if rest:
                        extra = 3 if fault == "truncated" and edit != "D" else 0
                        kept = () if role is None else (((role if edit == "R" else ""), at),)
                        ways.append((cost + extra + rest[0], edit + rest[1], kept + rest[2]))

            go("D", 4, None)
            if fault in ("", "truncated"):
                if initial in ("s", "u", "a"):
                    go("K", 0, initial)
                go("R", 3, "u")
                go("R", 3, "a")
        if inserts < 3:
            role = "a" if last == "u" else "u"
            rest = best(at, role, inserts + 1)
            if rest:
                ways.append((3 + rest[0], "I" + rest[1], ((role, None),) + rest[2]))
        return min(ways) if ways else None

    return best(0, "", 0)


def brute(rows):
    """The report of rows (turn, role, text), in order."""
    kinds = faults([r[1:] for r in rows])
    cost, audit, kept = cheapest(tuple(kinds))
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names[r] if r else rows[at][1]}:{'' if at is None else rows[at][2]}" for r, at in kept]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(k[0] == name for k in kinds) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_turns(seed, n):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \n", "d? ", "e"]
    return [(i + rng.randrange(2), rng.choice(ROLES[rng.randrange(2) :] + ("tool",)), rng.choice(texts) + ("" if rng.random() < 0.6 else f" {i}.")) for i in range(n)]


def ordered(rows):
    """The operator's order: turn (null first), role; tests give no two different texts of one turn and role."""
    seen = {}
    rows = [r for r in rows if seen.setdefault(r[:2], r[2]) == r[2]]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("bits", [0, 2, 6])
def test_reports_equal_brute_force(spark, bits):
    convs = {i: ordered(random_turns(i, i % 13)) for i in range(120)}
    frame = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in op.report(frame, ids, min_bits=bits).collect()}
    assert got == {c: brute(rows) for c, rows in convs.items()}


def test_a_long_conversation_is_cut_into_blocks(spark):
    rows = ordered([(i, r, t) for i, (_, r, t) in enumerate(random_turns(5, 700))])
    got = [op.report(f, f, min_bits=b).first() for b in (0, 9) for f in [spark.createDataFrame([(1, *r) for r in rows], SCHEMA)]]
    assert got[0] == got[1]
    kinds = [op.FAULTS.index(f) * 4 + "sua".find(i) + 1 if i else 0 for f, i in faults([r[1:] for r in rows])]
    vectors = [op._FINAL]
    for k in reversed(kinds):
        vectors.append(op.before(k, vectors[-1]))
    assert got[0].cost == vectors[-1][0] and got[0].audit.translate(str.maketrans("", "", "I")).__len__() == len(rows)


def test_matrices_are_products_of_rows():
    rng = random.Random(1)
    blocks = [[rng.randrange(16) for _ in range(n)] for n in (0, 1, 5, 40)]
    for block, m in zip(blocks, op.matrices(blocks), strict=True):
        vector = (5, 9, 1, 7)
        for k in reversed(block):
            vector = op.before(k, vector)
        assert [min(int(m[s, e]) + (5, 9, 1, 7)[e] for e in range(4)) for s in range(4)] == list(vector) or not block


def test_edits_are_the_repaired_rows(spark):
    convs = {i: ordered(random_turns(i + 500, 9)) for i in range(40)}
    frame = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA).selectExpr("*", "'x' tag", "1 start", "0 n")
    by = {}
    for r in sorted(op.edits(frame).collect(), key=lambda r: (r.conv_id, r.n)):
        by.setdefault(r.conv_id, []).append(r)
    for c, rows in convs.items():
        want = brute(rows)
        assert "".join(r.edit for r in by[c]) == want[6]
        lines = "\n".join(f"{r.role}:{r.text}" for r in by[c] if r.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == want[7]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in (0, 1, None)] + [(None, 3, None, None)]
    got = {}
    for r in op.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {
            0: [], 1: [(role, "")], 2: [(role, text.translate(str.maketrans("", "", ".!?")))], 3: [(role, text)] * 2, 4: [("user", text)]
        }.get(draw, [(role, text)])
        assert got.get((c, t), []) == want


def test_edge_rows(spark):
    rows = [(1, None, None, None), (1, 5, "user", "a."), (None, 0, "user", "b."), (None, 1, "assistant", "c" * 200_000 + ".")]
    rows += [(2, 0, "user", "x.")] * 50 + [(3, 2**63 - 1, "user", "y."), (3, -(2**63), "assistant", "z.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in op.report(frame, spark.createDataFrame([(1,), (2,), (3,), (None,), (9,)], "conv_id long"), 0).collect()}
    assert (got[1].blank, got[1].illegal, got[1].cost, got[1].audit, got[1].gaps) == (1, 1, 7, "DKI", 0)
    assert (got[None].cost, got[None].audit) == (0, "KK")
    assert (got[2].duplicate, got[2].audit) == (49, "K" + "D" * 49 + "I")
    assert got[3].gaps == 2**63 - 1 and got[3].audit == "IKKI"
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[9]) == (9, 0, 0, 0, 0, 0, 0, "", empty)
    none = spark.createDataFrame([], SCHEMA)
    assert op.report(none, none).collect() == [] and op.edits(none).collect() == []


def test_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = {}
    for r in op.damaged(turns).collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in op.report(op.damaged(turns), turns).collect()}
    assert set(got) == {r.conv_id for r in turns.select("conv_id").collect()}
    for c, found in got.items():
        assert found == brute(sorted(rows.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
