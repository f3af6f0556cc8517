import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, components, docs_frame, simhash
from tidemark.llm import simhash as op
from tidemark.llm.components import connected_components


def brute(rows, bits=3):
    fps = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    root = components(len(rows), links)
    least = {}
    for r, (d, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{fp:016x}", least[r]) for (d, _), fp, r in zip(rows, fps, root, strict=True))


def found(df):
    rows = op.simhash_components(df, shard_rows=64).select("doc_id", op.hex_digits(F.col("fp")).alias("f"), "component_id")
    return sorted(map(tuple, rows.collect()))


def test_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(df) == brute(rows)


def test_edge_rows(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "One"), (5, "one"), (4, "a b"), (3, "A B C D e"), (2, "a b c d E"), (1, "x " * 5000), (1, "x " * 5000), (0, "é é ñ")]
    assert found(docs_frame(spark, rows, extra=True)) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert found(docs_frame(spark, [])) == []
    rows = op.simhash_components(docs_frame(spark, [(None, "a b c d"), (4, "a b c d"), (None, "q r s t u")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("seed", range(3))
def test_hamming_links_find_every_component(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = base[rng.integers(0, 60, 500)]
    for _ in range(seed + 2):
        near = near ^ (np.int64(1) << rng.integers(0, 62, 500))
    dense = np.int64(12345) ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300))
    fps = np.unique(np.concatenate([base, near, dense]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = op.hamming_links(df, 3, shard_rows=40).collect()
    at = {int(x): i for i, x in enumerate(fps)}
    d = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
    assert all(d[at[r.a], at[r.b]] >= 0 for r in links)
    want = components(len(fps), [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 3), strict=True)])
    assert components(len(fps), [(at[r.a], at[r.b]) for r in links]) == want
    roots = {r.node: r.root for r in connected_components(df.sparkSession.createDataFrame(links)).collect()} if links else {}
    assert [at[roots.get(int(x), int(x))] for x in fps] == [min(j for j in range(len(fps)) if want[j] == w) for w in want]


def test_dense_ball_inside_one_shard():
    rng = np.random.default_rng(5)
    fp = np.uint64(99) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, rng.integers(0, 1 << 63, 500).astype(np.uint64)]))
    a, b = op.shard_links(fp, np.full(len(fp), -1), 3)
    at = {int(x): i for i, x in enumerate(fp)}
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = components(len(fp), [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 3), strict=True)])
    assert components(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == want


def test_keep_one_of_each_group(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (2, "other words stand here now"), (None, "a b c d")]
    df = docs_frame(spark, rows, extra=True)
    out = op.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]


def test_keep_one_with_repeated_and_null_ids(spark):
    x, y, z = "q r s t u v w", "other words stand here now", "third text of all of them"
    rows = [(5, x), (3, y), (5, y + " "), (5, y), (None, z), (None, z), (None, z + " "), (8, "x x"), (8, "alone it stands")]
    out = op.keep_one(docs_frame(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.text.strip()) for r in out)
    assert got == sorted([("5", x), ("3", y), ("None", z), ("8", "x x"), ("8", "alone it stands")])
    again = op.keep_one(docs_frame(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in again) == sorted((str(r.doc_id), r.text) for r in out)


def test_components_of_paths_stars_and_noise(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_tree_from_a_small_sample_finds_every_component(spark):
    rng = np.random.default_rng(8)
    near = rng.integers(0, 1 << 63, 900, dtype=np.int64)[rng.integers(0, 900, 5000)]
    for _ in range(3):
        near = near ^ (np.int64(1) << rng.integers(0, 62, 5000))
    fps = np.unique(near)
    links = op.hamming_links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 3, shard_rows=300).collect()
    at = {int(x): i for i, x in enumerate(fps)}
    pairs = [(int(i) + lo, int(j)) for lo in range(0, len(fps), 500) for i, j in zip(*np.nonzero(np.bitwise_count(fps.view(np.uint64)[lo : lo + 500, None] ^ fps.view(np.uint64)[None, :]) <= 3), strict=True)]
    assert components(len(fps), [(at[r.a], at[r.b]) for r in links]) == components(len(fps), pairs)
