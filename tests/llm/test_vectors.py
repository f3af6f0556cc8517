import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components
from tidemark.llm import nearest, similar

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.15, 0.5], n)[:, None]
    x[n // 2 : n // 2 + 40] = x[0]
    return x.astype(np.float32), rng.integers(0, 3, n)


def odd(n, dim):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * (dim - 1)
    return [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [nan, *one[1:]], 1), (n + 3, [inf, *one[1:]], 1), (n + 4, [None, *one[1:]], 1), (n + 5, one, None), (n + 6, [], 1), (n + 7, one[:3], 1)]


def cosines(x):
    x = x.astype(float)
    size = np.sqrt((x * x).sum(1))
    return (x @ x.T) / size[:, None] / size[None, :]


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"cell_rows": 20}), (2, {"cell_rows": 20, "part_rows": 30}), (3, {"part_rows": 25})])
def test_similar_against_brute_force(spark, seed, options):
    x, label = cloud(seed)
    n = len(x)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(n)]
    c = cosines(x)
    links = [(i, j) for i in range(n) for j in range(n) if i != j and label[i] == label[j] and c[i, j] >= 0.93]
    root, count = components(n, links), np.bincount([i for i, _ in links], minlength=n)
    df = spark.createDataFrame(rows + odd(n, 16), SCHEMA).withColumn("class_id", F.lit("x"))
    got = sorted(map(tuple, similar.similar_components(df, **options).collect()))
    want = [(i, int(count[i]), root[i], root[i] == i) for i in range(n)]
    assert got == want + [(n + i, 0, n + i, True) for i in range(8)]


def test_similar_empty_and_repeated(spark):
    assert similar.similar_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted(map(str, similar.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [g[4:-1] for g in got] == [
        "vec_id=1, n_links=2, component_id=1, kept=True", "vec_id=2, n_links=2, component_id=1, kept=False",
        "vec_id=2, n_links=2, component_id=1, kept=False", "vec_id=None, n_links=0, component_id=None, kept=True",
    ]


@pytest.fixture
def many_partitions(spark):
    """Shuffles that adaptive execution does not merge: every group goes where its key's hash sends it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 120, "query_rows": 3}])
def test_nearest_against_brute_force(spark, many_partitions, blocks):
    x, label = cloud(7, 700)
    n = len(x)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(n)] + odd(n, 16), SCHEMA).withColumn("rank", F.lit("x"))
    rows = nearest.nearest(df, F.col("vec_id") % 50 == 0, **blocks).collect()
    c = cosines(np.vstack([x, np.eye(16, dtype=np.float32)[:1]]))
    ids = [*range(n), n + 5]
    hits = 0
    for q in [q for q in ids if q % 50 == 0]:
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        row = c[ids.index(q)]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and q not in [g[1] for g in got]
        assert all(abs(s - row[ids.index(v)]) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        fifth = sorted((-row[i] for i, v in enumerate(ids) if v != q))[4]
        hits += sum(-s <= fifth + 1e-12 for _, _, s in got)
    assert hits >= 0.9 * 5 * len({r.query_id for r in rows}) and len({r.query_id for r in rows}) == 14


def test_nearest_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf["embedding"]), pdf["vec_id"].to_numpy()
    c = cosines(x)
    got = nearest.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        c[i, i] = -2
        hits += int((rows["score"] >= np.sort(c[i])[-5] - 1e-12).sum())
    assert hits >= 0.9 * 5 * int((ids % 50 == 0).sum())


def test_nearest_small_and_empty(spark):
    assert nearest.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (0, [1.0, 0.0], 1)]
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
