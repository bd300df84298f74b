from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from sensorframe.llm import queries, whitening

SF = "/root/testdata/sf0.01"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("n", T.StringType()), T.StructField("white", T.StringType()), T.StructField("_v", T.StringType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in vectors], VECTORS)


def plain(vectors, k=32):
    """Whole numbers, exact deviations, and whitened values by a dense eigensolver."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    scaled = [[n * c - t for c, t in zip(row, s)] for row in x]
    c = np.array([[a / n for a in row] for row in scaled])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum(a * a for a in row) for row in scaled], c @ u / np.sqrt(e), e / np.trace(v)


def test_query_equals_dense_solver(spark):
    rows = queries.op11_embedding_whitening(spark, SF).toPandas()
    emb = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
           if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    ids = sorted(emb)
    deviation, white, share = plain([emb[i] for i in ids])
    assert len(rows) == 32 * len(ids) and set(rows.n) == {len(ids)} and rows.identity_error.nunique() == 1
    assert rows.identity_error[0] < 1e-10
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    by = rows[rows.component == 1].set_index("vec_id").deviation
    assert [int(by[i]) for i in ids] == deviation
    assert np.allclose(rows.groupby("component").explained.first(), share, rtol=1e-10)


def test_inertia_counts():
    g = np.random.default_rng(1)
    for v in (np.diag([3.0, 3, 0, -1]), np.array([[0, 1.0], [1, 0]]), *(a + a.T for a in g.normal(size=(4, 9, 9)))):
        e = np.linalg.eigvalsh(v)
        edges = np.unique(e)
        for s in [edges[0] - 1, edges[-1] + 1, *((edges[:-1] + edges[1:]) / 2)]:
            assert whitening.count_above(v, s) == (e > s).sum()


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 0, 0], [3] * 40, list(range(50)), [2], [1, 1e-5, 1e-9], [4, 4.0000001, 4.0000002]])
def test_components_of_any_spectrum(spark, values):
    g = np.random.default_rng(2)
    u = np.linalg.qr(g.normal(size=(len(values),) * 2))[0]
    v = u @ np.diag(np.array(values, float)) @ u.T
    v = (v + v.T) / 2
    e, axes = whitening.principal(spark, v, 32)
    want = np.sort(np.array(values, float))[::-1]
    want = want[want > 1e-12 * want[0]][:32]
    assert np.allclose(e, want, rtol=1e-6, atol=1e-13)
    assert np.abs(axes.T @ axes - np.eye(len(want))).max() < 1e-10
    assert np.abs(v @ axes - axes * e).max() < 1e-12 * max(values)


def test_no_spread_no_components(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, rows)).collect() == []
    assert whitening.principal(spark, np.zeros((3, 3)), 32)[0].size == 0


def test_awkward_rows(spark):
    g = np.random.default_rng(3)
    good = [(i, g.normal(size=5).astype(np.float32).tolist()) for i in range(40)] + [(None, [0.5] * 5), (7, [0.25] * 5), (7, [0.25] * 5)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [1.0, 2.0]), (105, [])]
    rows = whitening.whiten(table(spark, good + bad), components=3).toPandas()
    deviation, white, _ = plain([v for _, v in good], 3)
    assert len(rows) == 3 * len(good) and set(rows.component) == {1, 2, 3} and set(rows.n) == {43}
    assert rows.vec_id.isna().sum() == 3 and (rows.vec_id == 7).sum() == 9 and not (rows.vec_id >= 100).any()
    assert sorted(rows[rows.component == 1].deviation.astype(int)) == sorted(deviation)
    for c in (1, 2, 3):
        one = np.sort(rows[rows.component == c].whitened.to_numpy())
        assert min(np.abs(one - np.sort(s * white[:, c - 1])).max() for s in (1, -1)) < 1e-9


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(v), float(v) / 3, 1.0]) for i, v in enumerate([1e12, -3e12, 5e14, 2.0, 0.0, 7e13])]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows), components=1).collect()}
    deviation, white, _ = plain([v for _, v in rows], 1)
    assert {i: r.deviation for i, r in got.items()} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
    assert np.allclose(np.abs([got[i].whitened for i in range(6)]), np.abs(white[:, 0]), rtol=1e-9)
    whitening.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])).collect()


def test_partitioning_does_not_matter(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    one, two = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-12
