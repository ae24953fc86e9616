"""Whitening against numpy."""

import numpy as np

from jobtide.llm import whitening as wh

VECTOR = "vec_id long, embedding array<float>, x int"


def plain(vectors):
    """Deviations and components of the given vectors, up to sign."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int).astype(object) + 100_000
    n, s = len(x), x.sum(0)
    off = n * x - s
    c = (off / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    return (off**2).sum(1).tolist(), e[::-1], c @ u[:, ::-1]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 12)) @ np.diag(np.arange(1, 13) / 6)
    rows = [(i, v.tolist(), i) for i, v in enumerate(good)] + [(300, good[0].tolist(), 0), (0, good[1].tolist(), 0), (None, good[2].tolist(), 0)]
    bad = [(400, None, 0), (401, [], 0), (402, [float("nan")] + [0.0] * 11, 0), (403, [float("inf")] * 12, 0), (404, [None] + [1.0] * 11, 0), (405, [1.0] * 5, 0)]
    spark.createDataFrame(rows + bad, VECTOR).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = wh.op13_whitening(spark, str(tmp_path)).toPandas()
    deviation, e, z = plain([v for _, v, _ in rows])
    assert len(found) == 8 * len(rows) and set(found.n) == {len(rows)} and found.identity_error.max() < 1e-9
    known = sorted((-1 if i is None else i, d, k + 1, round(abs(z[r, k]) / e[k] ** 0.5, 8)) for r, ((i, _, _), d) in enumerate(zip(rows, deviation)) for k in range(8))
    assert sorted((-1 if r.vec_id != r.vec_id else int(r.vec_id), r.deviation, r.component, round(abs(r.whitened), 8)) for r in found.itertuples()) == known
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, e[:8] / e.sum(), rtol=1e-9)
    # One sign for all rows of a component.
    first = found[found.vec_id == 5].set_index("component").whitened
    assert all(np.sign(first[k] * z[5, k - 1]) == np.sign(found[(found.vec_id == 9) & (found.component == k)].whitened.iloc[0] * z[9, k - 1]) for k in range(1, 9))


def test_few_components(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(20)], VECTOR)
    found = wh.whiten(flat)
    assert len(found.eigenvalues) == 1 and found.rows.count() == 20 and abs(found.identity_error) < 1e-9
    assert wh.whiten(flat.limit(1)) is None and wh.whiten(flat.limit(0)) is None


def test_many_blocks(spark, monkeypatch):
    """Rows in several blocks, and several stretches of them."""
    monkeypatch.setattr(wh, "BLOCK", 8)
    monkeypatch.setattr(wh, "STRETCH", 2)
    rng = np.random.default_rng(4)
    good = rng.normal(size=(77, 4)).tolist()
    found = wh.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(good)], VECTOR).repartition(3), k=4)
    deviation, e, z = plain(good)
    rows = {r["id"]: r for r in found.rows.collect()}
    assert [rows[i]["deviation"] for i in range(77)] == deviation and np.allclose(found.eigenvalues, e)
    assert np.allclose(np.abs([rows[i]["z"] for i in range(77)]), np.abs(z / np.sqrt(e)))


def test_wide_deviations(spark):
    """What no long holds is null; a double's limit drops the row."""
    found = wh.whiten(spark.createDataFrame([(1, [4e12, 0.0], 0), (2, [-4e12, 1.0], 0), (3, [5e12, 1.0], 0)], "vec_id long, embedding array<double>, x int"))
    assert found.n == 2 and {r["deviation"] for r in found.rows.collect()} == {None}
