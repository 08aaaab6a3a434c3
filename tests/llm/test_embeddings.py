import numpy as np
import pytest

from tracksmith.llm import embeddings


def brute(ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        after = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (after == label).all():
            break
        label = after
    return {i: (int(near[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}


def near_copies(rng, groups, each, noise, dim=32):
    seeds = rng.normal(size=(groups, dim))
    return np.concatenate([s + noise * rng.normal(size=(each, dim)) for s in seeds])


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_SIZE", 60)
    rng = np.random.default_rng(2)
    x = np.concatenate([near_copies(rng, 20, 10, 0.15), near_copies(rng, 30, 3, 0.3), rng.normal(size=(300, 32))]).astype(np.float32)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    want = brute(ids, x.astype(float))
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    found, total = sum(got[i].n_links for i in ids), sum(w[0] for w in want.values())
    assert 0.9 * total <= found <= total
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert np.mean([got[i].component_id == want[i][1] for i in ids]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0])]
    got = sorted(tuple(r)[:3] for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id IS NOT NULL").collect())
    linked = {1: (3, 1), 2: (3, 1), 11: (3, 1)}
    assert got == sorted((i, *linked.get(i, (0, i))) for i, _ in rows if i is not None)


def test_empty_table(spark):
    assert embeddings.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_table_distances_bound_true_ones():
    rng = np.random.default_rng(3)
    x = embeddings.unit(rng.normal(size=(500, 30)))
    q = embeddings.Quantizer(x, 8, 0.9)
    home = embeddings.nearest(x, q.centroids)
    members = np.flatnonzero(home == home[0])
    codes, own, error = q.encode(x[members], home[members])
    true = np.sqrt(((x[:, None] - x[None, members]) ** 2).sum(2))
    table = np.sqrt(np.maximum(q.table_distances(x, int(home[0]), codes, own), 0))
    assert (np.abs(true - table) <= error[None, :] + 1e-3).all()


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_quantizer_dimensions(dim):
    x = embeddings.unit(np.random.default_rng(dim).normal(size=(300, dim)))
    q = embeddings.Quantizer(x, 4, 0.9)
    assert q.parts * q.width >= dim and 1 <= q.probes <= 4
