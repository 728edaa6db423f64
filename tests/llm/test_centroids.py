import hashlib

import numpy as np
import pytest

from quillmesh.llm import centroid_clustering as K

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string"


def lloyd(rows, k, rounds, seed=K.SEED):
    """Plain Python over (vec_id, x)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[1]))
    c = [list(r[1]) for r in order[:k]]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min(range(len(c)), key=lambda i: (square(x, c[i]), i))
    for _ in range(rounds):
        at = [nearest(x) for _, x in rows]
        for i in range(len(c)):
            own = [x for (_, x), a in zip(rows, at) if a == i]
            if own:
                c[i] = [sum(v) // len(own) for v in zip(*own)]
    at = [nearest(x) for _, x in rows]
    return [(v, a, square(x, c[a]), c[a]) for (v, x), a in zip(rows, at)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3)


def check(spark, rows, k, rounds):
    found = K.clustered(vectors(spark, rows), k, rounds)
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in K.measured(found).collect())
    want = lloyd(rows, k, rounds)
    inertia = {a: sum(d for _, b, d, _ in want if b == a) for _, a, _, _ in want}
    assert got == sorted((v, a, d, inertia[a], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, a, d, c in want)
    return found


@pytest.mark.parametrize("k, dims, spread", [(8, 4, 3), (9, 2, 1), (1, 3, 5), (2, 3, 5), (16, 5, 200), (5, 3, K.RANGE - 1)])
def test_equals_plain_rounds(spark, k, dims, spread):
    r = np.random.default_rng(k)
    rows = [(i // 2 if i < 20 else i, [int(v) for v in r.integers(-spread, spread + 1, dims)]) for i in range(150)]
    check(spark, rows + rows[:10], k, 10)


def test_bounds_save_distances(spark):
    r = np.random.default_rng(1)
    middles = r.integers(-5000, 5000, (32, 8))
    rows = [(i, [int(v) for v in middles[i % 32] + r.integers(-60, 60, 8)]) for i in range(960)]
    found = check(spark, rows, 32, 10)
    assert found.looked[0] == 960 * 32 and sum(found.looked[1:]) < 0.15 * 9 * 960 * 32 and max(found.looked[3:]) < 0.02 * 960 * 32


def test_bounds_never_lie():
    r = np.random.default_rng(3)
    x, c = r.integers(-40, 40, (400, 3)), r.integers(-40, 40, (12, 3))
    s = K.Bounds(*K.scanned(x, c, 3))
    for step in range(12):
        new = c + r.integers(-4, 5, c.shape) * (r.random(12) < 0.4)[:, None]
        s = K.advanced(x, s, new, np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9), 3 - step // 5)
        c, d = new, K.squares(x, new)
        assert (s.cluster == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (s.upper >= root[np.arange(400), s.cluster] - 1e-6).all()
        assert (s.lower <= np.take_along_axis(root, s.near, 1) + 1e-6).all()
        others = np.ones(root.shape, bool)
        np.put_along_axis(others, np.column_stack([s.cluster, s.near]), False, 1)
        assert (s.rest <= np.where(others, root, np.inf).min(1) + 1e-6).all()


def test_what_takes_no_part(spark):
    ok = [0.5] * 64
    rows = [(1, ok, 0, 5, "x"), (2, None, 0, 5, "x"), (3, [], 0, 5, "x"), (4, ok[:63], 0, 5, "x"), (5, ok[:63] + [None], 0, 5, "x"), (6, ok[:63] + [float("nan")], 0, 5, "x"), (7, ok[:63] + [float("-inf")], 0, 5, "x")]
    rows += [(8, ok + ok, 0, 5, "x"), (9, ok[:63] + [1e30], 0, 5, "x"), (None, ok, None, None, None), (1, ok, 0, 5, "x"), (10, [-0.3] * 64, 0, 5, "x")]
    found = K.scaled(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vec_id or 0, r.x[0]) for r in found.collect()) == [(0, 512), (1, 512), (1, 512), (10, -308)]
    assert [r.distance for r in K.measured(K.clustered(found)).collect()] == [0] * 4


def test_empty_table(spark):
    rows = K.measured(K.clustered(K.scaled(spark.createDataFrame([], SCHEMA))))
    assert rows.collect() == [] and rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
