import math

import numpy as np
import pytest

from memspark.llm import covertree


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of every row, from all pairs."""
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.append(i)
    scaled = {i: np.array(rows[i][1], float) / max(map(abs, rows[i][1])) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in ok}
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near.get(i, [])), low, low == key))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def clustered(seed, n, dim, spreads):
    rng = np.random.default_rng(seed)
    out = []
    for c, spread in enumerate(spreads):
        center = rng.normal(size=dim)
        out += [center / np.linalg.norm(center) * (1 + c % 3) + rng.normal(size=dim) * spread / math.sqrt(dim) for _ in range(n)]
    return [out[i] for i in rng.permutation(len(out))]


SCHEMA = "vec_id long, embedding array<double>, label int, row string, n long, node long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize(("dim", "spreads"), [(3, [0.1, 0.5, 2.0]), (24, [0.02, 0.25, 0.4, 5.0]), (64, [0.01, 0.3])])
def test_traversal_finds_all_links(dim, spreads):
    x = np.array(clustered(dim, 60, dim, spreads))
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 4, len(x))
    cut = len(x) // 3

    def tree(part, w):
        u = covertree.units(part)
        order, center, first, radius = covertree.built(u, covertree.radii(0.93))
        for k in range(len(first)):  # levels are nested, covering, and their radii measured
            for i, c in enumerate(center[k]):
                own = u[order][first[k][i] : first[k][i + 1]]
                assert first[k][i] <= c < first[k][i + 1]
                assert covertree.apart(own @ u[order][c]).max() <= radius[k][i] + 1e-7
        return order, covertree.Tree(u[order], w[order], center, first, radius)

    (oa, a), (ob, b) = tree(x[:cut], weight[:cut]), tree(x[cut:], weight[cut:])
    linked = a.unit @ b.unit.T >= 0.93
    to_a, to_b, label = covertree.traverse(a, b, 0.93, False)
    assert (to_a == linked @ b.weight).all()
    assert (to_b == a.weight @ linked).all()
    i, j = np.nonzero(linked)
    assert (label[i] == label[j + cut]).all()
    assert len(set(label[(np.concatenate((to_a, to_b)) == 0)])) == ((to_a == 0).sum() + (to_b == 0).sum())
    own = b.unit @ b.unit.T >= 0.93
    np.fill_diagonal(own, False)
    both, _, label = covertree.traverse(b, b, 0.93, True)
    assert (both == own @ b.weight).all()
    assert all(label[i] == label[j] for i, j in zip(*np.nonzero(own), strict=True))


@pytest.mark.parametrize(("block", "fanout"), [(2048, 64), (40, 5)])
def test_links_and_components_equal_all_pairs(spark, block, fanout):
    vectors = clustered(5, 50, 8, [0.01, 0.2, 0.45, 3.0, 3.0])
    rows = [(1000 - 3 * i, list(map(float, v)), i % 2) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(45)]  # a copied vector
    rows += [(3000, [2 * x for x in rows[7][1]], rows[7][2]), (3001, rows[7][1], 1 - rows[7][2])]
    assert got(covertree.near_vectors(table(spark, rows), block=block, fanout=fanout)) == brute(rows)


def test_odd_vectors(spark):
    v, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (None, v, 0), (None, far, 0), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [0.0, 0.0, 0.0], 0)]
    rows += [(9, [1.0, None, 0.0], 0), (10, [1.0, float("nan"), 0.0], 0), (11, [float("inf"), 0.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [1e300, 0.0, 0.0], 0), (14, [1e-300, -0.0, 0.0], 0), (15, v, 1)]
    rows += [(16, [0.93, math.sqrt(1 - 0.93**2) * 1.001, 0.0], 2), (17, v, 2), (18, [0.93, math.sqrt(1 - 0.93**2) * 0.999, 0.0], 2)]
    expected = brute(rows)
    assert got(covertree.near_vectors(table(spark, rows))) == expected
    assert {r[0]: r[1] for r in expected}[17] == 1
    assert covertree.near_vectors(table(spark, [])).collect() == []
    assert got(covertree.near_vectors(table(spark, [(1, None, None), (2, [0.0], 3)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_ball_within_the_threshold_is_counted_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.01
    df = table(spark, [(i, list(map(float, v)), 0) for i, v in enumerate(x)])
    out = covertree.near_vectors(df, block=200, fanout=8)
    assert {(r["n_links"], r["component_id"]) for r in out.collect()} == {(2999, 0)}
