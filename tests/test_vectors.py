"""Neighbours, settled groups and density clusters against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import density, graphs, neighbours, vectors

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score double, key long"


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 8))
    x = np.concatenate([c + 0.25 * r.normal(size=(40, 8)) for c in centres] + [r.normal(size=(30, 8))])
    x[7] = x[5]
    x[100:110] = x[99]
    return x.astype(np.float32)


def frame(spark, x, odd=True):
    rows = [(i, [float(y) for y in v], i % 2, None if i % 17 == 0 else float(i * 7 % 50), 1) for i, v in enumerate(x)]
    if odd:
        rows += [(1000, None, 0, 1.0, 1), (1001, [0.0] * x.shape[1], 0, 1.0, 1), (1002, [float("nan")] * x.shape[1], 1, None, 1), (1003, [None] * x.shape[1], 1, 9.0, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def unit(x):
    x = x.astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gaps(x):
    u = unit(x)
    d = np.round(np.sqrt(np.maximum(2 - 2 * u @ u.T, 0)), 9)
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("rows", [2000, 30])
def test_nearest(spark, cloud, rows):
    at = neighbours.cells(frame(spark, cloud), "vec_id", "embedding", rows)
    got = {(r["key"], r["other"]): r["distance"] for r in neighbours.nearest(at, 4).collect()}
    d = gaps(cloud)
    want = {(i, int(j)): d[i, j] for i in range(len(d)) for j in np.lexsort((np.arange(len(d)), d[i]))[:4]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


@pytest.mark.parametrize("rows", [2000, 30])
def test_links_within(spark, cloud, rows):
    at = neighbours.cells(frame(spark, cloud), "vec_id", "embedding", rows)
    got = {r["id"]: r["component"] for r in graphs.components(neighbours.links_within(at, 0.5)).collect()}
    d = gaps(cloud) <= 0.5
    least = np.arange(len(d))
    for _ in range(len(d)):
        least = np.array([min([least[i], *least[np.flatnonzero(d[i])]]) for i in range(len(d))])
    assert {i: got.get(i, i) for i in range(len(d))} == dict(enumerate(least.tolist()))


def test_spanning_forest(spark, cloud):
    d = gaps(cloud[:60])
    edges = [(i, j, float(d[i, j])) for i in range(60) for j in range(i + 1, 60) if (i < 40) == (j < 40)]
    got = graphs.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert {(r["a"], r["b"], r["w"]) for r in got} == want and len(want) == 58
    assert graphs.spanning_forest(spark.createDataFrame([], "a long, b long, w double")).collect() == []


def plain_groups(rows, threshold):
    out = {}
    for label in {r[2] for r in rows}:
        groups = []
        for key, v, _, _, _ in sorted((r for r in rows if r[2] == label), key=lambda r: (r[3] is None, -(r[3] or 0), r[0])):
            x = None if v is None or None in v else np.array(v, float)
            if x is None or not np.isfinite(x).all() or not np.linalg.norm(x):
                out[key] = key
                continue
            x = x / np.linalg.norm(x)
            near = [s @ x / np.linalg.norm(s) for s, _ in groups]
            best = int(np.argmax(near)) if near else -1
            if best >= 0 and near[best] >= threshold:
                groups[best] = (groups[best][0] + x, groups[best][1])
            else:
                groups.append((x, key))
                best = -1
            out[key] = groups[best][1]
    return out


@pytest.mark.parametrize("threshold, at_once", [(0.92, 20_000), (0.92, 7), (0.8, 50)])
def test_settled_groups(spark, cloud, threshold, at_once):
    df = frame(spark, cloud)
    got = {r["vec_id"]: r["founder"] for r in vectors.settled_groups(df, threshold, at_once=at_once).collect()}
    want = plain_groups([tuple(r) for r in df.collect()], threshold)
    assert got == want and len(set(want.values())) < len(want) - 50


def test_settled_groups_of_nothing(spark):
    assert vectors.settled_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.nearest(neighbours.cells(spark.createDataFrame([], SCHEMA), "vec_id", "embedding"), 3).collect() == [] and F is not None


def plain_clusters(x, k, least, levels):
    """Single linkage of the neighbour graph, cut at the same steps, cluster by cluster."""
    d = gaps(x)
    n = len(d)
    order = [np.lexsort((np.arange(n), d[i]))[:k] for i in range(n)]
    core = np.array([d[i, order[i][-1]] for i in range(n)])
    edges = sorted({(max(d[min(i, j), max(i, j)], core[i], core[j]), min(i, j), max(i, j)) for i in range(n) for j in map(int, order[i])})
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    tree = []
    for w, a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            tree.append((w, a, b))
    low, high = min(w for w, _, _ in tree if w > 0), max(tree)[0]
    at = [low * (high / low) ** (i / levels) for i in range(levels + 1)]
    level = lambda w: 0 if w <= low else levels if w >= high else min(levels, max(0, int(np.ceil(np.log(w / low) / np.log(high / low) * levels))))
    stages = []
    for s in range(levels + 1):
        group = list(range(n))
        for w, a, b in tree:
            if level(w) <= s:
                ra, rb = group[a], group[b]
                group = [min(ra, rb) if g in (ra, rb) else g for g in group]
        stages.append([frozenset(i for i in range(n) if group[i] == g) for g in sorted(set(group))])

    def grow(s, members):
        """(stability of the run that ends here, kept clusters below, their stability, largest set) of a component at step s."""
        gain = len(members) * (1 / at[s] - (1 / at[s + 1] if s < levels else 0.0))
        below = [grow(s - 1, m) for m in stages[s - 1] if m <= members and len(m) >= least] if s else []
        if len(below) == 1:
            stab, kept, inside, _ = below[0]
            return stab + gain, kept, inside, members
        kept, inside = [], 0.0
        for stab, own, of, largest in below:
            kept += [largest] if stab >= of else own
            inside += max(stab, of)
        return gain, kept, inside, members

    out = [-1] * n
    for members in stages[-1]:
        if len(members) >= least:
            _, kept, inside, largest = grow(levels, members)
            for c in [largest] if not inside else kept:
                for i in c:
                    out[i] = min(c)
    return dict(enumerate(out))


@pytest.mark.parametrize("rows, levels", [(60, 5)])
def test_density_clusters(spark, cloud, rows, levels):
    got = {r["vec_id"]: r["cluster"] for r in density.clusters(frame(spark, cloud), 5, 10, levels, rows=rows).collect()}
    assert {got.pop(i) for i in range(1000, 1004)} == {-1}
    want = plain_clusters(cloud, 5, 10, levels)
    assert got == want and len(set(want.values())) > 4 and -1 in want.values()


def test_density_of_embeddings(spark):
    """The given vectors, whole, at the query's own settings."""
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    got = {r["vec_id"]: r["cluster"] for r in density.clusters(e, 5, 8, 3).collect()}
    ids = [r["vec_id"] for r in rows]
    want = plain_clusters(np.array([r["embedding"] for r in rows], np.float32), 5, 8, 3)
    assert got == {ids[i]: (ids[c] if c >= 0 else -1) for i, c in want.items()}


def test_density_of_nothing(spark):
    assert density.clusters(spark.createDataFrame([], SCHEMA)).collect() == []


def test_movement_by_quarter(spark):
    rows = [(1, 2020, 1, "a  b", True), (1, 2020, 1, "A b", False), (1, 2019, 4, None, None), (-1, 2020, 1, "x", True)]
    got = density.movement_by_quarter(spark.createDataFrame(rows, "cluster long, year int, quarter int, text string, moves boolean")).collect()
    assert sorted((r["year"], r["n"], r["n_texts"], r["movement_rate"], r["first_quarter"], r["last_quarter"]) for r in got) == [(2019, 1, 0, 0.0, "Q4 2019", "Q1 2020"), (2020, 2, 1, 0.5, "Q4 2019", "Q1 2020")]
