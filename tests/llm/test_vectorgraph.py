"""Links and components of vectors against a comparison of all pairs."""

import math

import numpy as np
import pytest
from ferrule.llm import vectorgraph as g


def plain_links(rows, least=0.95):
    """n_links and component_id of rows (vec_id, vector), by row."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, label = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and len(v) == len(w):
                a, b = (np.array(z, float) / max(map(abs, z)) for z in (v, w))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    label[root(i)] = root(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    least_id = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [(k, n[i], least_id[root(i)], k is not None and k == least_id[root(i)]) for i, (k, _) in enumerate(rows)]


def made(seed=1, size=12):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=size) for _ in range(150)]
    for base in rng.normal(size=(4, size)):
        rows += [base * rng.uniform(0.1, 9) + 0.09 * np.linalg.norm(base) / size**0.5 * rng.normal(size=size) for _ in range(60)]
    step = rng.normal(size=(2, size))
    rows += [step[0] * math.cos(t) + step[1] * math.sin(t) for t in np.arange(0, 3, 0.2)]  # a chain
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(10_000), rows, strict=False)]
    rows += [(20_000 + i, rows[5][1]) for i in range(7)] + [(3, rows[200][1]), (3, rows[200][1]), (None, rows[200][1]), (None, [9.0] + [0.0] * (size - 1))]
    odd = [None, [], [0.0] * size, [-0.0] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0], [2.0, 4.0], [1e300] * size, [1e-300] * size, [5.0]]
    return rows + [(30_000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("cell", "shard", "queries"), [(1_500, 6_000, 20_000), (40, 6_000, 20_000), (40, 50, 30)])
def test_links(spark, monkeypatch, cell, shard, queries):
    for name, value in (("CELL", cell), ("SHARD", shard), ("QUERIES", queries)):
        monkeypatch.setattr(g, name, value)
    rows = made()
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = sorted((tuple(r) for r in g.linked(table).collect()), key=repr)
    want = sorted(plain_links(rows), key=repr)
    if cell == 1_500:
        assert got == want
    else:  # many small cells: an index, which may miss a link, but never makes one
        assert [r[0] for r in got] == [r[0] for r in want]
        assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.03 * len(rows)


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert g.linked(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in g.linked(spark.createDataFrame([(1, None, 0), (2, [0.0], 1)], schema)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_over_a_whole_table(spark):
    """Over all vectors of check-like density: tight groups among scattered ones; all of them asked, against all pairs."""
    rng = np.random.default_rng(7)
    scattered, heads = rng.normal(size=(3_000, 64)), rng.normal(size=(12, 64))
    groups = [h + 0.12 * rng.normal(size=(n, 64)) for h, n in zip(heads, (900, *[40] * 11), strict=True)]
    x = g.unit(np.concatenate([scattered, *groups]))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in g.linked(table).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(got.values()) >= 0.99 * near.sum()


def test_audit_notices_lost_links(spark):
    x = [[1.0, 0.01 * i] for i in range(5)]
    nodes = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "node long, v array<double>, copies long")
    whole = spark.createDataFrame([(i, 4) for i in range(5)], "node long, found long")
    assert g.audit(nodes, whole, 0.95) == 1.0
    assert g.audit(nodes, whole.limit(3), 0.95) == pytest.approx(0.6)


def test_every_node_is_reached():
    rng = np.random.default_rng(2)
    x = g.unit(np.concatenate([rng.normal(size=(300, 16)), *(h + 0.01 * rng.normal(size=(80, 16)) for h in rng.normal(size=(5, 16)))]))
    lists, start = g.built(x)
    met, front = {start}, [start]
    while front:
        front = [j for i in front for j in lists[i].tolist() if j not in met and not met.add(j)]
    assert len(met) == len(x)


def test_matches_sql(spark, small):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = g.op13_vector_dedup(spark, small)
    assert got.columns == [d[0] for d in c.execute(g.ORACLE_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(g.ORACLE_SQL).fetchall())
