"""Stored indexes against plain scoring of everything."""

import hashlib
import re

import numpy as np
import pytest
from ferrule.operators import dense_index, late_interaction, sparse_index
from ferrule.sources.commits import Store
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def plain_nearest(rows, queries, k):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    out = []
    for q, v in queries:
        score = np.round(x @ np.array(v) / ((np.linalg.norm(x, axis=1) + 1e-12) * (np.linalg.norm(v) + 1e-12)), 12)
        out += [(q, rank, ids[i], score[i]) for rank, i in enumerate(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], 1)]
    return sorted(out)


def near(got, want):
    got = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-9)


def made(n=300, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 3 * rng.normal(size=(6, dims))[rng.integers(0, 6, n)]
    x[10], x[11] = x[5], x[5]  # ties
    return [(f"v{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)]


SCHEMA = "id string, vector array<double>, label int"


@pytest.mark.parametrize("sizes", [None, (0, 40, 7)])
def test_dense_index_is_exact_with_all_cells(spark, store, monkeypatch, sizes):
    for name, value in zip(("BROADCAST_QUERIES", "PART_ROWS", "QUERY_ROWS"), sizes or (), strict=False):
        monkeypatch.setattr(dense_index, name, value)
    rows = made()
    table = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)] + [(None, rows[0][1], 0), ("none", None, 0)], SCHEMA)
    dense_index.build(table, store, "t", cells=12)
    asked = [(i, v) for i, (_, v) in enumerate(rows[:30])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    near(dense_index.search(store, "t", queries, 5), plain_nearest(rows, asked, 5))
    near(dense_index.search(store, "t", queries, 5, spec={"label": 1}), plain_nearest(rows[1::3], asked, 5))
    near(dense_index.search(store, "t", queries, 5, spec={"$or": [{"label": 1}, {"id": "v000"}]}), plain_nearest([rows[0], *rows[1::3]], asked, 5))
    few = dense_index.search(store, "t", queries, 5, probes=2)
    best = {(q, i) for q, _, i, _ in plain_nearest(rows, asked, 5)}
    found = {(r.query_id, r.id) for r in few.collect()}
    assert len(found & best) >= 0.6 * len(best) and all(s.query_id in range(30) for s in few.collect())
    assert dense_index.search(store, "t", queries.limit(0), 5).count() == 0


def test_dense_index_reads_the_probed_cells_only(spark, store):
    rows = made()
    dense_index.build(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), store, "t", cells=12)
    one = spark.createDataFrame([(0, rows[7][1])], "query_id long, vector array<double>")
    found = dense_index.search(store, "t", one, 3, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan) and "ReadSchema: struct<id:string,vector:array<double>>" in plan
    assert found.orderBy("rank").first().id == rows[7][0]


def test_dense_index_upserts(spark, store):
    rows = made()
    dense_index.build(spark.createDataFrame([(*r, 0) for r in rows[:200]], SCHEMA), store, "t", cells=9)
    flipped = [(i, [-x for x in v]) for i, v in rows[:20]]
    dense_index.add(store, "t", spark.createDataFrame([(*r, 0) for r in flipped + rows[200:]], SCHEMA))
    asked = [(i, v) for i, (_, v) in enumerate(rows[190:210])]
    near(dense_index.search(store, "t", spark.createDataFrame(asked, "query_id long, vector array<double>"), 4), plain_nearest(flipped + rows[20:], asked, 4))
    store.compact("t")
    near(dense_index.search(store, "t", spark.createDataFrame(asked, "query_id long, vector array<double>"), 4), plain_nearest(flipped + rows[20:], asked, 4))


def test_large_searches_give_back_few_rows_for_each_cell(spark, store, monkeypatch):
    """Cells beyond a query's nearest give back only rows that reach the k-th best found in those, and the result is the exact one."""
    monkeypatch.setattr(dense_index, "BROADCAST_QUERIES", 0)
    rng = np.random.default_rng(3)
    middles = 5 * rng.normal(size=(12, 4))
    rows = [(f"v{i:03d}", (middles[i % 12] + rng.normal(size=4)).tolist()) for i in range(600)]
    dense_index.build(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), store, "t", cells=12)
    asked = [(i, v) for i, (_, v) in enumerate(rows[:40])]
    queries, seen, plain = spark.createDataFrame(asked, "query_id long, vector array<double>"), [], dense_index._large
    monkeypatch.setattr(dense_index, "_large", lambda *a: seen.append(plain(*a)) or seen[-1])
    near(dense_index.search(store, "t", queries, 5), plain_nearest(rows, asked, 5))
    assert seen[0].count() < 40 * 5 * 5  # 12 cells of 5 each, if none was left out


def test_recall_over_a_whole_table(spark, small):
    """Every vector whose id is divisible by 20, a hundred nearest, against all rows."""
    from ferrule.plans import indexes

    store, asked = indexes.dense_store(spark, small), indexes.asked(spark, small)
    rows = [(r.id, list(r.vector)) for r in indexes.vectors(spark, small).collect()]
    want = {(q, i) for q, _, i, _ in plain_nearest(rows, [(r.query_id, list(r.vector)) for r in asked.collect()], 100)}
    got = {(r.query_id, r.id) for r in indexes.ivf_topk(spark, small).collect()}
    assert len(got & want) >= 0.9 * len(want)
    measured = {r.k: (r.probes, r.recall) for r in store.read("cells_probes").collect()}
    assert measured[10][0] <= measured[100][0] < len(dense_index.centroids(store, "cells")) and min(r for _, r in measured.values()) >= 0.95
    assert dense_index.probes_for(store, "cells", 50) == measured[100][0]


def test_dense_index_of_nothing(spark, store):
    dense_index.build(spark.createDataFrame([], SCHEMA), store, "t")
    assert dense_index.search(store, "t", spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>"), 3).count() == 0
    with pytest.raises(Exception, match="one length"):
        dense_index.build(spark.createDataFrame([("a", [1.0], 0), ("b", [1.0, 2.0], 0)], SCHEMA), store, "u")


# ---- sparse


def plain_scores(rows, query, n_pieces, k=None):
    weight = {}
    for i, t, w, *_ in rows:
        if i is not None and t is not None and w is not None:
            weight[i, t] = weight.get((i, t), 0.0) + w
    asked, dots = {}, {}
    for p, t, w in query:
        asked[p, t] = asked.get((p, t), 0.0) + w
    for (p, t), w in asked.items():
        for (i, u), v in weight.items():
            if t == u:
                dots[i, p] = dots.get((i, p), 0.0) + w * v
    total = {}
    for (i, _), d in dots.items():
        total[i] = total.get(i, 0.0) + max(d, 0.0) ** 10
    scores = [(i, round((s / n_pieces) ** 0.1, 6)) for i, s in total.items()]
    return [(i, s, rank) for rank, (i, s) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0]))[:k], 1)]


POSTING, QUERY = "id string, term string, weight double, lang string", "piece long, term string, weight double"


def postings(seed, n=400, terms=25):
    rng = np.random.default_rng(seed)
    rows = [(f"d{i:04d}", f"t{t}", round(float(rng.pareto(1.2)) + 0.01, 3), "de" if i % 4 else "en") for i in range(n) for t in range(terms) if rng.random() < 0.9 / (1 + t)]
    return [*rows, *rows[:5], (None, "t0", 9.0, "de"), ("d0001", None, 9.0, "de"), ("d0002", "t3", 0.0, "de"), ("d0002", "t4", None, "de"), ("dx", "t0", 0.5, None)]


@pytest.mark.parametrize(("seed", "block", "hot", "listed"), [(1, 512, 65_536, 2_000), (2, 16, 65_536, 2_000), (3, 8, 50, 1)])
def test_sparse_index(spark, store, monkeypatch, seed, block, hot, listed):
    monkeypatch.setattr(sparse_index, "BLOCK", block)
    monkeypatch.setattr(sparse_index, "MOST_LISTED", listed)
    monkeypatch.setattr(sparse_index, "HOT", hot)
    rows = postings(seed)
    sparse_index.build(spark.createDataFrame(rows, POSTING), store, "p", by=("lang",))
    ask = [(0, "t0", 1.5), (0, "t5", 2.0), (1, "t2", 0.7), (1, "t0", 0.1), (2, "nowhere", 3.0), (1, "t2", 0.3), (0, None, 4.0)]
    query = spark.createDataFrame(ask, QUERY)
    for k in (3, 50, 10_000):
        assert sorted(map(tuple, sparse_index.search(store, "p", query, k).collect()), key=lambda r: r[2]) == plain_scores(rows, ask[:-1], 3, k)
    english = [r for r in rows if r[3] == "en"]
    assert sorted(map(tuple, sparse_index.search(store, "p", query, 9, {"lang": "en"}).collect()), key=lambda r: r[2]) == plain_scores(english, ask[:-1], 3, 9)
    assert sparse_index.search(store, "p", query, 9, {"source": "x"}).count() == 0
    some = spark.createDataFrame([("d0004",), ("d0008",), ("d0008",), ("none",)], "id string")
    chosen = sorted((r.id, round(r.score, 6)) for r in sparse_index.scores(store, "p", query, candidates=some).collect())
    assert chosen == sorted((i, s) for i, s, _ in plain_scores([r for r in rows if r[0] in ("d0004", "d0008")], ask[:-1], 3))
    with pytest.raises(ValueError, match="equalities"):
        sparse_index.search(store, "p", query, 9, {"$or": []})


def test_sparse_search_stops_early_and_stays_exact(spark, store, monkeypatch):
    """Few heavy postings decide the top k: a part of the blocks is read, and only candidates are completed."""
    monkeypatch.setattr(sparse_index, "BLOCK", 10)
    rows = [(f"d{i:04d}", f"t{t}", 50.0 - i if i < 20 else 0.01 + i / 10_000, "de") for i in range(600) for t in range(3)]
    sparse_index.build(spark.createDataFrame(rows, POSTING), store, "p")
    calls, plain = [], sparse_index.Request.sums
    monkeypatch.setattr(sparse_index.Request, "sums", lambda self, bars=None, only=None: calls.append((bars is not None, only is not None)) or plain(self, bars, only))
    ask = [(0, "t0", 1.0), (0, "t1", 0.5), (1, "t2", 1.0)]
    got = sorted(map(tuple, sparse_index.search(store, "p", spark.createDataFrame(ask, QUERY), 5).collect()), key=lambda r: r[2])
    assert got == plain_scores(rows, ask, 2, 5)
    assert calls[-1] == (False, True)  # only candidates were completed


def test_sparse_vectors_with_negative_weights(spark, store):
    rows = [("a", "t", -2.0, "x"), ("b", "t", 3.0, "x"), ("c", "u", 5.0, "x"), ("b", "u", -4.0, "x")]
    sparse_index.build(spark.createDataFrame(rows, POSTING), store, "p")
    ask = [(0, "t", 1.0), (0, "u", 0.5)]
    assert sorted(map(tuple, sparse_index.search(store, "p", spark.createDataFrame(ask, QUERY), 5).collect()), key=lambda r: r[2]) == plain_scores(rows, ask, 1, 5)


def test_sparse_index_reads_the_asked_terms_only(spark, store):
    sparse_index.build(spark.createDataFrame(postings(1), POSTING), store, "p", by=("lang",))
    plan = sparse_index.scores(store, "p", spark.createDataFrame([(0, "t3", 1.0)], QUERY))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert sparse_index.scores(store, "p", spark.createDataFrame([], QUERY)).count() == 0
    sparse_index.build(spark.createDataFrame([], POSTING), store, "none")
    assert sparse_index.search(store, "none", spark.createDataFrame([(0, "t3", 1.0)], QUERY), 3).count() == 0


def shuffled(spark, build):
    """Records that tasks wrote to shuffles while an index was built."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    known = {s.stageId() for s in stages(sc)}
    build()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteRecords() for s in stages(sc) if s.stageId() not in known)


def stages(sc):
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [listed.apply(i) for i in range(listed.size())]


def test_indexes_are_built_without_shuffling_postings_or_matrices(spark, store, small):
    from ferrule.plans import retrieval

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    terms = lambda: retrieval.terms(docs, "doc_id", "lang")
    assert shuffled(spark, lambda: sparse_index.build(terms(), store, "p", by=("lang",))) < n
    assert shuffled(spark, lambda: late_interaction.build(docs.select(F.col("doc_id").alias("id"), "text"), store, "m")) < n
    blocks = store.read("p")
    assert blocks.select(F.sum(F.size("postings"))).head()[0] == terms().count() and store.read("m").count() == n


def test_blocks_are_cut_heaviest_first_in_lots(spark, store, monkeypatch):
    monkeypatch.setattr(sparse_index, "BLOCK", 4)
    monkeypatch.setattr(sparse_index, "HOT", 30)
    rows = [(f"d{i}", f"t{i % 3}", float(i % 7 + 1), "de" if i % 2 else None) for i in range(100)]
    sparse_index.build(spark.createDataFrame(rows, POSTING).coalesce(1), store, "p", by=("lang",))
    got = []
    for r in store.read("p").collect():
        weights = [-p.minus for p in r.postings]
        assert weights == sorted(weights, reverse=True) and (r.greatest, r.least) == (weights[0], weights[-1]) and len(weights) <= 4
        assert r.lang_values == sorted({p.lang for p in r.postings} - {None})
        got += [(p.id, r.term, -p.minus, p.lang) for p in r.postings]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


# ---- token matrices


def test_late_interaction(spark, store):
    texts = [(1, "The cat sat, the CAT sat"), (2, ""), (3, None), (4, "dogs and cats"), (5, "cat"), (None, "cat")]
    late_interaction.build(spark.createDataFrame(texts, "id long, text string"), store, "m")
    pieces = [("p", "cat cat dog"), ("q", "...")]

    def plain(piece, text):
        v = lambda w: np.frombuffer(hashlib.md5(w.encode()).digest(), np.uint8) - 127.5
        cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
        words = re.findall("[a-z0-9]+", text.lower())
        return sum(max(cos(v(a), v(b)) for b in words) for a in re.findall("[a-z0-9]+", piece.lower()))

    asked = spark.createDataFrame(pieces, "piece string, text string")
    band = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (9,)], "id long")
    scores = lambda b: {(r.id, r.piece): r.score for r in late_interaction.max_sim(store, "m", asked, b).collect()}
    want = {(i, p): plain(q, t) for i, t in ((1, texts[0][1]), (4, "dogs and cats")) for p, q in pieces}
    assert scores(band) == pytest.approx(want) and scores(band.limit(0)) == {}
    late_interaction.add(store, "m", spark.createDataFrame([(4, "dog")], "id long, text string"))
    assert scores(band)[4, "p"] == pytest.approx(plain("cat cat dog", "dog"))
    plan = late_interaction.max_sim(store, "m", asked, spark.createDataFrame([(5,)], "id long"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*id", plan)


def test_filter_column_types(spark, store):
    assert F.col("x") is not None  # labels that aren't texts are met by value
    sparse_index.build(spark.createDataFrame([("a", "t", 1.0, 3), ("b", "t", 2.0, 4)], "id string, term string, weight double, year int"), store, "p", by=("year",))
    assert [r.id for r in sparse_index.search(store, "p", spark.createDataFrame([(0, "t", 1.0)], QUERY), 5, {"year": 3}).collect()] == ["a"]
