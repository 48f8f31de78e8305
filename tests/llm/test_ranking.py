"""Ranked search against plain scoring of every document."""

import math
from collections import Counter

import numpy as np
import pytest
from ferrule.llm import ranking
from ferrule.llm.common import texts

from . import brute

DOCS = [
    (1, "the cat sat on the mat. The CAT!"),
    (2, "a dog and a cat"),
    (3, None),
    (4, ""),
    (5, "... --- !!!"),
    (6, "a dog and a cat"),
    (6, "a dog and a cat"),
    (None, "a dog and a cat"),
    (None, "unique élan 42"),
    (9, "word " * 30_000 + "cat"),
    *((20 + i, "filler text about nothing " + "cat " * (i % 4) + "dog " * (i % 3)) for i in range(60)),
]
ITEMS = [(1, "Cat dog cat"), (2, None), (3, ""), (4, "élan 42 zebra"), (5, "zebra only"), (1, "mat"), (None, "the filler"), (7, "word unique")]


def plain_ranks(docs, items, k=10):
    bags = [Counter(brute.words(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag, n in zip(docs, bags, sizes, strict=True):
            score = 0
            for t in set(brute.words(text)):
                df, tf = sum(t in b for b in bags), bag[t]
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_words)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "postings"), [(4_000_000, 4_000_000), (10, 7)])
def test_ranks(spark, monkeypatch, block, postings):
    monkeypatch.setattr(ranking, "BLOCK_CHARS", block)
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", postings)
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, terms string, n int").repartition(3)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, rank int")
    got = ranking.search(texts(docs), items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranks(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search(texts(docs.limit(0)), items).count() == 0
    assert ranking.search(texts(docs), items.limit(0)).count() == 0


def test_early_stop_keeps_the_best(monkeypatch):
    """Any shard, request and bar: the best k of the documents found are those of full scores."""
    rng, stopped = np.random.default_rng(3), 0
    monkeypatch.setattr(ranking, "OPEN", 6)
    for _ in range(150):
        size, n_terms = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        full = rng.integers(0, 6, (size, n_terms)) ** 3 * (rng.random((size, n_terms)) < 0.5)
        doc, term = np.nonzero(np.ones_like(full))
        shard = ranking.Shard(size, doc, term, full[doc, term], n_terms)
        terms = rng.choice(n_terms, int(rng.integers(0, n_terms + 1)), replace=False)
        scores = full[:, terms].sum(axis=1)
        k, least = 4, int(rng.integers(0, 200))
        found, got = shard.best(terms, k, least)
        stopped += len(found) < np.count_nonzero(scores)
        assert (scores[found] == got).all()
        order = np.lexsort((np.arange(size), -scores))[:k]
        assert set(order[scores[order] >= max(least, 1)]) <= set(found)
    assert stopped > 50


def test_matches_sql(spark, small):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = ranking.op11_ranked_search(spark, small)
    assert got.columns == [d[0] for d in c.execute(ranking.ORACLE_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(ranking.ORACLE_SQL).fetchall())
