"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from ferrule.llm import collocations as c


def plain_phrases(rows, first, least):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, []
        inner = {(p[i:j], a) for p, a in cands.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}
        for p, a in cands.items():
            if (p, a) not in inner:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["the", "a", "Of", "élan", "中文", "x" * 300, "b-c", "d'e", "(f)", "42", " g", "h i"] + [f"w{i}" for i in range(30)]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(6)]
    apart = [" ", " ", "  ", "\t", " \t ", ". ", "! ", ",", ";", ":", "?", "\n", "\r\n", "\x0b", "\x0c"]
    texts = ["".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words)) + rng.choice(apart) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [(t, rng.choice(["en", "en", "de", None, "und", ""])) for t in texts]
    return [*rows, (None, "en"), ("", "fr"), (" \t\n.,", "es"), (None, None), ("the a " * 5000, "en"), ("the " * 300, "en"), *[("one and one only", "xx")] * 9]


@pytest.mark.parametrize(("seed", "chars"), [(1, 6_000_000), (2, 3_000), (3, 400)])
def test_phrases(spark, monkeypatch, seed, chars):
    monkeypatch.setattr(c, "RANGE_CHARS", chars)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    for first, least in ((2000, 9), (7, 3)):
        got = sorted(tuple(r) for r in c.collocations(docs, first, least).collect())
        assert got == plain_phrases(rows, first, least) and got


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert c.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_parts_of_a_trie_merge_to_the_whole():
    """Cut at any bounds, serialised and merged range by range, nodes and counts are those of all texts together."""
    texts = [t for t, _ in made(4)][:60]
    langs = [None if i % 3 else "en" for i in range(len(texts))]
    columns, names = c.paths(texts, langs)
    whole = c.Trie.of_positions(columns)
    plain = np.array(names.to_pylist(), object)
    bounds = sorted([bytes(plain[x - 1]) for x in whole.path[:, i] if x] for i in range(0, len(whole.depth), 97))
    bounds = sorted([*bounds, [b"en", b"no such word"], [b"zz"], [b""]])
    ranges = [[] for _ in range(len(bounds) + 1)]
    for a in range(0, 60, 13):
        part, own = c.paths(texts[a : a + 13], langs[a : a + 13])
        trie = c.Trie.of_positions(part)
        at = [0, *(trie.place(b, np.array(own.to_pylist(), object)) for b in bounds), len(trie.depth)]
        assert at == sorted(at)
        for r, lo, hi in zip(ranges, at, at[1:], strict=False):
            if lo < hi:
                r.append(trie.serial(lo, hi, own))
    named = lambda t, n, some: {tuple(n[int(x) - 1].as_py() for x in t.path[: t.depth[i], i]): int(t.count[i]) for i in some}
    merged = {}
    for r in filter(None, ranges):
        trie, own = c._merge(r)
        more = named(trie, own, np.flatnonzero(trie.count))
        assert not set(more) & set(merged)
        merged |= more
    assert merged == named(whole, names, range(len(whole.depth)))


def test_exact_scores(spark):
    """Products over 64 bits are exact."""
    from pyspark.sql import functions as F

    a, n, l, r = 10**12 + 7, 10**14 + 3, 3 * 10**12 + 1, 10**13 + 9
    exact = lambda v: F.lit(v).cast("decimal(17,0)")
    row = spark.range(1).select((F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n)).alias("top"), (exact(l) * exact(r)).alias("bottom")).select(F.expr("top div bottom")).head()
    assert row[0] == 1000 * a * n // (l * r)


def test_matches_sql(spark, small):
    import duckdb

    d = duckdb.connect()
    d.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = c.op12_collocations(spark, small)
    assert got.columns == [x[0] for x in d.execute(c.ORACLE_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(d.execute(c.ORACLE_SQL).fetchall())
