import hashlib
import re

import numpy as np
import pytest
from ferrule.operators import answers, gate, ingest, memory, predicates, prompt, reduce, retrieval
from ferrule.sources import files
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_where(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, None, False)], "id int, s string, f boolean")
    pick = lambda spec: [r.id for r in predicates.apply_where(df, spec).orderBy("id").collect()]
    assert pick({}) == pick(None) == [1, 2, 3]
    assert pick({"s": "a"}) == [1] and pick({"s": "a", "f": False}) == []
    assert pick({"$or": [{"s": "a"}, {"s": "b"}], "f": False}) == [1, 2]
    assert pick({"$and": [{"f": False}, {"$or": [{"s": "a"}, {"id": 3}]}]}) == [3]
    assert pick({"gone": 1}) == [] and pick({"s": None}) == [1, 2, 3]
    with pytest.raises(ValueError):
        pick({"$gt": 1})


def test_manifest_diff(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert rows(ingest.manifest_diff(before, now)) == [("a", "unchanged", "1"), ("b", "changed", "9"), ("c", "removed", "3"), ("d", "new", "4")]


def test_upsert_last_wins(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "p", 1), (2, "q", 2), (3, "r", 1)], "id int, v string, seq int")
    assert rows(ingest.upsert(stored, new, "id")) == [(1, "x"), (2, "q"), (3, "r")]
    assert rows(ingest.delete_where(stored, {})) == [(1, "x"), (2, "y")]
    assert rows(ingest.delete_where(stored, {"v": "x"})) == [(2, "y")]


def plain_rrf(a, b, wa=1.0, wb=1.0, k=60):
    score = {}
    for side, w in ((a, wa), (b, wb)):
        for i, x in enumerate(side, 1):
            score[x] = score.get(x, 0) + w / (k + i)
    return [(i, pytest.approx(s)) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))]


@pytest.mark.parametrize(("a", "b", "wb"), [([1, 2, 3], [3, 4], 1.0), ([1], [], 1.0), ([], [2], 1.0), ([2, 1], [1, 2], 1.0), ([5, 6], [7], 0.0)])
def test_rrf(spark, a, b, wb):
    side = lambda ids: spark.createDataFrame([(x, 1.0 / i, i) for i, x in enumerate(ids, 1)], "id int, score double, rank long")
    got = [(r.id, r.rrf_score) for r in retrieval.rrf(side(a), side(b), 1.0, wb).collect()]
    assert got == plain_rrf(a, b, 1.0, wb)
    assert len(retrieval.rrf(side(a), side(b), 1.0, wb, top_k=1).collect()) == min(1, len(set(a + b)))


def test_floor_is_after_the_limit(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, score double")
    assert rows(retrieval.floor(df), "id") == [(1,)] and retrieval.floor(df, 0).count() == 2


def test_missing_candidates(spark):
    have, want = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError):
        retrieval.require_all(want, have)
    retrieval.require_all(have, want)


def test_direct_recall_order(spark):
    recs = spark.createDataFrame([(1, "a", 5, "Green", "k"), (2, "b", 1, "Gold", "k"), (3, "c", 9, "Black", "k"), (4, "d", 1, "Black", "z")], "file_id int, record_id string, ordinal int, tag string, key string")
    keys = spark.createDataFrame([("k",), ("z",)], "key string")
    assert rows(memory.direct_recall(recs, keys, "key"), "key", "record_id") == [("k", "b")]


def test_parent_scores(spark):
    hits = spark.createDataFrame([("r", "question", 0.5), ("r", "question", 0.7), ("r", "odd", 0.1), (" ", "answer", 1.0)], "record_id string, role string, score double")
    assert rows(memory.parent_scores(hits)) == [("r", 0.7, None, 0.1, 3)]


def test_clean_brief(spark):
    recs = spark.createDataFrame([(1, "a", 1, "Green", "x", ["a"]), (1, "b", 2, "Black", "y", []), (1, "c", 3, "Green", "z", ["c", "b"])], "file_id int, record_id string, ordinal int, tag string, brief string, contributors array<string>")
    assert rows(memory.clean_brief(recs)) == [(1, "a", "x")]
    assert rows(memory.latest_brief(recs)) == [(1, "c", "z")]


def test_overlay_ignores_blank_tags(spark):
    log = spark.createDataFrame([("a", "Green"), ("b", "Green")], "record_id string, tag string")
    edits = spark.createDataFrame([("a", " "), ("b", "Gold"), ("x", "Gold")], "record_id string, tag string")
    assert rows(memory.overlay(log, edits, ["tag"])) == [("a", "Green", False), ("b", "Gold", True)]


@pytest.mark.parametrize(("t", "tier", "n"), [(0, "broad", None), (1199, "tight", 1), (1200, "narrow", 2), (1799, "narrow", 2), (1800, "medium", 3), (2599, "medium", 3), (2600, "broad", None)])
def test_budget_tier(spark, t, tier, n):
    assert tuple(spark.range(1).select(*gate.budget_tier(F.lit(t))).head()) == (tier, n)


def test_decisions(spark):
    states = spark.createDataFrame([("WEAK", "IRRELEVANT"), ("STRONG", "SAME_TOPIC")], "materiality string, relation string")
    assert rows(gate.decide(states), "relation", "prompt_mode", "memory_allowed") == [("IRRELEVANT", "none", False), ("SAME_TOPIC", "full_activebrief", True)]
    with pytest.raises(Exception, match="unknown state"):
        gate.decide(spark.createDataFrame([("ODD", "X")], "materiality string, relation string")).collect()


def test_sections(spark):
    text = "lost\n# One\nbody 1\n\n## Two\n### Three\nbody 3\n#### Four"
    got = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").select(prompt.sections(F.col("t"))).collect()
    assert [(s.level, s.title, s.body) for s in got[0][0]] == [(1, "One", "body 1"), (2, "Two", ""), (3, "Three", "body 3"), (3, "# Four", "")]
    assert got[1][0] == [] and got[2][0] == []


def test_preprocess(spark):
    names = spark.createDataFrame([("task", "task", 0), ("Aufgabe", "task", 1), ("context", "context", 0), ("tone", "tone", 0)], "name string, canonical string, priority int")
    prompts = spark.createDataFrame([(1, "# Aufgabe\nfirst\n# TASK\nlast\n# odd\nx"), (2, "no headings"), (3, "# Context\nonly this")], "prompt_id int, text string")
    got = {(r.prompt_id, r.name): r.body for r in prompt.preprocess(prompts, names, {"tone": "neutral"}).collect()}
    assert got == {(1, "task"): "last", (1, "tone"): "neutral", (2, "task"): "no headings", (3, "task"): "only this", (3, "tone"): "neutral"}


def test_keep_within_skips(spark):
    got = spark.createDataFrame([(["aaaa", "b" * 40, "cccc"],)], "s array<string>").select(reduce.keep_within(F.col("s"), 3)).head()[0]
    assert got == ["aaaa", "cccc"]


def test_reduce_text_skips_redundant():
    vectors = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    assert reduce.reduce_text(["aaaa", "bbbb", "cccc"], [[0], [1], [2]], vectors, np.array([1.0, 0.2]), 10) == [1, 2]
    assert reduce.reduce_text(["a" * 100], [[0]], vectors[:1], np.array([1.0, 0.0]), 5) == []
    assert reduce.reduce_text([], [], vectors[:0], np.array([1.0]), 5) == []


def test_blocks():
    text = " ".join(["w"] * 300) + "\n\n" + " ".join(["v"] * 300) + "\n \n" + " ".join(["u"] * 1700)
    got = reduce.text_blocks(text)
    assert [b["n_words"] for b in got] == [600, 800, 800, 100]
    assert all(text[b["start"]] == b["text"][0] and text[b["end"] - 1] == b["text"][-1] for b in got)
    assert reduce.text_blocks(None) == reduce.text_blocks(" \n ") == []


def test_clean_chunk(spark):
    texts = ["---\ntitle: x\n---\n\nTags: a\nkept\n\n\n```py\nalso\n@@meta y\n## END_OF_PROMPT", "---\nnever closed", "a\r\n\r\n \r\nb\r---\rdate : x", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(reduce.clean_chunk(F.col("t"))).collect()
    assert [r[0] for r in got] == ["kept\n\nalso", "", "a\n\nb\n---", "", ""]


def plain_vector(text, size):
    out = np.zeros(size)
    for w in re.findall("[a-z0-9]+", text.lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size] += 1
    return out


def plain_sentences(text):
    return [x for x in (y.strip() for y in re.split(r"(?<=[.!?])\s+|\n+", text)) if x]


def plain_windows(n):
    return [list(range(i, min(i + 3, n))) for i in range(0, max(n - 1, 1), 2)] if n else []


def plain_reduced(sents, windows, vectors, anchor, budget):
    """Windows one by one, by cosine; sums and comparisons by hand."""
    cost = lambda t: -(-len(t) // 4)
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else 0.0
    if cost(" ".join(sents)) <= budget:
        return sents
    if budget <= 0:
        return []
    left, taken = budget, []
    ranked = sorted(range(len(windows)), key=lambda i: (-round(cosine(vectors[i], anchor), 12), i))
    for i in ranked:
        c = cost(" ".join(sents[j] for j in windows[i]))
        if c <= left and all(cosine(vectors[i], vectors[t]) < 0.92 for t in taken):
            taken, left = [*taken, i], left - c
    out, left = [], budget
    for j in sorted({j for i in taken or ranked[:1] for j in windows[i]}):
        if cost(sents[j]) <= left:
            out, left = [*out, sents[j]], left - cost(sents[j])
    return out


def test_reduce_pairs(spark):
    """Against a plain version: one-sentence, long, repeating, empty and null texts."""
    long = " ".join(f"Topic {i % 5} has {'word ' * (i % 7)}number {i}." for i in range(30))
    recs = [("a", "Short one?", long), ("b", long, "Yes. No."), ("c", "Same line. " * 40, long), ("d", "", "An answer."), ("e", None, None), ("f", "!!! ???", long)]
    got = {r.record_id: (r.question, r.answer) for r in reduce.reduce_pairs(spark.createDataFrame(recs, "record_id string, input_text string, output_text string"), 60, 20).collect()}
    for key, q, a in recs:
        sents = [plain_sentences(x or "") for x in (q, a)]
        places = [plain_windows(len(s)) for s in sents]
        vectors = [[plain_vector(" ".join(s[j] for j in w), reduce.SIZE) for w in p] for s, p in zip(sents, places, strict=True)]
        anchor = np.mean(vectors[0] + vectors[1], axis=0) if vectors[0] + vectors[1] else np.zeros(reduce.SIZE)
        cost = [-(-len(x or "") // 4) for x in (q, a)]
        first = min(round(60 * cost[0] / max(sum(cost), 1)), 20) or (20 if cost[0] else 0)
        want = [" ".join(plain_reduced(s, p, v, anchor, b)) for s, p, v, b in zip(sents, places, vectors, (first, 60 - first), strict=True)]
        assert got[key] == tuple(want), key


def test_sources(spark, tmp_path):
    (tmp_path / "p" / "deep").mkdir(parents=True)
    (tmp_path / "p" / "a.txt").write_bytes("grün".encode())
    (tmp_path / "p" / "deep" / "b.md").write_bytes("grün".encode("latin-1"))
    got = files.read_folder(spark, f"file://{tmp_path}/p").orderBy("path").collect()
    assert [r.text for r in got] == ["grün", "grün"] and got[0].size == 5
    store = f"file://{tmp_path}/store"
    assert files.current(spark, store, "id int").count() == 0
    files.publish(spark.createDataFrame([(1,)], "id int"), store)
    files.publish(spark.createDataFrame([(1,), (2,)], "id int"), store)
    assert files.current(spark, store).count() == 2
    assert spark.read.parquet(files.snapshot(spark, store, "s1")).count() == 2
    assert files.read_manifest(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "m.json").write_text('{"version":"1","files":[{"path":"a","sha256":"s","mtime":1.5,"size":3}]}')
    assert rows(files.read_manifest(spark, f"file://{tmp_path}/m.json")) == [("a", "s", 1.5, 3)]


def test_record_log(spark, tmp_path):
    recs = spark.createDataFrame([("r1", "q\n1", "a")], "record_id string, input_text string, output_text string")
    files.append_records(recs, f"file://{tmp_path}/log")
    with open(tmp_path / "log" / "part-x.txt", "w") as f:
        f.write(f"{files.START}\nnot json\n{files.END}\n")
    assert rows(files.read_records(spark, f"file://{tmp_path}/log"), "record_id", "input_text") == [("r1", "q\n1")]


def test_publish_survives_a_crash(spark, tmp_path, monkeypatch):
    """A crash after the rows and before the marker leaves the version before current; the next try loses nothing."""
    from ferrule.sources import files

    root = f"file://{tmp_path}/store"
    assert files.current(spark, root, "x int").count() == 0
    files.publish(spark.createDataFrame([(1,)], "x int"), root)
    with monkeypatch.context() as m:
        m.setattr(files, "published", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            files.publish(spark.createDataFrame([(2,)], "x int"), root)
    assert [r.x for r in files.current(spark, root, "x int").collect()] == [1]
    files.publish(spark.createDataFrame([(2,)], "x int"), root)
    assert [r.x for r in files.current(spark, root).collect()] == [2] and len(files.published(spark, root)) == 2
    with pytest.raises(FileNotFoundError):
        files.current(spark, f"{root}-none")


def test_stream_store(spark, tmp_path):
    """The last row of a key counts, over deltas and a compacted base; a delta that wasn't finished isn't read."""
    from ferrule.streaming import ingest as streaming

    schema, source, store = "doc_id long, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/store"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.ingest_stream(spark, source, schema, store, f"file://{tmp_path}/check").awaitTermination()
        return sorted(tuple(r) for r in streaming.stored(spark, store, schema).collect())

    assert arrive((1, "a"), (2, "b")) == [(1, "a"), (2, "b")]
    assert arrive((2, "c"), (3, None)) == [(1, "a"), (2, "c"), (3, None)]
    streaming.compact(spark, store, keep=1)
    assert len(list((tmp_path / "store").glob("rows-*"))) == 1
    assert arrive((1, "d"), (1, "c"), (1, "cc")) == [(1, "d"), (2, "c"), (3, None)]  # of several the greatest
    spark.createDataFrame([(9, "half")], schema).write.parquet(f"{store}/rows-half")
    again = spark.createDataFrame([(1, "run again")], schema)
    streaming._take(again, 2, store, "doc_id", None, f"file://{tmp_path}/check")
    assert sorted(tuple(r) for r in streaming.stored(spark, store, schema).collect()) == [(1, "d"), (2, "c"), (3, None)]
    streaming._take(again.union(again), 3, store, "doc_id", None, f"file://{tmp_path}/check")
    assert sorted(tuple(r) for r in streaming.stored(spark, store, schema).collect()) == [(1, "run again"), (2, "c"), (3, None)]


def test_last_of_a_batch_by_order(spark, tmp_path):
    from ferrule.streaming import ingest as streaming

    schema, store = "k long, at int, v string", f"file://{tmp_path}/store"
    batch = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (2, 1, "x"), (2, 1, "y"), (None, 1, "n"), (None, 3, "m")], schema).repartition(4)
    streaming._take(batch, 0, store, "k", ["at"], "s")
    assert {r.k: r.v for r in streaming.stored(spark, store, schema).collect()} == {None: "m", 1: "a", 2: "y"}


def test_publishers_at_once(spark, tmp_path):
    """Every publisher gets a version of its own; one that was computed from an older version fails."""
    import threading

    root, one = f"file://{tmp_path}/store", lambda x: spark.createDataFrame([(x,)], "x int")
    threads = [threading.Thread(target=lambda i=i: files.publish(one(i), root)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert files.published(spark, root) == [f"{i:012d}" for i in range(5)]
    files.publish(one(9), root, after=4)
    with pytest.raises(files.Conflict):
        files.publish(one(10), root, after=4)
    assert [r.x for r in files.current(spark, root).collect()] == [9]
    assert len(files.remove_versions(spark, root, keep=1)) == 5 and [r.x for r in files.current(spark, root).collect()] == [9]
    files.publish(one(11), root)
    assert [r.x for r in files.current(spark, root).collect()] == [11]


def test_evidence_and_labels(spark):
    from ferrule.operators import gate, prompt, render

    rows = spark.createDataFrame([(2, "b", "# head\n---\nx"), (1, None, "one")], "pos int, source string, text string")
    assert render.evidence_xml(rows, source=True).head().xml == (
        '<evidence_chunks>\n  <chunk rank="1" chunk_id="1" source="">\n    <chunk_text>\n      one\n    </chunk_text>\n  </chunk>\n'
        '  <chunk rank="2" chunk_id="2" source="b">\n    <chunk_text>\n      [H1] head\n      [RULE]\n      x\n    </chunk_text>\n  </chunk>\n</evidence_chunks>'
    )
    gated = spark.createDataFrame([(1, "useful"), (2, "borderline")], "id long, label string")
    assert gate.empty_selection(gated).count() == 0 and gate.empty_selection(gated.where("id = 2")).head().reason == "a3_selected_zero_useful_chunks"
    none = F.lit(None).cast("string")
    assert spark.range(1).select(prompt.context_block(none, none, none, none, none, none, F.lit("raw"), F.lit("a5"))).head()[0] == ""


def test_catalogs_and_fields():
    from ferrule.operators import answers

    block = {"options": [{"id": "a", "label": "A", "description": "d"}, "odd", {"label": "no id"}], "default": "a", "max_selected": 3}
    assert answers.block_of({"tone": block}, "tone") is block and answers.block_of(block, "tone") is block and answers.block_of({"other": block, "x": 1}, "tone") is block
    with pytest.raises(KeyError):
        answers.block_of({"a": block, "b": block}, "tone")
    assert answers.field_config(block) == {"allowed": ["a"], "default": "a", "most": 3, "many": True, "labels": {"a": "A"}, "descriptions": {"a": "d"}}
    assert not answers.field_config({"options": [{"id": "a"}], "cardinality": "one", "max_selected": 5})["many"]
    assert not answers.field_config({"options": None, "max_selected": "x"})["many"]


def test_answers_of_odd_shapes(spark):
    from ferrule.operators import answers

    field = {"tags": answers.field_config({"options": [{"id": "a"}, {"id": "b"}], "cardinality": "many", "default": None})}
    said = spark.createDataFrame([('{"tags": "b"}',), ('{"tags": ["x", "b", "b"]}',), ('{"tags": {}}',), (None,)], "a string")
    assert [r[0] for r in said.select(answers.selected(F.col("a"), field)["tags"]).collect()] == [["b"], ["b"], ["a", "b"], ["a", "b"]]
    items = spark.createDataFrame([(1, '{"item_decisions": "none"}'), (2, '{"item_decisions": [{"chunk_id": 7, "tags": "a"}, {"chunk_id": " "}, 5]}'), (3, None)], "id int, answer string")
    one = {"tags": answers.field_config({"options": [{"id": "a"}, {"id": "b"}], "default": "b"})}
    assert rows(answers.classified(items, "id", one)) == [(2, "7", "a")]


def test_keyword_union_and_contributors(spark):
    got = spark.createDataFrame([(1, 2, ["B", "c"]), (1, 1, ["b", " "]), (2, 1, None), (2, 2, ["é", "É"])], "k int, o int, keywords array<string>")
    assert rows(memory.keyword_union(got, "k", "o")) == [(1, ["b", "c"]), (2, ["é"])]
    ids = spark.createDataFrame([(["a", " "], ["A", "a", "b"]), (None, None)], "x array<string>, y array<string>")
    assert [r[0] for r in ids.select(memory.contributors(F.col("x"), F.col("y"))).collect()] == [["a", "A", "b"], []]


def test_sinks(spark, tmp_path):
    files.write_metainfo(spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, ids string"), f"file://{tmp_path}/meta")
    files.write_metainfo(spark.createDataFrame([(1, "c")], "file_id int, ids string"), f"file://{tmp_path}/meta")
    assert rows(spark.read.json(f"file://{tmp_path}/meta"), "file_id", "ids") == [(1, "c")]
    files.write_jsonl(spark.createDataFrame([("ü", None)], "a string, b string"), f"file://{tmp_path}/l")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/l").collect()] == ['{"a":"ü"}']


def test_many_pieces_meet_the_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)))], "id int, vector array<double>")
    drawn = rng.normal(size=(25, 6)).tolist()
    pieces = spark.createDataFrame([(v,) for v in [*drawn, [0.0] * 6] + [drawn[0]] * 12], "vector array<double>")
    whole = dict(map(tuple, retrieval.dense_scores(stored, pieces).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_PIECES", 5)
    monkeypatch.setattr(retrieval, "BLOCK_PIECES", 4)
    assert dict(map(tuple, retrieval.dense_scores(stored, pieces).collect())) == pytest.approx(whole)
    assert len(whole) == 40


def test_agent_messages(spark):
    with pytest.raises(ValueError, match="a"):
        prompt.agent_messages({}, [{"id": "a", "required": True}], {})
    none = F.lit(None).cast("string")
    rows = spark.range(1).select(*prompt.agent_messages({"Only": "x"}, [{"id": " "}, {"id": "a"}, {"id": "b", "prompt_text": "B"}], {"a": none}, order=["ID:a", "decision_targets"]))
    assert tuple(rows.first()) == ("## Only\nx", "B")


def test_targets_text():
    fields = {"f": {"allowed": ["p", "q"], "labels": {"p": " P "}, "descriptions": {"p": "first", "q": ""}}}
    assert answers.targets_text([{"id": "f"}, {}], fields) == "Field 'f' (JSON key: 'f')\n- Select exactly one option id.\n  * p: P — first\n  * q"
