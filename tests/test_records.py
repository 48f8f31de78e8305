"""Forms of records, edits, orders and texts on odd rows."""

import json
import re
import unicodedata

import pytest
from ferrule.functions import text as fn
from ferrule.operators import memory, render, retrieval
from pyspark.sql import functions as F


def test_norm_key_of_compatible_forms(spark):
    keys = ["Ｔａｓｋ：", "ﬁnal  Report!", "①st", "Außer-halb", "  ÉTÉ x ", "éte", "Ⅳ_a", "plain Key?", "", None, "中文，键", "½ cup"]
    plain = lambda s: None if s is None else re.sub(r"[^\w\s]+", "", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).lower().strip()))
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string").select("i", fn.norm_key(F.col("k"))).orderBy("i").collect()
    assert [r[1] for r in rows] == list(map(plain, keys))


def test_hydrate_valid(spark):
    asked = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "a", -1), (5, "a", None), (6, " ", 0), (7, None, 0), (8, "none", 0), (9, "b", 0)], "rank int, path string, chunk_idx long")
    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (" ", 0, "blank")], "path string, chunk_idx long, chunk string")
    assert sorted((r.rank, r.chunk) for r in retrieval.hydrate_valid(asked, chunks).collect()) == [(1, "x"), (2, "y"), (9, "z")]


FIELDS = "record_id string, tag string, user_keywords array<string>, retrieval_source_mode string, direct_recall_key string"


def test_sync_edits(spark):
    own = spark.createDataFrame([("a", "Green", ["k"], "QA", "x"), ("b", "Gold", ["k"], "Q", ""), ("c", "Black", None, "A", "y")], FIELDS)
    edits = spark.createDataFrame([(" a ", "Black", None, "q", None), ("b", "Mauve", [], "Q", " "), ("zz", "Gold", ["n"], "A", "n"), (None, "Gold", ["n"], "A", "n")], FIELDS)
    got = {r.record_id: r[1:] for r in memory.sync_edits(own, edits).collect()}
    assert got == {"a": ("Black", ["k"], "Q", "", True), "b": ("Gold", [], "Q", "", True), "c": ("Black", None, "A", "y", False)}
    same = spark.createDataFrame([("b", "Gold", None, " q", None)], FIELDS)
    assert {r.record_id: r.changed for r in memory.sync_edits(own, same).collect()} == {"a": False, "b": False, "c": False}


def test_record_forms_and_index_rows(spark):
    rows = spark.createDataFrame([("r", None, "in", None, ["w"])], "record_id string, tag string, input_text string, parent_id string, user_keywords array<string>")
    full = memory.record_form(rows, memory.FULL_FIELDS).head().asDict()
    assert list(full) == memory.FULL_FIELDS and full["tag"] == "Green" and full["retrieval_source_mode"] == "QA" and full["parent_id"] is None and full["output_text"] == ""
    assert full["user_keywords"] == ["w"] and full["auto_keywords"] == [] and memory.record_form(rows, memory.INDEX_FIELDS).columns == memory.INDEX_FIELDS
    texts = ['["a", "b"]', '["a"', "{}", "", None, "7"]
    coded = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, user_keywords string")
    got = [r.user_keywords for r in memory.index_rows(coded).orderBy("i").collect()]
    assert got[0] == ["a", "b"] and got[2:] == [[]] * 4 and got[1] in ([], ["a"])


def test_packs_and_reasons(spark):
    asked = spark.createDataFrame([(1, 5, "q"), (2, None, "q"), (3, 5, " "), (4, None, None), (5, 9, "q")], "request_id int, file_id long, query string")
    pack = spark.createDataFrame([(5, "working", "r", 1)], "file_id long, slot string, record_id string, pos long")
    assert sorted(map(tuple, memory.pack_or_reason(asked, pack).collect())) == [(1, None, "working", "r", 1), (2, "no_active_file", None, None, None), (3, "empty_query", None, None, None), (4, "no_active_file", None, None, None)]


def test_chunk_order(spark):
    row = "prompt_id int, id string, pos int"
    base = spark.createDataFrame([(p, i, n) for p in range(1, 7) for n, i in enumerate("abc")], row)
    final = spark.createDataFrame([(1, "c", 0), (2, "c", 1), (2, "a", 2), (3, "b", 0), (3, "x", 1)], row)
    views = spark.createDataFrame([(1, "a3", "b", 0), (1, "a3", "a", 1), (2, "a2", "b", 0), (4, "a2", "c", 0), (4, "a2", "x", 1), (4, "a2", "b", 2), (5, "a3", "b", 0), (6, "a3", "x", 0)], "prompt_id int, stage string, id string, pos int")
    asked = spark.createDataFrame([(1, "a3"), (2, "a2"), (3, "a3"), (4, "a2"), (5, "a4"), (6, "a3")], "prompt_id int, stage string")
    out = {}
    for r in render.chunk_order(asked, views, final, base).orderBy("prompt_id", "pos").collect():
        out.setdefault(r.prompt_id, []).append(r.id)
    assert out == {1: ["b", "a"], 2: ["c", "a"], 3: ["b"], 4: ["c", "b"], 5: ["a", "b", "c"]}  # the view of 6 has no base chunk


def test_memory_evidence(spark):
    episodes = spark.createDataFrame([(1, 2, "r2", " ", None, "0.5", "q2", " "), (1, 1, "r1", "Gold", "gold", None, "q1", "a1")], "file_id int, pos int, record_id string, tag string, source string, score string, input_text string, output_text string")
    chunks = spark.createDataFrame([(1, 1, "v", "r1", "answer", None, " t "), (2, 1, "w", None, None, None, "u")], "file_id int, pos int, vector_id string, record_id string, role string, score string, text string")
    got = {r.file_id: r.text for r in render.memory_evidence(episodes, chunks).collect()}
    assert got[1] == (
        "## Reduced Episodic Memory Episodes\n\n### Episode 1\nrecord_id: r1\ntag: Gold\nsource: gold\n\nQUESTION:\nq1\n\nANSWER:\na1\n\n### Episode 2\nrecord_id: r2\nscore: 0.5\n\nQUESTION:\nq2"
        "\n\n## Semantic Memory Chunks\n\n### Semantic Chunk 1\nvector_id: v\nrecord_id: r1\nrole: answer\n\nTEXT:\nt"
    )
    assert got[2] == "## Semantic Memory Chunks\n\n### Semantic Chunk 1\nvector_id: w\n\nTEXT:\nu"


def test_diagnostics(spark):
    rows = spark.createDataFrame([(1, {"n": "3"}, None), (2, {}, None)], "i int, a map<string,string>, b map<string,string>")
    got = {r[0]: r[1] for r in rows.select("i", render.diagnostics_json(F.col("a"), F.col("b"))).collect()}
    assert got[2] is None and got[1].startswith("```json\n{") and json.loads(got[1][8:-4]) == {"selection_diagnostics": {"n": "3"}, "memory_synthesis_diagnostics": {}}


@pytest.mark.parametrize(("given", "want"), [("qa", "QA"), (" a ", "A"), ("Q", "Q"), ("both", "QA"), ("", "QA"), (None, "QA")])
def test_clean_mode(spark, given, want):
    assert spark.createDataFrame([(given,)], "m string").select(fn.clean_mode(F.col("m"))).head()[0] == want


def test_schema_from_a_file(spark, tmp_path):
    from ferrule.functions import schema
    from ferrule.operators import prompt

    own = {"canonical_keys": ["task", "tone"], "must_keys": ["task", "tone", "new"], "defaults": {"tone": "calm"}, "aliases": {"Wish!": "task", "x": "nowhere"}, "bilingual": {"de": {"Ton": "tone"}, "fr": None}}
    (tmp_path / "s.json").write_text(json.dumps(own, indent=1))
    names, must = schema.load(spark, f"file://{tmp_path}/s.json")
    assert must == {"tone": "calm", "new": ""} and names.count() == 4
    titles = spark.createDataFrame([("wish",), ("TON",), ("Tone:",), ("x",)], "title string")
    assert {r.title: r.canonical for r in prompt.resolve_headers(titles, names).collect()} == {"wish": "task", "TON": "tone", "Tone:": "tone", "x": None}
    (tmp_path / "s.json").write_text("[]")
    with pytest.raises(ValueError, match="JSON object"):
        schema.load(spark, f"file://{tmp_path}/s.json")


def test_sinks_are_written(spark, tmp_path):
    from ferrule.sources import files

    sinks = spark.createDataFrame([("a", ["x"], [1]), ("b", ["x", "y"], [1, 2])], "sink string, types array<string>, levels array<int>")
    for part in ([("x", 1, "m1")], [("y", 2, "m2"), ("z", 1, "m3")]):
        files.write_sinks(spark.createDataFrame(part, "type string, level int, message string"), sinks, f"file://{tmp_path}/log")
    got = spark.read.json(f"file://{tmp_path}/log")
    assert sorted((r.sink, r.message) for r in got.collect()) == [("a", "m1"), ("b", "m1"), ("b", "m2")]
