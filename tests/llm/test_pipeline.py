"""The pipeline's stages against plain versions, each over all that its predecessor kept."""

from . import brute


def test_stages(spark, small):
    import corpus_pipeline as c
    from ferrule.llm.common import scratch
    from ferrule.llm.pieces import default_model

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns, before = docs.columns, docs.collect()
    for name, stage in c.STAGES:
        docs = scratch(stage(spark, docs, small), name)
        after = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert gone and sum(labels.get(i, 0) == 0 for i in gone) >= 0.9 * len(gone)
        elif name == "lines":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
        elif name == "near_copies":
            least = brute.classes([(r.doc_id, r.text) for r in before if len(r.text) < 3000])
            short = {r.doc_id for r in after if r.doc_id in least}
            assert short == set(least.values())
        elif name == "decontamination":
            clean = {r.doc_id for r, (_, n, _) in zip(before, brute.hits([r.text for r in before], bench), strict=True) if not n}
            assert {r.doc_id for r in after} == clean
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
            texts = {r.doc_id: r.text for r in before}
            assert all(r.exact and r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in after) and len(after) == len(before)
        before = after


def test_edge_cases(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, one long text, clashing names; and empty tables."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, n_lines long, score_ double, digest_ string, key string, bucket long, hit_spans string"
    extra = (1, 2, 0.5, "d", "k", 3, "h")
    good = [f"Line {i} of a text that says a thing or two about number {i * i}.\nAnother line, and one more sentence {i}." for i in range(12)]
    texts = [*good, None, "", "", " \n\t ", "word " * 60_000, good[3], good[3]]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), *extra) for i, t in enumerate(texts)]
    rows += [(3, good[3], "en", "s", len(good[3]), *extra), (None, good[5] + " x", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    labels = [(i, 1, 0) for i in range(12)] + [(13, 0, 0), (15, 0, 0), (None, 1, None), (2, None, None)]
    bench = [(1, "number 49: another line and one more sentence 7"), (2, None), (3, "")]
    for name, data, kind in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/full/{name}.parquet")
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = c.run(spark, f"{tmp_path}/full").collect()
    ids = [r.doc_id for r in got]
    assert all(r.exact for r in got) and {0, 3, 11} <= set(ids) and 7 not in ids and ids.count(3) == 1 and not {17, 18} & set(ids)
    assert c.run(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/alone/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/none/{name}.parquet").write.parquet(f"{tmp_path}/alone/{name}.parquet")
    kept = [r.doc_id for r in c.run(spark, f"{tmp_path}/alone").collect()]
    assert {0, 3, 7, 11, 16} <= set(kept)  # nothing is learnt, nothing is tested for: copies alone go


def test_columns_of_the_caller_pass_unchanged(spark, small):
    """Further columns named like what stages use, in any case: after each stage a row's values are those it came with."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    names = "row_no score_ n_lines N_Dropped Host Bad Digest_ id_ key_ Hit_items longest_MATCH n_words class_id stays kept root ids decoded_ aside".split()
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).coalesce(1)
    docs = docs.withColumn("row_no", F.monotonically_increasing_id().cast("string"))
    docs = docs.withColumns({n: F.concat(F.lit(n + " "), F.col("row_no")) for n in names[1:]})
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} {r.row_no}" for r in rows for n in names[1:]), name
    assert c.STAGES[-1][1](spark, docs, small).count() == len(rows)
