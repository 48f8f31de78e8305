"""Token counts by the table of distinct words against the tokenizer on whole texts."""

import pytest
from ferrule.operators import tokens
from ferrule.sources.commits import Store

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "  \n\t x", "It's we'll I'd 'round", "naïve café — 中文 text 123456 12.5e3!!", "a" * 5000, " " * 2000 + "b", "tabs\t\tand\r\n\r\nlines  ", "the cat the cat the cat", "emoji 👍🏽  nbsp  em"]


@pytest.fixture
def ranks():
    return tokens.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_counts(spark, tmp_path, ranks):
    store, encoding = Store(spark, f"file://{tmp_path}/s"), ranks.load()
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    got = {r.id: r.n_tokens for r in tokens.counts(texts, store, ranks).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)}
    assert tokens.learn(store, "words", texts, ranks) == 0  # nothing new
    more = spark.createDataFrame([(1, "the cat"), (2, "unheard word")], "id long, text string")
    assert {r.id: r.n_tokens for r in tokens.counted(store, "words", more, ranks).collect()} == {1: 2, 2: None}
    assert tokens.learn(store, "words", more, ranks) >= 1
    assert {r.id: r.n_tokens for r in tokens.counted(store, "words", more, ranks).collect()} == {1: 2, 2: len(encoding.encode_ordinary("unheard word"))}


def test_frequent_words_are_not_shuffled(spark, tmp_path, ranks, monkeypatch):
    """Two frequent words are counted where the texts are, rare ones by the table; counts are those of whole texts either way."""
    from .test_indexes import shuffled

    store, encoding = Store(spark, f"file://{tmp_path}/s"), ranks.load()
    texts = [(i, "".join(f" w{j}" for j in range(200)) + f" own{i}") for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3).cache()
    tokens.learn(store, "words", rows, ranks)
    want = {i: len(encoding.encode_ordinary(t)) for i, t in texts}
    got = {}
    assert shuffled(spark, lambda: got.update((r.id, r.n_tokens) for r in tokens.counted(store, "words", rows, ranks).collect())) < 60 * 20
    assert got == want
    monkeypatch.setattr(tokens, "HOT_WORDS", 2)
    assert {r.id: r.n_tokens for r in tokens.counted(store, "words", rows, ranks).collect()} == want


def test_estimates_without_a_tokenizer(spark):
    texts = spark.createDataFrame([(1, "abcde"), (2, None), (3, "x")], "id long, text string")
    assert sorted(map(tuple, tokens.counts(texts).collect())) == [(1, 2), (2, 0), (3, 1)]


def test_whole_tables(spark, small, ranks):
    from ferrule.plans import indexes

    encoding = ranks.load()
    docs = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in indexes.token_counts(spark, small).collect()} == docs
    rows = indexes.qa_budget_tokens(spark, small).collect()
    assert rows and all(r.question_budget <= 150 and r.question_budget + r.answer_budget == 500 for r in rows)
    assert any(r.question_budget != r.estimated_question for r in rows)
