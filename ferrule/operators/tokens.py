"""Token counts of a rank-file tokenizer: a stored table of distinct words and their counts, joined to the words of texts.

A text's tokens are those of the words that the tokenizer's pattern cuts it into, and a word's count never changes, so
every distinct word is encoded once, when it is first met. Texts are cut by Spark with the same pattern. Where no
tokenizer is given, a count is a quarter of the characters, rounded up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..sources.commits import Change, Store

WORDS = "word string, n int"
#: Words that go to all tasks, and the texts that tell which are frequent.
HOT_WORDS, HOT_TEXTS = 100_000, 5_000


@dataclass(frozen=True)
class Ranks:
    """A tokenizer: the path of its rank file, which all workers can read, and the pattern that it cuts texts by."""

    path: str
    pattern: str

    def load(self):
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: Column, ranks: Ranks) -> Column:
    """The words of a text, white space included, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U)({ranks.pattern})"), 1)


def learn(store: Store, name: str, texts: DataFrame, ranks: Ranks, text: str = "text") -> int:
    """Put the words of texts that the table doesn't have yet into it; their number."""
    met = texts.select(F.explode(F.array_distinct(pieces(F.col(text), ranks))).alias("word")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = ranks.load()
        for batch in batches:
            n = [len(x) for x in encoding.encode_ordinary_batch(batch.column("word").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n, pa.int32())], names=["word", "n"])

    def apply(change: Change) -> None:
        known = change.state.get(name)
        new = met if known is None else met.join(store.rows(known).select("word"), "word", "left_anti")
        change.upsert(name, new.mapInArrow(count, WORDS), "word")  # words learnt twice at once have the same counts

    number = store.change(apply)
    return store.head(number)[1][name]["parts"][-1]["n"]


def _hot(store: Store, name: str, texts: DataFrame, ranks: Ranks, text: str) -> DataFrame:
    """Learnt words that go to all tasks: the whole table if it is small, else those most frequent in some texts. Which words these are changes no count."""
    table, held = store.read(name, schema=WORDS), store.head()[1].get(name)
    if held is None or sum(p["n"] for p in held["parts"]) <= HOT_WORDS:
        return F.broadcast(table)
    met = texts.limit(HOT_TEXTS).select(F.explode(pieces(F.col(text), ranks)).alias("word")).groupBy("word").count()
    return F.broadcast(table.join(F.broadcast(met.orderBy(F.desc("count"), "word").limit(HOT_WORDS).select("word")), "word"))


def counted(store: Store, name: str, texts: DataFrame, ranks: Ranks, key: str = "id", text: str = "text") -> DataFrame:
    """key, n_tokens of texts whose words were learnt; keys are unique. A text with a word that wasn't learnt has null.

    Frequent words are counted where the text is; only a text's other words are shuffled, to meet the table.
    """
    hot = _hot(store, name, texts, ranks, text).withColumnRenamed("n", "hot_")
    own = texts.select(key, F.explode_outer(pieces(F.col(text), ranks)).alias("word")).join(hot, "word", "left")
    rare = F.when(F.col("hot_").isNull(), F.col("word")).alias("word")
    own = own.groupBy(key, rare).agg(F.sum("hot_").alias("hot_"), F.count("*").alias("times"))
    salt = F.when(F.col("word").isNull(), F.xxhash64(key)).otherwise(0)  # rows without a rare word don't meet in one task
    table = store.read(name, schema=WORDS).withColumn("salt_", F.lit(0).cast("long"))
    known = own.withColumn("salt_", salt).join(table, ["word", "salt_"], "left")
    n = F.when(F.col("word").isNull(), F.coalesce("hot_", F.lit(0))).otherwise(F.col("times") * F.col("n"))
    return known.groupBy(key).agg(F.when(F.count("*") == F.count(n), F.sum(n).cast("long")).alias("n_tokens"))


def counts(texts: DataFrame, store: Store | None = None, ranks: Ranks | None = None, name: str = "words", key: str = "id", text: str = "text") -> DataFrame:
    """key, n_tokens: real counts with a tokenizer, whose table learns what it doesn't know; estimates without one."""
    if store is None or ranks is None:
        return texts.select(key, token_estimate(F.col(text)).cast("long").alias("n_tokens"))
    learn(store, name, texts, ranks, text)
    return counted(store, name, texts, ranks, key, text)
