"""SentencePiece encoding and decoding over a table of distinct marked words.

No piece of the model has a whitespace marker after another character, so merges never cross the
start of a marked word; when a model is read, this is checked, and that ``PROBES`` come out as the
library has them, so that a model with other rules for white space or characters is an error. Each
Python worker keeps a table of the distinct marked words it has met, from task to task, segments and
decodes every one of them once, and joins ids and texts back by position with one vectorised gather.
The table is emptied at ``TABLE_WORDS`` entries: words met again are then segmented again, which
changes no result. The table is per worker on purpose: shuffling each block's distinct words to a
global table and their ids back would move more bytes than the texts have.

Null texts encode and decode like empty ones: no ids, an empty text. Rows are independent; repeated
rows, ties and extra columns change nothing (columns named like the outputs are replaced); an empty
table gives an empty table. Texts of any length are cut at their marked words only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MARKED_WORD = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
TABLE_WORDS = 400_000
PROBES = ("a b", "  a  b  ", " ", "▁a▁ b", "a\tb\n\nc \r\n", "ﬁ ½ ｆ é é", "<s> </s> <unk>", "中文 👍🏽\u0000x", "A\u00a0b\u200bc")


class WordTable:
    """Distinct marked words of a task: ids, flat, with offsets; and decoded texts."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        crossing = [p for i in range(self.sp.get_piece_size()) if re.search(f"[^{MARK}]{MARK}", p := self.sp.id_to_piece(i))]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
        self.mark = self.sp.piece_to_id(MARK)
        self.clear()
        for probe in PROBES:
            flat, _, decoded = self.encode([probe])
            if flat.tolist() != self.sp.encode(probe) or decoded != [self.sp.decode(self.sp.encode(probe))]:
                raise ValueError(f"the model doesn't treat marked words of {probe!r} one by one")

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.decoded: list[str] = []
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    def add(self, words: list[str]) -> None:
        """Segment words that aren't in the table: the first marker is the one that the model itself puts before a text."""
        ids = [x or [self.mark] for x in self.sp.encode([w[1:] for w in words], num_threads=1)]
        n, first = sum(map(len, ids)), len(self.at)
        while self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while first + len(words) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        self.flat[self.used : self.used + n] = np.fromiter((i for x in ids for i in x), np.int32, n)
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(words)] = lengths
        self.used += n
        self.decoded += [" " + t for t in self.sp.decode(ids)]
        self.at.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, offsets of the documents in them, decoded texts."""
        words = [MARKED_WORD.findall(" " + t) if t else [] for t in docs]
        new = set().union(*words).difference(self.at)
        if new and len(self.at) + len(new) > TABLE_WORDS:
            self.clear()
            new = set().union(*words)
        if new:
            self.add(sorted(new))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter((self.at[w] for ws in words for w in ws), np.int64, counts.sum())
        lengths = self.lengths[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(total)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]])
        decoded, at = [], 0
        for n in counts.tolist():
            decoded.append("".join([self.decoded[i] for i in rows[at : at + n].tolist()])[1:])
            at += n
        return self.flat[take], offsets, decoded


def encode_decode(df: DataFrame, model_file: str | None = None, text_col: str = "text", ids_out: str = "ids", decoded_out: str = "decoded") -> DataFrame:
    """df with ``ids_out`` (array of int, no begin or end ids) and ``decoded_out`` (their decoded text)."""
    kept = df.drop(ids_out, decoded_out)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_out, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_table(model_file or default_model())
        for batch in batches:
            for part in slices(batch, text_col):
                flat, offsets, decoded = words.encode([t or "" for t in part.column(text_col).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(decoded, pa.string())], names=[*part.schema.names, ids_out, decoded_out])

    return kept.mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def worker_table(model_file: str) -> WordTable:
    """This Python worker's table, kept from task to task."""
    return WordTable(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(texts(table(spark, sf_dir, "documents"))))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
