"""Media columns: texts as 8-bit samples in WAVE containers, chunked by content, stored once, read back.

A null text is stored like an empty one (64 zero samples). Equal texts share all stored chunks and
have equal values. Repeated rows and equal doc_ids are all kept; extra columns are left behind; an
empty table gives an empty table. A text must be under 4 GB, the container's limit, and fit into a
task's memory. See :mod:`ferrule.llm.chunkstore`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkstore import Cuts, Store, payloads, write_store
from .common import table, texts

BLOCK, RATE = 64, 8000
CUTS = Cuts(least=2048, bits=12, most=65536)
LEVEL = 17
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> bytes:
    """UTF-8, padded with bytes 0 to a positive multiple of the block."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def to_wave(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wave(media: bytes) -> bytes:
    head = HEADER.unpack_from(media)
    if (head[0], head[2], head[11]) != (b"RIFF", b"WAVE", b"data") or head[12] != len(media) - HEADER.size:
        raise ValueError("not a wave file of this store")
    return media[HEADER.size :]


def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    waves = [to_wave(payload_of(t)) for t in batch]
    return np.frombuffer(b"".join(waves), np.uint8), np.array([len(w) for w in waves], np.int64)


def write_media(docs: DataFrame, cuts: Cuts = CUTS) -> Store:
    """Store the texts of (doc_id, text) as media."""
    return write_store(docs, lambda: encode, cuts, "media", level=LEVEL, trained=True)


def features(payload: bytes) -> str:
    """Of the samples: lowest, highest, sum, sum of squares, crossings of the middle, and counts in 16 equal bins."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    bins = counts.reshape(16, 16).sum(axis=1).tolist()
    return ",".join(map(str, [int(x.min()), int(x.max()), int(counts @ values), int(counts @ values**2), crossings, *bins]))


def measure(media: bytes) -> dict:
    payload = from_wave(media)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": features(payload),
    }


def read_media(store: Store) -> DataFrame:
    """doc_id, n_bytes (of the text), root and the measures of each document's stored media."""
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.recipes.select("doc_id", "n_bytes", "root").join(payloads(store, measure, schema), "root")


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    store = write_media(docs)
    return read_media(store).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _little(number: str) -> str:
    """SQL: four bytes of a number, the lowest first, in hexadecimal digits."""
    return " || ".join(f"printf('%02X', ({number}) // {1 << shift} % 256)" for shift in (0, 8, 16, 24))


#: Container, hashes, the checksum by its table, and features, without a store.
ORACLE_SQL = f"""WITH table_ AS (SELECT list(c ORDER BY k) AS step FROM (SELECT k, list_reduce([CAST(k AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, {0xEDB88320}) ELSE c // 2 END) AS c FROM range(256) t(k))),
bare AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
padded AS (SELECT doc_id, n, h || repeat('00', CASE WHEN n = 0 THEN {BLOCK} ELSE ({BLOCK} - n % {BLOCK}) % {BLOCK} END) AS p FROM bare),
samples AS (SELECT doc_id, n, p, length(p) // 2 AS m, list_transform(regexp_extract_all(p, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM padded),
waves AS (SELECT *, hex('RIFF') || {_little("m + 36")} || hex('WAVEfmt ') || '100000000100' || '0100' || {_little(str(RATE))} || {_little(str(RATE))} || '01000800' || hex('data') || {_little("m")} || p AS w FROM samples)
SELECT doc_id, n AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, lower(sha256(unhex(p))) AS payload_sha256,
xor(list_reduce(list_concat([{0xFFFFFFFF}::BIGINT], list_slice(b, m - {BLOCK - 1}, m)), lambda c, x: xor(c // 256, step[xor(c % 256, x) + 1])), {0xFFFFFFFF}::BIGINT) AS tail_crc32, CAST(m + 44 AS BIGINT) AS media_bytes, lower(sha256(unhex(w))) AS media_sha256,
array_to_string(list_concat([list_min(b), list_max(b), CAST(list_sum(b) AS BIGINT), CAST(list_sum(list_transform(b, lambda x: x * x)) AS BIGINT), len(list_filter(range(1, m), lambda i: (b[i] >= 128) <> (b[i + 1] >= 128)))],
list_transform(range(0, 16), lambda k: len(list_filter(b, lambda x: x // 16 = k)))), ',') AS feature FROM waves, table_"""
