"""Token ids in a content-addressed store: encode, cut, keep distinct chunks once, read back.

The file format: recipes (document order, Merkle root, number of ids, chunk digests, first id's
place) in ascending doc_id order, chunks by content address, and a manifest with one row per
recipe part. See :mod:`ferrule.llm.chunkstore`.

Null texts encode like empty ones: the end id alone. Repeated rows and equal doc_ids are all kept;
equal doc_ids follow each other by Merkle root; a null doc_id comes first. An empty table gives an
empty table. Texts of any length are encoded whole; extra columns are left behind.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkstore import Cuts, Encoder, Store, payloads, write_store
from .common import scratch, table, texts
from .wordhash import BYTE, PrefixHashes

MODEL = "word_bpe_49k.json"
END_ID = 2
CUTS = Cuts(least=128, bits=8, most=2048)
#: Distinct pieces that a Python worker remembers the ids of; beyond these it starts anew.
PIECES = 400_000
#: Characters that are cut into pieces at once; a longer text is cut at white space, which no piece crosses.
RUN = 500_000

# How the tokenizer file that the fast path is for declares its rules.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}

# What these rules say for texts of these characters: all are stable under NFC, lower-case one by one and
# are letters, digits, white space or neither as written here. Any other text goes to the library whole.
LETTERS, OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿‐-‧€"
PLAIN = re.compile(f"[ \\n\\t\\r0-9{LETTERS}{OTHERS}]*")
WHITE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Class of a lower-case byte of such texts; bytes after 0xC3 are letters too, those after other first bytes are not.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, 0x0A, 0x09, 0x0D]] = WHITE
CLASS[0x30:0x3A] = DIGIT
CLASS[0x61:0x7B] = CLASS[0xC3] = LETTER


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the others for 256 and following."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def known_rules(tokenizer_file: str) -> bool:
    """Whether the file declares the rules that the fast path is written for, and special tokens that all hold "<|"."""
    with open(tokenizer_file, encoding="utf-8") as f:
        declared = json.load(f)
    return declared["normalizer"] == NORMALIZER and declared["pre_tokenizer"] == PRE_TOKENIZER and not declared["model"].get("dropout") and all("<|" in t["content"] for t in declared["added_tokens"])


def piece_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every piece of lower-case text: runs of letters, single digits, runs of others, contractions."""
    kind = CLASS[data]
    kind[np.flatnonzero(data[:-1] == 0xC3) + 1] = LETTER
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[:-1] |= kind == DIGIT
    # an apostrophe that is no longer run of others takes a short ending after it along
    quote = np.flatnonzero(data == 0x27)
    quote = quote[cut[quote] & cut[quote + 1]]
    if len(quote):
        padded = np.concatenate([data[: quote[-1] + 3], np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        cut[quote + 1] = False
        cut[quote + size] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    whole = kind[start] != WHITE
    return start[whole], end[whole]


class PieceTable:
    """Ids of distinct pieces by the library's model, found by the hash of their bytes in a table of open addresses."""

    def __init__(self, tokenizer):
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear(PIECES)

    def clear(self, room: int) -> None:
        self.slots = np.full(1 << max(21, (4 * room).bit_length()), -1, np.int32)
        self.n, self.used = 0, 0
        self.keys, self.starts, self.lengths = np.empty(room, np.uint64), np.empty(room, np.int64), np.empty(room, np.int64)
        self.flat = np.empty(4 * room, self.dtype)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, -1 where it isn't there."""
        out = np.full(len(hashes), -1, np.int64)
        mask = np.uint64(len(self.slots) - 1)
        at, slot, key = np.arange(len(hashes)), (hashes & mask).astype(np.int64), hashes
        while len(at):
            row = self.slots[slot]
            hit = (row >= 0) & (self.keys[row] == key)
            out[at[hit]] = row[hit]
            on = np.flatnonzero(~hit & (row >= 0))
            at, slot, key = at[on], (slot[on] + 1) & int(mask), key[on]
        return out

    def add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Segment pieces whose hashes differ from each other and from those in the table."""
        ids = [[t.id for t in self.tokenize(p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())))] for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(lengths.sum())
        while self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(ids), self.dtype, n)
        made = slice(self.n, self.n + len(ids))
        self.keys[made], self.lengths[made], self.starts[made] = hashes, lengths, self.used + np.cumsum(lengths) - lengths
        row, slot, mask = np.arange(made.start, made.stop, dtype=np.int32), (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64), len(self.slots) - 1
        while len(row):
            first = np.zeros(len(row), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.slots[slot] < 0)
            self.slots[slot[put]] = row[put]
            row, slot = row[~put], (slot[~put] + 1) & mask
        self.n, self.used = made.stop, self.used + n

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case texts end to end, and the number of ids of each."""
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        start, end = piece_bounds(data) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
        hashes = PrefixHashes(BYTE[data]).of(start, end)
        rows = self.rows(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if self.n + len(fresh) > len(self.keys):
                new = np.arange(len(hashes))
                fresh, first = np.unique(hashes, return_index=True)
                self.clear(max(PIECES, len(fresh)))
            raw = data.tobytes()
            at = new[first]
            self.add(fresh, [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            rows[new] = self.rows(hashes[new])
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[rows] - (ends - lengths), lengths)
        take += np.arange(total)
        before = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        return self.flat[take], np.diff(before)


def segments(text: str) -> Iterator[str]:
    """The text in parts of about ``RUN`` characters, cut after white space."""
    at = 0
    while len(text) - at > RUN:
        m = re.compile(r"[ \n\t\r]").search(text, at + RUN)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def width_of(tokenizer_file: str) -> int:
    """Bytes of an id in the files: two where all ids of the vocabulary fit."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4


@functools.lru_cache(maxsize=2)
def _worker_tables(tokenizer_file: str) -> tuple:
    """The tokenizer and, if its rules are the known ones, the piece table of this Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    return tokenizer, PieceTable(tokenizer) if known_rules(tokenizer_file) else None


def make_encoder(tokenizer_file: str, end_id: int, width: int) -> Callable[[], Encoder]:
    def make() -> Encoder:
        tokenizer, pieces = _worker_tables(tokenizer_file)
        kind = np.dtype(f"<u{width}")

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flats: list[np.ndarray] = [np.empty(0, kind)]
            counts = np.zeros(len(texts), np.int64)
            held: list[bytes] = []
            of: list[int] = []

            def flush() -> None:
                if held:
                    flat, n = pieces.encode(held)
                    flats.append(flat)
                    np.add.at(counts, of, n)
                    held.clear()
                    of.clear()

            size = 0
            for i, t in enumerate(texts):
                if pieces and "<|" not in t and PLAIN.fullmatch(t):
                    for part in segments(t):
                        held.append(part.lower().encode())
                        of.append(i)
                        size += len(part)
                        if size >= RUN:
                            flush()
                            size = 0
                else:
                    flush()
                    ids = tokenizer.encode(t, add_special_tokens=False).ids
                    flats.append(np.array(ids, kind))
                    counts[i] += len(ids)
            flush()
            return np.insert(np.concatenate(flats), np.cumsum(counts), kind.type(end_id)), counts + 1

        return encode

    return make


def write_ids(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = END_ID, cuts: Cuts = CUTS) -> tuple[Store, DataFrame, DataFrame]:
    """The store of (doc_id, text), its recipes in ascending doc_id order, and the manifest of their parts."""
    import public_tokenizers

    tokenizer_file = tokenizer_file or public_tokenizers.path(MODEL)
    width = width_of(tokenizer_file)
    if not 0 <= end_id < 1 << 8 * width:
        raise ValueError(f"the end id {end_id} doesn't fit into {width} bytes")
    store = write_store(docs, make_encoder(tokenizer_file, end_id, width), cuts, "ids", level=3)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, row = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column("n_units").to_numpy()
            first = at + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), pa.array(first, pa.int64())], names=[*b.schema.names, "part", "row", "first"])
            at, row = at + int(n.sum()), row + len(n)

    ordered = store.recipes.drop("n_bytes").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    recipes = scratch(ordered.mapInArrow(place, "doc_id long, root binary, n_units long, digests binary, part int, row long, first long"), "recipes")
    return store, recipes, manifest(recipes, width)


def manifest(recipes: DataFrame, width: int) -> DataFrame:
    """One row per part of the recipes: rows, ids, bytes of an id, the first id's place over all parts, sum of its roots' hashes."""
    from pyspark.sql import Window

    parts = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_units").alias("n_ids"), F.sum(F.xxhash64("row", "root").cast("decimal(38,0)")).alias("roots_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts were written
    return parts.withColumn("width", F.lit(width)).withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(store: Store, recipes: DataFrame, parts: DataFrame, view: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Per document: doc_id, start, and ``view`` of its ids (unsigned 32-bit) as they are in the files."""
    first = parts.select("width").head()
    kind = f"<u{first.width if first else 2}"

    def of(raw: bytes) -> dict:
        return view(np.frombuffer(raw, kind).astype("<u4"))

    placed = recipes.join(F.broadcast(parts.select("part", "offset")), "part").select("doc_id", "root", (F.col("offset") + F.col("first")).alias("start"))
    return placed.join(payloads(store, of, schema), "root").drop("root")


def _digest(ids: np.ndarray) -> dict:
    import zlib

    return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, recipes, parts = write_ids(texts(table(spark, sf_dir, "documents")))
    return read_ids(store, recipes, parts, _digest, "n_tokens long, ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")
