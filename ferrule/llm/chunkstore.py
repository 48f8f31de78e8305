"""Content-addressed store: payloads cut by a rolling hash, every distinct chunk kept once.

A store is a Parquet table with two kinds of rows, written by one job:

* recipes, one per input row: key columns, Merkle root, number of units, ordered chunk digests;
* chunks, one per distinct digest: compressed bytes, number of references, and the reference
  (root, position) that owns it.

Reading back, an owned chunk goes straight to its document; only chunks that several places share
are joined in by digest. Equal payloads have one root and are put together once, whatever the
number of copies, so a hot payload is neither stored nor moved again. Every chunk's digest and
every payload's Merkle root are computed anew from the bytes that were read, and a difference is
an error. Empty payloads have no chunks and a fixed root. A payload must fit into a task's memory;
nothing else must.

Chunks can be compressed with a dictionary, trained on the encoded texts of at most
``DICTIONARY_TEXTS`` rows (those with the lowest hash of doc_id, each cut at
``DICTIONARY_CHARS`` characters); it is kept in the store as a row of its own. It changes sizes only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices

DIGEST = 16
#: Chunk digests that a task remembers having sent; beyond these it starts anew, and chunks met again are sent again.
KNOWN = 500_000
DICTIONARY_TEXTS, DICTIONARY_CHARS, DICTIONARY_BYTES = 1000, 20_000, 112_640


#: Units of texts, end to end, and how many each text has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: the gear value of a unit, by rule instead of a table of constants."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _mix(np.arange(1 << 16, dtype=np.uint64))


def rolling(units: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 units at each place: five doublings instead of a loop over the units."""
    h = GEAR[units] if units.dtype.itemsize <= 2 else _mix(units.astype(np.uint64))
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    return h


@dataclass(frozen=True)
class Cuts:
    """Chunks of ``least`` to ``most`` units, ending where ``bits`` top bits of the rolling hash are 0."""

    least: int
    bits: int
    most: int

    def __post_init__(self):
        if not 32 <= self.least <= self.most:
            raise ValueError("chunks need 32 units at least, the rolling hash's window, and most >= least")

    def marks(self, units: np.ndarray) -> list[int]:
        """Places where a chunk may end. A chunk has a window's units at least, so they hold for payloads laid end to end."""
        return (np.flatnonzero(rolling(units) < np.uint32(1 << (32 - self.bits))) + 1).tolist()

    def ends(self, marks: list[int], start: int, end: int) -> list[int]:
        """Ends of the chunks of the payload between start and end."""
        out, at = [], start
        while end - at > self.least:
            k = bisect_left(marks, at + self.least)
            at = min(marks[k] if k < len(marks) else end, at + self.most, end)
            out.append(at)
        return out if at == end else [*out, end]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over ordered digests; an odd one is carried up; of no leaves, the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"root" + level[0])


@dataclass(frozen=True)
class Store:
    table: DataFrame
    dictionary: bytes | None = None

    @property
    def recipes(self) -> DataFrame:
        """doc_id, n_bytes (of the text), root, n_units, digests (concatenated), one row per input row."""
        return self.table.where("kind = 0").select("doc_id", "n_bytes", F.col("owner.root").alias("root"), "n_units", "digests")

    @property
    def chunks(self) -> DataFrame:
        """digest, payload (compressed), refs, owner: one row per distinct chunk."""
        return self.table.where("kind = 1").select(F.col("key").alias("digest"), "payload", "refs", "owner")


def open_store(table: DataFrame) -> Store:
    """A store that was written before."""
    kept = table.where("kind = 2").select("payload").head()
    return Store(table, bytes(kept.payload) if kept else None)


def train_dictionary(docs: DataFrame, make_encoder: Callable[[], Encoder]) -> bytes | None:
    """A compression dictionary from a bounded sample; none where the sample is too small to train one."""
    import zstandard

    known = docs.where("doc_id IS NOT NULL")
    few = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_TEXTS)  # ids first: tasks send no texts that aren't taken
    rows = known.join(F.broadcast(few), "doc_id").select(F.substring("text", 1, DICTIONARY_CHARS).alias("text")).limit(DICTIONARY_TEXTS).collect()
    units, counts = make_encoder()([r.text for r in rows])
    samples = [x.tobytes() for x in np.split(units, np.cumsum(counts)[:-1])] if rows else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def write_store(docs: DataFrame, make_encoder: Callable[[], Encoder], cuts: Cuts, tag: str, level: int = 6, trained: bool = False) -> Store:
    """Encode the texts of (doc_id, text) to arrays of units, cut these and store them.

    Input rows are all kept, equal or not: recipe rows carry a key of their own through the same
    shuffle that brings equal chunks together (after each task has merged its own).
    """

    shared = train_dictionary(docs, make_encoder) if trained else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        words = None
        if shared:
            words = zstandard.ZstdCompressionDict(shared)
            words.precompute_compress(level=level)
        encode, pack = make_encoder(), zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_dict_id=False)
        part, serial = TaskContext.get().partitionId(), 0
        known: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                out: dict[str, list] = {n: [] for n in names}
                sizes = pa.compute.binary_length(piece.column("text")).to_pylist()
                units, counts = encode(piece.column("text").to_pylist())
                raw, width, marks, start = units.tobytes(), units.dtype.itemsize, cuts.marks(units), 0
                for doc_id, n_bytes, count in zip(piece.column("doc_id").to_pylist(), sizes, counts.tolist(), strict=True):
                    ends = cuts.ends(marks, start, start + count)
                    spans = [(a, b) for a, b in zip([start, *ends], ends, strict=False)]
                    chunks = [raw[a * width : b * width] for a, b in spans]
                    leaves = [digest(x) for x in chunks]
                    root = merkle_root(leaves)
                    serial += 1
                    add(out, 0, b"%d:%d" % (part, serial), doc_id, n_bytes, root, -1, count, b"".join(leaves), None, 1)
                    for i, (leaf, chunk, (a, b)) in enumerate(zip(leaves, chunks, spans, strict=True)):
                        fresh = leaf not in known
                        known.add(leaf)
                        add(out, 1, leaf, None, None, root, i, b - a, None, pack.compress(chunk) if fresh else None, 1)
                    start += count
                    if len(known) > KNOWN:
                        known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in types.items()], names=names)

    types = {"kind": pa.int8(), "key": pa.binary(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "root": pa.binary(), "idx": pa.int32(), "n_units": pa.int64(), "digests": pa.binary(), "payload": pa.binary(), "refs": pa.int64()}
    names = list(types)

    def add(out: dict[str, list], *values) -> None:
        for n, v in zip(names, values, strict=True):
            out[n].append(v)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "kind tinyint, key binary, doc_id long, n_bytes long, root binary, idx int, n_units long, digests binary, payload binary, refs long")
    one = made.groupBy("kind", "key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_bytes").alias("n_bytes"),
        F.min(F.struct("root", "idx")).alias("owner"),
        F.first("n_units").alias("n_units"),
        F.first("digests").alias("digests"),
        F.first("payload", ignorenulls=True).alias("payload"),
        F.sum("refs").alias("refs"),
    )
    if shared:
        kept = docs.sparkSession.createDataFrame([(2, bytearray(b"dictionary"), bytearray(shared))], "kind tinyint, key binary, payload binary")
        one = one.unionByName(kept, allowMissingColumns=True)
    return Store(scratch(one, tag, partition_by=("kind",)), shared)


def payloads(store: Store, view: Callable[[bytes], dict], schema: str) -> DataFrame:
    """root and ``view`` of the stored bytes, once per distinct payload, after all digests are checked."""
    refs = (
        store.recipes.where("n_units > 0")
        .groupBy("root")
        .agg(F.first("digests").alias("digests"))
        .select("root", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1), lambda i: F.substring("digests", i * DIGEST + 1, DIGEST))).alias("idx", "digest"))
    )
    chunks = store.chunks
    owned = chunks.select(F.col("owner.root").alias("root"), F.col("owner.idx").alias("idx"), "digest", "payload")
    shared = refs.join(chunks.where("refs > 1"), "digest").where(F.struct("root", "idx") != F.col("owner")).select("root", "idx", "digest", "payload")
    empty = store.recipes.where("n_units = 0").select("root").distinct().select("root", F.lit(0).alias("idx"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("payload"))

    trained = store.dictionary

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        root, leaves, parts, out = None, [], [], []

        def done() -> None:
            if root is not None:
                if merkle_root(leaves) != root:
                    raise ValueError(f"stored chunks don't match the Merkle root {root.hex()}")
                out.append({"root": root} | view(b"".join(parts)))

        for batch in batches:
            for r, leaf, packed in zip(*(batch.column(n).to_pylist() for n in ("root", "digest", "payload")), strict=True):
                if r != root:
                    done()
                    root, leaves, parts = r, [], []
                if leaf is not None:
                    raw = unpack.decompress(packed)
                    if digest(raw) != leaf:
                        raise ValueError(f"a stored chunk doesn't match its address {leaf.hex()}")
                    leaves.append(leaf)
                    parts.append(raw)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(f"root binary, {schema}")
    arrow = to_arrow_schema(kind)
    return owned.unionByName(shared).unionByName(empty).repartition("root").sortWithinPartitions("root", "idx").mapInArrow(assemble, kind)
