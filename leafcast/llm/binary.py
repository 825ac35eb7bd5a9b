"""Binary token output: raw id payloads in shards, and a minimal perfect hash index from document keys to places in them.

A shard `x` is two files. `x.bin` holds the ids of its documents one after another, 2 bytes each where the vocabulary allows, else 4,
little-endian. `x.idx` holds a JSON header line and numpy arrays: the hash function's bit levels with the number of bits set before each word, and for each of its slots the key's
32-bit fingerprint, the offset in ids and the number of ids; last the keys in file order, for scans. A lookup finds the shard by its key range, hashes the key, reads one
word of bits for each level until the key's bit is set, ranks it, and compares the fingerprint: some dozens of bytes at known places, however large the shard is, without any stored key.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches, drop, map_batches, new_path
from .tokens import encoder_of

GAMMA = 2.0
LEVELS = 40
#: Bytes of the header line, padded with spaces: the levels' sizes fall by more than half each, so it holds those of any shard.
HEAD = 1024


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    z = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def key_hashes(keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each key; the k-th row with the same key has occurrence k."""
    with np.errstate(over="ignore"):
        h = _mix(np.where(null, 0, keys).astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF), 7)
        return _mix(h + (occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), 11)


def occurrences(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many rows before each have its key; equal keys stand together."""
    n = len(keys)
    first = np.ones(n, bool)
    first[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(first, at, 0)) if n else at


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers: each level keeps the numbers that are alone in their cell and hands on the rest."""

    def __init__(self, words: list[np.ndarray], sizes: list[int]):
        self.words, self.sizes = words, sizes
        starts, total = [], 0
        for w in words:
            c = np.bitwise_count(w).astype(np.int64)
            starts.append(np.cumsum(c) - c + total)
            total += int(c.sum())
        self.ranks, self.n = starts, total

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash | None:
        """None if two numbers are equal or LEVELS don't suffice; the caller then takes another seed."""
        words, sizes, left = [], [], hashes.astype(np.uint64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = int(max(64, GAMMA * len(left)))
            cell = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            words.append(np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), "<u8"))
            sizes.append(size)
            left = left[~alone[cell]]
        return None if len(left) else cls(words, sizes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each number, -1 where no level has it. A number that wasn't built in may get any slot: compare fingerprints."""
        found = np.full(len(hashes), -1, np.int64)
        for level, (words, size, rank) in enumerate(zip(self.words, self.sizes, self.ranks, strict=True)):
            at = np.flatnonzero(found < 0)
            if not len(at):
                break
            cell = _mix(hashes[at], level) % np.uint64(size)
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            found[at[hit]] = (rank[word] + below)[hit]
        return found


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def index_bytes(keys: np.ndarray, null: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """The .idx file for documents in file order: keys (0 where null), and the number of ids of each."""
    offsets, occurrence = np.cumsum(sizes) - sizes, occurrences(keys, null)
    for seed in range(64):
        hashes = key_hashes(keys, null, occurrence, seed)
        if (function := PerfectHash.build(hashes)) is not None:
            break
    else:
        raise ValueError("no perfect hash function found")
    slot = function.slots(hashes)
    prints, at, size = np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8"), np.empty(len(keys), "<i8")
    prints[slot], at[slot], size[slot] = (_mix(hashes, 99) & np.uint64(0xFFFFFFFF)).astype("<u4"), offsets, sizes
    head = {"seed": seed, "n": len(keys), "width": width, "sizes": function.sizes}
    levels = [x for w, r in zip(function.words, function.ranks, strict=True) for x in (w, r.astype("<i8"))]
    return json.dumps(head).encode().ljust(HEAD - 1) + b"\n" + b"".join(x.tobytes() for x in (*levels, prints, at, size, keys.astype("<i8"), null.astype(np.uint8)))


class Index:
    """Lookups in one shard, from its .idx file: `raw` is all of it, or a file of which only what a lookup needs is read."""

    def __init__(self, raw):
        self.raw = raw
        head = json.loads(self._take(0, "u1", HEAD).tobytes())
        self.seed, self.n, self.width, self.sizes = head["seed"], head["n"], head["width"], head["sizes"]
        self.levels, at = [], HEAD
        for size in self.sizes:
            self.levels.append(at)
            at += 16 * ((size + 63) // 64)
        self.prints, self.places_at, self.lengths_at, self.keys_at = at, at + 4 * self.n, at + 12 * self.n, at + 20 * self.n

    def _take(self, at: int, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if isinstance(self.raw, bytes):
            return np.frombuffer(self.raw, kind, n, at)
        self.raw.seek(at)
        return np.frombuffer(self.raw.read(size), kind, n)

    def place(self, key: int | None, occurrence: int = 0) -> tuple[int, int]:
        """Offset and number of ids of a key; -1 and 0 if the shard doesn't hold it (but for 1 in 2**32 of such keys)."""
        h = key_hashes(np.array([key or 0]), np.array([key is None]), np.array([occurrence]), self.seed)
        for level, (size, at) in enumerate(zip(self.sizes, self.levels, strict=True)):
            cell = int(_mix(h, level)[0] % np.uint64(size))
            word = int(self._take(at + 8 * (cell >> 6), "<u8", 1)[0])
            if word >> (cell & 63) & 1:
                rank = int(self._take(at + 8 * ((size + 63) // 64) + 8 * (cell >> 6), "<i8", 1)[0])
                slot = rank + (word & ((1 << (cell & 63)) - 1)).bit_count()
                if int(self._take(self.prints + 4 * slot, "<u4", 1)[0]) != int(_mix(h, 99)[0]) & 0xFFFFFFFF:
                    return -1, 0
                return int(self._take(self.places_at + 8 * slot, "<i8", 1)[0]), int(self._take(self.lengths_at + 8 * slot, "<i8", 1)[0])
        return -1, 0

    def scan(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys (0 where null) and null marks in file order, with the offset and number of ids that the hash function finds for each."""
        keys, null = self._take(self.keys_at, "<i8", self.n), self._take(self.keys_at + 8 * self.n, "u1", self.n).astype(bool)
        words = [self._take(at, "<u8", (size + 63) // 64) for size, at in zip(self.sizes, self.levels, strict=True)]
        h = key_hashes(keys, null, occurrences(keys, null), self.seed)
        slot = PerfectHash(words, self.sizes).slots(h) if self.n else np.empty(0, np.int64)
        if not (self._take(self.prints, "<u4", self.n)[slot] == (_mix(h, 99) & np.uint64(0xFFFFFFFF))).all():
            raise ValueError("the index doesn't hold its own keys")
        return keys, null, self._take(self.places_at, "<i8", self.n)[slot], self._take(self.lengths_at, "<i8", self.n)[slot]


@dataclass(frozen=True)
class Shard:
    shard: int
    path: str
    n_docs: int
    n_ids: int
    first_key: int | None
    last_key: int | None


SHARD = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long"


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str) -> list[Shard]:
    """Encode every whole text and write shards in ascending doc_id order under `path` (a folder that all executors share).

    docs needs doc_id (integer; nulls first) and text (null: empty, its only id is end_id); rows with the same doc_id are in the order of
    a hash of their texts, and repeated rows, however many, go to several shards. One range shuffle of the texts; each task sorts its range, encodes it batch by batch and streams the
    payload out under a name of its own attempt, so a retried or speculative task leaves only files that no manifest names. Memory of a task: a batch, and some 200 bytes for
    each document of its shard while the index is made. Returns the manifest (one row for each shard, ordered by key).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((tokenizer_json, end_id))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        text, last = sent.value
        encode = encoder_of(text)
        width = encode.dtype.itemsize
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}"
        fs, base = _fs(name)
        keys, null, lengths, out = [], [], [], None
        for batch in batches(parts, "text", BATCH_BYTES):
            if out is None:
                fs.create_dir(base.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(f"{base}.bin")
            keys.append(pc.fill_null(batch.column("doc_id"), 0).to_numpy())
            null.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            ids, ends = encode(batch.column("text"))
            # an end id after each document
            out.write(np.insert(ids, ends[1:], last).tobytes())
            lengths.append(np.diff(ends) + 1)
        if out is None:
            return
        out.close()
        keys, null, lengths = (np.concatenate(x) for x in (keys, null, lengths))
        with fs.open_output_stream(f"{base}.idx") as f:
            f.write(index_bytes(keys, null, lengths, width))
        ends = [None if null[i] else int(keys[i]) for i in (0, -1)]
        row = ([shard], [name], [len(keys)], [int(lengths.sum())], [ends[0]], [ends[1]])
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["shard", "path", "n_docs", "n_ids", "first_key", "last_key"])

    order = ("doc_id", "__h", "__i")
    ranged = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"), F.monotonically_increasing_id().alias("__i"))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = map_batches(ranged, run, SHARD).collect()  # one row for each shard
    return sorted((Shard(*r) for r in found), key=lambda s: s.shard)


def read_tokens(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """Every document of the written shards: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of its ids as read back.

    Each task reads shards' files through their indexes, one document's ids at a time. No shards: no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    rows, before = [], 0
    for s in shards:
        rows.append((s.path, before))
        before += s.n_ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, base = _fs(path)
                with fs.open_input_stream(f"{base}.idx") as f:
                    index = Index(f.read())
                keys, null, offsets, lengths = index.scan()
                kind, crcs = f"<u{index.width}", np.empty(index.n, np.int64)
                with fs.open_input_file(f"{base}.bin") as f:
                    for i, (at, n) in enumerate(zip(offsets.tolist(), lengths.tolist(), strict=True)):
                        f.seek(at * index.width)
                        crcs[i] = zlib.crc32(np.frombuffer(f.read(n * index.width), kind).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(offsets + start), pa.array(lengths), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return map_batches(table, run, schema)


def lookup(shards: list[Shard], key: int | None) -> np.ndarray | None:
    """Ids of one document, by key: the shard by its key range, the place by the index, a few small reads in all. None if it isn't there; of several rows with the key, those of the first.
    Null keys come first in the order of shards."""
    low = -(1 << 63) - 1
    value = low if key is None else key
    last = [low if s.last_key is None else s.last_key for s in shards]
    for s in shards[bisect.bisect_left(last, value) :]:
        if (low if s.first_key is None else s.first_key) > value:
            break
        fs, base = _fs(s.path)
        with fs.open_input_file(f"{base}.idx") as f:
            index = Index(f)
            at, n = index.place(key)
        if at >= 0:
            with fs.open_input_file(f"{base}.bin") as f:
                f.seek(at * index.width)
                return np.frombuffer(f.read(n * index.width), f"<u{index.width}").astype("<u4")
    return None


def round_trip(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """write_tokens under a new shared folder, then read_tokens. The files stay while the result is read; drop_tokens removes them."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer_json, end_id, new_path(spark, "tokens")))


def drop_tokens(spark: SparkSession, shards: list[Shard]) -> None:
    drop(spark, *{s.path.rsplit("/", 1)[0] for s in shards})
