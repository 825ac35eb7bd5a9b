"""Best-fit packing of documents into sequences, with lower bounds that certify it and rounds of exchange where they don't."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches, drop, map_batches, map_groups, stored
from .tokens import encoder_of

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each length, and the number of bins.

    Bins are kept by the room that is left; a bit set of the rooms in use gives the smallest that suffices in a few machine words. Ties go to
    the bin touched last, equal lengths in input order, so the result depends on the input's order only.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return where, offset, n


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound of the number of bins: the largest that two families of dual feasible functions give.

    For a threshold t <= capacity / 2 the first counts lengths over capacity - t as whole bins and drops those under t. For a whole k the second rounds
    x * (k + 1) / capacity down to k-ths of a bin, and keeps x where it is whole.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    counts = counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    big = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    for t in sizes[sizes <= capacity // 2].tolist():
        low, high = np.searchsorted(sizes, t), np.searchsorted(sizes, capacity - t, side="right")
        best = max(best, int(big[-1] - big[high]) + -(-int(mass[high] - mass[low]) // capacity))
    for k in range(1, 41):
        scaled = sizes * (k + 1)
        # in units of capacity * k, so that everything stays whole
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def pieces(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of every whole text and end_id; only documents over `capacity` are cut. One pass, no shuffle.

    A null or empty text is the single id end_id. Repeated rows give repeated pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer_json, end_id))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, last = sent.value
        encode = encoder_of(text)
        for batch in batches(parts, "text", BATCH_BYTES):
            ids, number, start, length, crc = [], [], [], [], []
            found, ends = encode(batch.column("text"))
            found, ends = found.astype("<u4"), ends.tolist()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                whole = np.append(found[ends[k] : ends[k + 1]], last).astype("<u4")
                for i, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    ids.append(doc_id)
                    number.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, number, start, length, crc), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, PIECE)


#: Bits of a sequence's number below the round and the part that made it.
BIN_BITS, PART_BITS = 24, 32
STATE = f"{PACKED}, bins long, bound long, loose boolean"


def _packer(capacity: int, round_: int):
    """For one group: pack it, and bound its number of bins from below. Rows that have bins already keep them unless the new packing needs fewer, so that each group
    decides for itself. `loose` marks rows of bins that may be given up: those that aren't full, of a group that its bound doesn't certify."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        order = np.lexsort([group.column(c).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "start", "piece")] + [group.column("doc_id").fill_null(-1).to_numpy()])
        where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        where[order], offset[order], n = best_fit(lengths[order], capacity)
        bound = least_bins(lengths, capacity)
        part = int(group.column("part")[0].as_py())
        sequence = (np.int64(round_) << np.int64(BIN_BITS + PART_BITS)) + (np.int64(part) << np.int64(BIN_BITS)) + where
        if round_:
            held = group.column("sequence_id").to_numpy()
            before = len(np.unique(held))
            if n >= before:
                sequence, offset, n = held, group.column("offset").to_numpy(), before
        _, which = np.unique(sequence, return_inverse=True)
        fill = np.bincount(which, weights=lengths)
        values = {"sequence_id": sequence, "offset": offset, "bins": np.full(len(lengths), n), "bound": np.full(len(lengths), bound), "loose": (n > bound) & (fill[which] < capacity)}
        kept = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table({**{c: group.column(c) for c in kept}, **values})

    return run


def pack(found: DataFrame, capacity: int, rows_per_part: int = 8192, together: int = 4, least_gain: float = 1e-4) -> DataFrame:
    """Places of pieces (columns of `pieces`, each at most `capacity` long) in sequences: their rows with sequence_id, offset, and `bins` and `bound`: how many sequences
    their part needs and the least that any packing of it could need.

    Pieces are dealt by hash to parts of about `rows_per_part`, each packed by best-fit decreasing in one task. Dual feasible bounds certify a part whose
    number of bins equals its bound: nothing can better it. The other parts give up their bins that aren't full. Round after round, what they gave up is dealt anew
    to groups of up to `together` parts' rows, each packed again, and each group takes its new bins if they are fewer. Rounds end when all groups are certified, or
    when a round saves no bin, or less than `least_gain` of those given up. A hash deals repeated rows to different parts, so one that holds a third of the table is no group of its own. An empty table
    gives no rows.
    """
    spark = found.sparkSession
    n = found.count()
    columns = [x.split()[0] for x in PACKED.split(", ")] + ["bins", "bound"]
    # the number of a row in a written table: equal rows have different ones, and a task that is run again gives the same
    dealt = found.withColumn("deal", F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()))
    parts = max(1, -(-n // rows_per_part))
    state, path = stored(map_groups(dealt.withColumn("part", F.pmod("deal", F.lit(parts))).drop("deal"), ["part"], _packer(capacity, 0), STATE), "packed")
    done, paths, round_ = state.filter("not loose"), [path], 0
    loose = state.filter("loose")
    while True:
        left = loose.agg(F.count("*").alias("rows"), F.countDistinct("sequence_id").alias("bins")).first()
        # a single bin can't get better
        if left["bins"] < 2:
            break
        round_ += 1
        groups = max(1, -(-left["rows"] // (together * rows_per_part)))
        # rows of a bin go together, else bins could not be counted in their group
        again = loose.withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(round_)), F.lit(groups))).drop("bins", "bound", "loose")
        state, path = stored(map_groups(again, ["part"], _packer(capacity, round_), STATE), "repacked")
        paths.append(path)
        saved = left["bins"] - state.agg(F.countDistinct("sequence_id")).first()[0]
        done, loose = done.unionByName(state.filter("not loose")), state.filter("loose")
        if saved < max(1, least_gain * left["bins"]):
            break
    out, _ = stored(done.unionByName(loose).select(*columns), "sequences")
    drop(spark, *paths)
    return out


def best_fit_packing(docs: DataFrame, tokenizer_json: str, end_id: int = 0, capacity: int = 2048, rows_per_part: int = 8192) -> DataFrame:
    """Encode, cut and pack all documents: one row for each piece, with its sequence and its place there (no gaps, from 0), and the certificate of its part (see `pack`)."""
    found, path = stored(pieces(docs, tokenizer_json, end_id, capacity), "pieces")
    out = pack(found, capacity, rows_per_part)
    drop(docs.sparkSession, path)
    return out
