"""Best-fit decreasing packing of token sequences.

Pieces of one length are alike, and so are bins of one remaining capacity, so best-fit decreasing runs over the counts of
the lengths: a segment tree over remaining capacities finds the tightest open capacity that holds a length in logarithmic
time, and a run of equal bins takes its pieces at once. That gives the bins that placing documents one by one gives.

What the driver holds does not grow with the documents: at most `capacity` counts come to it. Every length opens at most
one run of bins and splits at most one in three, and a run that takes pieces of a length keeps less than half of its
remaining capacity, so the plan has at most 3 * capacity * log2(capacity) placements; that bounds what tasks are sent.
A piece finds its own place from its length and its rank among pieces of that length, which is a running number within
its task plus the counts of the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.base import mapped, free_names, named, small_batches, table, written
from cohortlens.llm.encoding import encoded, encoder, vocabulary


class CapacityTree:
    """Which remaining capacities have open bins; tightest(n) is the smallest such capacity of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.any[at] += by
            at >>= 1

    def tightest(self, n: int) -> int | None:
        at = n + self.size
        if self.any[at]:
            return n
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.any[2 * at])
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """counts of lengths 1..capacity -> placements (length, first rank, pieces, first bin, pieces a bin, offset), and the number of bins."""
    tree, runs, placed, bins = CapacityTree(capacity), {}, [], 0

    def push(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if left and not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                push(capacity, bins, n)
                bins += n
                continue
            first, n = runs[room].pop()
            tree.add(room, -1)
            each = room // length
            whole = min(n, left // each)
            for used, many in ((whole, each), (1 if whole < n else 0, min(each, left - whole * each))):
                if used and many:
                    placed.append((length, rank, used * many, first, many, capacity - room))
                    push(room - many * length, first, used)
                    rank, left, first, n = rank + used * many, left - used * many, first + used, n - used
            push(room, first, n)
    return placed, bins


def _pieces(batches: Iterator[pa.RecordBatch], vocab: str, lead: bool, end_id: int, capacity: int, keep_ids: bool, extra: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch, ids, offsets in encoded(batches, encoder(vocab, lead), 0, end_id):
        sizes = np.diff(offsets)
        many = -(-sizes // capacity)
        source = np.repeat(np.arange(len(sizes)), many)
        piece = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(sizes[source] - start, capacity)
        first, data = offsets[source] + start, memoryview(ids).cast("B")
        own = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        by_length = np.argsort(length, kind="stable")
        lengths, at, n = np.unique(length[by_length], return_index=True, return_counts=True)
        nth = np.empty(len(length), np.int64)
        nth[by_length] = np.arange(len(length)) - np.repeat(at, n) + seen[length[by_length]]
        seen[lengths] += n
        columns = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(list(map(zlib.crc32, own)), pa.int64()), "part": pa.array(np.full(len(piece), part, np.int64)), "nth": pa.array(nth)}
        if keep_ids:
            columns["ids"] = pa.array(own, pa.binary())
        carried = pa.Table.from_batches([batch.select(list(range(1, 1 + extra)))]).take(pa.array(source))
        yield from pa.Table.from_arrays([*carried.columns, *columns.values()], names=[*carried.column_names, *columns]).combine_chunks().to_batches()


def _place(batches: Iterator[pa.RecordBatch], plan: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(rank, ..., length) -> (..., length, sequence_id, offset)."""
    for batch in batches:
        length, rank = batch.columns[-1].to_numpy(), batch.columns[0].to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at, own = np.flatnonzero(length == n), plan[n]
            row = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * n
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence), pa.array(offset)], [*batch.schema.names[1:], "sequence_id", "offset"])


def pack(docs: DataFrame, vocab: str, lead: bool = False, text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep: list[str] | None = None, keep_ids: bool = True) -> DataFrame:
    """(keep..., piece, start, length, ids_crc32, [ids,] sequence_id, offset): docs in as few sequences as best fit needs.

    Each text is encoded and end_id added; what is longer than capacity is cut into pieces of capacity ids and a last,
    shorter one. Null texts are empty (only end_id); repeated rows are packed each. keep: columns of docs to carry
    (doc_id), which may not bear the names above or part, nth, base, rank (ValueError). ids are little-endian unsigned 32-bit.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    free_names(keep, ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "part", "nth", "base", "rank"])
    kept = docs.select(F.col(text_col).alias("__text"), *[named(c) for c in keep])
    own = "piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint" + ", ids binary" * keep_ids
    pieces = written(mapped(kept, lambda b: _pieces(b, vocab, lead, end_id, capacity, keep_ids, len(keep)), own), "pieces")
    by_task = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan: dict[int, list] = {}
    for length, rank, _, first, many, offset in best_fit_plan(counts, capacity)[0]:
        plan.setdefault(length, []).append((rank, first, many, offset))
    arrays = {k: np.array(v, dtype=np.int64) for k, v in plan.items()}
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = by_task.select("length", "part", (F.sum("n").over(order) - F.col("n")).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base")).drop("part", "nth", "base")
    out = mapped(ranked.select("rank", *[named(c) for c in ranked.columns if c not in ("rank", "length")], "length"), lambda b: _place(b, arrays), "sequence_id bigint, offset bigint")
    return out.select(*[named(c) for c in keep], "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, offsets, doc_ids): one row a packed sequence; a sequence holds at most `capacity` ids, so groups are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (x, y) -> concat(x, y.ids))").alias("ids"), F.col("p.offset").alias("offsets"), F.col("p.doc_id").alias("doc_ids")
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)
