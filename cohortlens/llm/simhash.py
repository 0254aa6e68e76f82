"""SimHash near duplicates: 64-bit fingerprints, links at a few differing bits, components.

Bit-sliced comparison: the fingerprints of a bucket range are transposed into 64 bit planes; a shift of the planes by d
places lines every row up with the row d places on, and carry-save counters over the planes give all those distances at
once, 64 to a machine word. Words in which every distance exceeds the radius are abandoned.

Candidates are exact: with radius r the 64 bits are cut into r + 2 blocks, of which two at least agree in any linked
pair, so each pair of blocks is a bucket key. A bucket of more than `hot` fingerprints is dealt again by finer keys (the
remaining bits are cut into r + 1 blocks, of which one at least agrees), so no bucket is capped and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import small_batches, written
from cohortlens.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HOT, FLUSH_ROWS = 1 << 15, 1 << 14
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles; 0 if there is no word. A-Z is lower-cased, nothing else."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([_hash(b" ".join(words))], dtype=">u8")
    else:
        hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))), dtype=np.uint64, count=len(words) - width + 1).astype(">u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _fingerprints(b, width), f"doc_id {kind}, fp bigint")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes; row i is bit i % 64 of word i // 64 in each."""
    padded = np.zeros((-len(fps) % 64) + len(fps), dtype=">u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _near(planes: np.ndarray, d: int, pairs: np.ndarray, radius: int) -> np.ndarray:
    """Places i, of those whose bit in pairs is set, at which rows i and i + d differ in radius bits at most."""
    words = np.flatnonzero(pairs)
    if not len(words):
        return words
    skip, bits = divmod(d, 64)
    size = planes.shape[1]
    first, second = words + skip, np.minimum(words + skip + 1, size - 1)
    last = words + skip + 1 >= size
    live = pairs[words]
    n = radius.bit_length()
    counters, over = [np.zeros(len(words), dtype=np.uint64) for _ in range(n)], np.zeros(len(words), dtype=np.uint64)
    for k in range(64):
        plane = planes[k]
        there = plane[first] >> np.uint64(bits) if bits else plane[first]
        if bits:
            there = there | np.where(last, np.uint64(0), plane[second] << np.uint64(64 - bits))
        carry = plane[words] ^ there
        for j in range(n):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if k % 8 == 7:  # the block is abandoned once all its pairs exceed what the counters can hold
            going = (live & ~over) != 0
            if not going.all():
                words, first, second, last, live, over = words[going], first[going], second[going], last[going], live[going], over[going]
                counters = [c[going] for c in counters]
                if not len(words):
                    return words
    count_le = np.zeros(len(words), dtype=np.uint64)
    for value in range(radius + 1):
        same = _ONES
        for j in range(n):
            same = same & (counters[j] if value >> j & 1 else ~counters[j])
        count_le |= same
    hit = live & ~over & count_le
    spots = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(spots)
    return words[at] * 64 + bit


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == parent[up]).all():
            return up
        at = up


def link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by key: the first row of each row's component within its bucket.

    A bucket whose rows are all connected is left; its other links would join nothing more.
    """
    n = len(keys)
    parent = np.arange(n)
    if n < 2:
        return parent
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    planes, parts, end = _planes(fps), sizes.copy(), (starts + sizes)[bucket]
    where = open_rows = np.arange(n)
    for d in range(1, int(sizes.max())):
        open_rows = open_rows[(open_rows + d < end[open_rows]) & (parts[bucket[open_rows]] > 1)]
        if not len(open_rows):
            break
        pairs = np.zeros(planes.shape[1] * 64, dtype=bool)
        pairs[open_rows] = True
        left = _near(planes, d, np.packbits(pairs, bitorder="little").view("<u8"), radius)
        if not len(left):
            continue
        a, b = _roots(parent, left), _roots(parent, left + d)
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                parts[bucket[x]] -= 1
    return _roots(parent, where)


def _links(batches: Iterator[pa.RecordBatch], radius: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links (key null, a, b), and rows of hot buckets as they are (key, a, b null)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, full, passing = 0, FLUSH_ROWS, None  # passing: the key of a hot bucket that is being handed on

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def linked(keys, fps):
        first = link_sorted(keys, fps.view(np.uint64), radius)
        own = np.flatnonzero(first != np.arange(len(first)))
        return out([None] * len(own), fps[own], fps[first[own]])

    def handed(keys, fps):
        return out(keys, fps, [None] * len(fps))

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if passing is not None:
            cut = int(np.searchsorted(keys, passing, side="right"))
            if cut:
                yield handed(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if not len(keys):
                continue
            passing = None
        held.append((keys, fps))
        count += len(keys)
        if count < min(full, hot + 1):
            continue
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield linked(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
        if len(keys) > hot:
            yield handed(keys, fps)
            passing, held, count = keys[-1], [], 0
        else:
            held, count = [(keys, fps)], len(keys)
        full = max(FLUSH_ROWS, 2 * count)
    if held:
        yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of parts blocks that make up width bits."""
    edges = [round(i * width / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cut(fp, shift: int, bits: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _run(keyed: DataFrame, radius: int, hot: int, name: str) -> DataFrame:
    """keyed (key, fp) -> written (key, a, b) of _links."""
    return written(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _links(b, radius, hot), "key bigint, a bigint, b bigint"), name)


def near_links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within the radius."""
    blocks = _blocks(64, radius + 2)
    pairs = list(combinations(range(len(blocks)), 2))
    keys, base = [], 1 << 2 * max(bits for _, bits in blocks)
    for t, (i, j) in enumerate(pairs):
        (si, bi), (sj, bj) = blocks[i], blocks[j]
        keys.append(F.lit(t * base).cast("bigint") + F.shiftleft(_cut(F.col("fp"), si, bi), bj) + _cut(F.col("fp"), sj, bj))
    first = _run(fps.select(F.explode(F.array(*keys)).alias("key"), "fp"), radius, hot, "links")
    # Hot buckets again: the bits outside the two agreeing blocks, by the block of them that agrees as well.
    finer = []
    for t, (i, j) in enumerate(pairs):
        rest = [blocks[k] for k in range(len(blocks)) if k not in (i, j)]
        bits = [s + x for s, n in rest for x in range(n)]
        for p, (start, n) in enumerate(_blocks(len(bits), radius + 1)):
            mask = sum(1 << b for b in bits[start : start + n])
            mask -= (mask >> 63) << 64
            finer.append(F.when(F.expr(f"key div {base}L") == t, F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")))))
    again = first.where("key is not null").select("key", F.col("a").alias("fp"))
    again = again.select(F.explode(F.filter(F.array(*finer), lambda x: x.isNotNull())).alias("key"), "fp")
    second = _run(again, radius, hot, "links")
    links = first.where("key is null").select("a", "b").unionByName(second.where("key is null").select("a", "b"))
    left = second.where("key is not null").select("key", F.col("a").alias("fp"))
    if left.isEmpty():
        return links
    # Buckets that are hot still: each is cut into parts of about hot / 2, and every two parts meet in a bucket of their own.
    sizes = left.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(hot)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    met = left.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    third = _run(met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"), radius, 1 << 62, "links")
    return links.unionByName(third.select("a", "b"))


def _components(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """prints (doc_id, fp) -> (fp, component, first_id): a row a fingerprint, with its least doc_id."""
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "unique")
    labels = connected_components(near_links(unique.select("fp"), radius, hot)).select(F.col("id").alias("fp"), "component")
    return unique.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest doc_id that links reach.

    Null texts and texts without a word have fingerprint 0 and link like any other; repeated rows stay; a null doc_id
    gets its component, and is not its name unless the whole component has null ids. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    labelled = _components(prints, radius, hot)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(labelled.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """docs, of which each component keeps one row: of its smallest doc_id, and of that the least text hash. Columns stay.

    A null doc_id is above all others. Rows that share an id, or have none, are told apart by their texts, so each
    component keeps a row whatever the ids in others are. Repeated rows of a kept document leave one row.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    prints = written(fingerprints(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", width), "fingerprints")
    labelled = _components(prints, radius, HOT).select("fp", "component")
    keep = prints.join(labelled, "fp").groupBy("component").agg(F.min("doc_id").alias("__kept")).select("__kept").distinct()
    kept = docs.withColumn("__key", key).join(keep, F.col("__key").eqNullSafe(F.col("__kept")), "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")  # by partial aggregates, so a row of many copies meets in no task


def op1(spark, sf_dir: str) -> DataFrame:
    from cohortlens.llm.base import table

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
