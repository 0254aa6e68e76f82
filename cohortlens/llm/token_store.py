"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A shard file holds consecutive documents in ascending order of doc_id:

    8 bytes   magic "EFTOKEN1"
    9 x u64   documents, null ids, tokens, least doc_id (two's complement), span of doc_ids, low bits of ends, low bits of ids, id width, select step
    ends      Elias-Fano code of each document's end within the shard
    doc ids   Elias-Fano code of doc_id - least (non-null ones; ids may repeat)
    ids       token ids, little endian, 2 or 4 bytes each

An Elias-Fano code of n ascending values below u keeps the low l = log2(u / n) bits packed, and the high parts as unary
gaps in a bit vector of n + (u >> l) + 1 bits with a sample of every `step`-th one's place: about 2 + log2(u / n) bits a
value, and select(i) reads one sample and scans to the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.base import shared_dir, small_batches, table, written
from cohortlens.llm.encoding import encoded, encoder, vocabulary

MAGIC, STEP = b"EFTOKEN1", 256
BLOCK_TOKENS = 1 << 24


class EliasFano:
    """Ascending values below u; select(i) is value i, values() all."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, u: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(u, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n, bits), dtype=np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (u >> bits) + 1, dtype=np.uint8)
        high[places] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::STEP].astype("<u4" if len(high) < 1 << 32 else "<u8"))

    @staticmethod
    def sizes(n: int, u: int, bits: int) -> tuple[int, int, int]:
        places = n + (u >> bits) + 1
        return (n * bits + 7) // 8, (places + 7) // 8, -(-n // STEP) * (4 if places < 1 << 32 else 8)

    @classmethod
    def read(cls, data: memoryview, n: int, u: int, bits: int) -> tuple[EliasFano, int]:
        a, b, c = cls.sizes(n, u, bits)
        raw = np.frombuffer(data[: a + b + c], dtype=np.uint8)
        return cls(n, bits, raw[:a], raw[a : a + b], np.frombuffer(raw[a + b :].tobytes(), "<u4" if n + (u >> bits) + 1 < 1 << 32 else "<u8")), a + b + c

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, dtype=np.int64)
        start, end = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 :][: end - start]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, from the sample before it and a scan of the bits up to the next one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // STEP
        start = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :]
        place = start + int(np.flatnonzero(bits)[i - k * STEP])
        return (place - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (places - np.arange(self.n)) << self.low_bits | self._low(0, self.n)


def pack_shard(doc_ids: list[int | None], ends: np.ndarray, data: bytes, width: int) -> bytes:
    """A shard's bytes; data are the documents' ids, ends where each document's end. Null doc_ids come first, the others ascend."""
    nulls = sum(x is None for x in doc_ids)
    own = np.array(doc_ids[nulls:], dtype=np.int64)
    least, span = (int(own[0]), int(own[-1]) - int(own[0])) if len(own) else (0, 0)
    total = int(ends[-1]) if len(ends) else 0
    a, b = EliasFano.of(ends, total), EliasFano.of((own.astype(np.uint64) - np.uint64(least % 2**64)), span)
    head = np.array([len(doc_ids), nulls, total, least % 2**64, span, a.low_bits, b.low_bits, width, STEP], dtype="<u8").tobytes()
    return b"".join([MAGIC, head, a.tobytes(), b.tobytes(), data])


class Shard:
    """A shard that is read: doc_ids, ends (Elias-Fano) and the ids of document i."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, self.nulls, self.tokens, self.least, span, low_a, low_b, self.width, step = np.frombuffer(view[8:80], "<u8").tolist()
        if step != STEP:
            raise ValueError("another select step")
        self.ends, used = EliasFano.read(view[80:], n, self.tokens, low_a)
        self._ids, more = EliasFano.read(view[80 + used :], n - self.nulls, span, low_b)
        self.n, self.data = n, view[80 + used + more :]
        if len(self.data) != self.tokens * self.width:
            raise ValueError("the ids are cut short")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else (self._ids.select(i - self.nulls) + self.least + 2**63) % 2**64 - 2**63

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self._ids.values().astype(np.uint64) + np.uint64(self.least)).view(np.int64).tolist()

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return np.frombuffer(self.data[start * self.width : end * self.width], f"<u{self.width}")


def open_folder(uri: str):
    """(file system, path) of a shared folder, by pyarrow: local files, S3, GCS or HDFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, data: bytes) -> None:
    """Writes under a name of the attempt's own, then renames: readers never see half a file."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    context = TaskContext.get()
    part = f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{folder}/{name}")


def get(uri: str, name: str) -> bytes:
    system, folder = open_folder(uri)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


def _write(batches: Iterator[pa.RecordBatch], uri: str, vocab: str, lead: bool, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocab, lead)
    width, part = enc.dtype.itemsize, TaskContext.get().partitionId()
    names, doc_ids, parts, ends, tokens, before = [], [], [], [], 0, 0

    def flush():
        nonlocal doc_ids, parts, ends, tokens, before
        name = f"part-{part:07d}-{len(names):05d}.eft"
        put(uri, name, pack_shard(doc_ids, np.concatenate(ends), b"".join(parts), width))
        names.append(name)
        row = [[part], [name], [before], [tokens]]
        before += tokens
        doc_ids, parts, ends, tokens = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "name", "part_start", "tokens"])

    for batch, ids, offsets in encoded(batches, enc, 1, end_id):
        own, at = batch.column(0).to_pylist(), 0
        while at < len(own):
            to = min(int(np.searchsorted(offsets, offsets[at] + block_tokens - tokens)), len(own))
            doc_ids += own[at:to]
            parts.append(ids[offsets[at] : offsets[to]].astype(enc.dtype).tobytes())
            ends.append(offsets[at + 1 : to + 1] - offsets[at] + tokens)
            tokens += int(offsets[to] - offsets[at])
            at = to
            if tokens >= block_tokens:
                yield flush()
    if doc_ids:
        yield flush()


def write_tokens(docs: DataFrame, vocab: str, lead: bool = True, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encodes every text, adds end_id, writes shard files in ascending order of id_col; -> (part, name, part_start, tokens, uri).

    Null texts are empty (only the end id), null ids come first; rows with the same id follow each other by their text's hash, then by text.
    Files go to the shared folder, one or more a partition of the id range, each written whole and then renamed, so a
    task that runs again leaves the same files. The listing is a written table of one row a file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    uri = shared_dir(spark, "tokens")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    listing = ranged.mapInArrow(lambda b: _write(b, uri, vocab, lead, end_id, block_tokens), "part bigint, name string, part_start bigint, tokens bigint")
    return written(listing, "token-listing").withColumn("uri", F.lit(uri))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, uri, start in zip(*(batch.column(c).to_pylist() for c in ("name", "uri", "start")), strict=True):
            shard = Shard(get(uri, name))
            doc_ids, ends = shard.doc_ids(), shard.ends.values()
            for at in range(0, shard.n, 1024):
                to = min(at + 1024, shard.n)
                base, last = shard.bounds(at)[0], shard.bounds(to - 1)[1]
                data = np.frombuffer(shard.data[base * shard.width : last * shard.width], f"<u{shard.width}").astype("<u4")
                own = ends[at:to]
                starts = np.append(base, own[:-1])
                edges = pa.py_buffer(np.append(0, 4 * (own - base)))
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, edges, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(starts + start), pa.array(own - starts), ids], ["doc_id", "start", "n_tokens", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        crc = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _located(listing: DataFrame) -> DataFrame:
    """The listing with each file's start in the whole: parts are counted up in their order, one row a part."""
    parts = listing.groupBy("part").agg(F.sum("tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    files = listing.join(bases, "part").select("name", "uri", (F.col("base") + F.col("part_start")).alias("start"))
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")


def read_tokens(listing: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids are little-endian unsigned 32-bit; start counts the ids of all documents before."""
    return _located(listing).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op5(spark, sf_dir: str) -> DataFrame:
    listing = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return _located(listing).mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
