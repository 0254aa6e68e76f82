"""Files as streams of bytes in executors: listings, digests a mebibyte at a time, and ranges.

A file is never a cell: what is read of it at once is a buffer. Paths are URIs of any store that Arrow opens (local and
shared folders, HDFS, S3, GCS); listings take any that Hadoop has.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = 1 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified in milliseconds) of the files below a path, empty ones too (Spark's readers leave those out).

    No content is read; names that begin with `_` or `.` are left out. The names pass through the driver, as in any listing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found, rows = root.getFileSystem(conf).listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if fnmatch.fnmatchcase(name, pattern) and not name.startswith(("_", ".")):
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "path string, length bigint, modified bigint")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            md5, sha, n = hashlib.md5(usedforsecurity=False), hashlib.sha256(), 0
            system, path = located(uri)
            with system.open_input_stream(path, compression=None, buffer_size=0) as stream:
                while part := stream.read(BUFFER):
                    md5.update(part)
                    sha.update(part)
                    n += len(part)
            rows.append((md5.hexdigest(), sha.hexdigest(), n))
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "md5", "sha256", "bytes"])


def hashed(files: DataFrame) -> DataFrame:
    """files (path, length) with md5, sha256 and bytes, what was read: a stream a file, dealt by length so that large ones are apart."""
    n = max(1, min(10_000, files.count()))
    own = files.select("path", F.col("length").cast("bigint").alias("length"))
    dealt = own.repartitionByRange(n, F.col("length").desc(), "path") if n > 1 else own
    return dealt.mapInArrow(_hashes, "path string, length bigint, md5 string, sha256 string, bytes bigint")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, md5, sha256) of the files below a path."""
    return hashed(listed(spark, path, pattern)).drop("bytes")


def verified(expected: DataFrame, files: DataFrame) -> DataFrame:
    """expected (path, and any of length, md5, sha256, null where unknown) with the file's own and a status.

    MISSING where there is no such file, SIZE_MISMATCH, MD5_MISMATCH, SHA256_MISMATCH, else VERIFIED; digests are compared
    in any case. Only expected files are read.
    """
    told = {c: F.col(c) if c in expected.columns else F.lit(None).cast("bigint" if c == "length" else "string") for c in ("length", "md5", "sha256")}
    want = expected.select("path", *[told[c].alias(f"want_{c}") for c in told])
    found = hashed(files.join(want.select("path").distinct(), "path", "left_semi")).select("path", F.col("bytes").alias("length"), "md5", "sha256")
    same = lambda c: F.col(f"want_{c}").isNull() | (F.lower(F.col(f"want_{c}").cast("string")) == F.lower(F.col(c).cast("string")))
    status = F.when(F.col("md5").isNull(), "MISSING").when(~same("length"), "SIZE_MISMATCH").when(~same("md5"), "MD5_MISMATCH").when(~same("sha256"), "SHA256_MISMATCH").otherwise("VERIFIED")
    return want.join(found, "path", "left").withColumn("status", status)


def read_range(uri: str, first: int, end: int) -> bytes:
    """The bytes first to end (not itself) of a file."""
    system, path = located(uri)
    with system.open_input_file(path) as f:
        return f.read_at(end - first, first)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file at a path of any store that Spark writes to, whole or not at all: written beside it, then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    beside = jvm.org.apache.hadoop.fs.Path(path + "._new")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(beside, target):
        raise OSError(f"can't write {path}")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file at a path of any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return rows[0][0] if rows else ""
