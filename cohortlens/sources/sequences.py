"""Sequence files by byte ranges: lines with their places, the five-column index, and intervals by seeking.

`fasta_lines` is a data source whose partitions are byte ranges of files: a partition seeks to its range, leaves the line
that began before it to the partition before, and numbers bases from its last header or from its start. What a
partition can't know, the contig that is open where it starts and how many bases that has so far, comes from one row a
partition: sums over partitions, never over lines. A folder is read as its files, each of which starts with a header.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortlens.sources.files import located, write_text

SPLIT = 64 << 20
LINES = "path string, split int, kind string, at bigint, width int, contig string, head_at bigint, run bigint, bases string"
#: Columns of an index file, in order; name, length and so on of each contig.
FIELDS = ("contig", "length", "offset", "line_bases", "line_width")


class Range(InputPartition):
    def __init__(self, uri: str, split: int, first: int, end: int):
        super().__init__((uri, split))
        self.uri, self.split, self.first, self.end = uri, split, first, end


def _lines(f, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line with its end) of the lines that begin in a range of bytes."""
    at = first
    if first:
        f.seek(first - 1)
        at += len(f.readline()) - 1
    while at < end and (line := f.readline()):
        yield at, line
        at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", str(SPLIT)))

    def partitions(self) -> list[Range]:
        system, path = located(self.path)
        scheme = re.match(r"[a-zA-Z0-9+.-]+://" + ("[^/]*" if path.startswith("/") else ""), self.path)
        uri = (lambda p: scheme[0] + quote(p)) if scheme else (lambda p: p)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such sequence file: {self.path}")
        files = [info] if info.is_file else sorted((x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        out = []
        for x in files:
            step = x.size if x.path.endswith(".gz") else self.split
            out += [Range(uri(x.path), i, at, min(at + step, x.size) if step == self.split else 1 << 62) for i, at in enumerate(range(0, max(x.size, 1), max(step, 1)))]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        system, path = located(part.uri)
        with system.open_input_file(path) as raw:
            f = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            contig, head_at, run, total = None, None, 0, 0
            for at, line in _lines(f, part.first, part.end):
                text = line.strip()
                if text.startswith(b">"):
                    name = text[1:].split(None, 1)
                    if not name:
                        raise ValueError(f"header without a name in {part.uri} at byte {at}")
                    contig, head_at, run = name[0].decode(), at, 0
                    yield part.uri, part.split, "head", at, len(line), contig, head_at, 0, None
                elif text:
                    if contig is None and part.first == 0:
                        raise ValueError(f"sequence before a header in {part.uri}")
                    yield part.uri, part.split, "line", at, len(line), contig, head_at, run, text.decode("ascii").upper()
                    run, total = run + len(text), total + len(text)
            yield part.uri, part.split, "end", total, None, contig, head_at, run, None


class FastaLines(DataSource):
    """Rows of kinds head and line, and of a partition one of kind end: at has its bases, run those since its last header."""

    @classmethod
    def name(cls) -> str:
        return "fasta_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def sequence_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, contig, head_at, at, width, start, bases): a sequence's lines, start 0-based in the contig, at in the file's bytes."""
    spark.dataSource.register(FastaLines)
    rows = spark.read.format("fasta_lines").option("path", path).option("split", split).load()
    ends = rows.where("kind = 'end'").select("path", "split", F.col("at").alias("total"), "contig", "head_at", "run")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ends = ends.withColumn("past", F.coalesce(F.sum("total").over(before), F.lit(0)))
    opened = F.when(F.col("head_at").isNotNull(), F.struct("contig", "head_at", (F.col("past") + F.col("total") - F.col("run")).alias("from")))
    ends = ends.withColumn("open", F.last(opened, ignorenulls=True).over(before))
    ends = ends.select(F.col("path").alias("p"), F.col("split").alias("s"), F.col("open.contig").alias("c"), F.col("open.head_at").alias("h"), (F.col("past") - F.col("open.from")).alias("base"))
    told = rows.where("kind = 'line'").join(ends, (F.col("path") == F.col("p")) & (F.col("split") == F.col("s")))
    carried = F.col("head_at").isNull()
    return told.select("path", F.when(carried, F.col("c")).otherwise(F.col("contig")).alias("contig"), F.when(carried, F.col("h")).otherwise(F.col("head_at")).alias("head_at"), "at", "width", (F.col("run") + F.when(carried, F.col("base")).otherwise(0)).alias("start"), "bases")


def index(lines: DataFrame) -> DataFrame:
    """(path, contig, length, offset, line_bases, line_width) of sequence lines: partial sums, one row a contig.

    Lines of a contig but its last must be equally wide, the last not wider, and no blank line may stand between them:
    else a place isn't known from the index, which is an error, as is a name that two contigs have.
    """
    n = F.length("bases")
    found = lines.groupBy("path", "head_at").agg(
        F.first("contig").alias("contig"), F.sum(n).cast("bigint").alias("length"), F.min("at").alias("offset"), F.min_by(n, "at").alias("line_bases"), F.min_by("width", "at").alias("line_width"),
        F.max(n).alias("widest"), F.max_by(n, "at").alias("last"), F.count("*").alias("n"), F.max("at").alias("last_at"),
    )
    even = (F.col("widest") == F.col("line_bases")) & (F.col("length") == F.col("line_bases") * (F.col("n") - 1) + F.col("last")) & (F.col("last_at") - F.col("offset") == F.col("line_width").cast("bigint") * (F.col("n") - 1))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("contig")))
    one = found.groupBy("contig").agg(F.count("*").alias("k"), F.first(F.struct("path", "length", "offset", "line_bases", "line_width", even.alias("even"))).alias("x"))
    width = F.when(F.col("k") > 1, fail("several contigs are named ").cast("int")).when(~F.col("x.even"), fail("lines of different widths in ").cast("int")).otherwise(F.col("x.line_width"))
    return one.select("x.path", "contig", "x.length", "x.offset", "x.line_bases", width.alias("line_width"))


def write_index(spark: SparkSession, path: str, split: int = SPLIT) -> str:
    """The index file of one uncompressed sequence file, beside it, in the file's order: a row a contig, through the driver."""
    if path.endswith(".gz"):
        raise ValueError("a compressed file has no index by bytes")
    rows = index(sequence_lines(spark, path, split)).orderBy("offset").collect()
    if not rows:
        raise ValueError(f"no sequences in {path}")
    return write_text(spark, f"{path}.fai", "".join("\t".join(str(r[c]) for c in FIELDS) + "\n" for r in rows))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a sequence file from the file beside it: what write_index wrote, or any of the same five columns."""
    cells = F.split("value", "\t")
    kinds = dict.fromkeys(FIELDS, "bigint") | {"contig": "string", "line_bases": "int", "line_width": "int"}
    ok = (F.size(cells) == len(FIELDS)) & F.forall(F.slice(cells, 2, 4), lambda x: x.rlike("^[0-9]+$"))
    checked = F.when(ok, cells).otherwise(F.array(F.raise_error(F.concat(F.lit("bad index row: "), F.col("value"))).cast("string")))
    return spark.read.text(f"{path}.fai").where("value <> ''").select(F.lit(path).alias("path"), *[F.get(checked, F.lit(i)).cast(kinds[c]).alias(c) for i, c in enumerate(FIELDS)])


def _other(name: Column) -> Column:
    """The name with `chr` before it, or without."""
    return F.when(name.startswith("chr"), F.substring(name, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), name))


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, f = None, None
    for batch in batches:
        out = []
        for place, first, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if place is None or first is None:
                out.append(None if first is None else "")
                continue
            if place != uri:
                system, path = located(place)
                uri, f = place, system.open_input_file(path)
            part = f.read_at(end - first, first)
            out.append(None if len(part) < end - first else part.replace(b"\n", b"").replace(b"\r", b"").decode("ascii").upper())
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, pa.string())], [*batch.schema.names[3:], "sequence"])


def fetch(intervals: DataFrame, contigs: DataFrame, contig: str = "contig", start: str = "start", end: str = "end") -> DataFrame:
    """intervals with sequence: the upper-case bases from start to end (0-based, end not itself), read by seeking.

    contigs is an index with paths. A name is met as it is, else with or without `chr`. Null where there is no such contig
    or the interval ends beyond it, '' where it is empty; a negative start or an end before it is an error. Rows are read in
    the order of their places within each partition.
    """
    both = F.array(*[F.struct(name.alias("__key"), F.lit(rank).alias("__rank")) for rank, name in enumerate((F.col("contig"), _other(F.col("contig"))))])
    names = contigs.select(F.inline(both), F.struct("path", "length", "offset", "line_bases", "line_width").alias("__x"))  # a union would read the files once more
    names = names.groupBy("__key").agg(F.min_by("__x", "__rank").alias("__x"))
    a, b = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    fits = F.col("__x").isNotNull() & (b <= F.col("__x.length"))
    byte = lambda at: F.col("__x.offset") + F.floor(at / F.col("__x.line_bases")) * F.col("__x.line_width") + at % F.col("__x.line_bases")
    valid = F.when((a < 0) | (b < a), F.raise_error(F.concat(F.lit("bad interval: "), a.cast("string"), F.lit("-"), b.cast("string"))).cast("boolean")).otherwise(F.lit(True))
    first = F.when(valid & fits, F.when(a == b, F.col("__x.offset")).otherwise(byte(a)))
    own = intervals.join(names, F.col(contig) == F.col("__key"), "left")
    rows = own.select(F.when(fits & (b > a), F.col("__x.path")).alias("__path"), first.alias("__first"), F.when(fits, F.when(a == b, F.col("__x.offset")).otherwise(byte(b - 1) + 1)).alias("__end"), *intervals.columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in intervals.schema.fields) + ", sequence string"
    return rows.sortWithinPartitions("__path", "__first").mapInArrow(_fetched, ddl)
