"""Sinks: tables, variant files, matrices, reports and JSON documents. Sentinels for missing values exist here only."""

from __future__ import annotations

import html
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import status as T
from cohortlens.sources.files import read_text, write_text

VCF_HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ",") -> None:
    """Given columns in their order; those that df lacks are empty. Parts are written where they are: no one task takes all rows."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("overwrite").csv(path, header=True, sep=sep, emptyValue="", nullValue="")


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def with_sentinel(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(T.UNAVAILABLE)) for c in columns})


def write_vcf(lines: DataFrame, path: str) -> None:
    """lines (chrom, pos, line) as text parts in genome order; the head stands in a file of its own."""
    spark = lines.sparkSession
    lines.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "line").select("line").write.mode("overwrite").text(f"{path}/records")
    spark.createDataFrame([(VCF_HEAD,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def write_sample_vcfs(lines: DataFrame, path: str) -> None:
    """lines (sample, chrom, pos, line): a folder a sample, sorted within."""
    lines.repartition("sample").sortWithinPartitions("sample", "chrom", "pos", "line").select("sample", "line").write.mode("overwrite").partitionBy("sample").text(path)


def top_rows(df: DataFrame, n: int, *order, by: str | None = None) -> DataFrame:
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def html_table(rows: list, columns: list[str]) -> str:
    cell = lambda v: html.escape("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def write_report(path: str, title: str, summary: dict, df: DataFrame, columns: list[str], n: int = 25, *order) -> None:
    """An HTML report of a summary and the first n rows."""
    rows = top_rows(df, n, *order).select(*columns).collect()
    items = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in summary.items())
    write_text(df.sparkSession, path, f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{items}</ul>{html_table(rows, columns)}</body></html>")


def append_section(path: str, title: str, summary: dict) -> None:
    """Puts a section at the end of a report's body."""
    spark = SparkSession.active()
    text = read_text(spark, path)
    items = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in summary.items())
    section = f"<h2>{html.escape(title)}</h2><ul>{items}</ul>"
    at = text.rfind("</body>")
    write_text(spark, path, text + section if at < 0 else text[:at] + section + text[at:])


def write_json(path: str, document) -> str:
    """Through the file system that the path names, or Spark's default one, as tables are."""
    return write_text(SparkSession.active(), path, json.dumps(document, indent=2, sort_keys=True, default=str))


def read_json(path: str):
    return json.loads(read_text(SparkSession.active(), path))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share, as a URI.

    Where none is set, a session whose tasks run on this machine gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = ("file://" if default.startswith("file:") else default.rstrip("/")) + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into Parquet in the shared folder and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
