"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into 2^bits cells of about equally many rows, by edges that are found from counts of distinct
values over the whole table; the cells' Hilbert index orders the rows, and equal runs of that order are the shards. Rows
of a shard are near each other in every dimension, so the files written from it have narrow ranges in all of them, and a
filter on any leaves most files out.

Only edges come to the driver: at most 2^bits - 1 values a dimension. Texts are measured where they are read and are not
sorted; writing shards moves them once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.base import free_names, table, written
from cohortlens.llm.ranks import in_order, numbered

BITS = 6
SHARDS = 16
LAW = "rows"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the curve of points (a row each) of 2 or more whole coordinates below 2^bits; bits times coordinates is at most 62.

    Skilling's transform: from the highest bit down, a coordinate whose bit is set inverts the lower bits of the first,
    one whose bit is not set exchanges its own with those of the first; what remains is the index's Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("an index has at most 62 bits")
    for b in range(bits - 1, 0, -1):
        low = (np.int64(1) << b) - 1
        for d in range(dims):
            on = (x[d] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (np.int64(1) << b) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | (x[d] >> b & 1)
    return index


def edges(rows: DataFrame, dim: str, bits: int) -> list:
    """2^bits - 1 ascending values: a value's cell is how many of them it reaches. Nulls come first, in cell 0.

    A value's cell is the share of rows before it, so cells hold about equally many rows, and equal values share one.
    Counts of distinct values are ranked by files and offsets; one row a cell comes to the driver.
    """
    counts = in_order(rows.groupBy(F.col(f"`{dim}`").alias("__v")).agg(F.count("*").alias("__c")), ["__v"], "hilbert-values")
    files = counts.groupBy("__part").agg(F.sum("__c").alias("__k"))
    base = F.sum("__k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__k")
    files = written(files.select(F.col("__part").alias("__p"), base.alias("__base"), F.sum("__k").over(Window.partitionBy()).alias("__n")), "hilbert-files")
    before = F.sum("__c").over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")
    placed = counts.withColumn("__before", before).join(files, F.col("__part") == F.col("__p"))
    cell = F.floor((F.col("__before") + F.col("__base")) * F.lit(1 << bits) / F.col("__n")).cast("int")
    first = {r["__cell"]: r["__v"] for r in placed.groupBy(cell.alias("__cell")).agg(F.min("__v").alias("__v")).collect()}
    out: list = [None] * (1 << bits)
    for k in range((1 << bits) - 1, 0, -1):
        out[k] = first.get(k, out[k + 1] if k + 1 < len(out) else None)
    return out[1:]


def cell_of(value: Column, ascending: list, kind: str, bits: int) -> Column:
    """The cell of a value by binary search among edges; null is in cell 0, and edges that are null (above all) are never reached."""
    if all(e is None for e in ascending):
        return F.lit(0)
    known = F.array(*[F.lit(e).cast(kind) for e in ascending])
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.element_at(known, at + s) <= value, F.lit(False)), s).otherwise(0))


def curve(bits: int):
    """A column function: the Hilbert index of cells; only these whole numbers go to Python, in Arrow batches."""

    @F.pandas_udf("bigint")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index


def shards(rows: DataFrame, dims: list[str], order: list[str], shard_count: int = SHARDS, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """(keep..., curve, shard, slot): rows in runs along the curve, counts at most one apart, slots gapless from 0 in a shard.

    Rows of one curve index follow `order` (nulls first), equal ones in any order, so a rerun gives equal rows the same
    set of places. dims are columns that can be compared, two or more; nulls are least. With fewer rows than shards
    some shards have none, an empty table has no rows. keep may not hold a name of the result or one that starts with
    "__" (ValueError).
    """
    keep = list(order) if keep is None else keep
    free_names(keep, ["curve", "shard", "slot"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    slim = rows.select(*[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(dims)], *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    slim = written(slim, "hilbert-rows")
    cells = [cell_of(F.col(f"__d{i}"), edges(slim, f"__d{i}", bits), kinds[c], bits) for i, c in enumerate(dims)]
    placed = slim.select("*", curve(bits)(*cells).alias("__curve")).drop(*[f"__d{i}" for i in range(len(dims))])
    ranked = numbered(in_order(placed, ["__curve", *[f"__o{i}" for i in range(len(order))]], "hilbert"), [], "hilbert")
    shard = F.expr(f"__i * {shard_count} div __n")
    first = F.expr(f"(shard * __n + {shard_count} - 1) div {shard_count}")
    return ranked.withColumn("shard", shard.cast("int")).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__curve").alias("curve"), "shard", (F.col("__i") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int) -> None:
    """Parquet files below path/shard=N, rows in their slots' order, at most rows_per_file a file: each file is a short run of the curve."""
    n = sharded.withColumn("__run", F.floor(F.col("slot") / rows_per_file))
    n.repartition("shard", "__run").sortWithinPartitions("shard", "__run", "slot").drop("__run").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def file_ranges(spark, path: str, dims: list[str]) -> DataFrame:
    """(file, rows, then for each dimension d: d_min, d_max, d_nulls): what a reader needs to leave files out, itself a table."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
    own = [x for d in dims for x in (F.min(f"`{d}`").alias(f"{d}_min"), F.max(f"`{d}`").alias(f"{d}_max"), F.count_if(F.col(f"`{d}`").isNull()).alias(f"{d}_nulls"))]
    return files.agg(F.count("*").alias("rows"), *own)


def touched(ranges: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """The files that may hold rows within all the closed ranges {dimension: (least, most)}."""
    return reduce(lambda df, x: df.where((F.col(f"`{x[0]}_min`") <= F.lit(x[1][1])) & (F.col(f"`{x[0]}_max`") >= F.lit(x[1][0]))), wanted.items(), ranges)


def op12(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 runs along the curve of language, source and size."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "lang", "source", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shards(slim, ["lang", "source", "size"], ["doc_id", "text_crc32"], keep=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
