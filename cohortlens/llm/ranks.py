"""Ranks over whole tables: a range sort, places within the sorted files, and one offset a file and group.

No window runs over the rows: a sorted file's row number is the place, and only one row a file and group is summed up.
Rows equal in all order columns are parted by their place in the input, so a row that is repeated without end is no
task's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.base import shared_dir, written


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written in ascending order (nulls first), with __part and __row: files in order and places from 0 in each."""
    spark = rows.sparkSession
    stored = written(rows, f"{name}-rows").select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__salt"))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col("__salt")]
    parts = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__part", F.spark_partition_id())
    path = shared_dir(spark, f"{name}-sorted")
    parts.write.option("maxRecordsPerFile", 0).parquet(path)  # a file a task
    return spark.read.schema(parts.schema).parquet(path).select("*", F.col("_metadata.row_index").alias("__row"))


def numbered(ordered: DataFrame, group: list[str], name: str) -> DataFrame:
    """ordered (by group first) with __i, its rank from 0 in its group, and __n, the rows of the group.

    group may be empty: then ranks run over all rows. The windows run over one row a file and group.
    """
    key = [F.col(f"`{c}`") for c in group]
    marks = ordered.groupBy(*key, "__part").agg(F.min("__row").alias("__lo"), F.count("*").alias("__k"))
    w = Window.partitionBy(*key)
    before = F.coalesce(F.sum("__k").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select(*[k.alias(f"__g{i}") for i, k in enumerate(key)], F.col("__part").alias("__p"), (before - F.col("__lo")).alias("__base"), F.sum("__k").over(w).alias("__n"))
    marks = written(marks, f"{name}-marks")
    same = ordered["__part"] == marks["__p"]
    for i, c in enumerate(group):
        same = same & ordered[f"`{c}`"].eqNullSafe(marks[f"__g{i}"])
    out = ordered.join(marks, same)
    return out.withColumn("__i", F.col("__row") + F.col("__base")).drop("__p", "__base", "__part", "__row", *[f"__g{i}" for i in range(len(group))])
