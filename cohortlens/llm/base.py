"""What the operators share: reading tables, the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to Python; texts may be long, so batches hold few rows.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where none is named, a session whose tasks run on this machine gets a temporary folder; on a cluster that is an error.
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


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, computed once into Parquet in the shared folder and read from there: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the memory of Python workers: whole texts go to them in batches of few rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def named(c: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + c.replace("`", "``") + "`")


def mapped(rows: DataFrame, func, new: str) -> DataFrame:
    """rows through func in Arrow batches: func drops the first column and adds those of `new`, the others pass.

    Their names may be any: mapInArrow itself takes none with dots, so they bear others meanwhile.
    """
    names = rows.columns[1:]
    plain = rows.toDF(rows.columns[0], *[f"__k{i}" for i in range(len(names))])
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:]] + [new])
    out = plain.mapInArrow(func, ddl)
    return out.toDF(*names, *out.columns[len(names) :])


def free_names(keep: list[str], names: list[str]) -> None:
    """Raises where a kept column has a name of the result, or one that starts with two underscores."""
    clash = [c for c in keep if c in names or c.startswith("__")]
    if clash:
        raise ValueError(f"kept columns have names of the result: {clash}")
