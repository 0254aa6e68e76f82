"""Rows that break a format's rules are set apart with their reasons, in the pass that writes the others.

A rule is a named condition that a good row meets; a row's reasons are the names of those it doesn't, all of them. Rows
are written once, parted by whether they have any, so that neither table is computed for the other and no bad row ends a
job. What a rule can't tell (null) is broken.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import status as T
from cohortlens.sources import tables as TB
from cohortlens.sources import vcf

SCHEMA = "sample_id string, reasons array<string>, module string, noted_at string, row string"


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def parted(rows: DataFrame, rules: dict[str, Column], path: str, module: str, sample: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of rows, both read from the one table written below path.

    accepted has rows' columns; quarantine has sample_id, reasons, module, noted_at and the row as JSON. sample names the
    sample of a row, null where none is known. An empty table gives two empty ones. Columns may not begin with `__`.
    """
    taken = [c for c in rows.columns if c.startswith("__")]
    if taken:
        raise ValueError(f"columns that are reserved: {taken}")
    noted = datetime.now(UTC).isoformat()
    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns], reasons(rules).alias("__reasons"), (sample if sample is not None else F.lit(None)).cast("string").alias("__sample"))
    kept = kept.withColumn("__accepted", F.size("__reasons") == 0)
    kept.write.mode("overwrite").partitionBy("__accepted").parquet(path)
    back = rows.sparkSession.read.schema(kept.schema).parquet(path)
    own = [F.col(f"`{c}`") for c in rows.columns]
    bad = back.where(~F.col("__accepted")).select(F.col("__sample").alias("sample_id"), F.col("__reasons").alias("reasons"), F.lit(module).alias("module"), F.lit(noted).alias("noted_at"), F.to_json(F.struct(*own)).alias("row"))
    return back.where("__accepted").select(*own), bad


def counts(quarantine: DataFrame) -> DataFrame:
    """(module, reason, rows, samples): a row with several reasons counts for each."""
    return quarantine.select("module", "sample_id", F.explode("reasons").alias("reason")).groupBy("module", "reason").agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("samples"))


def _whole(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*\d+\s*$"), F.lit(False))


def segments(spark: SparkSession, path: str, store: str, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments as tables.read_segments gives them, quarantine) of a copy-number file."""
    raw = TB.raw_segments(spark, path)
    pick = lambda k: T.first_of(list(TB.CNV_ALIASES[k]), raw.columns)
    start, end = pick("start"), pick("end")
    given = lambda k: pick(k).isNull() | (F.trim(pick(k)) == "") | pick(k).try_cast("double").isNotNull()
    rules = {
        "missing sample": F.trim(pick("sample_id")) != "",
        "missing chromosome": F.trim(pick("chrom")) != "",
        "bad start": _whole(start) & (start.try_cast("bigint") >= 1),
        "bad end": _whole(end) & (end.try_cast("bigint") >= F.coalesce(start.try_cast("bigint"), F.lit(1))),
        "bad number": given("copy_number") & given("log2_ratio"),
    }
    good, bad = parted(raw, rules, store, "copy number", pick("sample_id"))
    return TB.segment_rows(good, group), bad


def features(spark: SparkSession, path: str, store: str) -> tuple[DataFrame, DataFrame]:
    """(features as tables.read_features gives them, quarantine) of a feature file."""
    raw = TB.required(spark.read.csv(path, header=True), TB.FEATURE_FIELDS)
    rules = {"missing patient": F.trim("patient") != "", "missing region": F.trim("region") != "", "unknown feature type": F.upper(F.trim("feature_type")).isin(*T.FEATURE_TYPES)}
    good, bad = parted(raw, rules, store, "features", F.col("patient"))
    return TB.feature_rows(good), bad


def variant_lines(spark: SparkSession, path: str | list[str], store: str) -> tuple[DataFrame, DataFrame]:
    """(file, at, line of good records, quarantine) of variant files; header lines are neither."""
    text = vcf.lines(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    f = F.split("line", "\t")
    rules = {
        "too few columns": F.size(f) >= 8,
        "missing chromosome": F.trim(F.get(f, F.lit(0))) != "",
        "bad position": _whole(F.get(f, F.lit(1))) & (F.get(f, F.lit(1)).try_cast("bigint") >= 1),
        "bad reference allele": F.get(f, F.lit(3)).rlike("^[ACGTNacgtn]+$"),
        "missing alternate allele": F.trim(F.get(f, F.lit(4))) != "",
    }
    return parted(text.select("file", "at", "line"), rules, store, "variants", F.regexp_extract("file", r"([^/]+?)(\.vcf)?(\.gz)?$", 1))
