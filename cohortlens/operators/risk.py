"""Gene panels, zygosity, gene comparison with odds ratios, and subjects' risk; annotation by reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.operators.scan import with_bins


def zygosity(genotype: Column) -> Column:
    calls = F.split(genotype, r"[/|]")
    a, b = F.get(calls, F.lit(0)), F.get(calls, F.lit(1))
    return F.when(a.isNull() | b.isNull() | a.isin(".", "") | b.isin(".", ""), "Unknown").when((a == "0") & (b == "0"), "Homozygous_Ref").when(a == b, "Homozygous_Alt").otherwise("Heterozygous")


def genes_at(points: DataFrame, genes: DataFrame, size: int = 1_000_000) -> DataFrame:
    """points (chrom, pos, ...) with the gene (chrom, start, end, gene) whose range has them; others go. Equality on bins, then the range."""
    g = with_bins(genes.select("chrom", "start", "end", "gene"), size, "__bin")
    p = points.withColumn("__bin", F.floor((F.col("pos") - 1) / size))
    return p.join(g, ["chrom", "__bin"]).where("pos between start and end").drop("__bin", "start", "end")


def carriers(variants: DataFrame) -> DataFrame:
    """Distinct (sample_id, gene) of genotypes that carry a variant; homozygous reference calls carry nothing."""
    return variants.where(~zygosity(F.col("gt")).isin("Homozygous_Ref")).select("sample_id", "gene").distinct()


def gene_risks(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """counts (feature, case_carriers, ..., case_frequency, control_frequency, p_value) with odds ratio and risk: weight times the excess of cases."""
    a, c = F.col("case_carriers"), F.col("control_carriers")
    b, d = F.col("case_n") - a, F.col("control_n") - c
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    ratio = F.when(zero, S.odds_ratio(a, b, c, d)).otherwise(F.try_divide(a * d, F.nullif(b * c, F.lit(0))))
    out = counts.join(weights.select("feature", "weight"), "feature", "left").withColumn("odds_ratio", ratio)
    return out.withColumn("risk", F.coalesce("weight", F.lit(1.0)) * F.greatest(F.lit(0.0), F.col("case_frequency") - F.col("control_frequency")))


def subject_risks(subjects: DataFrame, own: DataFrame, risks: DataFrame, categories: dict[str, float]) -> DataFrame:
    """(sample_id, total_risk, category, genes): sums over a subject's genes; the category is the last whose least score is reached."""
    hit = own.withColumnRenamed("gene", "feature").join(risks.where("risk > 0").select("feature", "risk"), "feature")
    sums = hit.groupBy("sample_id").agg(F.sum("risk").alias("total"), F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("genes"))
    out = subjects.select("sample_id").join(sums, "sample_id", "left").withColumn("total_risk", F.coalesce("total", F.lit(0.0)))
    category = F.lit(None).cast("string")
    for name, least in sorted(categories.items(), key=lambda x: x[1]):
        category = F.when(F.col("total_risk") >= least, name).otherwise(category)
    return out.select("sample_id", "total_risk", category.alias("category"), F.coalesce("genes", F.lit("")).alias("genes"))


def annotated(variants: DataFrame, reference: DataFrame, *columns: str) -> DataFrame:
    """Variants with columns of a reference table by (chrom, pos, ref, alt), names with and without chr alike; what it lacks is NULL."""
    bare = lambda c: F.regexp_replace(c, "(?i)^chr", "")
    ref = reference.groupBy(bare("chrom").alias("__c"), F.col("pos").alias("__p"), F.col("ref").alias("__r"), F.col("alt").alias("__a")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    return variants.join(ref, (bare(variants["chrom"]) == ref["__c"]) & (variants["pos"] == ref["__p"]) & (variants["ref"] == ref["__r"]) & (variants["alt"] == ref["__a"]), "left").drop("__c", "__p", "__r", "__a")


def new_rows(catalog: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose natural key the catalog lacks, one each."""
    return rows.dropDuplicates(list(keys)).join(catalog.select(*keys), list(keys), "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grouped_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n) of each key by itself: one pass with grouping sets."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select("x.*")
    return long.groupBy("key", "value").agg(F.count("*").alias("n"))
