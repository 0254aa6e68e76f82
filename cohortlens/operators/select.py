"""Case, sample and file selection, manifests, deduplication and baseline models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import variants as V


def paired_cases(samples: DataFrame) -> DataFrame:
    """samples (case_id, sample_id, class) -> a row a case: first tumour, best normal (blood before solid), and whether both exist."""
    of = lambda keep, rank: F.min_by("sample_id", F.when(keep, F.struct(rank.alias("r"), F.col("sample_id"))))
    c = F.col("class")
    rank = F.when(c == "NORMAL_BLOOD", 0).otherwise(1)
    out = samples.groupBy("case_id").agg(F.min(F.when(c == "TUMOR", F.col("sample_id"))).alias("tumor"), of(c.startswith("NORMAL"), rank).alias("normal"))
    return out.withColumn("paired", F.col("tumor").isNotNull() & F.col("normal").isNotNull())


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def primary_files(files: DataFrame, workflows: list[str], types: list[str]) -> DataFrame:
    """files (file_id, file_name, workflow, data_type, case_ids array) -> the best file of each case: workflow, type, name, id."""
    place = lambda c, names: F.coalesce(*[F.when(F.lower(c) == n.lower(), i) for i, n in enumerate(names)], F.lit(len(names)))
    long = files.withColumn("case_id", F.explode("case_ids"))
    return first_per(long, "case_id", place(F.col("workflow"), workflows), place(F.col("data_type"), types), "file_name", "file_id")


def open_subset(files: DataFrame, cases: DataFrame, limit: int) -> DataFrame:
    """One open file of each paired case, of the first `limit` cases by id."""
    own = files.where(F.lower("access") == "open").withColumn("case_id", F.explode("case_ids")).join(cases.where("paired").select("case_id"), "case_id", "left_semi")
    return first_per(own, "case_id", "file_name", "file_id").orderBy("case_id").limit(limit)


def variant_files(files: DataFrame, kind: str = "SNV_INDEL", access: str | None = None, strategy: str | None = None, cases: DataFrame | None = None) -> DataFrame:
    out = files.where(V.file_kind(F.concat_ws(" ", "data_category", "data_type", "file_name")) == kind)
    out = out.where(F.lower("access") == access.lower()) if access else out
    out = out.where(F.lower("experimental_strategy") == strategy.lower()) if strategy else out
    if cases is None:
        return out
    hit = out.select("file_id", F.explode("case_ids").alias("case_id")).join(cases.select("case_id"), "case_id", "left_semi").select("file_id").distinct()
    return out.join(hit, "file_id", "left_semi")


def stratified(df: DataFrame, stratum: str, n: int, order: str) -> DataFrame:
    """n rows dealt evenly to the strata, the first strata by name one more each, in order within a stratum."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    names = df.select(stratum).distinct().withColumn("__i", F.row_number().over(Window.orderBy(stratum))).withColumn("__k", F.count("*").over(Window.partitionBy()))
    quota = F.floor(F.lit(n) / F.col("__k")) + (F.col("__i") <= n % F.col("__k")).cast("int")
    return ranked.join(names, stratum).where(F.col("__r") <= quota).drop("__r", "__i", "__k")


def nested_samples(cases: DataFrame) -> DataFrame:
    """cases (case_id, samples array of structs) -> a row a sample, classified; the first of a repeated (case, sample); cases without samples stay."""
    s = cases.select("case_id", F.posexplode_outer("samples").alias("pos", "s")).select("case_id", "pos", "s.*")
    s = s.withColumn("class", V.sample_class(F.col("sample_type"), F.col("tissue_type")))
    return s.withColumn("__r", F.row_number().over(Window.partitionBy("case_id", "sample_id").orderBy("pos"))).where("__r = 1").drop("__r", "pos")


def acquisition_manifest(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    out = files.withColumn("kind", V.file_kind(F.concat_ws(" ", "data_category", "data_type", "file_name")))
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def kind_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_bytes"))


def verified(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files (path, md5sum, file_size) against hashes (path, length, md5, sha256) of a listing: whether sum and size agree; what isn't stated passes."""
    have = hashes.select("path", "md5", F.col("length").alias("size"), "sha256")
    out = files.join(have, "path", "left")
    return out.withColumn("verified", F.col("md5").isNotNull() & F.coalesce(F.lower("md5sum") == F.col("md5"), F.lit(True)) & F.coalesce(F.col("file_size") == F.col("size"), F.lit(True)))


def distinct_records(df: DataFrame) -> DataFrame:
    """Exact distinct rows; NaN is an error, as it equals nothing."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in doubles:
        bad = bad | F.isnan(F.coalesce(F.col(c), F.lit(0.0)))
    checked = df.where(F.when(bad, F.raise_error("NaN in a record")).otherwise(F.lit(True))) if doubles else df
    return checked.distinct()


def median_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns with NULL as the median: one aggregation."""
    m = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return df.fillna({c: float(m[c]) for c in columns if m[c] is not None})


def baseline_model(df: DataFrame, columns: list[str], label: str = "label", elastic: float = 0.0, strength: float = 0.01, intercept: bool = True):
    """A regularised logistic regression; -> the fitted model and (column, coefficient) by size."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    labels = {r[0] for r in df.select(label).distinct().limit(3).collect()}
    if labels != {0, 1}:
        raise ValueError("labels are 0 and 1, and both occur")
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(median_imputed(df, columns))
    model = LogisticRegression(labelCol=label, elasticNetParam=elastic, regParam=strength, fitIntercept=intercept, maxIter=100).fit(data)
    return model, sorted(zip(columns, model.coefficients.toArray().tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))
