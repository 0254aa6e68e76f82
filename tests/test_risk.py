from pyspark.sql import functions as F

from cohortlens.operators import evidence as EV
from cohortlens.operators import risk


def test_zygosity(spark):
    rows = [("0/0", "Homozygous_Ref"), ("0|1", "Heterozygous"), ("1/1", "Homozygous_Alt"), ("./.", "Unknown"), ("1", "Unknown"), (None, "Unknown"), ("1/2", "Heterozygous")]
    got = spark.createDataFrame(rows, "gt string, want string").withColumn("z", risk.zygosity(F.col("gt"))).collect()
    assert all(r.z == r.want for r in got)


def test_reference_calls_carry_nothing(spark):
    v = spark.createDataFrame([("s", "g", "0/0"), ("s", "h", "0/1"), ("s", "h", "1/1")], "sample_id string, gene string, gt string")
    assert [tuple(r) for r in risk.carriers(v).collect()] == [("s", "h")]


def test_annotation_and_catalog(spark):
    v = spark.createDataFrame([("chr1", 5, "A", "T"), ("2", 5, "A", "T")], "chrom string, pos bigint, ref string, alt string")
    ref = spark.createDataFrame([("1", 5, "A", "T", "x"), ("1", 5, "A", "T", "x")], "chrom string, pos bigint, ref string, alt string, significance string")
    assert {r.chrom: r.significance for r in risk.annotated(v, ref, "significance").collect()} == {"chr1": "x", "2": None}
    assert risk.new_rows(v.where("chrom = '2'"), v, "chrom", "pos").count() == 1
    assert risk.repeated_keys(ref, "chrom", "pos").first().n == 2


def test_subject_categories(spark):
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    own = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "h")], "sample_id string, gene string")
    risks = spark.createDataFrame([("g", 0.5), ("h", 0.25), ("z", 9.0)], "feature string, risk double")
    got = {r.sample_id: (r.total_risk, r.category, r.genes) for r in risk.subject_risks(subjects, own, risks, {"low": 0.0, "mid": 0.25, "high": 0.7}).collect()}
    assert got == {"a": (0.75, "high", "g,h"), "b": (0.25, "mid", "h"), "c": (0.0, "low", "")}


def test_scores_and_buckets(spark):
    rows = [("a", 0.5, None, "yes"), ("b", 2.0, 0.5, "no"), ("c", None, None, None), ("d", 0.5, 0.5, None)]
    df = EV.constraint_flags(EV.normalized(spark.createDataFrame(rows, "candidate_id string, detectability double, blood_background_safety double, assay_available string"), ("detectability", "blood_background_safety")))
    got = {r.candidate_id: (r.bucket, r.score, r["rank"], r.used_fields) for r in EV.ranked(df, {"detectability": 3.0, "blood_background_safety": 1.0}).collect()}
    assert got["a"] == ("ranked", 0.5, 1, ["detectability"]) and got["d"][:3] == ("ranked", 0.5, 2)
    assert got["b"][:2] == ("ineligible", (3 + 0.5) / 4) and got["c"][:3] == ("unscored", None, None)
