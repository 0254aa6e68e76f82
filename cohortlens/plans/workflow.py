"""The whole analysis as one chain of DataFrames, with written stages and a manifest; and its command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.operators import cohort as C
from cohortlens.operators import evidence as E
from cohortlens.operators import panel as P
from cohortlens.plans import contracts as K
from cohortlens.sources import fasta, sinks, tables, vcf

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(df: DataFrame, stages: list[Stage]) -> tuple[DataFrame, list[str]]:
    """Stages in order; names are unique and not blank, and each returns a DataFrame."""
    names = [n for n, _ in stages]
    if len(set(names)) != len(names) or not all(n.strip() for n in names):
        raise ValueError("stage names are unique and not blank")
    for name, stage in stages:
        df = df.transform(stage)
        if not isinstance(df, DataFrame):
            raise TypeError(f"stage {name} gave no DataFrame")
    return df, names


def analyze(samples: DataFrame, carriers: DataFrame, alpha: float = 0.05, annotations: DataFrame | None = None, functional: DataFrame | None = None) -> DataFrame:
    """Compared, corrected, annotated and ranked candidates of two groups' carriers."""
    out = S.benjamini_hochberg(C.carrier_comparison(samples, carriers)).withColumn("significant", F.col("q_value") <= alpha)
    none = out.select("feature").limit(0)
    return E.discover(out, annotations if annotations is not None else none, functional if functional is not None else none)


def analyze_cohorts(spark: SparkSession, cases: str, controls: str, output: str, alpha: float = 0.05) -> dict:
    """Two directories of variant files -> variant and gene tables, a report and a run record below output."""
    run = K.RunRecord(config={"cases": cases, "controls": controls, "alpha": alpha})
    (s1, v1), (s2, v2) = vcf.read_cohort(spark, cases, "case"), vcf.read_cohort(spark, controls, "control")
    samples, variants = s1.unionByName(s2), v1.unionByName(v2)
    found = analyze(samples, variants.select("sample_id", F.col("variant_key").alias("feature")), alpha)
    genes = S.benjamini_hochberg(C.carrier_comparison(samples, variants.select("sample_id", F.col("gene").alias("feature"))))
    sinks.write_parquet(samples, f"{output}/variants/samples")
    sinks.write_parquet(found, f"{output}/variants/candidates")
    sinks.write_parquet(genes, f"{output}/variants/genes")
    done = spark.read.parquet(f"{output}/variants/candidates")
    n = done.agg(F.count("*").alias("features"), F.count_if("significant").alias("significant")).first().asDict()
    sinks.write_report(f"{output}/variants/report.html", "Cohort comparison", n, done, ["rank", "feature", "case_carriers", "control_carriers", "p_value", "q_value", "score"], 25, "rank")
    record = K.as_document(run.complete()) | {"summary": n}
    sinks.write_json(f"{output}/variants/run.json", record)
    return record


def final_panel(ranked: DataFrame, matrix: DataFrame, k: int = P.MOST, min_gain: float = 0.02, alpha: float = 0.05, key: str = "candidate_id") -> dict:
    """The panel of ranked candidates: exact where they are few, else greedy; with the level of each of its tests."""
    names = [r[0] for r in ranked.where("bucket = 'ranked'").select(key).orderBy("rank").limit(P.EXACT_CANDIDATES + 1).collect()]
    if len(names) <= P.EXACT_CANDIDATES:
        best = P.best_subset(P.exact_presence(matrix, names, min(k, len(names))), max(min_gain, 1e-12)) if names else None
        chosen, coverage, how = (best[0], best[1], "exact") if best else ([], None, "exact")
    else:
        own = matrix.join(ranked.where("bucket = 'ranked'").select(F.col(key).alias("candidate")), "candidate", "left_semi")
        steps = P.greedy(own, k, min_gain, by_presence=True)
        chosen, coverage, how = [c for c, _, _ in steps], steps[-1][1] if steps else None, "greedy"
    return {"panel": chosen, "coverage": coverage, "method": how, "alpha_each": 1 - (1 - alpha) ** (1 / max(1, len(chosen)))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohortlens")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"cohort": ("cases", "controls", "output"), "segments": ("input", "output"), "maf": ("input", "output"), "features": ("input", "output"), "hashes": ("input", "output"), "normalize": ("input", "reference", "output")}.items():
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
        q.add_argument("--alpha", type=float, default=0.05)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cohortlens").getOrCreate()
    if a.command == "cohort":
        print(json.dumps(analyze_cohorts(spark, a.cases, a.controls, a.output, a.alpha), default=str))
    elif a.command == "segments":
        rows = tables.read_segments(spark, a.input).withColumn("region", F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
        sinks.write_parquet(C.copy_number_comparison(rows, "region"), a.output)
    elif a.command == "maf":
        sinks.write_sample_vcfs(tables.maf_vcf_lines(tables.read_maf(spark, a.input)), a.output)
    elif a.command == "features":
        rows = tables.read_features(spark, a.input).withColumnRenamed("patient", "sample_id")
        rows = rows.withColumn("grp", F.col("group") if "group" in rows.columns else F.lit(None).cast("string"))
        sinks.write_parquet(C.exact_scan(rows, a.alpha), a.output)
    elif a.command == "normalize":
        report = vcf.normalize_batch(spark, a.input, fasta.read_fasta(spark, a.reference), f"{a.output}/files")
        sinks.write_parquet(report, f"{a.output}/report")
    else:
        sinks.write_parquet(tables.file_hashes(spark, a.input), a.output)
    return 0
