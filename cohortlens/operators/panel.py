"""Presence and detectability matrices in long form, coverage, and panel optimisation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.functions import status as T

EXACT_CANDIDATES, MOST = 22, 15


def presence(rows: DataFrame, patient: str = "patient", candidate: str = "candidate", order: str | None = None) -> DataFrame:
    """(patient, candidate, value): 1 or 0 of explicit statuses; unobserved pairs are absent. With order the last status counts, else detected wins."""
    v = rows.withColumn("value", T.observed(F.col("status"))).where("value is not null")
    agg = F.max_by("value", order) if order else F.max("value")
    return v.groupBy(patient, candidate).agg(agg.alias("value"))


def dense(rows: DataFrame, patient: str, candidate: str) -> DataFrame:
    """The 0/1 matrix in which missing is 0: for displays only."""
    return rows.groupBy(patient).pivot(candidate).agg(F.max(F.coalesce(T.observed(F.col("status")), F.lit(0)))).na.fill(0)


def wide(matrix: DataFrame, patient: str = "patient", candidate: str = "candidate", candidates: list[str] | None = None) -> DataFrame:
    """A column a candidate, with unobserved cells as text of that meaning."""
    out = matrix.groupBy(patient).pivot(candidate, candidates).agg(F.max("value").cast("string"))
    return out.na.fill(T.UNAVAILABLE)


def presence_coverage(matrix: DataFrame, selected: list[str], patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """One row: patients observed at the panel, covered by it, and the share."""
    per = matrix.where(F.col(candidate).isin(selected)).groupBy(patient).agg(F.max((F.col("value") > 0).cast("int")).alias("hit"))
    n = per.agg(F.count("*").alias("observed"), F.coalesce(F.sum("hit"), F.lit(0)).alias("covered"))
    return n.withColumn("coverage", S.observed_rate(F.col("covered"), F.col("observed")))


def candidate_coverage(matrix: DataFrame, candidate: str = "candidate") -> DataFrame:
    return matrix.groupBy(candidate).agg(F.avg((F.col("value") > 0).cast("int")).alias("coverage"), F.count("*").alias("observed"))


def _chosen(matrix: DataFrame, selected: list[str] | None, candidate: str) -> DataFrame:
    return matrix if selected is None else matrix.where(F.col(candidate).isin(selected))


def probable_coverage(matrix: DataFrame, selected: list[str] | None = None, patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """Mean over observed patients of 1 - product of misses, at selected candidates or at all."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value").cast("double")))
    per = _chosen(matrix, selected, candidate).groupBy(patient).agg((1 - F.product(1 - p)).alias("hit"))
    return per.agg(F.count("*").alias("observed"), F.avg("hit").alias("coverage"))


def detectability_matrix(patients: DataFrame, candidates: DataFrame, evidence: DataFrame, least: int = 3) -> DataFrame:
    """(patient, candidate, value): a patient's own evidence, else the candidate's; present = false gives 0, no fraction or depth NULL.

    patients (patient, present by candidate in evidence), candidates (candidate, tumor_fraction, depth, error_rate,
    background). The pairs are what is asked for; candidates are a panel, of bounded number, and are broadcast only where
    Spark finds them small.
    """
    pairs = patients.select("patient").distinct().crossJoin(candidates.select("candidate", *[F.col(c).alias(f"g_{c}") for c in ("tumor_fraction", "depth", "error_rate", "background")]))
    own = pairs.join(evidence, ["patient", "candidate"], "left")
    x = lambda c: F.coalesce(F.col(c), F.col(f"g_{c}"))
    d = S.detectability(x("tumor_fraction"), x("depth"), F.coalesce(x("error_rate"), F.lit(0.0)), x("background"), least)
    return own.select("patient", "candidate", F.when(F.col("present") == F.lit(False), 0.0).when(x("tumor_fraction").isNotNull() & x("depth").isNotNull(), d).alias("value"))


def greedy(matrix: DataFrame, k: int = MOST, min_gain: float = 0.0, by_presence: bool = False, patient: str = "patient", candidate: str = "candidate") -> list[tuple[str, float, float]]:
    """[(candidate, coverage, gain)]: the candidate that adds most, again and again; ties go to the largest id.

    A step is one aggregation over the long matrix and a table of each patient's chance of a miss; only the best
    candidate's row comes to the driver. It ends at k <= 15 or, after the first, below min_gain.
    """
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value").cast("double")))
    own = matrix.select(F.col(patient).alias("p"), F.col(candidate).alias("c"), ((F.col("value") > 0).cast("double") if by_presence else p).alias("v")).where("v is not null")
    patients = own.select("p").distinct()
    n = patients.count()
    chosen: list[tuple[str, float, float]] = []
    covered = 0.0
    while n and len(chosen) < min(k, MOST):
        names = [c for c, _, _ in chosen]
        miss = own.where(F.col("c").isin(names)).groupBy("p").agg(F.product(1 - F.col("v")).alias("m")) if names else None
        rest = own.where(~F.col("c").isin(names)) if names else own
        gain = rest.join(miss, "p", "left").withColumn("g", F.col("v") * F.coalesce("m", F.lit(1.0))) if miss is not None else rest.withColumn("g", F.col("v"))
        best = gain.groupBy("c").agg(F.sum("g").alias("g")).orderBy(F.round("g", 12).desc(), F.col("c").desc()).first()
        if best is None or (chosen and best.g / n < min_gain):
            break
        covered += best.g / n
        chosen.append((best.c, covered, best.g / n))
    return chosen


def patient_masks(matrix: DataFrame, order: list[str], patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """(mask, seen, n): how many patients have each set of hits and of observations, as bits of the candidates' places."""
    bit = F.coalesce(*[F.when(F.col(candidate) == c, F.lit(1 << i)) for i, c in enumerate(order)])
    per = matrix.where(F.col(candidate).isin(order)).groupBy(patient).agg(F.bit_or(F.when(F.col("value") > 0, bit).otherwise(0)).alias("mask"), F.bit_or(bit).alias("seen"))
    return per.groupBy("mask", "seen").agg(F.count("*").alias("n"))


def exact_presence(matrix: DataFrame, candidates: list[str], k: int, patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """(panel, size, covered, observed, coverage) of every subset of up to k of at most 22 candidates.

    Patients are counted by their bit masks first, so the pairs of subsets and masks do not grow with patients.
    """
    if len(candidates) > EXACT_CANDIDATES:
        raise ValueError(f"exact search takes at most {EXACT_CANDIDATES} candidates")
    order = sorted(candidates)
    masks = patient_masks(matrix, order, patient, candidate)
    spark = matrix.sparkSession
    subsets = spark.range(1, 1 << len(order)).select(F.col("id").cast("int").alias("s")).where(F.bit_count("s") <= k)
    joined = masks.crossJoin(F.broadcast(subsets))  # at most 2^22 integers, 16 MB
    hit = F.col("s").bitwiseAND(F.col("mask")) != 0
    seen = F.col("s").bitwiseAND(F.col("seen")) != 0
    out = joined.groupBy("s").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("observed"))
    names = F.filter(F.array(*[F.when(F.col("s").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(order)]), lambda x: x.isNotNull())
    return out.select(names.alias("panel"), F.bit_count("s").alias("size"), "covered", "observed", S.observed_rate(F.col("covered"), F.col("observed")).alias("coverage"))


def best_subset(panels: DataFrame, gain: float = 1e-12) -> tuple[list[str], float] | None:
    """Sizes in order, the best of each (first by name): a larger panel replaces the best only if it is better by `gain`."""
    rows = panels.groupBy("size").agg(F.min_by("panel", F.struct((-F.round("coverage", 12)).alias("c"), F.col("panel").alias("p"))).alias("panel"), F.max("coverage").alias("coverage")).orderBy("size").collect()
    best = None
    for r in rows:  # at most 15 sizes
        if r.coverage is not None and (best is None or r.coverage > best[1] + gain):
            best = (list(r.panel), r.coverage)
    return best




def layer_contribution(matrix: DataFrame, selected: list[str] | None, layers: dict[str, str], patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """(layer, coverage, without, delta): the panel's coverage with and without each layer's candidates, in one pass over the matrix."""
    names = sorted({x for c, x in layers.items() if selected is None or c in selected})
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value").cast("double")))
    own = _chosen(matrix, selected, candidate)
    layer = F.coalesce(*[F.when(F.col(candidate) == c, F.lit(x)) for c, x in layers.items()], F.lit(""))
    per = own.withColumn("l", layer).groupBy(patient).agg((1 - F.product(1 - p)).alias("all"), *[F.coalesce(1 - F.product(F.when(F.col("l") != n, 1 - p)), F.lit(0.0)).alias(f"w{i}") for i, n in enumerate(names)])
    sums = per.agg(F.avg("all").alias("all"), *[F.avg(f"w{i}").alias(f"w{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("layer"), F.col("all").alias("coverage"), F.col(f"w{i}").alias("without"), (F.col("all") - F.col(f"w{i}")).alias("delta")) for i, n in enumerate(names)])
    return sums.select(F.inline(rows))


def frozen_coverage(discovery: DataFrame, validation: DataFrame, selected: list[str]) -> DataFrame:
    a = presence_coverage(discovery, selected).select(F.col("coverage").alias("discovery"))
    b = presence_coverage(validation, selected).select(F.col("coverage").alias("validation"))
    return a.crossJoin(F.broadcast(b)).withColumn("delta", F.col("validation") - F.col("discovery"))  # one row each


def alpha_budget(k: Column, alpha: float = 0.05) -> Column:
    return S.sidak_alpha(alpha, F.greatest(F.lit(1), F.least(F.lit(MOST), k)))
