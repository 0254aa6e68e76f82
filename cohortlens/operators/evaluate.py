"""Predictions, thresholds, splits, rank metrics and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import status as T


def binary_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = "label", empty: float | None = None) -> DataFrame:
    """One row of counts and rates at score >= threshold; empty denominators give `empty`."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(empty).cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"sensitivity": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "precision": rate(tp, tp + fp), "accuracy": rate(tp + tn, tp + tn + fp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg): what curves need, summed in the tasks; as many rows as there are distinct scores."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank-sum area under the curve, ties by half; NULL without both labels."""
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    c = score_counts(df, score, label).withColumn("less", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)), F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", order: str = "id") -> DataFrame:
    """Mean over positives of precision at their rank, by score and then `order`.

    Ranks are found per score first and within a score after, so a window never holds more than one score's rows.
    """
    own = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = score_counts(own, score, label).select(F.col("score").alias("s"), F.coalesce(F.sum(F.col("pos") + F.col("neg")).over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("p0"))
    within = Window.partitionBy(score).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = own.select(F.col(score).alias("s"), F.col(label).alias("y"), F.row_number().over(Window.partitionBy(score).orderBy(order)).alias("n"), F.sum(label).over(within).alias("p")).join(base, "s")
    return r.agg(F.try_divide(F.sum(F.when(F.col("y") == 1, (F.col("p0") + F.col("p")) / (F.col("n0") + F.col("n")))), F.nullif(F.sum("y"), F.lit(0))).alias("average_precision"))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label", objective: str = "youden") -> DataFrame:
    """The threshold (least score, midpoints, greatest) with the best objective, ties to the smallest: windows over distinct scores."""
    c = score_counts(df, score, label)
    up, all_rows = Window.orderBy("score"), Window.partitionBy()
    c = c.withColumns({"p_below": F.coalesce(F.sum("pos").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n_below": F.coalesce(F.sum("neg").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "prev": F.lag("score").over(up), "p_all": F.sum("pos").over(all_rows), "n_all": F.sum("neg").over(all_rows)})
    tp, fp = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    t = F.coalesce((F.col("prev") + F.col("score")) / 2, F.col("score"))
    value = {
        "youden": tp / F.nullif(F.col("p_all"), F.lit(0)) - fp / F.nullif(F.col("n_all"), F.lit(0)),
        "f1": F.try_divide(2 * tp, F.nullif(2 * tp + fp + F.col("p_below"), F.lit(0))),
        "accuracy": (tp + F.col("n_below")) / (F.col("p_all") + F.col("n_all")),
    }[objective]
    return c.select(t.alias("threshold"), value.alias("value")).where("value is not null").orderBy(F.round("value", 12).desc(), "threshold").limit(1)


def frozen_evaluation(df: DataFrame, patient: str = "patient_id", split: str = "split", score: str = "score", label: str = "label", objective: str = "f1") -> DataFrame:
    """A row a held-out split, validation and test: status, leaked, threshold, its value, and rates at the threshold that discovery rows fit.

    Only rows of the split `discovery` reach the fit, as a filter of the plan. Patients of more than one split are counted in the
    same plan: if there are any, both rows have status FAIL and neither a threshold nor rates. A split without rows that have
    a score and a label, or discovery rows that fit no threshold, are "Data unavailable", with NULLs. Rows without a
    patient can't leak; rows of other splits, or none, count as neither.
    """
    known = df.where(F.col(split).isin("discovery", "validation", "test"))
    leaked = known.where(F.col(patient).isNotNull()).groupBy(patient).agg(F.min(split).alias("a"), F.max(split).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("leaked"))
    fitted = best_threshold(known.where(F.col(split) == "discovery"), score, label, objective)
    at = df.sparkSession.range(1).select(leaked.scalar().alias("leaked"), fitted.select("threshold").scalar().alias("threshold"), fitted.select("value").scalar().alias("fit_value"))
    hit, pos = F.col(score) >= fitted.select("threshold").scalar(), F.col(label) == 1
    seen = known.where((F.col(split) != "discovery") & F.col(score).isNotNull() & F.col(label).isNotNull())
    n = seen.groupBy(F.col(split).alias("split")).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    out = at.withColumn("split", F.explode(F.array(F.lit("validation"), F.lit("test")))).join(n, "split", "left")
    status = F.when(F.col("leaked") > 0, "FAIL").when(F.col("threshold").isNull() | F.col("tp").isNull(), T.UNAVAILABLE).otherwise("Available")
    out = out.withColumn("status", status)
    shown = lambda c: F.when(F.col("status") == "Available", c)
    rate = lambda a, b: shown(F.try_divide(a, F.nullif(b, F.lit(0))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"sensitivity": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "precision": rate(tp, tp + fp), "accuracy": rate(tp + tn, tp + tn + fp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)}
    fit = [F.when(F.col("leaked") == 0, F.col(c)).alias(c) for c in ("threshold", "fit_value")]
    return out.select("split", "status", "leaked", *fit, *[shown(F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")], *[c.alias(k) for k, c in rates.items()])


def duplicated_ids(df: DataFrame, key: str = "patient_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def patient_split(df: DataFrame, key: str, stratum: str | None = None, validation: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, stratum, split): ids once each, in a seeded hash order within strata, floor sizes: test, then validation, the rest discovery.

    Ids with several values of the stratum form the stratum `unknown`.
    """
    s = F.when(F.count_distinct(stratum) == 1, F.max(F.col(stratum).cast("string"))).otherwise("unknown") if stratum else F.lit("all")
    ids = df.where(F.col(key).isNotNull()).groupBy(key).agg(s.alias("stratum"))
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    r = ids.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("stratum"))})
    a, b = F.floor(F.col("n") * test), F.floor(F.col("n") * validation)
    return r.select(key, "stratum", F.when(F.col("i") <= a, "test").when(F.col("i") <= a + b, "validation").otherwise("discovery").alias("split"))


def pareto(df: DataFrame, cost: str = "cost", value: str = "recall") -> DataFrame:
    """Rows that no cheaper (or equally cheap, better) row reaches: running maximum over cost."""
    before = Window.orderBy(F.col(cost), F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__best", F.max(value).over(before)).where(F.col("__best").isNull() | (F.col(value) > F.col("__best"))).drop("__best")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def quality_gate(schema_ok: bool, complete: bool, artifacts_ok: bool, leakage: str) -> str:
    if leakage == "FAIL" or not schema_ok:
        return "FAIL"
    return "PASS" if complete and artifacts_ok and leakage == "PASS" else "CONDITIONAL"
