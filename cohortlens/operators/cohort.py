"""Two-group comparison of carriers and observations, panels of normals, backgrounds, rates and design checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.functions import status as T

BACKGROUND_SOURCES = ("healthy_plasma", "wbc", "pon", "gnomad", "chip", "observed")
DESIGN_FIELDS = ("platform", "batch", "center", "sex", "age_group", "library", "assay", "site", "stage")


def carrier_comparison(samples: DataFrame, carriers: DataFrame) -> DataFrame:
    """samples (sample_id, grp), carriers (sample_id, feature) -> counts, frequencies, difference, ratio and Fisher p by feature.

    Denominators are whole groups. Carriers are made distinct before they are counted, and counts are summed in the
    tasks before the shuffle. The group sizes are two numbers. The ratio is infinite where only cases carry, and 1 where
    nobody does.
    """
    sizes = samples.groupBy().agg(F.count_if(F.col("grp") == "case").alias("case_n"), F.count_if(F.col("grp") == "control").alias("control_n"))
    own = carriers.where("feature is not null").select("sample_id", "feature").distinct().join(samples.select("sample_id", "grp"), "sample_id")
    counts = own.groupBy("feature").agg(F.count_if(F.col("grp") == "case").alias("case_carriers"), F.count_if(F.col("grp") == "control").alias("control_carriers"))
    out = counts.crossJoin(F.broadcast(sizes))  # one row of two sizes
    cf, tf = S.observed_rate(F.col("case_carriers"), F.col("case_n")), S.observed_rate(F.col("control_carriers"), F.col("control_n"))
    ratio = F.when((cf == 0) & (tf == 0), 1.0).when(tf == 0, float("inf")).otherwise(cf / F.nullif(tf, F.lit(0.0)))
    p = S.fisher_exact(F.col("case_carriers"), F.col("case_n") - F.col("case_carriers"), F.col("control_carriers"), F.col("control_n") - F.col("control_carriers"))
    return out.select("feature", "case_carriers", "control_carriers", "case_n", "control_n", cf.alias("case_frequency"), tf.alias("control_frequency"), (cf - tf).alias("frequency_difference"), ratio.alias("ratio"), p.alias("p_value"))


def patient_states(obs: DataFrame, *keys: str) -> DataFrame:
    """obs (sample_id, grp, status, keys) -> value 1, 0 or NULL of each patient and key: detected wins, unobserved stays NULL."""
    return obs.groupBy("sample_id", "grp", *keys).agg(F.max(T.observed(F.col("status"))).alias("value"))


def observed_comparison(obs: DataFrame, *keys: str) -> DataFrame:
    """Detected and observed patients of each group by keys; denominators count observed patients only.

    Where a group was not observed its rate is NULL, p is 1 and the effect 0.
    """
    per = patient_states(obs, *keys)
    count = lambda g, v: F.count_if((F.col("grp") == g) & v)
    out = per.groupBy(*keys).agg(
        count("case", F.col("value") == 1).alias("case_detected"), count("case", F.col("value").isNotNull()).alias("case_observed"),
        count("control", F.col("value") == 1).alias("control_detected"), count("control", F.col("value").isNotNull()).alias("control_observed"),
    )
    both = (F.col("case_observed") > 0) & (F.col("control_observed") > 0)
    cf, tf = S.observed_rate(F.col("case_detected"), F.col("case_observed")), S.observed_rate(F.col("control_detected"), F.col("control_observed"))
    p = S.fisher_exact(F.col("case_detected"), F.col("case_observed") - F.col("case_detected"), F.col("control_detected"), F.col("control_observed") - F.col("control_detected"))
    return out.withColumns({"case_rate": cf, "control_rate": tf, "effect": F.when(both, F.abs(cf - tf)).otherwise(0.0), "p_value": F.when(both, p).otherwise(1.0)})


def continuous_comparison(values: DataFrame, *keys: str) -> DataFrame:
    """values (sample_id, grp, value, keys): means of patients' means in each group, their difference and Cohen's d."""
    per = values.where("value is not null").groupBy("sample_id", "grp", *keys).agg(F.avg("value").alias("v"))
    of = lambda g: F.when(F.col("grp") == g, F.col("v"))
    out = per.groupBy(*keys).agg(*[x for g in ("case", "control") for x in (F.count(of(g)).alias(f"{g}_n"), F.avg(of(g)).alias(f"{g}_mean"), F.var_samp(of(g)).alias(f"__{g}_var"))])
    d = S.standardized_difference(F.col("case_n"), F.col("case_mean"), F.col("__case_var"), F.col("control_n"), F.col("control_mean"), F.col("__control_var"))
    return out.withColumns({"mean_difference": F.col("case_mean") - F.col("control_mean"), "cohen_d": d}).drop("__case_var", "__control_var")


def feature_values(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (sample_id, grp, feature_type, status, keys; value columns of status.MEASURES) -> (sample_id, grp, keys, feature_type, o, m) of cases and controls.

    grp is case or control, feature_type upper case, SNV where blank, o 1, 0 or null as observed, m the number of a measured type.
    """
    kind = T.feature_type(F.col("feature_type"))
    own = rows.select("sample_id", T.group_of(F.col("grp")).alias("grp"), *keys, kind.alias("feature_type"), T.observed(F.col("status")).alias("o"), T.measure(kind, rows.columns).alias("m"))
    return own.where("grp is not null")


def value_stats(values: DataFrame, *keys: str) -> DataFrame:
    """feature_stats of feature_values."""
    per = values.groupBy("sample_id", "grp", "feature_type", *keys).agg(F.max("o").alias("o"), F.avg("m").alias("m"), F.count_if(F.col("o") == 1).alias("e"))
    both = []
    for g in ("case", "control"):
        here = F.col("grp") == g
        both += [F.count_if(here).alias(f"{g}_n"), F.sum(F.when(here, F.col("e")).otherwise(0)).alias(f"{g}_events"), F.count_if(here & (F.col("o") == 1)).alias("__d" + g), F.count_if(here & F.col("o").isNotNull()).alias("__o" + g), F.count(F.when(here, F.col("m"))).alias("__m" + g), F.avg(F.when(here, F.col("m"))).alias(f"{g}_mean")]
    out = per.groupBy(*keys, "feature_type").agg(*both)
    measured = F.col("feature_type").isin(*T.MEASURES)
    for g in ("case", "control"):
        out = out.withColumns({f"{g}_detected": F.when(measured, F.col("__m" + g)).otherwise(F.col("__d" + g)), f"{g}_observed": F.when(measured, F.col("__m" + g)).otherwise(F.col("__o" + g)), f"{g}_mean": F.when(measured, F.col(f"{g}_mean"))})
        out = out.withColumn(f"{g}_rate", F.when(~measured, S.observed_rate(F.col(f"{g}_detected"), F.col(f"{g}_observed"))))
    difference = F.abs(F.when(measured, F.col("case_mean") - F.col("control_mean")).otherwise(F.col("case_rate") - F.col("control_rate")))
    return out.withColumn("effect", F.coalesce(difference, F.lit(0.0))).select(*keys, "feature_type", *[f"{g}_{x}" for x in ("n", "detected", "observed", "rate", "mean", "events") for g in ("case", "control")], "effect")


def feature_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (sample_id, grp, feature_type, status, keys; value columns of status.MEASURES) -> a row a key and type.

    Types that are detected or not compare rates among observed patients, measured types means of patients' means; a
    type is upper case, SNV where blank. effect is the absolute difference, 0 where a group has no value. case_n and
    control_n count patients with any row, case_events and control_events detected rows. Two partial aggregations, the
    first by patient.
    """
    return value_stats(feature_values(rows, *keys), *keys)


def tested_values(values: DataFrame, *keys: str, draws: int | None = None) -> DataFrame:
    """tested of feature_values."""
    from cohortlens.operators import resample as R

    out = value_stats(values, *keys)
    measured = values.where(F.col("feature_type").isin(*T.MEASURES)).select("sample_id", "grp", *keys, "feature_type", F.col("m").alias("value"))
    p = R.permutation_tests(measured, *keys, "feature_type", draws=draws or R.SCAN_DRAWS).select(*keys, "feature_type", F.col("p_value").alias("__p"))
    both = (F.col("case_observed") > 0) & (F.col("control_observed") > 0)
    exact = S.fisher_exact(F.col("case_detected"), F.col("case_observed") - F.col("case_detected"), F.col("control_detected"), F.col("control_observed") - F.col("control_detected"))
    value = F.when(F.col("feature_type").isin(*T.MEASURES), F.coalesce("__p", F.lit(1.0))).when(both, exact).otherwise(1.0)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # Fisher's test is work on small rows, not to be coalesced
    return out.join(p, [*keys, "feature_type"], "left").repartition(tasks).withColumn("p_value", value).drop("__p")


def tested(rows: DataFrame, *keys: str, draws: int | None = None) -> DataFrame:
    """feature_stats with p_value: Fisher's exact test, or the permutation test of means for measured types; 1 where a group has no value."""
    return tested_values(feature_values(rows, *keys), *keys, draws=draws)


def exact_scan(obs: DataFrame, alpha: float = 0.05, draws: int | None = None) -> DataFrame:
    """Every (region, feature_type) tested by what its type has, with q values and significance; alleles at one place merge."""
    return S.benjamini_hochberg(tested(obs, "region", draws=draws)).withColumn("significant", F.col("q_value") <= alpha)


def gene_events(rows: DataFrame, genes: str = "genes") -> DataFrame:
    """A row a gene of lists parted by ; or , ."""
    return rows.withColumn("gene", F.explode(F.filter(F.transform(F.split(genes, "[;,]"), F.trim), lambda x: x != "")))


def copy_number_comparison(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (sample_id, grp, event, log2_ratio, keys): GAIN and LOSS of each key that has any, tested among observed samples, with dosage."""
    per = rows.where("event is not null").groupBy("sample_id", "grp", *keys).agg(F.max(F.when(F.col("event") == "GAIN", 1).otherwise(0)).alias("GAIN"), F.max(F.when(F.col("event") == "LOSS", 1).otherwise(0)).alias("LOSS"))
    long = per.select("sample_id", "grp", *keys, F.expr("stack(2, 'GAIN', GAIN, 'LOSS', LOSS) as (event, hit)"))
    n = lambda g, v: F.count_if((F.col("grp") == g) & v)
    any_event = F.max("hit").alias("__any")
    counts = long.groupBy(*keys, "event").agg(n("case", F.col("hit") == 1).alias("case_events"), n("case", F.lit(True)).alias("case_n"), n("control", F.col("hit") == 1).alias("control_events"), n("control", F.lit(True)).alias("control_n"))
    kept = counts.join(long.groupBy(*keys).agg(any_event).where("__any = 1").drop("__any"), list(keys), "left_semi")
    p = S.fisher_exact(F.col("case_events"), F.col("case_n") - F.col("case_events"), F.col("control_events"), F.col("control_n") - F.col("control_events"))
    tested = kept.withColumn("p_value", F.when((F.col("case_n") > 0) & (F.col("control_n") > 0), p))
    dosage = continuous_comparison(rows.withColumnRenamed("log2_ratio", "value"), *keys).select(*keys, "case_mean", "control_mean", "mean_difference", "cohen_d")
    return S.benjamini_hochberg(tested.join(dosage, list(keys), "left"))


def panel_of_normals(obs: DataFrame, key: str = "region") -> DataFrame:
    """Observed and carrying normal samples of every feature; features that no normal was observed at stay, as unavailable."""
    normal = F.when(T.group_of(F.col("grp")) == "control", T.observed(F.col("status")))
    per = obs.withColumn("v", normal).groupBy(key, "sample_id").agg(F.max("v").alias("v"))
    out = per.groupBy(key).agg(F.count("v").alias("normal_observed"), F.count_if(F.col("v") == 1).alias("normal_carriers"))
    return out.withColumns({"normal_frequency": S.observed_rate(F.col("normal_carriers"), F.col("normal_observed")), "status": F.when(F.col("normal_observed") > 0, "Available").otherwise(T.UNAVAILABLE)})


def background(rows: DataFrame, key: str = "region", sources: tuple[str, ...] = BACKGROUND_SOURCES) -> DataFrame:
    """rows (key, a column a source) -> n, mean and max of each key and source; sources without values stay, as unavailable.

    healthy_plasma falls back on a column blood_background.
    """
    have = set(rows.columns)
    value = lambda s: F.coalesce(T.first_number([s], rows.columns), T.first_number(["blood_background"], rows.columns)) if s == "healthy_plasma" else T.first_number([s], rows.columns)
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("source"), (value(s) if s in have or s == "healthy_plasma" else F.lit(None).cast("double")).alias("v")) for s in sources])).alias("x")).select(key, "x.*")
    out = long.groupBy(key, "source").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("maximum"))
    return out.withColumn("status", F.when(F.col("n") > 0, "Available").otherwise(T.UNAVAILABLE))


def stage_rates(rows: DataFrame, candidate: str = "candidate") -> DataFrame:
    """rows (candidate, stage, detected 0/1/NULL) -> early and late detection rates and observed numbers."""
    g = T.stage_group(F.col("stage"))
    of = lambda s: F.when(g == s, F.col("detected"))
    return rows.groupBy(candidate).agg(F.avg(of("early")).alias("early_rate"), F.count(of("early")).alias("early_n"), F.avg(of("late")).alias("late_rate"), F.count(of("late")).alias("late_n"))


def group_rates(rows: DataFrame, candidate: str = "candidate", group: str = "grp") -> DataFrame:
    """Detection rate and observed number of each candidate and group."""
    return rows.groupBy(candidate, group).agg(F.avg("detected").alias("rate"), F.count("detected").alias("n"))


def specificity(rates: DataFrame, target: tuple[str, ...], competing: tuple[str, ...] = (), candidate: str = "candidate", group: str = "grp") -> DataFrame:
    """1 - mean rate of the target groups; with competitors 1 - the greater of that and their mean rate."""
    t = F.avg(F.when(F.col(group).isin(*target), F.col("rate")))
    out = rates.groupBy(candidate).agg(t.alias("t"), (F.avg(F.when(F.col(group).isin(*competing), F.col("rate"))) if competing else F.lit(None).cast("double")).alias("c"))
    return out.select(candidate, F.when(F.col("t").isNotNull(), 1 - F.greatest("t", "c")).alias("specificity"))


def modality_summary(rows: DataFrame, keys: tuple[str, ...] = ("region", "feature_type")) -> DataFrame:
    """Carriers of each region and type among all patients of that type and group, specificity, early share and mean measures.

    rows (sample_id, grp, stage, region, feature_type, status, detectability, blood_background).
    """
    hit = T.observed(F.col("status")) == 1
    sizes = rows.groupBy("feature_type").agg(F.count_distinct(F.when(F.col("grp") == "case", F.col("sample_id"))).alias("case_n"), F.count_distinct(F.when(F.col("grp") == "control", F.col("sample_id"))).alias("control_n"))
    carriers = lambda g: F.count_distinct(F.when((F.col("grp") == g) & hit, F.col("sample_id")))
    early = F.count_distinct(F.when((F.col("grp") == "case") & hit & (T.stage_group(F.col("stage")) == "early"), F.col("sample_id")))
    out = rows.groupBy(*keys).agg(carriers("case").alias("case_carriers"), carriers("control").alias("control_carriers"), early.alias("early_carriers"), F.max("blood_background").alias("max_background"), F.avg("detectability").alias("mean_detectability"))
    out = out.join(sizes, "feature_type")
    cf, hf = S.observed_rate(F.col("case_carriers"), F.col("case_n")), S.observed_rate(F.col("control_carriers"), F.col("control_n"))
    return out.withColumns({"case_frequency": cf, "control_frequency": hf, "specificity": F.greatest(F.lit(0.0), cf - F.coalesce(hf, F.lit(0.0))), "early_fraction": S.observed_rate(F.col("early_carriers"), F.col("case_carriers"))})


def detection_rates(rows: DataFrame, key: str) -> DataFrame:
    """Patients, rows, detected rows and their rate of each key that is not blank."""
    own = rows.where(F.trim(F.col(key).cast("string")) != "")
    v = T.observed(F.col("status"))
    return own.groupBy(key).agg(F.count_distinct("sample_id").alias("patients"), F.count("*").alias("n_rows"), F.count_if(v == 1).alias("detected"), F.avg(v).alias("detection_rate"))


def design_summary(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, grp, n_observed, n_missing, values): what each group has of each design field."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("v")) for f in fields])).alias("x")).select("grp", "x.*")
    return long.groupBy("field", "grp").agg(F.count("v").alias("n_observed"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.array_sort(F.collect_set("v")).alias("values"))


def confounding(summary: DataFrame) -> DataFrame:
    """(field, status, shared): disjoint values of the groups may confound; without values in both it can't be told."""
    of = lambda g: F.flatten(F.collect_list(F.when(F.col("grp") == g, F.col("values"))))
    both = summary.groupBy("field").agg(of("case").alias("a"), of("control").alias("b"))
    shared = F.array_sort(F.array_intersect("a", "b"))
    state = F.when((F.size("a") == 0) | (F.size("b") == 0), T.UNAVAILABLE).when(F.size(shared) == 0, "Potential_confounding").otherwise("Overlap")
    return both.select("field", state.alias("status"), shared.alias("shared"))


def design_verdict(found: DataFrame) -> DataFrame:
    return found.agg(F.when(F.count_if(F.col("status") == "Potential_confounding") > 0, "REVIEW").otherwise("PASS").alias("verdict"), F.array_sort(F.collect_list(F.when(F.col("status") == "Potential_confounding", F.col("field")))).alias("fields"))


def merge_design(samples: DataFrame, metadata: DataFrame, fields: tuple[str, ...], key: str = "sample_id", order: str = "row_no") -> DataFrame:
    """Design fields of metadata on samples; of repeated metadata rows the last value that is not blank counts."""
    filled = [F.max_by(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.when(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).isNotNull(), F.col(order))).alias(f) for f in fields]
    return samples.drop(*fields).join(metadata.groupBy(key).agg(*filled), key, "left")


def leakage(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: ids of both, and PASS, FAIL or unavailable where either has none."""
    ids = a.select(key, F.lit(1).alias("x")).unionByName(b.select(key, F.lit(2).alias("x"))).where(F.col(key).isNotNull())
    per = ids.groupBy(key).agg(F.max(F.when(F.col("x") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("x") == 2, 1).otherwise(0)).alias("b"))
    n = per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_shared"))
    return n.withColumn("status", F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), T.UNAVAILABLE).when(F.col("n_shared") > 0, "FAIL").otherwise("PASS"))


def three_way_leakage(splits: DataFrame, key: str = "patient_id", split: str = "split") -> DataFrame:
    """Ids that stand in more than one split."""
    return splits.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
