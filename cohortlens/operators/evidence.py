"""Evidence joins, constraints, transparent scores and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import status as T

# The evidence fields and the weights of the suitability components.
FIELDS = (
    "statistical_evidence", "effect_size", "recurrence", "early_stage", "specificity", "blood_background_safety", "detectability",
    "analytical_validity", "assay_feasibility", "literature_support", "replication", "functional_support", "patient_coverage",
)
SUITABILITY = {"detectability": 0.25, "blood_background_safety": 0.20, "patient_coverage": 0.15, "recurrence": 0.10, "specificity": 0.15, "early_stage": 0.10, "assay_feasibility": 0.05}
CONFIDENCE = {"high": 0.75, "moderate": 0.50, "high_fields": 5, "moderate_fields": 3, "stability": 0.80}


def normalized(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each evidence field as a number in [0, 1] or NULL; fields that the table lacks are NULL."""
    return df.withColumns({f: T.unit_score(F.col(f)) if f in df.columns else F.lit(None).cast("double") for f in fields})


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights over their sum; each is finite and at least 0, and one is above."""
    if any(not isinstance(w, int | float) or isinstance(w, bool) or not 0 <= w < float("inf") for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights are finite, not below 0, and not all 0")
    return {k: w / sum(weights.values()) for k, w in weights.items()}


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted mean over the observed fields; NULL without any."""
    used = [(F.col(k), w) for k, w in weights.items() if w > 0]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in used), F.lit(0.0))
    return F.try_divide(top, F.nullif(sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in used), F.lit(0.0)), F.lit(0.0)))


def used_fields(weights: dict[str, float]) -> Column:
    return F.array_sort(F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k, w in weights.items() if w > 0]), lambda x: x.isNotNull()))


def constraint_flags(df: DataFrame, min_detectability: float = 0.0, max_background: float = 1.0, require_assay: bool = True, require_fpr: bool = True) -> DataFrame:
    """detectable, background_safe, assay_ok, fpr_ok and eligible. Missing evidence passes only where nothing is asked of it."""
    for name, x in (("min_detectability", min_detectability), ("max_background", max_background)):
        if not 0 <= x <= 1:
            raise ValueError(f"{name} is between 0 and 1")
    flag = lambda c, needed: T.truthy(F.col(c)) if c in df.columns and needed else F.lit(True)
    out = df.withColumns(
        {
            "detectable": F.coalesce(F.col("detectability") >= min_detectability, F.lit(min_detectability <= 0)),
            "background_safe": F.coalesce(F.col("blood_background_safety") >= 1 - max_background, F.lit(max_background >= 1)),
            "assay_ok": flag("assay_available", require_assay),
            "fpr_ok": flag("fpr_controlled", require_fpr),
        }
    )
    return out.withColumn("eligible", F.col("detectable") & F.col("background_safe") & F.col("assay_ok") & F.col("fpr_ok"))


def ranked(df: DataFrame, weights: dict[str, float], key: str = "candidate_id", scenario: tuple[str, ...] = ()) -> DataFrame:
    """df with score, bucket (ranked, ineligible, unscored) and its rank by score, then id. Ranks run within a scenario."""
    scored = df.withColumn("score", weighted_score(weights)).withColumn("used_fields", used_fields(weights))
    bucket = F.when(~F.col("eligible"), "ineligible").when(F.col("score").isNull(), "unscored").otherwise("ranked")
    order = Window.partitionBy(*scenario, "bucket").orderBy(F.col("score").desc_nulls_last(), F.col(key))
    return scored.withColumn("bucket", bucket).withColumn("rank", F.when(F.col("bucket") == "ranked", F.row_number().over(order)))


def suitability(df: DataFrame) -> DataFrame:
    return df.withColumn("cfdna_suitability", weighted_score({k: w for k, w in SUITABILITY.items() if k in df.columns}))


def recurrence(df: DataFrame) -> Column:
    """case_frequency, else carriers over n, within [0, 1]."""
    return F.coalesce(T.unit_score(F.col("case_frequency")), T.unit_score(F.try_divide(F.col("case_carriers"), F.nullif(F.col("case_n"), F.lit(0)))))


def confidence(score: Column, n_fields: Column, stability: Column | None = None) -> Column:
    c, s = CONFIDENCE, stability if stability is not None else F.lit(None).cast("double")
    high = (score >= c["high"]) & (n_fields >= c["high_fields"]) & F.coalesce(s >= c["stability"], F.lit(True))
    return F.when(score.isNull(), T.UNAVAILABLE).when(high, "HIGH").when((score >= c["moderate"]) & (n_fields >= c["moderate_fields"]), "MODERATE").otherwise("LOW")


def discovery_score(difference: Column, q: Column, annotated: Column, functional: Column) -> Column:
    """0 to 100: up to 40 for the difference, 30 for significance, 15 each for annotation and function."""
    return F.least(F.lit(40.0), F.abs(difference) * 40) + F.when(q <= 0.05, 30.0).when(q <= 0.1, 15.0).otherwise(0.0) + F.when(annotated, 15.0).otherwise(0.0) + F.when(functional, 15.0).otherwise(0.0)


def discover(results: DataFrame, annotations: DataFrame, functional: DataFrame, key: str = "feature") -> DataFrame:
    """Results with whether annotation and functional evidence exist, a score and a rank by score, p and key."""
    a, f = annotations.select(key).distinct().withColumn("annotated", F.lit(True)), functional.select(key).distinct().withColumn("functional", F.lit(True))
    out = results.join(a, key, "left").join(f, key, "left").fillna(False, ["annotated", "functional"])
    out = out.withColumn("score", discovery_score(F.col("frequency_difference"), F.col("q_value"), F.col("annotated"), F.col("functional")))
    # Equal scores and p values, which differ in their last bits only, go by key.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), F.round("p_value", 12), key)))


def with_normals(candidates: DataFrame, normals: DataFrame, key: str = "region") -> DataFrame:
    out = candidates.join(normals.withColumnRenamed("status", "pon_status"), key, "left")
    return out.withColumn("pon_status", F.coalesce("pon_status", F.lit(T.UNAVAILABLE)))


def background_filter(candidates: DataFrame, background: DataFrame, limit: float = 0.1, key: str = "region") -> DataFrame:
    """Candidates with the greatest background of any source, and whether they are kept; unknown backgrounds are kept."""
    worst = background.groupBy(key).agg(F.max("maximum").alias("background"))
    return candidates.join(worst, key, "left").withColumn("kept", F.col("background").isNull() | (F.col("background") <= limit))


def generalization(discovery: DataFrame, validation: DataFrame, key: str = "feature", effect: str = "effect_size") -> DataFrame:
    """Features of both with whether their effects have one sign (or are both 0); NULL where an effect is missing."""
    a, b = discovery.select(key, F.col(effect).alias("d")), validation.select(key, F.col(effect).alias("v"))
    return a.join(b, key).withColumn("concordant", (F.col("d") * F.col("v") > 0) | ((F.col("d") == 0) & (F.col("v") == 0)))


def revalidated(selected: DataFrame, validation: DataFrame, key: str = "feature") -> DataFrame:
    """One row: how many of the selected the validation has, and their share."""
    hit = selected.select(key).distinct().join(validation.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("n_selected"), F.count("hit").alias("n_found"), F.try_divide(F.count("hit"), F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def overlap(reference: DataFrame, candidate: DataFrame, *keys: str) -> DataFrame:
    """One row: sizes, shared, recall and precision of two key sets; empty sets give NULL."""
    both = reference.select(*keys).distinct().withColumn("r", F.lit(1)).join(candidate.select(*keys).distinct().withColumn("c", F.lit(1)), list(keys), "full")
    n = both.agg(F.count("r").alias("n_reference"), F.count("c").alias("n_candidate"), F.count_if(F.col("r").isNotNull() & F.col("c").isNotNull()).alias("n_shared"))
    return n.withColumns({"recall": F.try_divide(F.col("n_shared"), F.nullif(F.col("n_reference"), F.lit(0))), "precision": F.try_divide(F.col("n_shared"), F.nullif(F.col("n_candidate"), F.lit(0)))})


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def scenario_ranks(df: DataFrame, scenarios: dict[str, dict[str, float]], key: str = "candidate_id") -> DataFrame:
    """Candidates ranked under each scenario's weights: one pass, a score a scenario, no loop of jobs."""
    long = df.select(key, "eligible", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), weighted_score(w).alias("score")) for n, w in scenarios.items()])).alias("x")).select(key, "eligible", "x.*")
    live = long.where(F.col("eligible") & F.col("score").isNotNull())
    return live.withColumn("rank", F.row_number().over(Window.partitionBy("scenario").orderBy(F.col("score").desc(), key)))


def ablation_weights(weights: dict[str, float], groups: dict[str, tuple[str, ...]]) -> dict[str, dict[str, float]]:
    """The full weights, and for each group those without its fields."""
    return {"full": weights} | {name: {k: w for k, w in weights.items() if k not in fields} for name, fields in groups.items()}


def doubled_weights(weights: dict[str, float], value: float = 2.0) -> dict[str, dict[str, float]]:
    """For each field a scenario in which its normalised weight is replaced by `value` before all are normalised again."""
    base = checked_weights(weights)
    return {"base": base} | {f"{k}_x": checked_weights(base | {k: value}) for k in base}


def selection_stability(ranks: DataFrame, k: int = 15, key: str = "candidate_id") -> DataFrame:
    """One row: share of the commonest first candidate, and mean Jaccard of the top k of each two scenarios."""
    tops = ranks.where(F.col("rank") <= k).groupBy("scenario").agg(F.collect_set(key).alias("ids"), F.min_by(key, "rank").alias("first"))
    pairs = tops.alias("a").join(tops.alias("b"), F.col("a.scenario") < F.col("b.scenario")).agg(F.avg(jaccard(F.col("a.ids"), F.col("b.ids"))).alias("mean_jaccard"))
    firsts = tops.groupBy("first").agg(F.count("*").alias("n")).agg(F.try_divide(F.max("n"), F.sum("n")).alias("top_frequency"))
    return firsts.crossJoin(F.broadcast(pairs))  # one row each


def constraint_grid(df: DataFrame, weights: dict[str, float], detectabilities: tuple[float, ...], backgrounds: tuple[float, ...], key: str = "candidate_id") -> DataFrame:
    """(min_detectability, max_background, n_ranked, top): how many candidates each pair of limits leaves, and the first."""
    grid = F.array(*[F.struct(F.lit(d).alias("min_detectability"), F.lit(b).alias("max_background")) for d in detectabilities for b in backgrounds])
    long = df.withColumn("score", weighted_score(weights)).select(key, "score", "detectability", "blood_background_safety", F.explode(grid).alias("g")).select("*", "g.*")
    ok = F.coalesce(F.col("detectability") >= F.col("min_detectability"), F.col("min_detectability") <= 0) & F.coalesce(F.col("blood_background_safety") >= 1 - F.col("max_background"), F.col("max_background") >= 1) & F.col("score").isNotNull()
    return long.groupBy("min_detectability", "max_background").agg(F.count_if(ok).alias("n_ranked"), F.min_by(key, F.when(ok, F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))).alias("top"))


def conventional_ranking(df: DataFrame, k: int, key: str = "feature") -> DataFrame:
    """Top k by 1 - q, else the frequency difference, else the effect, else 0."""
    have = df.columns
    parts = [1 - F.col("q_value")] * ("q_value" in have) + [F.abs(F.col("frequency_difference"))] * ("frequency_difference" in have) + [F.abs(F.col("effect"))] * ("effect" in have)
    return df.withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*parts, F.lit(0.0))))).orderBy(F.col("strength").desc(), key).limit(k)


def literature_queries(candidates: DataFrame, key: str = "feature", aliases: tuple[str, ...] = ("gene", "region")) -> DataFrame:
    """Rows of candidate, intent and query text; names without repeats, in their order."""
    names = F.array_distinct(F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in (key, *aliases) if c in candidates.columns]), lambda x: x.isNotNull() & (x != "")))
    any_name = F.concat(F.lit('("'), F.array_join(names, '" OR "'), F.lit('")'))
    intents = {"disease": "cancer", "cfdna": "(cfDNA OR ctDNA OR plasma)", "early_detection": "early detection"}
    return candidates.select(F.col(key).alias("candidate"), F.explode(F.array(*[F.struct(F.lit(i).alias("intent"), F.concat(any_name, F.lit(f" AND {t}")).alias("query")) for i, t in intents.items()])).alias("x")).select("candidate", "x.*")


def literature_records(queries: DataFrame, counts: DataFrame, sources: tuple[str, ...] = ("PubMed", "EuropePMC")) -> DataFrame:
    """A record a query and source; a source that wasn't searched is unavailable, never 0."""
    rows = queries.withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    out = rows.join(counts.select("query", "source", "result_count"), ["query", "source"], "left")
    return out.withColumn("status", F.when(F.col("result_count").isNull(), T.UNAVAILABLE).otherwise("Available"))


def whitespace_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("candidate").agg(F.count("*").alias("n_records"), F.count("result_count").alias("n_available"), F.sum("result_count").alias("total_hits"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("intent")).alias("intents"))


def with_background_sources(candidates: DataFrame, background: DataFrame, sources: tuple[str, ...], key: str = "region") -> DataFrame:
    """candidates with background_sources: a struct of n, mean, maximum and status a source, unavailable where there is none.

    Each region's sources become one row before the join, so a candidate meets one row whatever there is of it.
    """
    own = F.struct(F.col("n").cast("bigint").alias("n"), F.col("mean").cast("double").alias("mean"), F.col("maximum").cast("double").alias("maximum"), "status")
    per = background.where(F.col("source").isin(*sources)).groupBy(F.col(key).alias("__key")).agg(*[F.max(F.when(F.col("source") == s, own)).alias(f"__{i}") for i, s in enumerate(sources)])
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("maximum"), F.lit(T.UNAVAILABLE).alias("status"))
    all_sources = F.struct(*[F.coalesce(F.col(f"__{i}"), none).alias(s) for i, s in enumerate(sources)])
    return candidates.join(per, F.col(key) == F.col("__key"), "left").withColumn("background_sources", all_sources).drop("__key", *[f"__{i}" for i in range(len(sources))])


# The kinds of external evidence, the source of each, and the columns any of which makes it available.
EXTERNAL = {
    "functional": ("VEP/Ensembl", ("functional_evidence",)),
    "population_identity": ("dbSNP", ("dbsnp_rsids", "dbsnp_ref_snp_id")),
    "clinical": ("ClinVar", ("clinvar_accession", "clinvar_id")),
    "cancer_specific": ("cancer-specific literature", ("cancer_evidence_score",)),
    "cfDNA_specific": ("cfDNA literature / assay evidence", ("prior_cfdna_evidence",)),
}


def external_evidence(rows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, kind, source, available, detail): a row a candidate and kind of external evidence; detail is the value that makes it available.

    A record of one kind is evidence of no other. Empty text, the word for unavailable, and columns that rows lack are
    not available.
    """

    def detail(columns: tuple[str, ...]) -> Column:
        texts = [F.col(c).cast("string") for c in columns if c in rows.columns]
        return F.coalesce(*[F.when(~F.trim(t).isin("", T.UNAVAILABLE), t) for t in texts], F.lit(None).cast("string"))

    kinds = [F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), detail(columns).isNotNull().alias("available"), detail(columns).alias("detail")) for kind, (source, columns) in EXTERNAL.items()]
    return rows.select(key, F.inline(F.array(*kinds)))
