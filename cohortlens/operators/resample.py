"""Permutation, bootstrap and Monte-Carlo operators: replicates are rows or groups, dealt to tasks, with seeds of their own."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, combinations
from math import comb
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.sinks import staged

EXACT_COMBINATIONS, DRAWS, SCAN_DRAWS = 100_000, 999, 100_000
#: Values of which all splits are counted by halves; values of a test that are drawn from, above which its permutations
#: are normal; hits after which a test's draws end, which leaves p an error of a twentieth.
HALVED, DRAWN, ENOUGH = 30, 2000, 400
EQUAL = 1e-12


@lru_cache(256)
def _splits(n: int, k: int) -> np.ndarray:
    """Every choice of k of n places, a row each."""
    return np.fromiter(chain.from_iterable(combinations(range(n), k)), np.int32).reshape(-1, k)


def _sums_by_size(values: np.ndarray) -> list[np.ndarray]:
    """The sums of all subsets, in order, for each size of a subset."""
    sums, sizes = np.zeros(1), np.zeros(1, np.int64)
    for v in values:
        sums, sizes = np.concatenate([sums, sums + v]), np.concatenate([sizes, sizes + 1])
    return [np.sort(sums[sizes == n]) for n in range(len(values) + 1)]


def splits_beyond(values: np.ndarray, k: int, least: float) -> int:
    """How many choices of k values have a sum of at least `least` in size, of all choices, none of which is made.

    The subsets of either half are summed and sorted by their number; each sum of the one asks how many of the other
    leave the range.
    """
    a, b = _sums_by_size(values[: len(values) // 2]), _sums_by_size(values[len(values) // 2 :])
    found = 0
    for n, own in enumerate(a):
        if 0 <= k - n < len(b):
            rest = b[k - n]
            found += len(own) * len(rest) - int((np.searchsorted(rest, least - own, "left") - np.searchsorted(rest, -least - own, "right")).sum())
    return found


def permutation_p(values: np.ndarray, cases: np.ndarray, draws: int = DRAWS, seed: int = 42, exact: int = EXACT_COMBINATIONS) -> float | None:
    """p of the absolute mean difference.

    Exact over all splits of up to HALVED values, by halves, and where there are at most `exact` splits; else of up to
    `draws` random splits, fewer once ENOUGH of them are as extreme: then p is their share.
    """
    n, k = len(values), int(cases.sum())
    if not 0 < k < n:
        return None
    centred = values - values.mean()
    least = abs(centred[cases].sum()) - EQUAL * k * (n - k) / n
    if least <= 0:
        return 1.0
    if n <= HALVED:
        return splits_beyond(centred, k, least) / comb(n, k)
    if comb(n, k) <= exact:
        return float((np.abs(centred[_splits(n, k)].sum(axis=1)) >= least).mean())
    rng, hits, made, few = np.random.default_rng(seed), 0, 0, min(k, n - k)  # the others' sum is its negative
    while made < draws and hits < ENOUGH:
        m = min(max(64, (1 << 20) // n), draws - made)
        order = np.argpartition(rng.random((m, n), np.float32), few - 1, axis=1)[:, :few]
        hits += int((np.abs(centred[order].sum(axis=1)) >= least).sum())
        made += m
    return hits / made if made < draws else (hits + 1) / (draws + 1)


def _tested(batches: Iterator[pa.RecordBatch], draws: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for values, spread, n_case, n_control, difference in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not n_case or not n_control:
                out.append(None)
            elif values is not None:
                v = np.array([x["value"] for x in values], float)
                out.append(permutation_p(v, np.array([x["case"] for x in values], bool), draws, seed))
            else:
                z = abs(difference) / (spread * math.sqrt(1 / n_case + 1 / n_control)) if spread else 0.0
                out.append(math.erfc(z / math.sqrt(2)))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.float64())], [*batch.schema.names[2:], "p_value"])


def permutation_tests(values: DataFrame, *keys: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """values (keys, sample_id, grp, value) -> (n_case, n_control, mean_difference, keys, p_value): of one value a patient.

    Counts, means and spreads are partial sums. A test of up to DRAWN patients has its values in one row, in the order of
    values, and permutation_p; one of more never has: its splits' means are normal with the spread of all values, whose
    error is below that of the draws. p is null where a group has no value. Reruns agree.
    """
    per = values.where("value is not null and grp in ('case', 'control')").groupBy(*keys, "sample_id", "grp").agg(F.avg("value").alias("value"))
    per = staged(per.select(*keys, "value", (F.col("grp") == "case").alias("case")), "permutation-values")
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    sums = per.groupBy(*keys).agg(F.count_if("case").alias("n_case"), F.count_if(~F.col("case")).alias("n_control"), F.stddev_samp("value").alias("__spread"), (mean(F.col("case")) - mean(~F.col("case"))).alias("mean_difference"))
    few = sums.where(F.col("n_case") + F.col("n_control") <= DRAWN).select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)])
    same = reduce(and_, (per[k].eqNullSafe(few[f"__s{i}"]) for i, k in enumerate(keys)))
    held = per.join(few, same, "left_semi").groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list(F.struct("value", "case"))).alias("__values"))
    both = sums.join(held, reduce(and_, (sums[k].eqNullSafe(held[f"__k{i}"]) for i, k in enumerate(keys))), "left")
    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    tasks = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small and work is not: not to be coalesced
    rows = both.select("__values", "__spread", "n_case", "n_control", "mean_difference", *keys).repartition(tasks)
    return rows.mapInArrow(lambda b: _tested(b, draws, seed), f"n_case bigint, n_control bigint, mean_difference double, {kinds}, p_value double")


def _drawn(rows: DataFrame, replicates: int, seed: int, key: str) -> DataFrame:
    """rows once a replicate that draws their key, with replicate and weight, made where the rows are.

    Joined to the rows afterwards, the draws could be broadcast: Spark's sizes are those from before they are opened.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("replicate")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cuts, total, p = [], 0.0, float(np.exp(-1))
    for k in range(9):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("weight", weight).where("weight > 0")


def bootstrap_weights(ids: DataFrame, replicates: int, seed: int = 42, key: str = "patient") -> DataFrame:
    """(replicate, key, weight): Poisson(1) bootstrap counts from a seeded hash of id and replicate; no driver state, reruns agree."""
    return _drawn(ids.select(key).distinct(), replicates, seed, key)


def rate_bootstrap(rows: DataFrame, value: str, replicates: int = 200, seed: int = 42, key: str = "patient") -> DataFrame:
    """One row: mean, least and greatest of the bootstrap means of a value in [0, 1]."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("v")).where("v is not null")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small and work is not: not to be coalesced
    w = _drawn(per.repartition(tasks, key), replicates, seed, key)
    means = w.groupBy("replicate").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("m"))
    return means.agg(F.count("*").alias("replicates"), F.avg("m").alias("mean"), F.min("m").alias("least"), F.max("m").alias("greatest"))


def panel_stability(matrix: DataFrame, k: int, replicates: int = 200, seed: int = 42, patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """(candidate, frequency): how often greedy presence panels over bootstrapped patients choose each candidate.

    Patients are counted by their sets of hits first; a replicate is one task's work over those counts, whose number is
    that of distinct hit sets of a panel's bounded candidates.
    """
    hits = matrix.where(F.col(patient).isNotNull() & (F.col("value") > 0)).groupBy(patient).agg(F.array_sort(F.collect_set(candidate)).alias("hits"))
    counted = _drawn(hits, replicates, seed, patient).groupBy("replicate", "hits").agg(F.sum("weight").alias("n"))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        left, chosen = [(set(h), int(n)) for h, n in zip(g["hits"], g["n"], strict=True)], []
        while len(chosen) < k:
            gain: dict[str, int] = {}
            for h, n in left:
                for c in h:
                    gain[c] = gain.get(c, 0) + n
            if not gain:
                break
            best = max(gain, key=lambda c: (gain[c], c))
            chosen.append(best)
            left = [(h, n) for h, n in left if best not in h]
        return pd.DataFrame({"replicate": int(g["replicate"].iloc[0]), "candidate": chosen})

    picks = counted.groupBy("replicate").applyInPandas(choose, "replicate int, candidate string")
    return picks.groupBy("candidate").agg((F.count("*") / replicates).alias("frequency"))


def rank_stability(scored: DataFrame, k: int, replicates: int = 200, seed: int = 42, key: str = "candidate_id") -> DataFrame:
    """(key, frequency): share of bootstrap draws of candidates in which each is in the top k; a candidate counts once a draw."""
    from pyspark.sql import Window

    drawn = _drawn(scored.where(F.col(key).isNotNull() & F.col("score").isNotNull()).select(key, "score"), replicates, seed, key)
    top = drawn.withColumn("r", F.row_number().over(Window.partitionBy("replicate").orderBy(F.col("score").desc(), key))).where(F.col("r") <= k)
    return top.groupBy(key).agg((F.count("*") / replicates).alias("frequency"))


def masked(df: DataFrame, fields: list[str], rate: float, repeats: int, seed: int = 42, key: str = "candidate_id") -> DataFrame:
    """df repeated, with fields made NULL at the rate, chosen by a hash of repeat, id and field."""
    long = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hide = lambda f: F.pmod(F.xxhash64(F.lit(seed), F.col("repeat"), F.col(key), F.lit(f)), F.lit(1_000_000)) < int(rate * 1_000_000)
    return long.withColumns({f: F.when(~hide(f), F.col(f)) for f in fields})


def simulated_power(grid: DataFrame, draws: int = 10_000, least: int = 3, seed: int = 42) -> DataFrame:
    """grid (depth, p, ...) with simulated: share of binomial draws of at least `least`, seeded by the row's values."""

    def run(batches):
        for g in batches:
            out = [float((np.random.default_rng([seed, int(d), int(p * 1e9)]).binomial(int(d), p, draws) >= least).mean()) for d, p in zip(g["depth"], g["p"], strict=True)]
            yield g.assign(simulated=out)

    return grid.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema.fields) + ", simulated double")
