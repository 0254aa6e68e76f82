from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import resample as R

ROWS = [(f"p{i % 40}", [1, 0, None][i % 3] if i % 40 != 7 else None) for i in range(300)] + [(None, 1), (None, 0)]


def weights(spark, ids, replicates, key="patient"):
    return {(r[key], r.replicate): r.weight for r in R.bootstrap_weights(spark.createDataFrame([(x,) for x in ids], f"{key} string"), replicates, key=key).collect()}


def test_rates_of_draws_against_loops(spark):
    own = defaultdict(list)
    for p, v in ROWS:
        if p is not None and v is not None:
            own[p].append(v)
    means = []
    w = weights(spark, own, 20)
    for k in range(20):
        n = {p: w.get((p, k), 0) for p in own}
        means.append(sum(n[p] * sum(own[p]) / len(own[p]) for p in own) / sum(n.values()))
    got = R.rate_bootstrap(spark.createDataFrame(ROWS, "patient string, v int"), "v", 20).first()
    assert got.replicates == 20 and (got.mean, got.least, got.greatest) == (pytest.approx(sum(means) / 20), pytest.approx(min(means)), pytest.approx(max(means)))


def test_ranks_of_draws_against_loops(spark):
    scored = [(f"c{i}", float(i % 5)) for i in range(12)] + [("none", None), (None, 9.0)]
    w, want = weights(spark, [f"c{i}" for i in range(12)], 30, "candidate_id"), defaultdict(int)
    for k in range(30):
        for c, _ in sorted((x for x in scored if w.get((x[0], k))), key=lambda x: (-x[1], x[0]))[:3]:
            want[c] += 1
    got = R.rank_stability(spark.createDataFrame(scored, "candidate_id string, score double"), 3, 30).collect()
    assert {r.candidate_id: r.frequency for r in got} == {c: n / 30 for c, n in want.items()}


def test_draws_are_never_broadcast(spark):
    """Sizes that Spark knows of draws are those of the ids before they are opened, so a join may send all draws through the driver."""
    rows = spark.createDataFrame(ROWS, "patient string, v int")
    scored = rows.groupBy(F.col("patient").alias("candidate_id")).agg(F.avg("v").alias("score"))
    matrix = rows.select("patient", F.lit("c").alias("candidate"), F.col("v").alias("value"))
    for df in (R.rate_bootstrap(rows, "v"), R.rank_stability(scored, 3), R.panel_stability(matrix, 1)):
        df.collect()
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
