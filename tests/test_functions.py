import math
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.functions import status as T
from cohortlens.functions import variants as V


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def fisher(a, b, c, d):
    r1, r2, c1 = a + b, c + d, a + c
    if r1 + r2 == 0:
        return 1.0
    p = {x: Fraction(comb(r1, x) * comb(r2, c1 - x), comb(r1 + r2, c1)) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return float(sum(v for v in p.values() if v <= p[a] * (1 + Fraction(1, 10**7))))


def test_fisher(spark):
    cells = [(2, 0, 0, 2), (0, 0, 2, 2), (0, 5, 0, 7), (0, 0, 0, 0), (8, 2, 1, 5), (100, 300, 20, 400), (3, 997, 0, 1000), (70, 5, 3, 90), (500, 500, 480, 520)]
    df = spark.createDataFrame(cells, "a int, b int, c int, d int").withColumn("p", S.fisher_exact(*(F.col(x) for x in "abcd")))
    for r in df.collect():
        assert r.p == pytest.approx(fisher(r.a, r.b, r.c, r.d), rel=1e-9, abs=1e-14)


def test_log_factorial(spark):
    for r in spark.range(0, 3000, 7).select("id", S.log_factorial(F.col("id")).alias("x")).collect():
        assert r.x == pytest.approx(math.lgamma(r.id + 1), rel=1e-13, abs=1e-12)


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, None, 0.005, 0.03, 1.0]
    got = {r.i: r.q_value for r in S.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    best = 1.0
    for rank in range(len(known), 0, -1):
        best = min(best, known[rank - 1][0] * len(known) / rank)
        assert got[known[rank - 1][1]] == pytest.approx(best)
    assert got[3] is None


def tail(n, p, least):
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


@pytest.mark.parametrize("n,p,least", [(10, 0.1, 3), (50, 0.01, 1), (2, 0.5, 3), (0, 0.3, 1), (30, 0.0, 2), (30, 1.0, 2), (100, 0.02, 0)])
def test_upper_tail(spark, n, p, least):
    assert one(spark, S.upper_tail(F.lit(n), F.lit(p), least))[0] == pytest.approx(tail(n, p, least), abs=1e-9)


def test_deep_coverage_and_limits(spark):
    deep, lod, none = one(spark, S.upper_tail(F.lit(30000), F.lit(0.001), 3), S.limit_of_detection(F.lit(1000), F.lit(0.0)), S.limit_of_detection(F.lit(2), F.lit(0.0)))
    assert deep == pytest.approx(1.0) and none is None
    assert tail(1000, lod, 3) == pytest.approx(0.95, abs=1e-4)
    assert one(spark, S.sidak_alpha(0.05, F.lit(5)))[0] == pytest.approx(1 - 0.95**0.2)
    assert one(spark, S.cohen_h(F.lit(0.5), F.lit(0.5)), S.odds_ratio(*map(F.lit, (1, 2, 3, 4)))) == pytest.approx([0.0, 1.5 * 4.5 / (2.5 * 3.5)])
    assert one(spark, S.detectability(F.lit(0.1), F.lit(30), F.lit(0.01), F.lit(0.5)))[0] == pytest.approx(tail(30, 0.055, 3))


@pytest.mark.parametrize("status,value", [("Detected", 1), (" NOT detected ", 0), ("Data unavailable", None), (None, None), ("odd", None)])
def test_observed(spark, status, value):
    assert one(spark, T.observed(F.lit(status).cast("string")))[0] == value


def test_words(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, T.group_of(lit("Tumor")), T.group_of(lit("healthy")), T.group_of(lit("x")), T.stage_group(lit("Stage IIA")), T.stage_group(lit("IV")), T.label(lit("1.0")), T.label(lit("Control")), T.label(lit("2"))) == ["case", "control", None, "early", "late", 1, 0, None]
    assert one(spark, T.unit_score(lit("1.5")), T.unit_score(lit("nan")), T.unit_score(lit("Data unavailable")), T.truthy(lit("no")), T.truthy(lit(None))) == [1.0, None, None, False, True]
    with pytest.raises(Exception, match="unknown feature status"):
        one(spark, T.canonical_status(lit("maybe")))


def test_variants(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, V.variant_type(lit("A"), lit("T")), V.variant_type(lit("AT"), lit("A")), V.variant_type(lit("AT"), lit("GC")), V.small_variant(lit("A"), lit("<DEL>"))) == ["SNV", "INDEL", "MNV", None]
    assert one(spark, V.genotype_status(lit("0/2"), F.lit(2)), V.genotype_status(lit("0/2"), F.lit(1)), V.genotype_status(lit("./."), F.lit(1)), V.genotype_status(lit("1|."), F.lit(1))) == [1, 0, None, 1]
    assert one(spark, V.info_map(lit("A=1;FLAG;.;A=2;B=x=y")))[0] == {"A": "2", "FLAG": None, "B": "x=y"}
    assert one(spark, V.add_info(lit("."), "K", lit("a;b=c,100%")))[0] == "K=a%3Bb%3Dc%2C100%25"
    r = one(spark, V.region(lit("chr1:1,000-2,000")), V.region(lit("chr1:100")), V.region(lit("1:5-2")), V.region(lit("none")))
    assert tuple(r[0]) == ("chr1", 1000, 2000) and tuple(r[1]) == ("chr1", 100, 100) and r[2] is None and r[3] is None
    assert one(spark, V.bins(F.lit(1), F.lit(1000), 1000), V.bins(F.lit(1000), F.lit(1001), 1000), V.zero_based_bins(F.lit(1000), F.lit(1000), 1000)) == [[0], [0, 1], [1]]
    assert one(spark, V.copy_event(F.lit(3.0), F.lit(-9.0)), V.copy_event(F.lit(None).cast("double"), F.lit(-0.3)), V.copy_event(F.lit(None).cast("double"), F.lit(None).cast("double"))) == ["GAIN", "LOSS", None]
    assert one(spark, V.chromosome(lit("CHRX")), V.chromosome(lit("chrM"), True), V.file_kind(lit("Structural Variant calls")), V.file_kind(lit("Simple somatic mutation")), V.sample_class(lit("Blood Derived Normal"), lit(None))) == ["X", "MT", "SV", "SNV_INDEL", "NORMAL_BLOOD"]


@pytest.mark.parametrize("seed", range(4))
def test_false_discovery_over_ranges(spark, seed):
    """Ties, zeros, ones, tiny values and nulls; a q is the least of p n / rank from its rank on."""
    import random

    rng = random.Random(seed)
    ps = [rng.choice([0.0, 1.0, 1e-300, 5e-324, 0.5, rng.random(), rng.random() ** 9]) for _ in range(200)] * (seed < 3)
    order, q, low = sorted(range(len(ps)), key=lambda i: ps[i]), {}, 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        q[order[rank - 1]] = low
    data = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(-1, None)], "i int, p_value double")
    got = {r.i: r.q_value for r in S.benjamini_hochberg(data).collect()}
    assert got.pop(-1) is None and got.keys() == q.keys()
    assert all(got[i] == pytest.approx(q[i], rel=1e-12) for i in q)
