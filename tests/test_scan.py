import itertools
import math
import random

import pytest

from cohortlens.functions import stats as S
from cohortlens.operators import cohort as C
from cohortlens.operators import scan as SC

SCHEMA = "sample_id string, grp string, region string, chrom string, start bigint, end bigint, feature_type string, status string, log2_ratio double, beta double, heteroplasmy double, value string"


def mean_p(a, b):
    """Two-sided exact permutation p of the difference of means."""
    pool, seen = a + b, abs(sum(a) / len(a) - sum(b) / len(b))
    sums = [sum(c) for c in itertools.combinations(pool, len(a))]
    return sum(abs(s / len(a) - (sum(pool) - s) / len(b)) >= seen - 1e-12 for s in sums) / len(sums)


def fisher(a, b, c, d):
    r1, r2, k = a + b, c + d, a + c
    p = lambda x: math.comb(r1, x) * math.comb(r2, k - x) / math.comb(r1 + r2, k)
    return min(1.0, sum(p(x) for x in range(max(0, k - r2), min(r1, k) + 1) if p(x) <= p(a) * (1 + 1e-7)))


def row(patient, grp, region, kind, status=None, cnv=None, beta=None, het=None, value=None):
    chrom, span = region.split(":")
    start, end = map(int, span.split("-"))
    return (patient, grp, region, chrom, start, end, kind, status, cnv, beta, het, value)


def test_types_are_tested_by_what_they_have(spark):
    rng = random.Random(2)
    groups = {f"p{i}": rng.choice(["Cancer", "tumor"]) if i < 5 else rng.choice(["Healthy", "normal", "control"]) for i in range(10)}
    rows, want = [], {}
    for kind, at in (("CNV", "cnv"), ("methylation", "beta"), ("MITOCHONDRIAL", "het"), ("MITOCHONDRIAL", "value")):
        region = f"chr1:{len(want) * 10 + 1}-{len(want) * 10 + 5}"
        values = {p: round(rng.random(), 3) for p in groups}
        rows += [row(p, g, region, kind, **{at: str(values[p]) if at == "value" else values[p]}) for p, g in groups.items()]
        a, b = ([v for p, v in values.items() if (groups[p] in ("Cancer", "tumor")) == case] for case in (True, False))
        want[region] = (abs(sum(a) / 5 - sum(b) / 5), mean_p(a, b))
    rows += [row("p0", groups["p0"], "chr1:900-901", "CNV", cnv=1.0), row("p7", groups["p7"], "chr1:900-901", "CNV")]
    want["chr1:900-901"] = (0.0, 1.0)
    for i, (p, g) in enumerate(groups.items()):
        rows.append(row(p, g, "chr2:5-9", "snv", "Variant detected" if i < 4 else "wild type" if i < 9 else "Data unavailable"))
    want["chr2:5-9"] = (4 / 5, fisher(4, 1, 0, 4))
    got = {r.region: r for r in C.exact_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    for region, (effect, p) in want.items():
        assert got[region].effect == pytest.approx(effect) and got[region].p_value == pytest.approx(p), region
    assert C.exact_scan(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cells", [(0, 0, 0, 0), (0, 5, 0, 7), (3, 1, 2, 9), (12, 0, 0, 11), (400, 100, 300, 350), (1, 900, 8, 700), (60, 2, 3, 70)])
def test_fisher(spark, cells):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([cells], "a bigint, b bigint, c bigint, d bigint").select(S.fisher_exact(*map(F.col, "abcd")).alias("p")).first().p
    assert got == pytest.approx(fisher(*cells) if sum(cells) else 1.0, rel=1e-9)


def test_coarse_to_fine_finds_measured_and_counted_regions(spark):
    rows = []
    for i in range(12):
        grp = "case" if i < 6 else "control"
        rows.append(row(f"p{i}", grp, "chr1:2000001-2000010", "SNV", "Detected" if i < 6 else "Not detected"))
        rows.append(row(f"p{i}", grp, "chr1:9000001-9000010", "SNV", "Detected"))
        rows.append(row(f"p{i}", grp, "chr3:1-100", "CNV", cnv=2.0 if i < 6 else 0.0))
        rows.append(row(f"p{i}", grp, "chr3:7000000-7000100", "CNV", cnv=1.0))
    lineage, final = SC.coarse_to_fine(spark.createDataFrame(rows, SCHEMA))
    found = {(r.chrom, r.start, r.feature_type): r for r in final.collect()}
    assert found.keys() == {("chr1", 2000001, "SNV"), ("chr3", 1, "CNV")}
    assert found["chr3", 1, "CNV"].p_value == pytest.approx(2 / math.comb(12, 6)) and found["chr1", 2000001, "SNV"].effect == 1
    kept = {(r.resolution, r.chrom, r.bin) for r in lineage.collect()}
    assert {(5_000_000, "chr1", 0), (5_000_000, "chr3", 0)} <= kept and not any(c == "chr1" and b * s > 5_000_000 for s, c, b in kept)


def test_features_command(spark, tmp_path):
    from cohortlens.plans import workflow

    lines = ["patient,group,region,feature_type,value,status"]
    lines += [f"p{i},{'Cancer' if i < 5 else 'Healthy'},chr1:1-2,SNV,1,{'Detected' if i < 4 else 'Not detected'}" for i in range(10)]
    lines += [f"p{i},{'Cancer' if i < 5 else 'Healthy'},chrM:1-2,MITOCHONDRIAL,{i / 10},Detected" for i in range(10)]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    assert workflow.main(["features", str(tmp_path / "f.csv"), str(tmp_path / "out")]) == 0
    got = {r.feature_type: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got["SNV"].case_detected, got["SNV"].case_observed, got["SNV"].control_detected, got["SNV"].control_observed) == (4, 5, 0, 5)
    assert got["MITOCHONDRIAL"].effect == pytest.approx(0.5) and got["MITOCHONDRIAL"].p_value == pytest.approx(2 / math.comb(10, 5))


def test_rates_of_long_intervals_against_loops(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        start = rng.randrange(0, 3000)
        end = rng.choice([start, start - 5, start + rng.randrange(1, 40), start + rng.randrange(1000, 40000), None])
        rows.append((rng.choice(["a", "b", "c", None]), rng.choice(["1", "2", None]), rng.choice([start, start, start, None]), end, rng.choice(["SNV", "CNV", None]), rng.choice(["Detected", "Not detected", "Data unavailable", None])))
    rows += rows[:50]
    sizes = (1000, 100, 7)
    want = {}
    for patient, chrom, start, end, kind, status in rows:
        if start is not None:
            for size in sizes:
                for b in range(start // size, max(start // size, (end - 1) // size if end is not None and end > 0 else 0) + 1):
                    seen = want.setdefault((size, chrom, b, kind), [set(), 0, 0])
                    seen[0] |= {patient} - {None}
                    seen[1] += 1
                    seen[2] += status == "Detected"
    df = spark.createDataFrame(rows, "sample_id string, chrom string, start bigint, end bigint, feature_type string, status string")
    got = {(r.resolution, r.chrom, r.bin, r.feature_type): [r.patients, r.total, r.detected] for r in SC.multiresolution_rates(df, sizes).collect()}
    assert got == {k: [len(p), n, d] for k, (p, n, d) in want.items()}
    assert SC.multiresolution_rates(df.limit(0), sizes).count() == 0


def test_long_intervals_cost_few_rows(spark):
    rows = [(f"p{i % 7}", "1", 1, 100_000_000 + i, "CNV", "Detected") for i in range(500)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, start bigint, end bigint, feature_type string, status string")
    runs = SC.rate_runs(df, (100,)).collect()
    assert len(runs) == 10 + 5  # blocks, and last bins
    assert all(r.patients == 7 and r.total == 500 for r in runs if r.first < 1_000_000)
    assert sum(r["last"] - r.first + 1 for r in runs) == 1_000_005


def test_joined_intervals_of_all_lengths(spark):
    rng = random.Random(9)

    def some(n):
        out = [(rng.choice(["1", "2", None]), s, s + rng.choice([0, 3, 70, 600, 5_000, 90_000, 10**9, -4]), i) for i in range(n) for s in [rng.randrange(1, 200_000)]]
        return [*out, ("1", None, 5, -1), ("1", 5, None, -2)]

    a, b = some(150), some(120)
    schema = "chrom string, start bigint, end bigint, id int"
    got = sorted((r.a_id, r.b_id) for r in SC.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 16).collect())
    whole = lambda x: None not in x and x[1] <= x[2]
    assert got == sorted((x[3], y[3]) for x in a for y in b if whole(x) and whole(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    empty = spark.createDataFrame([], schema)
    assert SC.interval_join(empty, spark.createDataFrame(b, schema), 16).count() == 0


def test_scan_computes_its_rows_once(spark):
    """Each level and the regions read what was written of them, so what makes the rows (joins, say) is not done again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [row(f"p{i}", "case" if i < 6 else "control", f"chr{c}:{c}000001-{c}000010", "SNV", "Detected" if i < 6 else "Not detected") for i in range(12) for c in (1, 7)]
    lineage, final = SC.coarse_to_fine(spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA))
    assert lineage.count() > 2 and final.count() == 2 and made.value == len(rows)


def test_rows_in_bins_of_several_sizes_against_loops(spark, monkeypatch):
    rng = random.Random(4)
    by = lambda p, size: int((p - 1) / size)  # noqa: E731  towards 0, as bins are dealt
    bins = {(rng.choice("12"), rng.choice(["SNV", "CNV"]), size, rng.randrange(0, 20_000 // size + 1)) for size, n in ((1000, 8), (100, 20), (10, 60)) for _ in range(n)} | {("1", "SNV", 10, -3), ("2", "CNV", 10, 0)}
    rows = [(i, rng.choice(["1", "2", "3", None]), s, s + rng.choice([0, 1, 9, 40, 700, 9000, -3, -300]), rng.choice(["SNV", "CNV"])) for i in range(1500) for s in [rng.choice([rng.randrange(-60, 60), rng.randrange(1, 25_000)])]]
    rows += [(-1, "1", None, 5, "SNV"), (-2, "1", 5, None, "SNV"), rows[0]]
    want = []
    for x in rows:
        i, chrom, s, e, kind = x
        if None not in x and any((chrom, kind, size, b) in bins for size in (1000, 100, 10) for b in range(min(by(s, size), by(e, size)), max(by(s, size), by(e, size)) + 1)):
            want.append(x)
    values = spark.createDataFrame(rows, "id int, chrom string, start bigint, end bigint, feature_type string")
    some = spark.createDataFrame(list(bins), "chrom string, feature_type string, resolution bigint, bin bigint")
    for block, few in ((1000, SC.FEW), (64, 0)):
        monkeypatch.setattr(SC, "FEW", few)
        got = SC.in_bins(values, some, block)
        assert ("BroadcastHashJoin" if few else "SortMergeJoin") in got._jdf.queryExecution().sparkPlan().toString()
        assert got.columns == values.columns and sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(rows)
    assert SC.in_bins(values, some.limit(0), 1000).count() == 0
