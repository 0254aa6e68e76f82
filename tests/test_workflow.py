import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort as C
from cohortlens.operators import evaluate as E
from cohortlens.operators import panel as P
from cohortlens.operators import resample as R
from cohortlens.operators import scan as SC
from cohortlens.operators import select as SEL
from cohortlens.plans import contracts as K
from cohortlens.plans import workflow as W
from cohortlens.streaming import rates


def test_missing_is_not_negative(spark):
    rows = [("a", "case", "Detected"), ("b", "case", "Data unavailable"), ("c", "control", "Not detected"), ("d", "control", None)]
    r = C.observed_comparison(spark.createDataFrame([(*x, "r") for x in rows], "sample_id string, grp string, status string, region string"), "region").first()
    assert (r.case_detected, r.case_observed, r.control_detected, r.control_observed, r.case_rate, r.control_rate) == (1, 1, 0, 1, 1.0, 0.0)
    alone = C.observed_comparison(spark.createDataFrame([("a", "case", "Detected", "r")], "sample_id string, grp string, status string, region string"), "region").first()
    assert (alone.control_rate, alone.p_value, alone.effect) == (None, 1.0, 0.0)


def test_panels(spark):
    rows = [("p1", "A", 1), ("p1", "B", 0), ("p2", "B", 1), ("p3", "B", 1), ("p3", "C", 1), ("p4", "C", 0)]
    m = spark.createDataFrame(rows, "patient string, candidate string, value int")
    assert [c for c, _, _ in P.greedy(m, 3, by_presence=True)] == ["B", "A", "C"][:2] + ["C"]
    best = P.best_subset(P.exact_presence(m, ["A", "B", "C"], 3))
    assert best == (["A"], 1.0)  # of those observed at it
    assert P.presence_coverage(m, ["C"]).first().coverage == 0.5
    layers = {r.layer: round(r.delta, 6) for r in P.layer_contribution(m, ["A", "B", "C"], {"A": "x", "B": "y", "C": "y"}).collect()}
    assert layers == {"x": 0.25, "y": 0.5}
    with pytest.raises(ValueError):
        P.exact_presence(m, [str(i) for i in range(23)], 2)


def test_interval_join_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    a = [("1", s, s + rng.randrange(200), i) for i in range(80) for s in [rng.randrange(1, 2000)]]
    b = [("1", s, s + rng.randrange(900), i) for i in range(60) for s in [rng.randrange(1, 2000)]]
    schema = "chrom string, start bigint, end bigint, id int"
    got = sorted((r.a_id, r.b_id) for r in SC.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 64).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)], "id int, score double, label int")
    assert E.roc_auc(df).first()[0] == 0.75
    assert E.average_precision(df).first()[0] == pytest.approx((1 + 2 / 3) / 2)
    assert E.best_threshold(df).first().threshold == pytest.approx(0.4)
    assert E.binary_metrics(df, 0.95).first().precision is None
    split = E.patient_split(spark.range(100).withColumn("s", F.col("id") % 3), "id", "s")
    assert C.three_way_leakage(split, "id").count() == 0 and split.count() == 100


def test_frozen_threshold(spark):
    schema = "patient_id string, split string, score double, label int, tp int"
    rows = [(f"d{i}", "discovery", i / 10, int(i > 4), 0) for i in range(10)] + [(None, "validation", 0.5, 1, 0), ("v1", "validation", 0.4, 0, 0), ("v2", "validation", 0.9, 0, 0), ("v3", "validation", None, 1, 0), ("o", "other", 0.9, 1, 0), ("d1", None, 0.9, 1, 0)]
    got = {r.split: r for r in E.frozen_evaluation(spark.createDataFrame(rows, schema)).collect()}
    v, t = got["validation"], got["test"]
    assert (v.status, v.leaked, v.threshold, v.fit_value) == ("Available", 0, pytest.approx(0.45), 1.0) and (v.tp, v.fp, v.fn, v.tn, v.precision, v.sensitivity) == (1, 1, 0, 1, 0.5, 1.0)
    assert t.status == "Data unavailable" and t.tp is None and t.f1 is None and t.threshold == v.threshold
    got = E.frozen_evaluation(spark.createDataFrame([*rows, ("d3", "test", 0.1, 0, 0)], schema)).collect()
    assert all((r.status, r.leaked, r.threshold, r.tp, r.accuracy) == ("FAIL", 1, None, None, None) for r in got) and len(got) == 2
    assert [r.status for r in E.frozen_evaluation(spark.createDataFrame([], schema)).collect()] == ["Data unavailable"] * 2


def test_resampling(spark):
    import numpy as np

    assert R.permutation_p(np.array([1.0, 2, 3, 10, 11, 12]), np.array([0, 0, 0, 1, 1, 1], bool)) == pytest.approx(2 / 20)
    w = R.bootstrap_weights(spark.range(2000).withColumnRenamed("id", "patient"), 5)
    assert abs(w.agg(F.sum("weight")).first()[0] / 10000 - 1) < 0.05
    p = R.simulated_power(spark.createDataFrame([(100, 0.05)], "depth int, p double")).first().simulated
    assert abs(p - 0.8817) < 0.02


def test_selection(spark):
    s = spark.createDataFrame([("c1", "t2", "TUMOR"), ("c1", "t1", "TUMOR"), ("c1", "s1", "NORMAL_SOLID"), ("c1", "z", "NORMAL_BLOOD"), ("c2", "t", "TUMOR")], "case_id string, sample_id string, class string")
    assert {r.case_id: (r.tumor, r.normal, r.paired) for r in SEL.paired_cases(s).collect()} == {"c1": ("t1", "z", True), "c2": ("t", None, False)}
    model, weights = SEL.baseline_model(spark.createDataFrame([(float(i), None if i % 9 == 0 else 1.0, int(i > 10)) for i in range(20)], "a double, b double, label int"), ["a", "b"])
    assert weights[0][0] == "a"


def test_contracts(spark):
    run = K.RunRecord(config={"a": 1})
    assert run.complete().status == "PASS"
    for bad in (lambda: K.FeatureRecord("", "r", "SNV"), lambda: K.FeatureRecord("p", "r", "SNV", status="x"), lambda: K.Trace("r", ["a", "a"], []), lambda: K.ScanResult("r", "PASS", [], True), lambda: K.Provenance("s", "", "b", "p", "x", "t")):
        with pytest.raises(K.ContractError):
            bad()
    trace = K.Trace(run.run_id, ["i"], ["o"])
    errors = K.bundle_errors(run, trace, [K.InputArtifact("i", "p", "vcf")], [], [], None, {})
    assert "traced outputs differ from the outputs" in errors and "no provenance" in errors
    assert K.dataset_state(3, 0)[0] == "partial"
    rows = K.manifest_errors(spark.createDataFrame([("d", "n", "s", "m", "x")], "dataset_id string, name string, source string, modality string, n_tumor string")).first().errors
    assert "n_tumor is no count" in rows and "license is missing" in rows


def test_analysis_of_directories(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    for d, n in (("cancer", 4), ("healthy", 4)):
        (tmp_path / d).mkdir()
        for i in range(n):
            (tmp_path / d / f"{d}{i}.vcf").write_text(head + ("17\t7\t.\tC\tT\t.\tPASS\tGENE=TP53\n" if d == "cancer" else ""))
    record = W.analyze_cohorts(spark, str(tmp_path / "cancer"), str(tmp_path / "healthy"), str(tmp_path / "out"))
    assert record["status"] == "PASS" and record["summary"] == {"features": 1, "significant": 1}
    r = spark.read.parquet(str(tmp_path / "out/variants/candidates")).first()
    assert (r.feature, r.case_carriers, r.case_n, r.control_n) == ("17:7:C:T", 4, 4, 4) and r.p_value == pytest.approx(1 / 35)
    with pytest.raises(ValueError):
        W.run_stages(spark.range(1), [("a", lambda d: d), ("a", lambda d: d)])


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("feature_type"), F.when(F.col("value") > 50, "Detected").otherwise("Not detected").alias("status"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rates.windowed_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, rates.windowed_rates(events).collect()))
