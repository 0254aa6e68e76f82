import glob
import json
import os

import pytest

from cohortlens.plans import audit as A
from cohortlens.sources import quarantine as Q
from cohortlens.sources import tables

ROLES = {"evidence": "evidence", "literature_table": "lit", "constraints": "constraints.json", "literature": "lit.json", "panel": "panel.json", "robustness": "robustness.json", "gate": "gate.json", "report": "report.html"}


@pytest.fixture
def run(spark, tmp_path):
    """A run that passes: (its folder, what was written)."""
    documents = {
        "constraints": {"ranked": 5, "ineligible": 1, "unscored": 2},
        "literature": {"schema_version": "c10.literature.v1", "records": [{}] * 3, "sources": ["PubMed"]},
        "panel": {"panel": {"selected": ["a", "b"], "max_k": 3}},
        "robustness": {"schema_version": "c09.robustness.v1"},
        "gate": {"overall": "CONDITIONAL"},
    }
    for role, document in documents.items():
        (tmp_path / ROLES[role]).write_text(json.dumps(document))
    (tmp_path / "report.html").write_text("<html>")
    return tmp_path, [A.write_counted(spark.range(8).repartition(3), f"{tmp_path}/evidence"), A.write_counted(spark.range(3), f"{tmp_path}/lit")]


def failed(spark, run):
    rows = A.audit_run(spark, str(run[0]), ROLES, run[1]).collect()
    assert tuple(r.check for r in rows) == A.CHECKS
    return {r.check for r in rows if r.status == "FAIL"}


def test_a_whole_run_passes(spark, run):
    assert [w["rows"] for w in run[1]] == [8, 3]
    assert failed(spark, run) == set()


def edit(name, **fields):
    def do(root):
        path = root / ROLES[name]
        path.write_text(json.dumps(json.loads(path.read_text()) | fields))

    return do


def lose_a_file(root):
    """A part of a table that a lost disk took."""
    os.remove(next(f for f in sorted(glob.glob(f"{root}/evidence/*.parquet")) if os.path.getsize(f)))


@pytest.mark.parametrize(
    "fault, checks",
    [
        (lose_a_file, {"rows_as_written", "candidate_partition"}),
        (edit("constraints", unscored=3), {"candidate_partition"}),
        (edit("literature", schema_version="other"), {"literature_contract"}),
        (edit("literature", records=[{}]), {"literature_contract"}),
        (edit("literature", sources=["Elsewhere"]), {"literature_contract"}),
        (edit("panel", panel={"selected": ["a", "b"], "max_k": 1}), {"panel_cap"}),
        (edit("panel", panel={"selected": [], "max_k": 16}), {"panel_cap"}),
        (edit("robustness", schema_version=None), {"robustness_version"}),
        (edit("gate", overall="GOOD"), {"quality_gate"}),
        (lambda root: (root / "report.html").write_text(""), {"required_artefacts", "report_present"}),
        (lambda root: (root / "gate.json").write_text("{not json"), {"quality_gate"}),
        (lambda root: (root / "panel.json").write_text("[1]"), {"panel_cap"}),
        (lambda root: os.remove(root / "constraints.json"), {"required_artefacts", "candidate_partition"}),
    ],
)
def test_each_fault_fails_its_check(spark, run, fault, checks):
    fault(run[0])
    assert failed(spark, run) == checks


def test_bad_segments_are_set_apart(spark, tmp_path):
    (tmp_path / "seg.csv").write_text("sample,chrom,start,end,segment_mean\nA,chr1,1,9,0.3\n,chr1,1,9,0.1\nB,1,9,2,0.1\nC,,x,9,high\nD,2,5,5,\n")
    good, bad = Q.segments(spark, str(tmp_path / "seg.csv"), f"{tmp_path}/store", "case")
    assert {(r.sample_id, r.chrom, r.start, r.event, r.grp) for r in good.collect()} == {("A", "1", 1, "GAIN", "case"), ("D", "2", 5, None, "case")}
    assert good.columns == tables.read_segments(spark, str(tmp_path / "seg.csv")).columns
    got = {r.sample_id: (r.reasons, json.loads(r.row)["chrom"] if "chrom" in json.loads(r.row) else None, r.module) for r in bad.collect()}
    assert got == {None: (["missing sample"], "chr1", "copy number"), "B": (["bad end"], "1", "copy number"), "C": (["missing chromosome", "bad start", "bad number"], None, "copy number")}
    assert {(r.reason, r.rows) for r in Q.counts(bad).collect()} == {("missing sample", 1), ("bad end", 1), ("missing chromosome", 1), ("bad start", 1), ("bad number", 1)}


def test_bad_features_and_variants_are_set_apart(spark, tmp_path):
    (tmp_path / "f.csv").write_text("patient,region,feature_type,value,status\np,r,snv,1,Detected\nq,r,other,1,Detected\n,,cnv,1,Detected\n")
    good, bad = Q.features(spark, str(tmp_path / "f.csv"), f"{tmp_path}/f")
    assert [r.patient for r in good.collect()] == ["p"] and sorted(r.reasons for r in bad.collect()) == [["missing patient", "missing region"], ["unknown feature type"]]
    (tmp_path / "S1.vcf").write_text("##x\n#CHROM\tPOS\n1\t5\t.\tA\tT\t.\tPASS\tX=1\n1\tx\t.\tA\tT\t.\tPASS\tX=1\n1\t5\t.\t<A>\t\t.\tPASS\t.\n1\t5\n")
    good, bad = Q.variant_lines(spark, str(tmp_path / "S1.vcf"), f"{tmp_path}/v")
    assert good.count() == 1
    assert sorted((r.sample_id, r.reasons) for r in bad.collect()) == [("S1", ["bad position"]), ("S1", ["bad reference allele", "missing alternate allele"]), ("S1", ["too few columns", "bad reference allele", "missing alternate allele"])]
    none, empty = Q.parted(good.limit(0), {}, f"{tmp_path}/none", "x")
    assert none.count() == empty.count() == 0
