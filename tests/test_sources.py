import gzip

import pytest

from cohortlens.sources import fasta, sinks, tables, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def write(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return str(path)


def test_cohort(spark, tmp_path):
    multi = HEAD + "\tFORMAT\tS1\tS2\tS3\n1\t100\trs1\tA\tT,G\t50\tPASS\tGENE=TP53;IMPACT=HIGH\tGT:DP\t0/1:9\t1|2:8\t0/0:7\n1\t100\t.\tA\tT\t.\tPASS\tGENE=LAST\tGT\t0/1\t0/0\t./.\n"
    write(tmp_path / "m.vcf.gz", multi, True)
    write(tmp_path / "solo.vcf", HEAD + "\n2\t5\t.\tAT\tA\t.\tPASS\tSYMBOL=KRAS\n")
    samples, variants = vcf.read_cohort(spark, str(tmp_path), "case")
    assert sorted(r.sample_id for r in samples.collect()) == ["S1", "S2", "S3", "solo"]
    got = {(r.sample_id, r.variant_key): (r.gene, r.variant_type) for r in variants.collect()}
    assert got == {("S1", "1:100:A:T"): ("LAST", "SNV"), ("S2", "1:100:A:T"): ("TP53", "SNV"), ("S2", "1:100:A:G"): ("TP53", "SNV"), ("solo", "2:5:AT:A"): ("KRAS", "INDEL")}


def test_bad_records_and_shared_names(spark, tmp_path):
    write(tmp_path / "a/x.vcf", HEAD + "\n1\t2\t.\tA\n")
    with pytest.raises(Exception, match="fewer than 8 columns"):
        vcf.read_vcf(spark, str(tmp_path / "a")).collect()
    for d in "bc":
        write(tmp_path / f"two/{d}.vcf", HEAD + "\tFORMAT\tS1\n1\t2\t.\tA\tT\t.\t.\t.\tGT\t0/1\n")
    with pytest.raises(Exception, match="several files"):
        vcf.read_cohort(spark, str(tmp_path / "two"), "case")[0].collect()


def test_observations(spark, tmp_path):
    text = HEAD + "\tFORMAT\tP\n1\t10\t.\tA\tT,AC\t.\tPASS\tDP=77\tGT:DP:AD\t1/2:100:10,40,50\n1\t20\t.\tG\tC\t.\tLowQual\t.\tGT\t0/1\n1\t30\t.\tG\tC\t.\t.\tDP=12;AF=0.25\tGT\t./.\n1\t40\t.\tG\tC\t.\tPASS\t.\tGT\t0/0\n"
    path = write(tmp_path / "o.vcf", text)
    got = sorted((r.start, r.alt, r.feature_type, r.status, r.depth, r.vaf) for r in vcf.read_observations(spark, path, "case").collect())
    assert got == [(10, "AC", "INDEL", "Detected", 100.0, 0.5), (10, "T", "SNV", "Detected", 100.0, 0.4), (30, "C", "SNV", "Data unavailable", 12.0, 0.25), (40, "C", "SNV", "Not detected", None, None)]
    assert {r.start for r in vcf.read_observations(spark, path, "case", min_depth=50).collect()} == {10}


def test_subset_and_quality(spark, tmp_path):
    path = write(tmp_path / "s.vcf", HEAD + "\tFORMAT\tA\tB\tC\n1\t1\t.\tA\tT\t.\t.\tSOURCE=x\tGT\ta\tb\tc\n")
    assert [r.line.split("\t")[-2:] for r in vcf.subset_samples(spark, path, ["C", "A"]).orderBy("at").collect()][1:] == [["C", "A"], ["c", "a"]]
    with pytest.raises(ValueError):
        vcf.subset_samples(spark, path, ["Z"])
    assert vcf.vcf_quality(vcf.lines(spark, path)).first().status == "PASS"


SEQ = "ACGTCACACACACAGGGTTTACGATCG"


@pytest.fixture
def reference(spark, tmp_path):
    path = write(tmp_path / "ref.fa", ">chr1 first\n" + "\n".join(SEQ[i : i + 7] for i in range(0, len(SEQ), 7)) + "\n>2\nAAAA\nCC\n")
    return fasta.read_fasta(spark, path, chunk=8)


def test_fasta(spark, reference):
    parts = {}
    for r in reference.orderBy("contig", "chunk_no").collect():
        assert len(parts.get(r.contig, "")) == r.start
        parts[r.contig] = parts.get(r.contig, "") + r.bases
    assert parts == {"chr1": SEQ, "2": "AAAACC"}


def brute(seq, pos, ref, alt):
    """The leftmost equal change, by trying every place and pair of alleles."""
    whole = seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]
    d = len(ref) - len(alt)
    for p in range(1, len(seq) + 1):
        for n in range(1, len(seq) - p + 2):
            r = seq[p - 1 : p - 1 + n]
            m = n - d
            if m >= 1 and min(n, m) == 1 and seq[: p - 1] + whole[p - 1 : p - 1 + m] + seq[p - 1 + n :] == whole:
                return p, r, whole[p - 1 : p - 1 + m]


def test_normalize(spark, reference):
    cases = [(12, "ACA", "A"), (5, "CACA", "CA"), (14, "A", "ACA"), (15, "GGG", "GG"), (20, "TA", "T"), (16, "GGT", "GT")]
    rows = [("1", p, r, a, i) for i, (p, r, a) in enumerate(cases)] + [("1", 3, "A", "T", 90), ("9", 3, "A", "T", 91), ("1", 3, "G", "<DEL>", 92), ("1", 3, "g", "t", 93)]
    got = {r.row_no: (r.pos, r.ref, r.alt, r.norm_status) for r in fasta.normalize(spark.createDataFrame(rows, "chrom string, pos bigint, ref string, alt string, row_no int"), reference, chunk=8).collect()}
    for i, (p, r, a) in enumerate(cases):
        assert got[i][:3] == brute(SEQ, p, r, a), cases[i]
    assert [got[i][3] for i in (90, 91, 92, 93)] == ["REF_MISMATCH", "NO_REFERENCE", "SYMBOLIC", "NORMALIZED"]


def test_maf(spark, tmp_path, reference):
    head = "\t".join(["Hugo_Symbol", *tables.MAF_FIELDS])
    body = [("G", "chr1", "5", "C", "T", "S/1"), ("G", "chr1", "6", "-", "GG", "S/1"), ("G", "chr1", "9", "AC", "-", "S/1"), ("G", "chr1", "5", "C", "T", "S/1"), ("G", "7", "9", "AC", "-", "S2")]
    path = write(tmp_path / "x.maf", "﻿#version\n" + head + "\n#later\n" + "\n".join("\t".join(b) for b in body) + "\n")
    rows = tables.read_maf(spark, path)
    assert rows.count() == 5
    plain = sorted((r.sample, r.pos) for r in tables.maf_vcf_lines(rows).collect())
    assert plain == [("S_1", 5)]
    full = fasta.read_fasta(spark, str(tmp_path / "ref.fa"))
    lines = sorted((r.pos, *r.line.split("\t")[3:5]) for r in tables.maf_vcf_lines(rows, full).collect())
    assert lines == [(5, "C", "T"), (6, "A", "AGG"), (8, SEQ[7] + "AC", SEQ[7])]


def test_segments_features_and_manifest(spark, tmp_path):
    path = write(tmp_path / "seg.tsv", "GDC Aliquot\tChromosome\tStart\tEnd\tSegment Mean\tGene-Name\nA\tchr1\t1\t9\t0.3\tX;Y\nB\t1\t1\t9\t\t\nC\t1\t1\t9\t0.0\t\n".replace("Gene-Name", "gene-name"))
    got = {r.sample_id: (r.chrom, r.event, r.status, r.grp) for r in tables.read_segments(spark, path, "case").collect()}
    assert got == {"A": ("1", "GAIN", "Detected", "case"), "B": ("1", None, "Data unavailable", "case"), "C": ("1", "NEUTRAL", "Not detected", "case")}
    bad = write(tmp_path / "bad.csv", "sample,chrom,start,end\nA,1,9,2\n")
    with pytest.raises(Exception, match="bad segment start"):
        tables.read_segments(spark, bad).collect()
    feats = write(tmp_path / "f.csv", "patient,region,feature_type,value,status\np,r,snv,1,not DETECTED\n")
    r = tables.read_features(spark, feats).first()
    assert (r.feature_type, r.status, r.value_num) == ("SNV", "Not detected", 1.0)
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_features(spark, bad)
    write(tmp_path / "set/cancer/C1.vcf", HEAD)
    write(tmp_path / "set/healthy/H1.csv", "x")
    assert {(r.id, r.grp) for r in tables.discover(spark, str(tmp_path / "set")).collect()} == {("C1", "case"), ("H1", "control")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    sinks.write_csv(df, str(tmp_path / "out"), ["v", "k", "none"])
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), header=True).collect()), key=str) == [("1.0", "a", None), (None, "b", None)]
    assert {r.v for r in sinks.with_sentinel(df, ["v"]).collect()} == {"1.0", "Data unavailable"}
    report = str(tmp_path / "r/report.html")
    sinks.write_report(report, "T<", {"n": 2}, df, ["k", "v"], 1, "k")
    sinks.append_section(report, "More", {"x": "&"})
    text = open(report).read()
    assert "T&lt;" in text and text.index("More") < text.index("</body>") and "<td>a</td>" in text and "<td>b</td>" not in text
    assert sinks.read_json(sinks.write_json(str(tmp_path / "x/y.json"), {"a": 1})) == {"a": 1}
    assert {r.length for r in tables.file_hashes(spark, str(tmp_path / "x")).collect()} == {len(open(tmp_path / "x/y.json").read())}
