import glob
import random

from pyspark.sql import functions as F

from cohortlens.functions import variants as V
from cohortlens.plans import workflow
from cohortlens.sources import fasta, vcf
from tests.test_sources import brute

SEQ = "ACGTCACACACACAGGGTTTACGATCGACGT"


def test_ten_files_in_ten_out(spark, tmp_path):
    """Each file keeps its header, the order of its contigs and its own copies; equal records go within a file only."""
    rng, want = random.Random(1), {}
    (tmp_path / "ref.fa").write_text(f">1\n{SEQ}\n>2\n{SEQ[::-1]}\n")
    (tmp_path / "in").mkdir()
    for i in range(10):
        contigs = ["1", "2"] if i % 2 else ["2", "1"]
        rows = []
        for c in contigs:
            seq = SEQ if c == "1" else SEQ[::-1]
            for pos in sorted(rng.sample(range(2, len(SEQ) - 4), 5)):
                ref = seq[pos - 1 : pos + 1]
                rows.append((c, pos, ref, ref[0]))
        rows.append(rows[-1])
        head = ["##fileformat=VCFv4.2", f"##file={i}", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
        (tmp_path / f"in/f{i}.vcf").write_text("\n".join(head + [f"{c}\t{p}\tid{n}\t{r}\t{a}\t.\tPASS\tX={n}" for n, (c, p, r, a) in enumerate(rows)]) + "\n")
        got, seen = [], set()
        for c, p, r, a in rows:
            got.append((c, *brute(SEQ if c == "1" else SEQ[::-1], p, r, a)))
        unique = [x for x in got if not (x in seen or seen.add(x))]
        want[f"f{i}.vcf"] = (head, sorted(unique, key=lambda x: (contigs.index(x[0]), x[1])), len(rows))
    report = {r.file.rsplit("/", 1)[1]: r for r in vcf.normalize_batch(spark, f"{tmp_path}/in", fasta.read_fasta(spark, f"{tmp_path}/ref.fa"), f"{tmp_path}/out").collect()}
    assert report.keys() == want.keys()
    for name, (head, records, n) in want.items():
        lines = [x for f in sorted(glob.glob(f"{tmp_path}/out/name={name}/part-*")) for x in open(f).read().splitlines()]
        assert lines[:3] == head
        cells = [x.split("\t") for x in lines[3:]]
        assert sorted((c[0], int(c[1]), c[3], c[4]) for c in cells) == sorted(records)
        assert [(c[0], int(c[1])) for c in cells] == [x[:2] for x in records]
        assert (report[name].records, report[name].expanded, report[name].written, report[name].status) == (n, n, len(records), "PASS")


def test_alternates_and_mismatches(spark, tmp_path):
    (tmp_path / "ref.fa").write_text(f">chr1\n{SEQ}\n")
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n1\t5\t.\tC\tT,G\t.\tPASS\tX\tGT\t1/2\n1\t6\t.\tG\tT\t.\tPASS\tX\tGT\t0/1\n")
    r = vcf.normalize_batch(spark, str(tmp_path / "a.vcf"), fasta.read_fasta(spark, str(tmp_path / "ref.fa")), str(tmp_path / "out")).first()
    assert (r.records, r.expanded, r.written, r.mismatches, r.status) == (2, 3, 3, 1, "CONDITIONAL")
    assert workflow.main(["normalize", str(tmp_path / "a.vcf"), str(tmp_path / "ref.fa"), str(tmp_path / "done")]) == 0
    assert spark.read.parquet(f"{tmp_path}/done/report").count() == 1


def test_build_names(spark):
    df = spark.createDataFrame([("hg38",), ("GRCh37",), ("hg19",), ("HG19",), (None,)], "n string")
    assert [r.b for r in df.select(V.build_name(F.col("n")).alias("b")).collect()] == ["GRCh38", "GRCh37", "GRCh37", None, None]
