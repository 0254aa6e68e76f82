import gzip
import hashlib
import os
import random

import pytest

from cohortlens.sources import fasta, files, sequences


def fasta_text(contigs, width, end="\n"):
    return "".join(f">{name} about it{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for name, s in contigs.items())


def bases(rng, n):
    return "".join(rng.choice("ACGTacgtn") for _ in range(n))


@pytest.fixture
def contigs():
    rng = random.Random(2)
    return {"chr1": bases(rng, 997), "2": bases(rng, 60), "MT": bases(rng, 1), "chrX": bases(rng, 500)}


@pytest.mark.parametrize("split, width, end", [(1 << 20, 60, "\n"), (100, 60, "\r\n"), (37, 10, "\n"), (7, 70, "\n")])
def test_lines_at_any_split(spark, tmp_path, contigs, split, width, end):
    """However the bytes are parted, each base has its place in its contig, and each line its place in the file."""
    path = tmp_path / "a.fa"
    path.write_bytes(fasta_text(contigs, width, end).encode())
    data, got = path.read_bytes(), {}
    for r in sequences.sequence_lines(spark, str(path), split).orderBy("at").collect():
        assert r.start == len(got.get(r.contig, "")) and data[r.at : r.at + len(r.bases)].decode().upper() == r.bases
        got[r.contig] = got.get(r.contig, "") + r.bases
    assert got == {k: s.upper() for k, s in contigs.items()}


def test_index_and_fetch(spark, tmp_path, contigs):
    path = tmp_path / "a.fa"
    path.write_text(fasta_text(contigs, 61, "\r\n"), newline="")
    sequences.write_index(spark, str(path), 128)
    lines = [x.split("\t") for x in (tmp_path / "a.fa.fai").read_text().splitlines()]
    assert [x[0] for x in lines] == list(contigs) and [int(x[1]) for x in lines] == [len(s) for s in contigs.values()]
    data = path.read_bytes()
    assert all(data[int(x[2]) : int(x[2]) + 1].decode() == contigs[x[0]][0] for x in lines)
    assert lines[0][3:] == ["61", "63"]
    own = sequences.read_index(spark, str(path))
    rng = random.Random(3)
    cases = [(c, *sorted((rng.randrange(len(s) + 1), rng.randrange(len(s) + 1))), c) for c, s in contigs.items() for _ in range(30)]
    cases += [("1", 3, 9, "chr1"), ("chr2", 0, 60, "2"), ("X", 60, 62, "chrX"), ("chr1", 0, 997, "chr1")]
    asked = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(cases)], "i int, contig string, start bigint, end bigint")
    got = {r.i: r.sequence for r in sequences.fetch(asked, own).collect()}
    assert got == {i: contigs[real][a:b].upper() for i, (_, a, b, real) in enumerate(cases)}
    odd = spark.createDataFrame([("chr1", 990, 998), ("none", 0, 1), ("2", 60, 60)], "contig string, start bigint, end bigint")
    assert {(r.contig, r.sequence) for r in sequences.fetch(odd, own).collect()} == {("chr1", None), ("none", None), ("2", "")}
    for a, b in ((-1, 4), (5, 4)):
        with pytest.raises(Exception, match="bad interval"):
            sequences.fetch(spark.createDataFrame([("2", a, b)], "contig string, start bigint, end bigint"), own).collect()


@pytest.mark.parametrize("text, says", [(">a\nACGT\nAC\nACGT\n", "different widths"), (">a\nAC\nACGT\n", "different widths"), (">a\nACGT\n\nACGT\n", "different widths"), (">a\nAC\n>a\nAC\n", "several contigs"), ("ACGT\n>a\nAC\n", "before a header"), (">\nACGT\n", "without a name")])
def test_broken_files_are_errors(spark, tmp_path, text, says):
    (tmp_path / "a.fa").write_text(text)
    with pytest.raises(Exception, match=says):
        sequences.index(sequences.sequence_lines(spark, str(tmp_path / "a.fa"))).collect()


def test_missing_empty_and_compressed(spark, tmp_path, contigs):
    with pytest.raises(Exception, match="no such"):
        sequences.sequence_lines(spark, str(tmp_path / "none.fa")).collect()
    (tmp_path / "e.fa").write_text("")
    with pytest.raises(ValueError, match="no sequences"):
        sequences.write_index(spark, str(tmp_path / "e.fa"))
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(fasta_text(contigs, 50))
    whole = {}
    for r in sequences.sequence_lines(spark, str(tmp_path / "z.fa.gz"), 10).orderBy("at").collect():
        whole[r.contig] = whole.get(r.contig, "") + r.bases
    assert whole == {k: s.upper() for k, s in contigs.items()}
    with pytest.raises(ValueError, match="compressed"):
        sequences.write_index(spark, str(tmp_path / "z.fa.gz"))
    (tmp_path / "i.fa.fai").write_text("a\t1\t2\n")
    with pytest.raises(Exception, match="bad index row"):
        sequences.read_index(spark, str(tmp_path / "i.fa")).collect()


def test_chunks_of_a_folder(spark, tmp_path, contigs):
    for name, s in contigs.items():
        (tmp_path / f"{name}.fa").write_text(fasta_text({name: s}, 33))
    got = {}
    for r in fasta.read_fasta(spark, str(tmp_path), chunk=64).orderBy("contig", "chunk_no").collect():
        assert r.start == len(got.get(r.contig, ""))
        got[r.contig] = got.get(r.contig, "") + r.bases
    assert got == {k: s.upper() for k, s in contigs.items()}


def test_hashes_stream(spark, tmp_path):
    """A sparse file of over 2 GB, more than a cell can hold, and an empty one."""
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate((1 << 31) + 5)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.gz").write_bytes(b"plain bytes")
    (tmp_path / "none").write_bytes(b"")
    got = {os.path.basename(r.path): r for r in files.file_hashes(spark, str(tmp_path)).collect()}
    zeros, left = hashlib.sha256(), (1 << 31) + 5
    while left:
        n = min(left, 1 << 24)
        zeros.update(bytes(n))
        left -= n
    assert got["big.bin"].sha256 == zeros.hexdigest() and got["big.bin"].length == (1 << 31) + 5
    assert got["x.gz"].md5 == hashlib.md5(b"plain bytes").hexdigest() and got["none"].sha256 == hashlib.sha256(b"").hexdigest()


def test_verified(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    own = files.listed(spark, str(tmp_path))
    uri = {r.path[-1]: r.path for r in own.collect()}
    rows = [(uri["a"], 1, hashlib.md5(b"a").hexdigest().upper(), None), (uri["b"], 2, None, None), (uri["c"], None, None, "0" * 64), ("file:/none", None, None, None)]
    got = {r.path: r.status for r in files.verified(spark.createDataFrame(rows, "path string, length bigint, md5 string, sha256 string"), own).collect()}
    assert got == {uri["a"]: "VERIFIED", uri["b"]: "SIZE_MISMATCH", uri["c"]: "SHA256_MISMATCH", "file:/none": "MISSING"}


def test_texts_are_written_whole(spark, tmp_path):
    path = f"file://{tmp_path}/deep/report.html"
    for text in ("first", "sécond\nline"):
        assert files.write_text(spark, path, text) == path and files.read_text(spark, path) == text
    assert sorted(x for x in os.listdir(tmp_path / "deep") if not x.startswith(".")) == ["report.html"]


def test_asked_intervals_meet_as_distinct_ones(spark):
    """Rows of both tables may be equal in what is asked: pairs grow with what is distinct."""
    from cohortlens.queries import _asked_intervals

    part = spark.range(6000).selectExpr("concat('Brand#', id % 3) as p_brand", "cast(id % 2 as int) as p_size")
    supplier = spark.range(7200).selectExpr("id as s_suppkey", "cast(id % 2 as int) as s_nationkey")
    asked = _asked_intervals(part, supplier)
    own = [(f"Brand_{b}", n) for b in range(3) for n in range(2)]
    want = {(("chr" if s % 2 == 0 else "") + b, s * 7 % 400, s * 7 % 400 + s % 90) for b, n in own for s in range(7200) if s % 2 == n}
    got = asked.collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    _, below = asked._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert below.count("Aggregate") == 2


def test_files_are_read_twice_for_intervals(spark, tmp_path, contigs):
    """Once for lines, once for what each range leaves open: both forms of a name come from one index."""
    (tmp_path / "a.fa").write_text(fasta_text(contigs, 60))
    asked = spark.createDataFrame([("1", 3, 9)], "contig string, start bigint, end bigint")
    found = sequences.fetch(asked, sequences.index(sequences.sequence_lines(spark, str(tmp_path))))
    assert [r.sequence for r in found.collect()] == [contigs["chr1"][3:9].upper()]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("fasta_lines") == 2
