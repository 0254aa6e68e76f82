import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import sharding as S

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_passes_every_cell_by_single_steps(dims, bits):
    points = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    index = S.hilbert_index(points, bits)
    assert sorted(index) == list(range(1 << bits * dims))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_curve_has_a_bound():
    with pytest.raises(ValueError):
        S.hilbert_index(np.zeros((1, 8), int), 8)


def brute_cells(values, bits):
    """Each value's cell by the share of rows before it, null first."""
    key = lambda v: (v is not None, v or 0) if not isinstance(v, str) else (True, v.encode())
    ordered, before, n = sorted(set(values), key=key), 0, len(values)
    counts, out = Counter(values), {}
    for v in ordered:
        out[v] = before * (1 << bits) // n
        before += counts[v]
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(3000)]), rng.choice(["en", "fr", None]), rng.choice(["hot"] * 4 + [f"s{j}" for j in range(9)] + [None]), 0) for i in range(n)]


def expected(rows):
    """{doc_id: (curve, shard, slot)} of rows with distinct ids."""
    size = lambda t: len((t or "").encode()) + 1
    cells = [brute_cells(v, S.BITS) for v in ([r[2] for r in rows], [r[3] for r in rows], [size(r[1]) for r in rows])]
    points = np.array([[cells[0][r[2]], cells[1][r[3]], cells[2][size(r[1])]] for r in rows])
    index = S.hilbert_index(points, S.BITS)
    ordered = sorted(range(len(rows)), key=lambda i: (index[i], rows[i][0]))
    out, slots = {}, Counter()
    for rank, i in enumerate(ordered):
        shard = rank * S.SHARDS // len(rows)
        out[rows[i][0]] = (int(index[i]), shard, slots[shard])
        slots[shard] += 1
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return S.op12(spark, str(tmp_path)).collect()


def test_against_brute_force(spark, tmp_path):
    rows = corpus(700)
    got, want = run(spark, tmp_path, rows), expected(rows)
    assert {r.doc_id: (r.curve, r.shard, r.slot) for r in got} == want
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)


def test_repeated_null_and_few_rows(spark, tmp_path):
    """A third of the rows are one row; ids may be null; the law holds and slots have no gaps."""
    rows = corpus(200) + [(5, "same", "en", "hot", 4)] * 100 + [(None, None, None, None, None)] * 3
    got = run(spark, tmp_path / "many", rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    per = Counter(r.shard for r in got)
    assert sorted(per) == list(range(16)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
    few = run(spark, tmp_path / "few", [(1, "a", "en", None, 1), (2, None, None, None, None)])
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2
    assert run(spark, tmp_path / "none", []) == []


def test_reruns_agree(spark, tmp_path):
    rows = corpus(150)
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/x/documents.parquet")
    assert {tuple(r) for r in S.op12(spark, f"{tmp_path}/x").collect()} == {tuple(r) for r in run(spark, tmp_path, rows[::-1])}


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    """Of 64 files a box of a tenth of each of two dimensions touches few; sorted by one of them it touches all that are near in it."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(10_000), rng.randrange(10_000), f"row {i}") for i in range(4096)]
    data = spark.createDataFrame(rows, "id bigint, x bigint, y bigint, `a.b` string")
    out = S.shards(data, ["x", "y"], ["id"], keep=["id", "x", "y", "a.b"])
    S.write_shards(out, f"{tmp_path}/s", 64)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert {(r.id, r.x, r.y, r["a.b"]) for r in back.collect()} == set(rows)
    ranges = S.file_ranges(spark, f"{tmp_path}/s", ["x", "y"]).cache()
    assert ranges.count() == 64 and {r.rows for r in ranges.collect()} == {64}
    most = 0
    for x, y in ((0, 9000), (4500, 4500), (8000, 1000)):
        box = {"x": (x, x + 1000), "y": (y, y + 1000)}
        files = {r.file for r in S.touched(ranges, box).collect()}
        inside = back.where(F.col("x").between(*box["x"]) & F.col("y").between(*box["y"])).select("_metadata.file_path").distinct().collect()
        assert {r[0] for r in inside} <= files
        most = max(most, len(files))
    # Sorted by x alone a tenth of x is 6 or 7 of 64 files, but a tenth of y is all 64; along the curve both are few.
    assert most <= 9
    for only in ({"x": (4500, 5500)}, {"y": (4500, 5500)}):
        assert S.touched(ranges, only).count() <= 26


def test_clashing_names(spark):
    data = spark.createDataFrame([(1, 2)], "a int, shard int")
    with pytest.raises(ValueError):
        S.shards(data, ["a", "shard"], ["a"], keep=["shard"])
