import itertools
import random

import numpy as np
import pytest

from cohortlens.llm import mixing as M


@pytest.mark.parametrize("seed", range(40))
def test_knapsack_is_best(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 20), 4)
    counts = [rng.randrange(4) for _ in lengths]
    budget = rng.randrange(60)
    take = M.knapsack(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
    sums = [sum(a * b for a, b in zip(lengths, x, strict=True)) for x in itertools.product(*(range(c + 1) for c in counts))]
    assert sum(a * b for a, b in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("seed", range(20))
def test_fill_meets_the_budget(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(0, 3000), 200)))
    counts = np.array([rng.randrange(1, 50) for _ in lengths])
    total = int((lengths * counts).sum())
    budget = rng.randrange(total)
    take = M.fill(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert int((lengths * take).sum()) == budget


def test_fill_spreads_over_lengths():
    lengths, counts = np.arange(1, 4001), np.ones(4000, np.int64)
    take = M.fill(lengths, counts, int(lengths.sum()) // 2)
    shares = [take[i : i + 1000].mean() for i in range(0, 4000, 1000)]
    assert int((lengths * take).sum()) == int(lengths.sum()) // 2 and max(shares) - min(shares) < 0.6


def test_fill_of_long_documents():
    lengths, counts = np.array([3, 100_000, 300_001]), np.array([2, 1, 3])
    take = M.fill(lengths, counts, 500_000)
    assert (lengths * take).sum() == 400_007


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 5, "é": 0}, {None: 4}, {"b": 0}, {"z": 100, "y": 3, "x": 900, "w": 2, "v": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * (i % 5 + 1) for _ in range(rng.randrange(1, 40))), rng.choice(["hot"] * 8 + ["b", "ä", None]), 1.5) for i in range(3000)]
    rows += [(5000, None, "b", 0.0), (5001, "", "hot", 0.0), (17, rows[17][1], rows[17][2], 1.5), (None, "a b", "b", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double").repartition(4)
    got = M.mix(docs.drop("target")).collect()
    assert len(got) == len(rows)
    again = M.mix(docs.drop("target").repartition(7), store=False).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        sizes[r.mix_source] = sizes.get(r.mix_source, 0) + r.size
        taken[r.mix_source] = taken.get(r.mix_source, 0) + r.size * r.copies
        target[r.mix_source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 40
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[5000].size == by_id[5001].size == 0
    assert M.mix(docs.drop("target").limit(0)).count() == 0


def test_repeated_rows_meet_the_target(spark):
    same = " ".join(["w"] * 10)
    rows = [(7, same, "a", i) for i in range(1000)] + [(i, same, "b", 0) for i in range(100, 600)] + [(i, same, "c", 0) for i in range(600, 1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int").repartition(5)
    with pytest.raises(ValueError):
        M.mix(docs, keep=["doc_id", "copies"])
    for store in (True, False):
        got = M.mix(docs, keep=["doc_id", "copies"], prefix="x_", store=store).collect()
        assert len(got) == len(rows)
        for s in "abc":
            own = [r for r in got if r.x_mix_source == s]
            assert abs(sum(r.x_copies * r.x_size for r in own) - own[0].x_target) <= 10
            assert all(0 <= r.x_copies <= 3 for r in own)


def test_which_documents_are_taken(spark):
    """Of each length, the whole rounds and then the documents of the least hashes, as many as fill() says."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 4, 9, 30])), rng.choice("aab")) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(42, doc_id, text) as h").collect()}
    got = {r.doc_id: r for r in M.mix(docs).collect()}
    for s in "ab":
        own = [r for r in got.values() if r.mix_source == s]
        size, target = own[0].source_size, own[0].target
        rounds, rest = divmod(min(round(target), 3 * size), size)
        lengths = sorted({r.size for r in own})
        take = dict(zip(lengths, M.fill(np.array(lengths), np.array([sum(r.size == n for r in own) for n in lengths]), rest), strict=True))
        for n in lengths:
            chosen = {r.doc_id for r in sorted((r for r in own if r.size == n), key=lambda r: hashes[r.doc_id])[: take[n]]}
            assert all(r.copies == rounds + (r.doc_id in chosen) for r in own if r.size == n)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "b c", "b")], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.size for r in M.mix(docs).collect()} == {1: 400_000, 2: 2}
