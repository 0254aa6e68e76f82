import itertools
import math
import random

import pytest

from cohortlens.operators import panel_search as X

SCHEMA = "patient string, candidate string, value double"


def coverage(matrix, panel):
    shares = []
    for row in matrix.values():
        seen = [min(1.0, max(0.0, row[c])) for c in panel if c in row]
        if seen:
            shares.append(1 - math.prod(1 - v for v in seen))
    return sum(shares) / len(shares) if shares else 0.0


def enumerated(matrix, k):
    names, best = sorted({c for r in matrix.values() for c in r}), (0.0, ())
    for n in range(1, k + 1):
        for panel in itertools.combinations(names, n):
            at = coverage(matrix, panel)
            if at > best[0] + 1e-12:
                best = (at, panel)
    return best


def matrix_of(seed, patients=40, candidates=8, values=(0.0, 0.2, 0.5, 0.9, 1.0, 1.5, -1.0), missing=0.3):
    rng = random.Random(seed)
    names = [f"c{i:02d}" for i in range(candidates)]
    return {f"p{i}": {c: rng.choice(values) for c in names if rng.random() > missing} for i in range(patients)}


def frame(spark, matrix):
    return spark.createDataFrame([(p, c, v) for p, row in matrix.items() for c, v in row.items()], SCHEMA)


@pytest.mark.parametrize("seed, k, missing", [(1, 3, 0.3), (2, 8, 0.3), (3, 4, 0.0), (4, 2, 0.8), (5, 15, 0.6)])
def test_exact_is_the_enumerated_best(spark, seed, k, missing):
    m = matrix_of(seed, missing=missing)
    got, want = X.exact_panel(frame(spark, m), k), enumerated(m, min(k, 8))
    assert got["status"] == "optimal" and tuple(got["panel"]) == want[1] and abs(got["coverage"] - want[0]) < 1e-9


def test_ties_take_the_smallest_then_the_first_by_name(spark):
    m = {"p1": {"d": 1.0, "b": 1.0, "a": 0.0}, "p2": {"d": 1.0, "b": 1.0, "c": 0.5}}
    assert X.exact_panel(frame(spark, m), 3)["panel"] == ["b"]
    m = {"p1": {"b": 1.0, "a": 0.0, "d": 0.0, "c": 1.0}, "p2": {"b": 0.0, "a": 1.0, "d": 1.0, "c": 0.0}}
    assert X.exact_panel(frame(spark, m), 4)["panel"] == ["a", "b"]


def test_missing_is_not_negative_and_zero_is(spark):
    assert X.exact_panel(frame(spark, {"P1": {"A": 1.0}, "P2": {"B": 1.0}}), 2)["panel"] == ["A"]
    assert X.greedy_panel(frame(spark, {"P1": {"A": 0.0}, "P2": {}}))[0]["coverage"] == 0.0
    assert X.exact_panel(frame(spark, {"P1": {"A": 0.0}}), 2) == {"status": "optimal", "panel": [], "coverage": 0.0, "scored": 1}


def test_bounds_save_panels_of_22_candidates(spark):
    m = matrix_of(9, patients=200, candidates=22, values=(0.0, 0.0, 0.0, 0.3, 1.0), missing=0.0)
    got = X.exact_panel(frame(spark, m), 4)
    assert tuple(got["panel"]) == enumerated(m, 4)[1]
    assert got["scored"] < sum(math.comb(22, i) for i in range(1, 5))
    over = X.exact_panel(frame(spark, matrix_of(9, candidates=23)), 4)
    assert (over["status"], over["panel"]) == ("not_run", [])


@pytest.mark.parametrize("seed, gain", [(1, 0.02), (2, 0.0), (3, 0.1)])
def test_greedy_is_among_observed_patients(spark, seed, gain):
    m, chosen, before = matrix_of(seed), [], 0.0
    names = {c for r in m.values() for c in r}
    while names - {*chosen}:
        best = max(names - {*chosen}, key=lambda c: (round(coverage(m, [*chosen, c]), 12), c))
        now = coverage(m, [*chosen, best])
        if chosen and now - before < gain:
            break
        chosen.append(best)
        before = now
    got = X.greedy_panel(frame(spark, m), min_gain=gain)
    assert [s["candidate"] for s in got] == chosen and abs(got[-1]["coverage"] - before) < 1e-9


def test_comparison(spark):
    row = X.greedy_and_exact(frame(spark, matrix_of(3)), 3).first()
    assert row.status == "optimal" and row.delta >= -1e-12
    assert X.greedy_and_exact(frame(spark, matrix_of(3, candidates=23)), 3).first().delta is None
    assert X.greedy_and_exact(spark.createDataFrame([], SCHEMA)).first().status == "Data unavailable"
