import itertools
import math
import random

import numpy as np
import pytest

from cohortlens.operators import resample as R

SCHEMA = "region string, sample_id int, grp string, value double"


def enumerated(case, control):
    pooled, k = case + control, len(case)
    observed = abs(sum(case) / k - sum(control) / len(control))
    far = 0
    for chosen in itertools.combinations(range(len(pooled)), k):
        a = [pooled[i] for i in chosen]
        far += abs(sum(a) / k - (sum(pooled) - sum(a)) / (len(pooled) - k)) >= observed - 1e-12
    return far / math.comb(len(pooled), k)


def p_of(case, control, **more):
    return R.permutation_p(np.array(case + control, float), np.array([1] * len(case) + [0] * len(control), bool), **more)


@pytest.mark.parametrize("seed", range(40))
def test_halves_count_every_split(seed):
    """Also with ties and equal values, where many splits are as far as the observed one."""
    rng = random.Random(seed)
    draw = rng.choice([lambda: rng.choice([0.0, 0.1, 0.25]), rng.random, lambda: rng.gauss(0, 1) ** 3, lambda: 1.0])
    case, control = [draw() for _ in range(rng.randrange(1, 7))], [draw() for _ in range(rng.randrange(1, 8))]
    assert p_of(case, control) == pytest.approx(enumerated(case, control), abs=1e-12)


def test_exact_beyond_a_hundred_thousand_splits(monkeypatch):
    """Of 24 values there are 2.7 million splits: each is counted, and draws agree."""
    rng = random.Random(5)
    case, control = [rng.random() + 0.3 for _ in range(12)], [rng.random() for _ in range(12)]
    exact = p_of(case, control)
    values = np.array(case + control)
    sums = np.concatenate([values[R._splits(24, 12)[i : i + 300_000]].sum(axis=1) for i in range(0, math.comb(24, 12), 300_000)])
    far = np.abs(2 * sums - values.sum()) / 12 >= abs(np.mean(case) - np.mean(control)) - 1e-12
    assert exact == pytest.approx(far.mean(), abs=1e-12)
    monkeypatch.setattr(R, "HALVED", 0)
    assert abs(p_of(case, control, draws=100_000) - exact) < 0.1 * exact


@pytest.mark.parametrize("shift, n", [(0.0, 60), (0.3, 80), (1.5, 60)])
def test_draws_end_early_and_agree_with_the_normal_law(shift, n):
    rng = np.random.default_rng(1)
    case, control = rng.normal(shift, 1, n), rng.normal(0, 1, n)
    pooled = np.concatenate([case, control])
    z = abs(case.mean() - control.mean()) / (pooled.std(ddof=1) * math.sqrt(2 / n))
    want, got = math.erfc(z / math.sqrt(2)), p_of(list(case), list(control), draws=100_000)
    assert abs(got - want) <= 0.15 * want + 2e-4
    assert got == p_of(list(case), list(control), draws=100_000)


def test_one_group_or_no_difference():
    assert p_of([1.0], []) is None
    assert p_of([2.0, 2.0], [2.0] * 40) == 1.0


def test_operator(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"r{i}", p, rng.choice(["case", "control"]), rng.choice([0.1, 0.2, 0.7])) for i in range(12) for p in range(10) for _ in range(2)]
    rows += [("lone", 1, "case", 0.5), (None, 1, "case", 0.5), (None, 2, "control", 0.1), ("skip", 1, None, 0.1), ("skip", 2, "case", None)]
    per = {}
    for region, p, g, v in rows:
        if g and v is not None:
            per.setdefault(region, {}).setdefault((p, g), []).append(v)
    want = {}
    for region, own in per.items():
        a, b = ([sum(v) / len(v) for (_, g), v in own.items() if g == x] for x in ("case", "control"))
        want[region] = (len(a), len(b), enumerated(a, b) if a and b else None)
    got = {r.region: r for r in R.permutation_tests(spark.createDataFrame(rows, SCHEMA), "region").collect()}
    assert set(got) == set(want)
    for region, (a, b, p) in want.items():
        r = got[region]
        assert (r.n_case, r.n_control) == (a, b) and (r.p_value is None if p is None else r.p_value == pytest.approx(p, abs=1e-9))
    monkeypatch.setattr(R, "DRAWN", 5)  # beyond which no row holds a test's values
    many = {r.region: r.p_value for r in R.permutation_tests(spark.createDataFrame(rows, SCHEMA), "region").collect()}
    assert all(abs(many[x] - want[x][2]) < 0.2 for x in want if want[x][2] is not None and sum(want[x][:2]) > 5)
