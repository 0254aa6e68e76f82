"""Exact tests, effect sizes and detectability as Columns: no shuffle, no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.sinks import staged

_SMALL = [math.lgamma(n + 1) for n in range(64)]


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 64, Stirling's series above, whose error is under 1e-15 there."""
    x = n.cast("double")
    y = F.greatest(x, F.lit(32.0))
    series = y * F.ln(y) - y + 0.5 * F.ln(y * (2 * math.pi)) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    table = F.array(*[F.lit(v) for v in _SMALL])
    return F.when(x < len(_SMALL), F.get(table, F.least(F.greatest(n.cast("int"), F.lit(0)), F.lit(len(_SMALL) - 1)))).otherwise(series)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table [[a, b], [c, d]]: the sum over tables as likely or less, with relative tolerance 1e-7.

    The fold runs over the possible values of a, so its length is the smaller margin. Each table's log probability
    follows from the one before by one logarithm; what doesn't change in a row is computed once. Empty tables give 1.
    """
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    fixed = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(b + d) - log_factorial(r1 + r2)
    log_p = lambda x: fixed - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x)
    lo, hi = F.greatest(F.lit(0), c1 - r2), F.least(r1, c1)
    row = F.struct(lo.alias("lo"), hi.alias("hi"), log_p(lo).alias("first"), (log_p(a) + 1e-7).alias("bound"), r1.alias("r1"), c1.alias("c1"), (r2 - c1).alias("rest"))

    def total(v: Column) -> Column:
        likely = lambda s: s["sum"] + F.when(s["log"] <= v["bound"], F.exp(s["log"])).otherwise(0.0)
        step = lambda x: F.ln((v["r1"] - x + 1.0) * (v["c1"] - x + 1.0) / (x * (v["rest"] + x).cast("double")))
        start = F.struct(v["first"].alias("log"), F.lit(0.0).alias("sum"))
        onward = F.aggregate(F.filter(F.sequence(v["lo"], v["hi"]), lambda x: x > v["lo"]), start, lambda s, x: F.struct((s["log"] + step(x)).alias("log"), likely(s).alias("sum")))
        return F.get(F.transform(F.array(onward), likely), F.lit(0))

    return F.when(r1 + r2 == 0, 1.0).otherwise(F.least(F.lit(1.0), F.get(F.transform(F.array(row), total), F.lit(0))))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", q: str = "q_value") -> DataFrame:
    """df with q: over rows whose p is not null; others have a null q. df is written once.

    q follows from p and how many are at most it: equal ones are counted first, then counts run up and minima run down
    within ranges of p, and across ranges by one row a range. A range is a 64th of an octave, so there are under 70,000
    of them however many tests there are, and no window takes all tests.
    """
    rows = staged(df, "tested")
    key = F.col(p)
    span = F.when(F.col("__p") > 0, F.floor(F.log2("__p") * 64)).otherwise(-(1 << 20)).cast("bigint")
    counts = rows.where(key.isNotNull()).groupBy(key.alias("__p")).agg(F.count("*").alias("__k")).withColumn("__span", span)
    upto = Window.partitionBy("__span").orderBy("__p")
    counts = staged(counts.withColumn("__upto", F.sum("__k").over(upto)), "tested-counts")
    spans = counts.groupBy("__span").agg(F.sum("__k").alias("__s"))
    before = F.sum("__s").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__s")
    spans = spans.select("__span", before.alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__n"))
    ratio = counts.join(spans, "__span").select("__p", "__span", (F.col("__p") * F.col("__n") / (F.col("__upto") + F.col("__before"))).alias("__r"))
    least = ratio.groupBy("__span").agg(F.min("__r").alias("__m"))
    later = F.min("__m").over(Window.orderBy(F.col("__span").desc()).rowsBetween(Window.unboundedPreceding, -1))
    within = F.min("__r").over(Window.partitionBy("__span").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ratio.withColumn("__w", within).join(least.select("__span", later.alias("__l")), "__span").select("__p", F.least(F.lit(1.0), F.col("__w"), F.col("__l")).alias(q))
    return rows.join(found, key == F.col("__p"), "left").drop("__p")


def cohen_h(p1: Column, p2: Column) -> Column:
    return F.abs(2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Haldane-Anscombe corrected."""
    return ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))


def sidak_alpha(alpha: float, k: Column) -> Column:
    """The level of each of k tests for a level of alpha of all."""
    return 1 - F.pow(F.lit(1 - alpha), 1.0 / F.greatest(F.lit(1), k))


def standardized_difference(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Cohen's d with the pooled deviation; NULL below two values a group or without variation."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m1 - m2) / F.sqrt(pooled))


def alternate_fraction(fraction: Column, error: Column, dilution: float = 1.0, copies: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction * dilution / max(0.1, copies) + error))


def upper_tail(n: Column, p: Column, least: int) -> Column:
    """P(X >= least) of a binomial, by the complement in log space: deep coverage doesn't overflow."""
    n = n.cast("bigint")
    safe = F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), p))
    term = lambda k: F.when(k <= n, F.exp(log_factorial(n) - log_factorial(k) - log_factorial(F.greatest(n - k, F.lit(0))) + k * F.ln(safe) + (n - k) * F.ln(1 - safe))).otherwise(0.0)
    below = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(least - 1).cast("bigint")), F.lit(0.0), lambda s, k: s + term(k)) if least > 0 else F.lit(0.0)
    return F.when(p <= 0, 1.0 if least <= 0 else 0.0).when(p >= 1, (n >= least).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - below)))


def detectability(fraction: Column, depth: Column, error: Column, background: Column, least: int = 3, sites: int = 1) -> Column:
    """Chance that at least `least` reads of one of `sites` sites show the variant."""
    p = alternate_fraction(fraction, error) * (1 - F.coalesce(background, F.lit(0.0)))
    return 1 - F.pow(1 - upper_tail(depth, p, least), F.lit(float(sites)))


def simple_power(fraction: Column, depth: Column, error: Column, least: int = 3) -> Column:
    """The second model in use: P(X >= least) at fraction + error, without dilution and background."""
    return upper_tail(depth, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction + error)), least)


def limit_of_detection(depth: Column, error: Column, target: float = 0.95, least: int = 3, upper: float = 1.0, steps: int = 40) -> Column:
    """Smallest fraction with the target power, by bisection within the row; NULL where even `upper` has less."""
    power = lambda f: upper_tail(depth, alternate_fraction(f, error), least)
    half = lambda s, _: F.struct(F.when(power((s["lo"] + s["hi"]) / 2) >= target, s["lo"]).otherwise((s["lo"] + s["hi"]) / 2).alias("lo"), F.when(power((s["lo"] + s["hi"]) / 2) >= target, (s["lo"] + s["hi"]) / 2).otherwise(s["hi"]).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(upper).alias("hi")), half)
    return F.when(power(F.lit(upper)) >= target, found["hi"])


def observed_rate(positive: Column, seen: Column) -> Column:
    """positive / seen; NULL where nothing was observed."""
    return F.try_divide(positive, F.nullif(seen, F.lit(0)))
