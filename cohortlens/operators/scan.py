"""Interval joins by bins, binned rates at several resolutions, and the coarse-to-fine scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import stats as S
from cohortlens.functions import status as T
from cohortlens.operators.cohort import feature_values, tested_values, value_stats
from cohortlens.sources.sinks import staged

# The resolutions of the scan.
LEVELS, RATES = (5_000_000, 1_000_000, 100_000, 10_000, 1_000), (1_000_000, 100_000, 10_000, 1_000, 100)
#: The sweep cuts intervals at blocks of about so many of the least bins.
BLOCK = 100_000
#: Rows of a written table up to which a join broadcasts it.
FEW = 100_000


def with_bins(df: DataFrame, size: int, name: str = "bin", start: str = "start", end: str = "end") -> DataFrame:
    """A row a 1-based bin of `size` that an interval covers."""
    return df.withColumn(name, F.explode(F.expr(f"sequence(({start} - 1) div {size}, ({end} - 1) div {size})")))


#: Each level's bins of an interval join are 2 ** STEP times as wide as those of the level below.
STEP = 3


def _levelled(df: DataFrame, keys: tuple[str, ...], size: int, side: str) -> DataFrame:
    """df with its columns prefixed by the side, __own: the first level whose bins are wider than the interval."""
    df = df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys]).where(f"{side}_start <= {side}_end")
    bits = f"if({side}_end - {side}_start < {size}, 0, length(bin(({side}_end - {side}_start) div {size})))"
    return df.withColumn("__own", F.expr(f"cast(({bits} + {STEP - 1}) div {STEP} as int)"))


def _at_levels(df: DataFrame, levels: Column, size: int, side: str) -> DataFrame:
    """A row a level and bin there that the interval covers, at most two a level of its own or above."""
    rows = df.withColumn("__level", F.explode(levels)).withColumn("__width", F.expr(f"shiftleft({size}L, {STEP} * __level)"))
    return rows.withColumn("__bin", F.explode(F.expr(f"sequence(({side}_start - 1) div __width, ({side}_end - 1) div __width)")))


def interval_join(a: DataFrame, b: DataFrame, size: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Pairs of overlapping closed intervals with equal keys: equality joins on bins with the overlap as a residual.

    Bins have levels, of size, 2 ** STEP times size and so on. A pair meets at the level of its longer interval, where either
    covers two bins at most, so rows that are shuffled grow with intervals and levels and never with lengths: the longer
    one is there once, and the shorter ones come up to the levels that the other side has, whose highest a small job finds
    first. A pair that shares two bins
    comes once, from the bin of the later start. size is about the least intervals' length. Null starts, ends or keys
    and ends before starts have no pairs.
    """
    x, y = _levelled(a, keys, size, "a"), _levelled(b, keys, size, "b")
    on = [*keys, "__level", "__bin"]
    tops = x.select(F.lit("a").alias("side"), "__own").unionByName(y.select(F.lit("b").alias("side"), "__own")).groupBy("side").agg(F.max("__own"))
    top = {"a": 0, "b": 0} | {r[0]: r[1] for r in tops.collect()}
    pairs = None
    for long, short, l, s, first in ((x, y, "a", "b", 0), (y, x, "b", "a", 1)):  # noqa: E741
        if first > top[l]:
            continue  # intervals of one level met in the first join
        low = F.col("__own") + first
        up = _at_levels(short, F.when(low <= top[l], F.sequence(low, F.lit(top[l]))), size, s).drop("__own", "__width")
        own = _at_levels(long, F.array("__own"), size, l).drop("__own")
        met = own.join(up, on).where("a_start <= b_end and b_start <= a_end and __bin = (greatest(a_start, b_start) - 1) div __width")
        met = met.select(*keys, *[c for c in x.columns if c.startswith("a_")], *[c for c in y.columns if c.startswith("b_")])
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def rate_runs(rows: DataFrame, sizes: tuple[int, ...] = RATES) -> DataFrame:
    """rows (sample_id, chrom, start, end, feature_type, status) -> runs of bins [first, last] with equal counts, of each size.

    A sweep: an interval is +1 at its first bin and -1 after its last one, so what is shuffled grows with intervals and not
    with their lengths. Intervals are cut at blocks of whole bins of all sizes, which spreads a patient or place with very
    many; equal ones of a patient are counted before the shuffle. Within a patient's block, in order of starts, only what
    lies beyond the earlier ones' greatest end is new, at all sizes alike: that is where the patient is counted. Events of
    all patients are summed by place, and running sums within a block, over no more rows than it has bins, are the counts.

    A null patient counts as rows only; rows without a start, or with one below 0, have no bins; an end before the start,
    or none, is the start's bin. Bins that no row covers are in no run.
    """
    block, at = math.lcm(*sizes) * max(1, BLOCK * min(sizes) // math.lcm(*sizes)), ["chrom", "feature_type", "block"]
    long = rows.where("start >= 0").select("sample_id", "chrom", "feature_type", F.col("start").cast("bigint").alias("lo"), F.expr("greatest(start, end - 1)").cast("bigint").alias("hi"), T.observed(F.col("status")).alias("v"))
    cut = long.withColumn("block", F.explode(F.expr(f"sequence(lo div {block}L, hi div {block}L)")))
    cut = cut.select("sample_id", *at, F.greatest("lo", F.col("block") * block).alias("lo"), F.least("hi", F.col("block") * block + (block - 1)).alias("hi"), "v")
    own = cut.groupBy("sample_id", *at, "lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 1).alias("d"))
    before = Window.partitionBy("sample_id", *at).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("seen", F.max("hi").over(before))
    ends = [F.expr(f"named_struct('resolution', {s}L, 'first', lo div {s}, 'after', hi div {s} + 1, 'new', greatest(lo div {s}, coalesce(seen div {s} + 1, 0L)))") for s in sizes]
    sized = own.select("sample_id", *at, "n", "d", F.explode(F.array(*ends)).alias("x")).select("sample_id", *at, "n", "d", "x.*")
    sized = sized.withColumn("p", (F.col("sample_id").isNotNull() & (F.col("new") < F.col("after"))).cast("bigint"))
    event = lambda place, n, d, p: F.struct(F.col(place).alias("first"), n.alias("n"), d.alias("d"), p.alias("p"))
    n, d, p, zero = F.col("n"), F.col("d"), F.col("p"), F.lit(0).cast("bigint")
    both = F.array(event("first", n, d, F.when(F.col("new") == F.col("first"), p).otherwise(zero)), event("after", -n, -d, -p))
    later = F.array(event("new", zero, zero, p))
    events = sized.select("resolution", *at, F.explode(F.when((F.col("new") > F.col("first")) & (p > 0), F.concat(both, later)).otherwise(both)).alias("e"))
    places = events.groupBy("resolution", *at, "e.first").agg(*[F.sum(f"e.{c}").alias(c) for c in "ndp"])
    w = Window.partitionBy("resolution", *at).orderBy("first")
    sums = [F.sum(c).over(w).alias(name) for c, name in (("p", "patients"), ("n", "total"), ("d", "detected"))]
    return places.select("resolution", "chrom", "feature_type", "first", (F.lead("first").over(w) - 1).alias("last"), *sums).where("total > 0")


def multiresolution_rates(rows: DataFrame, sizes: tuple[int, ...] = RATES) -> DataFrame:
    """rate_runs as a row a bin, with the detection rate. Bins count from 0 at `start div size`.

    Runs are opened after all shuffles; only here do rows grow with lengths.
    """
    out = rate_runs(rows, sizes).select("resolution", "chrom", F.explode(F.sequence("first", "last")).alias("bin"), "feature_type", "patients", "total", "detected")
    return out.withColumn("detection_rate", F.col("detected") / F.col("total"))


def level_stats(binned: DataFrame, size: int) -> DataFrame:
    """value_stats of each bin of values dealt to bins, of those that both groups have patients at, with the screening effect.

    Where variants are counted, a difference of detected rows a megabase may raise it.
    """
    out = value_stats(binned, "chrom", "bin").where("case_n > 0 and control_n > 0")
    density = F.abs(F.col("case_events") - F.col("control_events")) * F.lit(1e6) / F.lit(size)
    return out.withColumn("density_difference", F.when(F.col("feature_type").isin(*T.DENSE), density)).withColumn(
        "screening", F.greatest("effect", F.coalesce(F.col("density_difference") / (1 + F.col("density_difference")), F.lit(0.0)))
    )


def _joined(small: DataFrame, n: int) -> DataFrame:
    """A written table of n rows for a join: by its file, whose size is a small part of its rows', Spark may broadcast very many."""
    return F.broadcast(small) if n <= FEW else small.hint("merge")


def scan_values(rows: DataFrame) -> DataFrame:
    """feature_values of intervals, written once: each level and the regions read what they need of it."""
    return staged(feature_values(rows, "chrom", "start", "end"), "scan-values")


def retained_bins(values: DataFrame, threshold: float = 0.1, levels: tuple[int, ...] = LEVELS, neighbours: int = 1, tile: bool = False) -> DataFrame:
    """The lineage of coarse_to_fine: retained bins of every level of scan_values, with their parents."""
    lineage, wanted = None, None
    for k, size in enumerate(levels):
        own = with_bins(values, size).drop("start", "end")
        if wanted is not None:
            own = own.join(wanted.drop("parent"), ["chrom", "feature_type", "bin"], "left_semi")
        found = level_stats(own, size).where(F.col("screening") >= threshold).withColumn("resolution", F.lit(size).cast("bigint"))
        found = found.withColumn("parent", F.lit(None).cast("bigint")) if wanted is None else found.join(wanted, ["chrom", "feature_type", "bin"])
        kept = staged(found, f"scan-{size}")
        lineage = kept if lineage is None else lineage.unionByName(kept)
        if k + 1 < len(levels):
            child = levels[k + 1]
            bins = F.expr(f"sequence((bin * {size}L) div {child}, ((bin + 1) * {size}L - 1) div {child})") if tile else F.expr(f"filter(transform(sequence({-neighbours}, {neighbours}), i -> (bin * {size}L) div {child} + i), x -> x >= 0)")
            wanted = kept.select("chrom", "feature_type", F.col("bin").alias("parent"), F.explode(bins).alias("bin")).groupBy("chrom", "feature_type", "bin").agg(F.min("parent").alias("parent"))
            wanted = staged(wanted, f"scan-wanted-{child}")
            wanted = _joined(wanted, wanted.count())
    return lineage


def in_bins(values: DataFrame, bins: DataFrame, block: int) -> DataFrame:
    """The rows of values whose intervals overlap any of bins (chrom, feature_type, resolution, bin), each once.

    Bins are merged to runs apart from each other. An interval meets those that start in its end's block by an equality join, and
    of all that start before that block the greatest end: it overlaps one of these if that isn't before its start. A block
    has at most half as many runs as it has of the least bins.
    """
    at = ["chrom", "feature_type"]
    b, size = F.col("bin"), F.col("resolution")  # places below 1 are in the bins that with_bins gives them
    spans = bins.select(*at, F.when(b > 0, b * size + 1).otherwise((b - 1) * size + 2).alias("lo"), F.when(b < 0, b * size + 1).otherwise((b + 1) * size).alias("hi"))
    order = Window.partitionBy(*at).orderBy("lo")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True))
    runs = spans.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(*at, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    started = runs.groupBy(*at, F.expr(f"lo div {block}L").alias("__block")).agg(F.collect_list(F.struct("lo", "hi")).alias("__runs"), F.max("hi").alias("__hi"))
    values = values.where("start is not null and end is not null")
    last = values.groupBy(*at).agg(F.max(F.greatest("start", "end")).alias("__last"))
    after = F.coalesce(F.lead("__block").over(Window.partitionBy(*at).orderBy("__block")) - 1, F.greatest(F.expr(f"__last div {block}L"), F.col("__block")))
    ends = started.join(last, at).withColumn("__to", after).withColumn("__past", F.max("__hi").over(Window.partitionBy(*at).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.col("__each") == F.col("__block")
    blocks = ends.withColumn("__each", F.explode(F.sequence("__block", "__to"))).select(
        *at, F.col("__each").alias("__block"), F.when(own, F.col("__runs")).otherwise(F.array().cast(started.schema["__runs"].dataType)).alias("__runs"), F.when(own, F.col("__past")).otherwise(F.greatest("__past", "__hi")).alias("__past")
    )
    blocks = staged(blocks, "scan-blocks")
    blocks = _joined(blocks, blocks.agg(F.sum(1 + F.size("__runs"))).first()[0] or 0)
    met = values.withColumn("__block", F.expr(f"greatest(start, end) div {block}L")).join(blocks, [*at, "__block"])
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    hit = F.coalesce(F.col("__past") >= lo, F.lit(False)) | F.exists("__runs", lambda r: (r["lo"] <= hi) & (r["hi"] >= lo))
    return met.where(hit).select(*values.columns)


def coarse_to_fine(rows: DataFrame, threshold: float = 0.1, levels: tuple[int, ...] = LEVELS, neighbours: int = 1, tile: bool = False, alpha: float = 0.05, draws: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lineage, final): retained bins of every level with their parents, and the exact regions that overlap any of them.

    The next level's bins are the 2k+1 bins around a retained bin's start, or with tile all that tile it. Rows are written
    once; each level's retained bins are written, and only rows in the bins wanted next are aggregated, so a level reads the
    rows once and finer levels aggregate less. Regions meet the union of retained bins of all levels.
    """
    values = scan_values(rows)
    lineage = retained_bins(values, threshold, levels, neighbours, tile)
    final = tested_values(staged(in_bins(values, lineage, max(levels)), "scan-regions"), "chrom", "start", "end", draws=draws)
    return lineage, S.benjamini_hochberg(final).withColumn("significant", F.col("q_value") <= alpha)
