"""Mixing sources to target weights by subset sums.

Every source gets a word budget from its weight, capped at `most` times its size. Whole rounds of the source fill what
they can; for the remaining budget, documents are counted by exact length, each length gives its proportional part,
lengths with the largest fractions give one more, and a bounded-knapsack dynamic programme over the lengths that are left
fills the rest, less than two of the longest documents, to the word where that can be done. Which documents of a length are
taken follows from a seeded hash, so reruns agree.

Counts by (source, length) are summed before they are shuffled, and a source's programme reads one row a distinct
length; targets come from one row a source, so sources may be many but fit a task. The least hashes of a length are
found in two steps: cells of hashes are counted first, and only the cell where the count ends is ranked, one row a
distinct hash, so neither a length nor a repeated row that holds a third of all documents meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.base import free_names, named, table, written

WORD_SIZE = r"[^\x20\x09-\x0D]+"
#: Rows that a cell of hashes holds about.
CELL_ROWS = 1024


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.size(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many pieces of each length to take, so that their sum is the largest that is at most budget and can be made.

    Counts are split into powers of two; a sum keeps the chunk that first made it, and sums are made of earlier chunks
    only, so walking back uses each chunk once. It stops once the budget itself is made.
    """
    take = [0] * len(lengths)
    if budget <= 0:
        return take
    made, by, chunks = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32), []
    made[0] = True
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, n = min(count, budget // length) if length else 0, 1
        while left and not made[budget]:
            n = min(n, left)
            step = n * length
            new = made[:-step] & ~made[step:]
            by[step:][new] = len(chunks)
            made[step:] |= new
            chunks.append((i, n, step))
            left, n = left - n, 2 * n
    at = int(np.flatnonzero(made)[-1])
    while at:
        i, n, step = chunks[by[at]]
        take[i] += n
        at -= step
    return take


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length for a budget below the sum of all: proportional parts, one more of the lengths
    with the largest fractions, then the programme for the rest, which is kept at one to two of the longest length
    where there is so much, so that many lengths can meet it."""
    total = sum(int(a) * int(b) for a, b in zip(lengths, counts, strict=True))
    if not total:
        return np.zeros(len(lengths), np.int64)
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    fraction = np.array([int(c) * budget % total / total for c in counts])
    rest, longest = budget - sum(int(a) * int(b) for a, b in zip(lengths, take, strict=True)), int(lengths.max())
    scattered = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # ties favour no range of lengths
    for i in np.lexsort((scattered, -fraction)).tolist():
        if fraction[i] and 0 < lengths[i] <= rest - longest:
            take[i] += 1
            rest -= int(lengths[i])
    own = [i for i in np.argsort(-lengths, kind="stable").tolist() if 0 < lengths[i] <= rest and counts[i] > take[i]]
    take[own] += np.array(knapsack([int(lengths[i]) for i in own], [int(counts[i] - take[i]) for i in own], rest), dtype=np.int64)
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: shares of the sum of all sizes by weight, at most `most` times the size.

    Sources take the weights in turn by code point, null last. Excess goes to the others by weight until none is above:
    sources sorted by cap / weight are capped from the first while a common level for the rest would exceed the cap.
    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("open", F.col("level") < F.col("ratio"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    return w.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


NAMES = ("mix_source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, keep: list[str] | None = None, prefix: str = "", store: bool = True) -> DataFrame:
    """(keep..., mix_source, size, source_size, target, copies): how often the mix takes each row of docs, 0 to `most` times.

    Null texts have size 0 and are taken in whole rounds only; a null source is a source of its own. A source without
    words has target 0. Of a length that is taken in part, the rows with the least seeded hashes of (id, text) are taken;
    of rows repeated with the same id and text at the border as many as are due, by their place in the table, so reruns
    take the same number of them. prefix stands before the five new names, which keep may not have (ValueError), nor
    names that start with "__". store: whether sizes and kept columns are written once; without it texts are counted
    twice and kept columns are not stored.
    """
    keep = [id_col] if keep is None else keep
    free_names(keep, [prefix + n for n in NAMES])
    rows = docs.select(*[named(c) for c in keep], F.col(source_col).alias("__source"), word_count(text_col).alias("__size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__h"))
    if store:
        rows = written(rows, "mix-sizes")
    slim = rows.select(F.col("__source").alias("s"), F.col("__size").alias("n"), F.col("__h").alias("h"))
    lengths = written(slim.groupBy("s", "n").agg(F.count("*").alias("c")), "mix-lengths")
    sources = lengths.groupBy(F.col("s").alias("source")).agg(F.sum(F.col("n") * F.col("c")).alias("source_size"))
    aims = written(targets(sources, weights, most), "mix-targets")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        size, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        rounds, rest = divmod(min(round(target), most * size), size) if size else (0, 0)
        extra = fill(g["n"].to_numpy(), g["c"].to_numpy(), rest) if rest else np.zeros(len(g), np.int64)
        return pd.DataFrame({"s": g["s"], "n": g["n"], "c": g["c"], "source_size": size, "target": target, "rounds": rounds, "extra": extra})

    kind = lengths.schema["s"].dataType.simpleString()
    plan = lengths.join(aims, lengths["s"].eqNullSafe(aims["source"])).select("s", "n", "c", "source_size", "target")
    plan = written(plan.groupBy("s").applyInPandas(choose, f"s {kind}, n bigint, c bigint, source_size bigint, target double, rounds bigint, extra bigint"), "mix-plan")
    # The hash up to which a part of a length is taken: cells of hashes are counted, then the cell is ranked in which the count ends.
    part = plan.where("extra > 0 and extra < c").select(F.col("s").alias("ps"), F.col("n").alias("pn"), "c", "extra")
    cell = F.floor((F.col("h").cast("double") / float(2**64) + 0.5) * F.ceil(F.col("c") / CELL_ROWS))
    inside = slim.join(part, slim["s"].eqNullSafe(part["ps"]) & (slim["n"] == part["pn"])).select("s", "n", "extra", cell.alias("cell"), "h")
    inside = written(inside.groupBy("s", "n", "extra", "cell", "h").agg(F.count("*").alias("k")), "mix-cells")
    counted = inside.groupBy("s", "n", "cell").agg(F.sum("k").alias("k"))
    before = F.sum("k").over(Window.partitionBy("s", "n").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    cells = written(counted.withColumn("before", before).select(F.col("s").alias("cs"), F.col("n").alias("cn"), F.col("cell").alias("cc"), F.col("k").alias("ck"), "before"), "mix-counted")
    last = inside.join(cells, inside["s"].eqNullSafe(cells["cs"]) & (inside["n"] == cells["cn"]) & (inside["cell"] == cells["cc"])).where("before < extra and extra <= before + ck")
    reached = F.sum("k").over(Window.partitionBy("s", "n").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    border = last.withColumn("reached", reached).where("reached - k < extra and extra <= reached").select(F.col("s").alias("bs"), F.col("n").alias("bn"), F.col("h").alias("upto"), "k", (F.col("extra") - F.col("reached") + F.col("k")).alias("due"))
    upto = F.when(F.col("extra") == 0, F.lit(None)).when(F.col("extra") == F.col("c"), F.lit((1 << 63) - 1)).otherwise(F.col("upto"))
    plan = plan.join(border, plan["s"].eqNullSafe(border["bs"]) & (plan["n"] == border["bn"]), "left")
    plan = written(plan.select(F.col("s").alias("__ps"), F.col("n").alias("__pn"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rounds").alias("__rounds"), upto.alias("__upto"), F.when(F.col("due") < F.col("k"), F.col("due")).alias("__due")), "mix-borders")
    planned = rows.join(plan, rows["__source"].eqNullSafe(plan["__ps"]) & (rows["__size"] == plan["__pn"])).drop("__ps", "__pn")
    whole = F.col("__rounds") + F.coalesce(F.col("__h") <= F.col("__upto"), F.lit(False)).cast("bigint")
    result = [*[named(c) for c in keep], *[F.col(f"__{c.removeprefix('mix_')}").alias(prefix + c) for c in NAMES[:-1]]]
    if plan.where("__due is not null").isEmpty():
        return planned.select(*result, whole.alias(prefix + "copies"))
    tied = F.coalesce((F.col("__h") == F.col("__upto")) & F.col("__due").isNotNull(), F.lit(False))
    even = planned.where(~tied).select(*result, whole.alias(prefix + "copies"))
    return even.unionByName(_dealt(planned.where(tied)).select(*result, (F.col("__rounds") + F.col("__taken").cast("bigint")).alias(prefix + "copies")))


def _dealt(rows: DataFrame) -> DataFrame:
    """Equal rows at a border (__source, __size, __due) -> with __taken for as many as are due, numbered by the task that reads them.

    The numbers are written before they are counted, as another run of the plan may part the rows differently.
    """
    placed = written(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "mix-tied")
    key = ["__source", "__size", "__part"]
    placed = placed.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy("__at")))
    counts = placed.groupBy(*key).agg(F.count("*").alias("__k"))
    bases = counts.withColumn("__base", F.sum("__k").over(Window.partitionBy("__source", "__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__k"))
    bases = bases.select(F.col("__source").alias("__bs"), F.col("__size").alias("__bn"), F.col("__part").alias("__bp"), "__base")
    numbered = placed.join(bases, placed["__source"].eqNullSafe(bases["__bs"]) & (placed["__size"] == bases["__bn"]) & (placed["__part"] == bases["__bp"]))
    return numbered.withColumn("__taken", F.col("__nth") + F.col("__base") <= F.col("__due"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
