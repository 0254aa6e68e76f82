"""Panels by detectability: coverage of many panels at once, the greedy panel, the exact one and their comparison.

A panel covers a patient by 1 minus the product of the misses of what is observed there, and the panel's coverage is the
mean over patients with any observation at it. Patients are rows of one array of values, equal rows counted once, and a
batch of panels is scored against every row by matrix products: misses of each panel times misses of each further
candidate. A job takes a bounded batch of panels to all partitions and adds up partial sums, so nothing of the patients
comes to the driver.

The exact search is branch and bound. Panels grow by candidates of later names only, so each is met once. Coverage of
what a panel grows into is at most its own sum of hits plus the largest further gains, over the patients observed at it
already: hits have diminishing returns and observed patients only become more. Panels whose bound can't change the
answer are left out; the others go to the next job, best bound first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.panel import EXACT_CANDIDATES, MOST
from cohortlens.sources.sinks import staged

#: Panels that go to the executors in a job, rows of patients that a matrix product takes, and what counts as equal.
BATCH, ROWS, EQUAL = 1024, 2048, 1e-12
OPTIMAL, NOT_RUN = "optimal", "not_run"


def vectors(matrix: DataFrame, names: list[str], patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """(v, n): patients' values at the named candidates in order, null where not observed or not finite, and how many have them.

    Values are held to 0..1; of repeated rows the greatest counts. Patients observed at none are left out, as they are in
    no denominator.
    """
    value = F.col("value").cast("double")
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    each = [F.max(F.when(F.col(candidate) == c, finite)) for c in names]
    rows = matrix.where(F.col(candidate).isin(names)).groupBy(patient).agg(F.array(*each).alias("v"))
    return staged(rows.where(F.exists("v", lambda x: x.isNotNull())).groupBy("v").agg(F.count("*").alias("n")), "panel-vectors")


def _sums(batches: Iterator[pa.RecordBatch], panels: list[int], width: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of hits and of observed patients for each panel with each candidate more, then for itself; a row a panel."""
    bits = np.array([[p >> i & 1 for i in range(width)] for p in panels], bool)
    hits, seen = np.zeros((len(panels), width + 1)), np.zeros((len(panels), width + 1))
    for batch in batches:
        values, counts = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column(1).to_numpy()
        for i in range(0, len(counts), ROWS):
            v, n = values[i : i + ROWS], counts[i : i + ROWS].astype(float)
            gone = np.isnan(v)
            miss = np.where(gone, 1.0, 1.0 - v)
            left, unseen = np.ones((len(n), len(panels))), np.ones((len(n), len(panels)))
            for c in range(width):
                left[:, bits[:, c]] *= miss[:, c, None]
                unseen[:, bits[:, c]] *= gone[:, c, None]
            total, itself = n.sum(), np.ones((len(n), 1))
            hits += total - (left * n[:, None]).T @ np.hstack([miss, itself])
            seen += total - (unseen * n[:, None]).T @ np.hstack([gone, itself])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(panels)), pa.int32()), pa.array(hits.tolist(), pa.list_(pa.float64())), pa.array(seen.tolist(), pa.list_(pa.float64()))], ["panel", "hits", "seen"])


def scores(rows: DataFrame, panels: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hits, seen), each panels x (candidates + 1): sums for every panel (bits of its candidates) with one candidate more,
    which none of its own may be, and at last for the panel itself."""
    parts = rows.mapInArrow(lambda b: _sums(b, panels, width), "panel int, hits array<double>, seen array<double>")
    total = lambda c: [F.sum(F.element_at(c, i + 1)) for i in range(width + 1)]
    found = parts.groupBy("panel").agg(F.array(*total("hits")).alias("hits"), F.array(*total("seen")).alias("seen")).collect()
    hits, seen = np.zeros((len(panels), width + 1)), np.zeros((len(panels), width + 1))
    for r in found:  # at most BATCH rows of as many numbers as there are candidates
        hits[r.panel], seen[r.panel] = r.hits, r.seen
    return hits, seen


def names_of(matrix: DataFrame, candidate: str = "candidate", most: int | None = None) -> list[str]:
    """Candidates in the order of their names; with `most`, None of them beyond the first most + 1."""
    rows = matrix.select(candidate).distinct().orderBy(candidate)
    return [r[0] for r in (rows.limit(most + 1) if most else rows).collect()]



def greedy_panel(matrix: DataFrame, k: int = MOST, min_gain: float = 0.02, patient: str = "patient", candidate: str = "candidate") -> list[dict]:
    """The greedy panel's steps: step, candidate, coverage and gain. A step is one job that scores all candidates.

    The candidate that gives the panel the highest coverage comes next, of equal ones the greatest name; after the first,
    a step below min_gain ends it. Coverage is among observed patients, so a gain may be negative.
    """
    names = names_of(matrix, candidate)
    rows, panel, steps, before = vectors(matrix, names, patient, candidate), 0, [], 0.0
    while names and len(steps) < min(k, MOST) and panel != (1 << len(names)) - 1:
        hits, seen = scores(rows, [panel], len(names))
        share = np.divide(hits[0], seen[0], out=np.zeros(len(names) + 1), where=seen[0] > 0)
        best = max((i for i in range(len(names)) if not panel >> i & 1), key=lambda i: (round(share[i], 12), names[i]))
        if steps and share[best] - before < min_gain:
            break
        steps.append({"step": len(steps) + 1, "candidate": names[best], "coverage": float(share[best]), "gain": float(share[best] - before)})
        panel, before = panel | 1 << best, float(share[best])
    return steps


def exact_panel(matrix: DataFrame, k: int = MOST, most: int = EXACT_CANDIDATES, patient: str = "patient", candidate: str = "candidate") -> dict:
    """The panel of up to k candidates with the greatest coverage: status, panel, coverage and how many panels were scored.

    Of panels that are equal to 1e-12 the smallest is taken, then the first by name. More than `most` candidates are not
    searched: the status says so and the panel is empty.
    """
    names = names_of(matrix, candidate, most)
    if len(names) > most:
        return {"status": NOT_RUN, "reason": "too_many_candidates", "panel": [], "coverage": 0.0, "scored": 0}
    k = min(k, MOST, len(names))
    best: tuple[float, int, tuple] = (0.0, 0, ())
    scored, width = 0, len(names)
    open_: list[tuple[float, int]] = [(-np.inf, 0)] if k > 0 else []
    rows = vectors(matrix, names, patient, candidate) if open_ else None

    def worth(bound: float, size: int) -> bool:
        """Whether panels of this size and above, none with more than bound, can take the best one's place."""
        return bound > best[0] + EQUAL or (bound >= best[0] - EQUAL and size <= best[1])

    while open_:
        batch = []
        while open_ and len(batch) < BATCH:
            bound, panel = heapq.heappop(open_)
            if worth(-bound, panel.bit_count() + 1):
                batch.append(panel)
        if not batch:
            break
        hits, seen = scores(rows, batch, width)
        grown = []
        for j, panel in enumerate(batch):
            size, gains = panel.bit_count() + 1, hits[j, :width] - hits[j, width]
            for i in range(panel.bit_length(), width):
                scored += 1
                at = float(hits[j, i] / seen[j, i]) if seen[j, i] else 0.0
                members = (*(x for x in range(width) if panel >> x & 1), i)
                if at > best[0] + EQUAL or (at >= best[0] - EQUAL and at > EQUAL and (size, members) < best[1:]):
                    best = (max(at, best[0]), size, members)
                later = np.sort(gains[i + 1 :])[::-1][: k - size]
                if len(later) and seen[j, i]:
                    grown.append((min(1.0, (hits[j, i] + later.sum()) / seen[j, i]), panel | 1 << i, size))
                elif len(later):
                    grown.append((1.0, panel | 1 << i, size))
        for bound, panel, size in grown:
            if worth(bound, size + 1):
                heapq.heappush(open_, (-bound, panel))
    return {"status": OPTIMAL, "panel": [names[i] for i in best[2]], "coverage": best[0], "scored": scored}


def greedy_and_exact(matrix: DataFrame, k: int = MOST, min_gain: float = 0.02, most: int = EXACT_CANDIDATES, patient: str = "patient", candidate: str = "candidate") -> DataFrame:
    """One row: both panels, joined by `|`, their coverage, the exact search's status, and exact minus greedy where it ran.

    A matrix without rows gives the status "Data unavailable" and nulls.
    """
    spark = matrix.sparkSession
    schema = "status string, greedy_panel string, greedy_coverage double, exact_panel string, exact_coverage double, delta double"
    steps = greedy_panel(matrix, k, min_gain, patient, candidate)
    if not steps:
        return spark.createDataFrame([("Data unavailable", None, None, None, None, None)], schema)
    exact = exact_panel(matrix, k, most, patient, candidate)
    ran, coverage = exact["status"] == OPTIMAL, steps[-1]["coverage"]
    row = (exact["status"], "|".join(s["candidate"] for s in steps), coverage, "|".join(exact["panel"]) if ran else None, exact["coverage"] if ran else None, exact["coverage"] - coverage if ran else None)
    return spark.createDataFrame([row], schema)
