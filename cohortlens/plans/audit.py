"""Audit of a run's artefacts: rows are counted while tables are written and held against the files' footers.

`write_counted` observes the rows of the job that writes a table, so nothing is read for the count; `stored_rows` reads
footers only, in executors. The checks take the run's documents by their roles, whatever the files are called.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.panel import MOST
from cohortlens.sources import files
from cohortlens.sources.files import located

# Outcomes of a quality gate, literature services, and versions of documents.
GATES = ("PASS", "CONDITIONAL", "FAIL")
SERVICES = ("PubMed", "Europe PMC")
VERSIONS = {"literature": "c10.literature.v1", "robustness": "c09.robustness.v1"}
PARTS = ("ranked", "ineligible", "unscored")
#: Roles of a run's artefacts: tables are folders of Parquet files, documents JSON.
TABLES = ("evidence", "literature_table")
DOCUMENTS = ("constraints", "literature", "panel", "robustness", "gate")
CHECKS = ("required_artefacts", "rows_as_written", "candidate_partition", "literature_contract", "panel_cap", "robustness_version", "quality_gate", "report_present")


def write_counted(df: DataFrame, path: str) -> dict:
    """Writes a table and tells {path, rows}, as counted by the job that wrote it."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return {"path": path, "rows": seen.get["rows"]}


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            system, path = located(uri)
            with system.open_input_file(path) as f:
                rows.append(pq.read_metadata(f).num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], ["path", "rows"])


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table by its files' footers."""
    own = files.listed(spark, path, "*.parquet").select("path")
    return own.repartition(max(1, min(1000, own.count()))).mapInArrow(_footers, "path string, rows bigint").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def audit_run(spark: SparkSession, root: str, roles: dict[str, str], written: list[dict]) -> DataFrame:
    """(check, status, detail) of a run below root: a row a check, PASS or FAIL; the run passes if all do.

    roles name each artefact's path below root (TABLES, DOCUMENTS, `report`); written are write_counted's records. A
    document that can't be read fails the checks that need it, and no other. The documents are small and read by the
    driver, tables by their footers only.
    """
    base = root.rstrip("/")
    place = {r: f"{base}/{p}" for r, p in roles.items()}
    listed = files.listed(spark, base).select("path", "length").where("length > 0")
    full = {r: f"/{p.strip('/')}" for r, p in roles.items()}
    hits = listed.agg(*[F.count_if(F.col("path").endswith(p) | F.col("path").contains(p + "/")).alias(r) for r, p in full.items()]).first().asDict()
    absent = sorted([r for r in (*TABLES, *DOCUMENTS, "report") if not hits.get(r)])
    out = [("required_artefacts", not absent, "all present" if not absent else f"missing or empty: {', '.join(absent)}")]

    def check(name: str, needs: tuple[str, ...], test) -> None:
        try:
            gone = [r for r in needs if r in absent]
            ok, detail = (False, f"missing: {', '.join(gone)}") if gone else test(*[json.loads(files.read_text(spark, place[r])) if r in DOCUMENTS else stored_rows(spark, place[r]) for r in needs])
        except (ValueError, TypeError, AttributeError, KeyError) as e:
            ok, detail = False, f"not readable: {type(e).__name__}"
        out.append((name, bool(ok), detail))

    def as_written():
        found = [(w["path"], w["rows"], stored_rows(spark, w["path"])) for w in written]
        differ = [f"{p}: {a} written, {b} stored" for p, a, b in found if a != b]
        return bool(found) and not differ, "; ".join(differ) or f"{len(found)} tables"

    def partition(rows, parts):
        total = sum(int(parts.get(k, 0)) for k in PARTS)
        return rows == total, f"rows={rows}; total of parts={total}"

    def literature(doc, rows):
        records = doc.get("records")
        ok = doc.get("schema_version") == VERSIONS["literature"] and isinstance(records, list) and rows == len(records) and set(doc.get("sources", [])) <= set(SERVICES)
        return ok, f"schema={doc.get('schema_version')}; records={len(records) if isinstance(records, list) else records}; rows={rows}"

    def panel(doc):
        own = doc.get("panel", {})
        n, most = len(own.get("selected", [])), int(own.get("max_k", MOST))
        return n <= most <= MOST, f"selected={n}; max_k={most}"

    check("rows_as_written", (), as_written)
    check("candidate_partition", ("evidence", "constraints"), partition)
    check("literature_contract", ("literature", "literature_table"), literature)
    check("panel_cap", ("panel",), panel)
    check("robustness_version", ("robustness",), lambda d: (d.get("schema_version") == VERSIONS["robustness"], f"schema={d.get('schema_version')}"))
    check("quality_gate", ("gate",), lambda d: (d.get("overall") in GATES, f"overall={d.get('overall')}"))
    out.append(("report_present", "report" not in absent, "report" if "report" not in absent else "missing or empty"))
    return spark.createDataFrame([(n, "PASS" if ok else "FAIL", d) for n, ok, d in out], "check string, status string, detail string")
