"""Contracts, provenance and gates: small records on the driver, and checks of tables by counts."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
import uuid
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import status as T

DATASET_STATES = ("usable", "partial", "unavailable")
MANIFEST_FIELDS = ("dataset_id", "name", "source", "modality", "reference_build", "access", "n_tumor", "n_normal", "stage_available", "license", "version", "notes")


class ContractError(ValueError):
    """A record that breaks its contract."""


def filled(record: Any, *names: str) -> None:
    for name in names:
        value = getattr(record, name)
        if value is None or not str(value).strip():
            raise ContractError(f"{type(record).__name__}.{name} is blank")


def among(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ContractError(f"unknown {what}: {value!r}")
    return value


@dataclass
class FeatureRecord:
    patient: str
    region: str
    feature_type: str
    value: Any = None
    status: str = T.UNAVAILABLE
    group: str | None = None
    stage: str | None = None
    tumor_fraction: float | None = None
    depth: float | None = None
    vaf: float | None = None
    assay: str | None = None
    validation_status: str | None = None
    provenance: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        filled(self, "patient", "region", "feature_type")
        among(self.status, (T.DETECTED, T.NOT_DETECTED, T.UNAVAILABLE), "feature status")
        self.provenance = self.provenance or {}

    @classmethod
    def of(cls, row: dict) -> FeatureRecord:
        return cls(**{f.name: row[f.name] for f in fields(cls) if f.name in row})


@dataclass
class Provenance:
    source: str
    version: str
    reference_build: str
    pipeline: str
    parameters: str
    created_at: str

    def __post_init__(self):
        filled(self, *(f.name for f in fields(self)))


@dataclass
class RunRecord:
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    config: dict = field(default_factory=dict)
    status: str = "CONDITIONAL"

    def __post_init__(self):
        filled(self, "run_id", "created_at")
        among(self.status, T.WORKFLOW, "workflow status")
        if not isinstance(self.config, dict):
            raise ContractError("config is a mapping")
        self.config = json.loads(json.dumps(self.config))  # a snapshot

    def complete(self) -> RunRecord:
        return RunRecord(self.run_id, self.created_at, self.config, "PASS")


@dataclass
class InputArtifact:
    artifact_id: str
    path: str
    kind: str
    status: str = T.UNAVAILABLE

    def __post_init__(self):
        filled(self, "artifact_id", "path", "kind")


@dataclass
class OutputArtifact:
    artifact_id: str
    path: str
    kind: str
    schema_version: str
    status: str = "PASS"

    def __post_init__(self):
        filled(self, "artifact_id", "path", "kind", "schema_version")
        among(self.status, T.WORKFLOW, "workflow status")


@dataclass
class Trace:
    run_id: str
    inputs: list[str]
    outputs: list[str]

    def __post_init__(self):
        filled(self, "run_id")
        for ids in (self.inputs, self.outputs):
            if len(set(ids)) != len(ids) or any(not str(i).strip() for i in ids):
                raise ContractError("trace ids are unique and not blank")

    def check(self, *, input_id: str | None = None, output_id: str | None = None) -> None:
        if input_id is not None and input_id not in self.inputs or output_id is not None and output_id not in self.outputs:
            raise ContractError("an artefact that the trace lacks")


@dataclass
class ScanResult:
    run_id: str
    status: str
    candidates: list
    records_evaluated: int
    alpha: float = 0.05

    def __post_init__(self):
        filled(self, "run_id")
        among(self.status, T.WORKFLOW + (T.UNAVAILABLE,), "status")
        n = self.records_evaluated
        if not isinstance(self.candidates, list | tuple) or isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ContractError("candidates are a list and records a count")


def bundle_errors(run: RunRecord, trace: Trace, inputs: list[InputArtifact], outputs: list[OutputArtifact], features: list[FeatureRecord], provenance: Provenance | None, dataset: dict) -> list[str]:
    """What in a bundle doesn't refer to what it says."""
    out = []
    if trace.run_id != run.run_id:
        out.append("the trace is of another run")
    if sorted(trace.inputs) != sorted(a.artifact_id for a in inputs):
        out.append("traced inputs differ from the inputs")
    if sorted(trace.outputs) != sorted(a.artifact_id for a in outputs):
        out.append("traced outputs differ from the outputs")
    if not features:
        out.append("no features")
    if provenance is None:
        out.append("no provenance")
    return out + [f"dataset field {n} is missing" for n in MANIFEST_FIELDS if n not in dataset]


def manifest_errors(df: DataFrame) -> DataFrame:
    """(row..., errors): what is wrong with each manifest row."""
    missing = [F.lit(f"{n} is missing") for n in MANIFEST_FIELDS if n not in df.columns]
    have = set(df.columns)
    blank = [F.when(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "", F.lit(f"{n} is blank")) for n in MANIFEST_FIELDS[:4] if n in have]
    counts = [F.when(F.col(n).cast("string").try_cast("int").isNull() | (F.col(n).cast("string").try_cast("int") < 0), F.lit(f"{n} is no count")) for n in ("n_tumor", "n_normal") if n in have]
    stage = [F.when(~F.lower(F.col("stage_available").cast("string")).isin("true", "false"), F.lit("stage_available is no truth value"))] if "stage_available" in have else []
    return df.withColumn("errors", F.filter(F.array(*missing, *blank, *counts, *stage, F.lit(None).cast("string")), lambda x: x.isNotNull()))


def dataset_state(n_tumor: int | None, n_normal: int | None) -> tuple[str, str]:
    if not n_tumor and not n_normal:
        return "unavailable", "no samples"
    if not n_tumor or not n_normal:
        return "partial", "one group has no samples"
    return "usable", "both groups have samples"


def not_a_negative(df: DataFrame, status: str = "status", value: str = "value") -> DataFrame:
    """Rows whose unavailable status stands beside a negative value; there should be none."""
    return df.where((F.col(status) == T.UNAVAILABLE) & F.col(value).isNotNull() & (F.col(value) == 0))


def dataset_errors(samples: DataFrame, files: DataFrame | None = None) -> dict[str, int]:
    """Counts of unknown groups, repeated ids and missing files of a sample table."""
    n = samples.agg(F.count_if(T.group_of(F.col("grp")).isNull()).alias("unknown_group"), (F.count("*") - F.count_distinct("sample_id")).alias("repeated_id")).first().asDict()
    if files is not None:
        n["missing_file"] = samples.join(files.select(F.col("path").alias("file")), "file", "left_anti").count()
    return n


def audit(files: DataFrame, needed: list[str]) -> DataFrame:
    """files (path, length) against needed relative paths -> (artefact, present, not_empty, status)."""
    spark = files.sparkSession
    want = spark.createDataFrame([(n,) for n in needed], "artefact string")
    joined = want.join(files.select("path", "length"), F.col("path").endswith(F.col("artefact")), "left").groupBy("artefact").agg(F.count("path").alias("n"), F.max("length").alias("length"))
    return joined.select("artefact", (F.col("n") > 0).alias("present"), F.coalesce(F.col("length") > 0, F.lit(False)).alias("not_empty"), F.when((F.col("n") > 0) & (F.col("length") > 0), "PASS").otherwise("FAIL").alias("status"))


def health(components: set[str], required: set[str], metadata: dict) -> dict:
    missing = sorted(required - components)
    complete = all(str(metadata.get(k, "")).strip() for k in ("name", "version", "scope"))
    return {"status": "PASS" if not missing and complete else "FAIL", "missing": missing, "metadata_complete": complete}


def readiness(state: dict) -> dict:
    return {"software": state["status"], "scientific_results": "CONDITIONAL"}


def reproducibility(config: dict, hashes: list[tuple[str, str]], run_id: str | None = None) -> dict:
    return {"run_id": run_id or uuid.uuid4().hex, "python": sys.version.split()[0], "platform": platform.platform(), "config": config, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), "artefacts": dict(sorted(hashes))}


def as_document(record) -> dict:
    return asdict(record)
