"""Delimited sources: mutation tables, copy-number segments, feature tables, panels, manifests and file inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import status as T
from cohortlens.functions import variants as V
from cohortlens.sources.files import file_hashes as file_hashes
from cohortlens.sources.files import listed

# Required columns and header aliases of the formats.
MAF_FIELDS = ("Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2", "Tumor_Sample_Barcode")
CNV_ALIASES = {
    "sample_id": ("sample_id", "sample", "patient", "patient_id", "gdc_aliquot", "gdc_aliquot_id", "aliquot_id"),
    "chrom": ("chrom", "chromosome", "chr"),
    "start": ("start", "start_position", "begin"),
    "end": ("end", "end_position", "stop"),
    "copy_number": ("copy_number", "cn", "total_cn", "total_copy_number"),
    "log2_ratio": ("log2_ratio", "log2", "segment_mean", "log2ratio", "log2r"),
    "event": ("event_type", "event", "call"),
    "genes": ("genes", "gene", "gene_name", "gene_symbol"),
    "grp": ("group", "grp", "cohort"),
    "stage": ("stage", "tumor_stage"),
}
FEATURE_FIELDS = ("patient", "region", "feature_type", "value", "status")
PANEL_FIELDS = ("sample", "population", "super_population")


def header_name(name: str) -> str:
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def required(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def checked(ok: Column, value: Column, message: str) -> Column:
    """value, or an error where ok isn't true."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("NULL")))).cast("string"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Mutation rows; comments before and after the header are left out, and a byte-order mark. Files of one path share a header."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("line")).where("trim(line) <> '' and not line like '#%'")
    has_all = F.lit(True)
    for name in MAF_FIELDS:
        has_all = has_all & F.array_contains(F.split("line", "\t"), name)
    head = text.where(has_all).select("line").distinct().limit(2).collect()
    if len(head) != 1:
        raise ValueError("no header with the required columns" if not head else "files of different headers")
    names = head[0].line.split("\t")
    cells = F.split("line", "\t")
    return text.where(F.col("line") != head[0].line).select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def maf_alleles(rows: DataFrame, reference: DataFrame | None = None, chunk: int = 4096) -> DataFrame:
    """rows with pos, ref and alt as in variant files; NULL where an indel needs a reference that isn't there or differs.

    An insertion is anchored on the base at its place, a deletion on the base before it, or after it at place 1. The
    reference is the chunk table of fasta.read_fasta, joined by contig and chunk.
    """
    ref, alt = F.upper("Reference_Allele"), F.upper("Tumor_Seq_Allele2")
    start = F.col("Start_Position").cast("bigint")
    ins, gone = F.col("Reference_Allele") == "-", F.col("Tumor_Seq_Allele2") == "-"
    anchor = F.when(ins, start).when(gone & (start > 1), start - 1).when(gone, start + F.length("Reference_Allele"))
    out = rows.withColumns({"__start": start, "__anchor": anchor, "__c": F.regexp_replace("Chromosome", "(?i)^chr", ""), "__k": F.floor((F.col("Start_Position").cast("bigint") - 1) / chunk), "__ak": F.floor((anchor - 1) / chunk)})
    base = F.lit(None).cast("string")
    if reference is not None:
        r = reference.select(F.regexp_replace("contig", "(?i)^chr", "").alias("__c"), F.col("chunk_no").alias("__ak"), F.col("bases").alias("__b"))
        out = out.join(r, ["__c", "__ak"], "left")
        base = F.nullif(F.expr(f"substring(__b, cast(__anchor - 1 - __ak * {chunk} + 1 as int), 1)"), F.lit(""))
    out = out.withColumn("__base", base)
    return out.withColumns(
        {
            "pos": F.when(ins, F.when(F.col("__base").isNotNull(), F.col("__start"))).when(gone, F.when(F.col("__base").isNotNull(), F.greatest(F.lit(1), F.col("__start") - 1))).otherwise(F.col("__start")),
            "ref": F.when(ins, F.col("__base")).when(gone & (F.col("__start") > 1), F.concat("__base", ref)).when(gone, F.concat(ref, F.col("__base"))).otherwise(ref),
            "alt": F.when(ins, F.concat("__base", alt)).when(gone, F.col("__base")).otherwise(alt),
        }
    ).drop("__start", "__anchor", "__c", "__k", "__ak", "__b", "__base")


def maf_vcf_lines(rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """(sample, chrom, pos, line): a distinct variant line a sample and allele; unresolved indels are left out."""
    a = maf_alleles(rows, reference).where("pos is not null and ref is not null and alt is not null")
    a = a.select(V.sample_name(F.col("Tumor_Sample_Barcode")).alias("sample"), F.col("Chromosome").alias("chrom"), "pos", "ref", "alt", (F.col("Hugo_Symbol") if "Hugo_Symbol" in a.columns else F.lit(None).cast("string")).alias("gene")).distinct()
    info = F.concat(F.lit("SOURCE=MAF"), F.coalesce(F.concat(F.lit(";GENE="), V.escape_info(F.col("gene"))), F.lit("")))
    return a.select("sample", "chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info).alias("line"))


def delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, by the first line."""
    first = spark.read.text(path).limit(1).collect()
    return "\t" if first and "\t" in first[0].value else ","


def read_segments(spark: SparkSession, path: str, group: str | None = None, gain: float = V.GAIN, loss: float = V.LOSS) -> DataFrame:
    """Copy-number segments with any of the known header names: sample_id, grp, stage, chrom, start, end, copy_number, log2_ratio, event, genes, status.

    A bad row is an error; quarantine.segments sets such rows apart instead.
    """
    return segment_rows(raw_segments(spark, path), group, gain, loss)


def raw_segments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, sep=delimiter(spark, path))
    return raw.toDF(*[header_name(c) for c in raw.columns])


def segment_rows(raw: DataFrame, group: str | None = None, gain: float = V.GAIN, loss: float = V.LOSS) -> DataFrame:
    """The columns of read_segments from a file's own."""
    pick = lambda k: T.first_of(list(CNV_ALIASES[k]), raw.columns)
    num = lambda k: pick(k).cast("double")
    start, end = pick("start").cast("bigint"), pick("end").cast("bigint")
    stated = F.upper(pick("event"))
    event = F.when(stated.isin("GAIN", "LOSS", "NEUTRAL"), stated).otherwise(V.copy_event(num("copy_number"), num("log2_ratio"), gain, loss))
    out = raw.select(
        checked(pick("sample_id").isNotNull(), pick("sample_id"), "a segment without a sample").alias("sample_id"), F.coalesce(F.lit(group), T.group_of(pick("grp"))).alias("grp"), pick("stage").alias("stage"), V.chromosome(pick("chrom")).alias("chrom"),
        checked((start >= 1) & (end >= start), start.cast("string"), "a bad segment start").cast("bigint").alias("start"), end.alias("end"), num("copy_number").alias("copy_number"), num("log2_ratio").alias("log2_ratio"), event.alias("event"), pick("genes").alias("genes"),
    )
    return out.withColumn("status", F.when(F.col("event").isNull(), T.UNAVAILABLE).when(F.col("event") == "NEUTRAL", T.NOT_DETECTED).otherwise(T.DETECTED))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Multimodal features: type in upper case, one of the known ones; status in any case."""
    return feature_rows(required(spark.read.csv(path, header=True), FEATURE_FIELDS))


def feature_rows(raw: DataFrame) -> DataFrame:
    kind = F.upper(F.trim("feature_type"))
    return raw.withColumns({"feature_type": checked(kind.isin(*T.FEATURE_TYPES), kind, "unknown feature type"), "status": T.canonical_status(F.col("status")), "value_num": F.col("value").try_cast("double")})


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return required(spark.read.csv(path, header=True, sep="\t"), PANEL_FIELDS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as CSV, or YAML with project, reference and samples: a row a sample."""
    if not re.search(r"\.ya?ml$", path):
        return spark.read.csv(path, header=True)
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    doc = yaml.safe_load(text) or {}
    samples = [{"project": str(doc.get("project", "")), "reference": str(doc.get("reference", "")), **{k: str(v) for k, v in s.items()}} for s in doc.get("samples", [])]
    names = sorted({k for s in samples for k in s}) or ["project", "reference"]
    return spark.createDataFrame([[s.get(n) for n in names] for s in samples], ", ".join(f"`{n}` string" for n in names))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(id, grp, file) of variant and table files below cancer/ and healthy/."""
    files = listed(spark, root).select("path")
    kind = F.regexp_extract("path", r"/(cancer|healthy)/[^/]+$", 1)
    return files.where((kind != "") & F.col("path").rlike(r"\.(vcf|vcf\.gz|csv)$")).select(F.regexp_extract("path", r"([^/]+?)\.(vcf|vcf\.gz|csv)$", 1).alias("id"), F.when(kind == "cancer", "case").otherwise("control").alias("grp"), F.col("path").alias("file"))
