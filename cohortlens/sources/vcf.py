"""Variant call files as DataFrames: cohort carriers and observations, and a directory of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions import status as T
from cohortlens.functions import variants as V

# The INFO keys that name a gene, a consequence and an impact.
GENE_KEYS, CONSEQUENCE_KEYS, IMPACT_KEYS = ("GENE", "GENE_SYMBOL", "SYMBOL"), ("CONSEQUENCE", "CSQ_CONSEQUENCE", "CSQ", "EFFECT"), ("IMPACT", "CSQ_IMPACT", "SEVERITY")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, at, line) of text files, gzip by suffix. at orders the lines of a file: (block, offset row) of Spark's file source."""
    text = spark.read.text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("line"))


def fields(text: DataFrame, unescape: bool = False) -> DataFrame:
    """text with its data lines cut at tabs; a data line of fewer than eight columns is an error. unescape turns written \\t into tabs."""
    line = F.regexp_replace("line", r"\\t", "\t") if unescape else F.col("line")
    data = text.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split(line, "\t"))
    return data.withColumn("f", F.when(F.size("f") >= 8, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("fewer than 8 columns in "), F.col("file"), F.lit(": "), F.substring("line", 1, 80))).cast("array<string>")))


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a record: chrom, pos, id, ref, alts (array), qual, filter, info; a dot is NULL."""
    dot = lambda i: F.nullif(F.col("f")[i], F.lit("."))
    return fields(lines(spark, paths)).select("file", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), dot(2).alias("id"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), dot(5).alias("qual"), dot(6).alias("filter"), F.col("f")[7].alias("info"))


def _headers(text: DataFrame) -> DataFrame:
    """(file, samples): the sample columns of each file's header. One row a file; Spark decides how to join it."""
    return text.where(F.col("line").startswith("#CHROM")).groupBy("file").agg(F.first(F.slice(F.split("line", "\t"), 10, 1_000_000)).alias("samples"))


def _stem(file):
    return F.regexp_replace(F.regexp_extract(file, r"([^/]+)$", 1), r"(?i)\.vcf(\.b?gz)?$", "")


def read_cohort(spark: SparkSession, paths: str | list[str], group: str) -> tuple[DataFrame, DataFrame]:
    """(samples, variants). Samples without a carried variant stay in samples.

    A sample carries ALT i if its genotype has the number i; a file without sample columns is one sample, named after
    the file, that carries every record. A variant that a sample has several times comes once, from its last line.
    Names that two files share are an error, as they would count twice.
    """
    text = lines(spark, paths)
    heads = _headers(text)
    files = text.select("file").distinct().join(heads, "file", "left").select("file", F.when(F.size("samples") > 0, F.col("samples")).otherwise(F.array(_stem(F.col("file")))).alias("names"))
    samples = files.select("file", F.explode("names").alias("sample_id")).groupBy("sample_id").agg(F.count("*").alias("n"), F.min("file").alias("source_file"))
    samples = samples.select(F.when(F.col("n") == 1, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("a sample in several files: "), F.col("sample_id"))).cast("string")).alias("sample_id"), F.lit(group).alias("grp"), "source_file")
    rows = fields(text).join(files, "file").select("file", "at", "f", F.posexplode(F.split(F.col("f")[4], ",")).alias("i", "alt"), "names")
    rows = rows.select("file", "at", "f", "i", "alt", F.posexplode("names").alias("s", "sample_id"))
    keys = F.split(F.coalesce(F.get("f", F.lit(8)), F.lit("")), ":")
    gt = F.get(F.split(F.get("f", F.col("s") + 9), ":"), F.array_position(keys, "GT").cast("int") - 1)
    carried = rows.withColumn("gt", gt).where((F.size("f") < 10) | (V.genotype_status(F.col("gt"), F.col("i") + 1) == 1))
    info = V.info_map(F.col("f")[7], upper=True)
    pick = lambda names: F.coalesce(*[F.try_element_at("info", F.lit(n)) for n in names])
    out = carried.withColumn("info", info).select(
        "file", "at", "sample_id", F.lit(group).alias("grp"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[3].alias("ref"), "alt", F.nullif(F.col("f")[2], F.lit(".")).alias("id"), F.nullif(F.col("f")[5], F.lit(".")).alias("qual"), F.col("f")[6].alias("filter"),
        "gt", pick(GENE_KEYS).alias("gene"), pick(CONSEQUENCE_KEYS).alias("consequence"), pick(IMPACT_KEYS).alias("impact"),
    )
    out = out.withColumn("variant_key", V.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("variant_type", V.variant_type(F.col("ref"), F.col("alt")))
    last = F.row_number().over(Window.partitionBy("sample_id", "variant_key").orderBy(F.col("at").desc()))
    return samples, out.withColumn("__r", last).where("__r = 1").drop("__r", "at")


def read_observations(spark: SparkSession, paths: str | list[str], group: str, sample: str | None = None, min_depth: float | None = None, min_vaf: float | None = None, allele_specific: bool = True) -> DataFrame:
    """SNV and INDEL observations of records that pass: patient, grp, region, feature_type, status, depth, vaf, gene.

    Depth is DP of the sample, then of INFO; vaf is the allele's part of AD, then AF. Limits leave out rows whose value
    is missing. Status follows the genotype: no call is unavailable; with allele_specific the allele's own number counts,
    else any ALT. Records of fewer than eight columns are left out.
    """
    text = lines(spark, paths)
    heads = _headers(text)
    data = text.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 8)
    rows = data.join(heads, "file", "left").where(F.col("f")[6].isin("PASS", ".")).select("file", "f", F.posexplode(F.split(F.col("f")[4], ",")).alias("i", "alt"), "samples")
    own = F.when(F.get("f", F.lit(8)).isNotNull() & F.get("f", F.lit(9)).isNotNull(), V.format_map(F.get("f", F.lit(8)), F.get("f", F.lit(9))))
    info = V.info_map(F.col("f")[7], upper=True)
    rows = rows.withColumns({"m": own, "info": info})
    number = lambda m, k, i=None: (F.try_element_at(m, F.lit(k)) if i is None else F.get(F.split(F.try_element_at(m, F.lit(k)), ","), i)).try_cast("double")
    ad = F.transform(F.split(F.try_element_at("m", F.lit("AD")), ","), lambda x: x.try_cast("double"))
    total = F.aggregate(ad, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    af = lambda m: F.get(F.split(F.try_element_at(m, F.lit("AF")), ","), F.least(F.col("i"), F.size(F.split(F.try_element_at(m, F.lit("AF")), ",")) - 1)).try_cast("double")
    gt = F.try_element_at("m", F.lit("GT"))
    called = V.genotype_status(gt, F.col("i") + 1) if allele_specific else F.when(V.genotype_status(gt, F.lit(0)).isNotNull(), V.carries_alt(gt).cast("int"))
    width = F.greatest(F.length(F.col("f")[3]), F.length("alt"))
    out = rows.select(
        F.coalesce(F.lit(sample), F.get("samples", F.lit(0)), _stem(F.col("file"))).alias("patient"), F.lit(group).alias("grp"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("start"), (F.col("f")[1].cast("bigint") + width - 1).alias("end"), F.col("f")[3].alias("ref"), "alt",
        V.small_variant(F.col("f")[3], F.col("alt")).alias("feature_type"), T.status_of(called).alias("status"), F.coalesce(number("m", "DP"), number("info", "DP")).alias("depth"),
        F.coalesce(F.when(total > 0, F.get(ad, F.col("i") + 1) / total), af("m"), af("info")).alias("vaf"), F.coalesce(*[F.try_element_at("info", F.lit(k)) for k in GENE_KEYS]).alias("gene"),
    ).where("feature_type is not null")
    out = out.withColumn("region", V.region_text(F.col("chrom"), F.col("start"), F.col("end")))
    out = out.where(F.col("depth") >= min_depth) if min_depth is not None else out
    return out.where(F.col("vaf") >= min_vaf) if min_vaf is not None else out


def normalized_vcf(records: DataFrame, reference: DataFrame) -> DataFrame:
    """records (chrom, pos, ref, alt, ...) trimmed, left-aligned against a reference (see fasta), first of equal ones kept, with a status."""
    from cohortlens.sources.fasta import normalize

    out = normalize(records, reference)
    first = F.row_number().over(Window.partitionBy("chrom", "pos", "ref", "alt").orderBy("row_no"))
    return out.withColumn("__r", first).where("__r = 1").drop("__r")


def vcf_quality(text: DataFrame) -> DataFrame:
    """A row a file: records, records of too few columns, records without a SOURCE tag, and a status."""
    data = text.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("f", F.split("line", "\t"))
    n = data.groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.size("f") < 8).alias("invalid"), F.count_if((F.size("f") >= 8) & ~F.coalesce(F.get("f", F.lit(7)), F.lit("")).contains("SOURCE=")).alias("untagged"))
    return n.withColumn("status", F.when((F.col("records") == 0) | (F.col("invalid") > 0), "FAIL").when(F.col("untagged") > 0, "CONDITIONAL").otherwise("PASS"))


def subset_samples(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(at, line) of a file with the first nine columns and those of the wanted samples; one that isn't there is an error."""
    text = lines(spark, path)
    head = text.where(F.col("line").startswith("#CHROM")).select("line").first()
    names = head.line.split("\t") if head else []
    missing = [w for w in wanted if w not in names[9:]]
    if missing:
        raise ValueError(f"samples that aren't there: {missing}")
    places = list(range(9)) + [names.index(w) for w in wanted]
    cut = F.concat_ws("\t", *[F.get(F.split("line", "\t"), F.lit(i)) for i in places])
    return text.select("at", F.when(F.col("line").startswith("##"), F.col("line")).otherwise(cut).alias("line"))


def normalize_batch(spark: SparkSession, paths: str | list[str], reference: DataFrame, output: str) -> DataFrame:
    """Normalises many variant files in one job, each below output/name=<its name> in its own order; a row a file of what was done.

    A record of several ALTs becomes a record each, trimmed and left-aligned against the reference (see fasta.normalize); of
    equal ones in a file the first stays. A file's header lines come first, as they were, then its records by contig in
    the order of the file's first record of each, by place and by line. Files are dealt by ranges of their lines, so a long
    one is several tasks and parts. Report: file, records, expanded, written, mismatches, status (PASS, or CONDITIONAL with
    mismatches or alleles that can't be placed).
    """
    from cohortlens.sources.fasta import normalize
    from cohortlens.sources.sinks import staged

    text = lines(spark, paths).where(F.trim("line") != "")
    head = text.where(F.col("line").startswith("#")).select("file", F.lit(-1).cast("bigint").alias("block"), F.col("at.row").alias("row"), F.lit(0).cast("bigint").alias("pos"), "line")
    data = fields(text).select("file", "at", "f", F.posexplode(F.split(F.col("f")[4], ",")).alias("nth", "alt"))
    records = data.select("file", F.col("at.block").alias("block"), F.col("at.row").alias("row"), "nth", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[3].alias("ref"), "alt", "f")
    done = normalize(records, reference)
    same = Window.partitionBy("file", "chrom", "pos", "ref", "alt").orderBy("block", "row", "nth")
    done = staged(done.withColumn("first", F.row_number().over(same) == 1), "normalized")
    report = done.groupBy("file").agg(F.count_if(F.col("nth") == 0).alias("records"), F.count("*").alias("expanded"), F.count_if("first").alias("written"), F.count_if(F.col("norm_status") == "REF_MISMATCH").alias("mismatches"), F.count_if(F.col("norm_status").isin("REF_MISMATCH", "NO_REFERENCE", "REPEAT")).alias("__odd"))
    kept = done.where("first")
    places = kept.groupBy(F.col("file").alias("__file"), F.col("chrom").alias("__chrom")).agg(F.min(F.struct("block", "row")).alias("__from"))
    cells = F.array(F.col("f")[0], F.col("pos").cast("string"), F.col("f")[2], F.col("ref"), F.col("alt"))
    line = F.concat_ws("\t", F.concat(cells, F.slice("f", 6, 1_000_000)))
    body = kept.join(places, (F.col("file") == F.col("__file")) & (F.col("chrom") == F.col("__chrom"))).select("file", F.col("__from.block").alias("block"), F.col("__from.row").alias("row"), "pos", line.alias("line"), F.lit(1).alias("kind"))
    out = head.withColumn("kind", F.lit(0)).unionByName(body).withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1))
    order = ["name", "file", "kind", "block", "row", "pos", "line"]  # the name first, or the writer sorts once more, by name only
    out.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "line").write.mode("overwrite").partitionBy("name").text(output)
    return report.withColumn("status", F.when(F.col("__odd") > 0, "CONDITIONAL").otherwise("PASS")).drop("__odd")
