"""Variant, interval and copy-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gain and loss of a log2 ratio.
GAIN, LOSS = 0.25, -0.25


# Reference builds and other names of each.
BUILDS = {"GRCh38": ("hg38", "GRCh38.p14"), "GRCh37": ("hg19",)}


def build_name(name: Column) -> Column:
    """The build that a name stands for, NULL for any other; names are taken as they are written."""
    return F.coalesce(*[F.when(name.isin(build, *others), F.lit(build)) for build, others in BUILDS.items()])


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", chrom, pos, ref, alt)


def variant_type(ref: Column, alt: Column) -> Column:
    """SNV, INDEL or MNV by lengths."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").when(F.length(ref) != F.length(alt), "INDEL").otherwise("MNV")


def small_variant(ref: Column, alt: Column) -> Column:
    """SNV or INDEL; NULL for MNV, symbolic alleles and breakends."""
    plain = alt.rlike("^[ACGTNacgtn]+$") & ref.rlike("^[ACGTNacgtn]+$")
    return F.when(plain & (variant_type(ref, alt) != "MNV"), variant_type(ref, alt))


def chromosome(c: Column, mitochondria: bool = False) -> Column:
    bare = F.regexp_replace(F.trim(c), "(?i)^chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), "MT").otherwise(bare) if mitochondria else bare


def sample_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_.-]", "_")


def info_map(info: Column, upper: bool = False) -> Column:
    """KEY=VALUE;FLAG text as a map; flags have NULL values."""
    m = F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    entries = F.filter(F.split(info, ";"), lambda x: ~x.isin("", "."))
    entries = F.transform(entries, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))
    keyed = F.transform(entries, lambda e: F.struct((F.upper(e["key"]) if upper else e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), m)


def format_map(keys: Column, values: Column) -> Column:
    a, b = F.split(keys, ":"), F.split(values, ":")
    n = F.least(F.size(a), F.size(b))
    return F.map_from_arrays(F.slice(a, 1, n), F.slice(b, 1, n))


def escape_info(value: Column) -> Column:
    for plain, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), (",", "%2C")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def add_info(info: Column, key: str, value: Column) -> Column:
    return F.concat_ws(";", F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: ~x.isin("", ".")), F.concat(F.lit(f"{key}="), escape_info(value)))


def genotype_status(gt: Column, allele: Column) -> Column:
    """Of one ALT allele: NULL for no call, else 1 if the genotype has its number, else 0."""
    calls = F.split(gt, r"[/|]")
    known = F.filter(calls, lambda x: ~x.isin(".", ""))
    return F.when(gt.isNull() | (F.size(known) == 0), None).when(F.array_contains(calls, allele.cast("string")), 1).otherwise(0)


def carries_alt(gt: Column) -> Column:
    return F.when(gt.isNull() | (gt == ""), True).otherwise(F.exists(F.split(gt, r"[/|]"), lambda x: F.coalesce(x.try_cast("int") > 0, F.lit(False))))


def copy_event(copies: Column, log2: Column, gain: float = GAIN, loss: float = LOSS) -> Column:
    return (
        F.when(copies > 2, "GAIN").when(copies < 2, "LOSS").when(copies == 2, "NEUTRAL").when(log2 >= gain, "GAIN").when(log2 <= loss, "LOSS").when(log2.isNotNull(), "NEUTRAL")
    )


def region(text: Column) -> Column:
    """chrom:start-end or chrom:point (1-based, closed, thousands separators allowed) as a struct; NULL if it is none."""
    t = F.regexp_replace(F.trim(text), ",", "")
    start = F.regexp_extract(t, r"^(.+):(\d+)(?:-(\d+))?$", 2).try_cast("bigint")
    end = F.coalesce(F.nullif(F.regexp_extract(t, r"^(.+):(\d+)(?:-(\d+))?$", 3), F.lit("")).try_cast("bigint"), start)
    return F.when((start >= 1) & (end >= start), F.struct(F.regexp_extract(t, r"^(.+):(\d+)(?:-(\d+))?$", 1).alias("chrom"), start.alias("start"), end.alias("end")))


def strict_region(text: Column) -> Column:
    return F.coalesce(region(text), F.raise_error(F.concat(F.lit("bad region: "), F.coalesce(text, F.lit("NULL")))).cast("struct<chrom:string,start:bigint,end:bigint>"))


def region_text(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def bins(start: Column, end: Column, size: int) -> Column:
    """Numbers of the 1-based bins of `size` that an interval covers; explode and join on them instead of a range join."""
    return F.sequence(F.floor((start - 1) / size), F.floor((end - 1) / size))


def zero_based_bins(start: Column, end: Column, size: int) -> Column:
    """The other convention in use: start div size to (end - 1) div size."""
    return F.sequence(F.floor(start / size), F.greatest(F.floor(start / size), F.floor((end - 1) / size)))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.chrom") == F.col(f"{b}.chrom")) & (F.col(f"{a}.start") <= F.col(f"{b}.end")) & (F.col(f"{b}.start") <= F.col(f"{a}.end"))


def neighbour_bins(start: Column, size: int, k: int) -> Column:
    """Starts of the 2k+1 bins of `size` around an interval's start, those before 1 left out."""
    first = F.floor((start - 1) / size).cast("bigint") * size + 1
    return F.filter(F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda i: first + i * size), lambda x: x >= 1)


def tiles(start: Column, end: Column, size: int) -> Column:
    """Starts of all bins of `size` that tile an interval."""
    return F.sequence(F.floor((start - 1) / size).cast("bigint") * size + 1, end, F.lit(size).cast("bigint"))


def file_kind(name: Column) -> Column:
    """Kind of a data file by words in its category, type and name; structural variants before other variants."""
    t = F.lower(name)
    return (
        F.when(t.contains("structural variant") | t.contains("structural_variant") | t.contains("breakpoint"), "SV")
        .when(t.contains("copy number") | t.contains("copy_number") | t.contains("cnv"), "CNV")
        .when(t.contains("methylation") | t.contains("beta value"), "METHYLATION")
        .when(t.contains("mutation") | t.contains("variant") | t.contains("snv") | t.contains("indel"), "SNV_INDEL")
        .when(t.contains("biospecimen"), "BIOSPECIMEN")
        .when(t.contains("clinical"), "CLINICAL")
        .otherwise("OTHER")
    )


def sample_class(sample_type: Column, tissue_type: Column) -> Column:
    """TUMOR, NORMAL_BLOOD, NORMAL_SOLID or UNCLASSIFIED."""
    t, k = F.lower(F.coalesce(sample_type, F.lit(""))), F.lower(F.coalesce(tissue_type, F.lit("")))
    return F.when(t.contains("blood") & (t.contains("normal") | (k == "normal")), "NORMAL_BLOOD").when(t.contains("normal") | (k == "normal"), "NORMAL_SOLID").when(t.contains("tumor") | t.contains("tumour") | t.contains("metasta") | (k == "tumor"), "TUMOR").otherwise("UNCLASSIFIED")
