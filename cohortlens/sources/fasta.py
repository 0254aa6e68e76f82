"""Reference sequences as a table of fixed-width chunks, and left alignment of variants against them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.sequences import sequence_lines

CHUNK, FLANK = 4096, 512


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(contig, chunk_no, start, bases): upper-case chunks of `chunk` bases, start 0-based.

    Lines may be of any width; a line must follow a header. Each line is cut where chunks meet, and a chunk puts its
    pieces together: a group is a chunk, never a contig.
    """
    rows = sequence_lines(spark, path).select("contig", F.col("start").alias("o"), F.col("bases").alias("v"))
    cut = rows.select("contig", "o", "v", F.explode(F.sequence(F.floor(F.col("o") / chunk), F.floor((F.col("o") + F.length("v") - 1) / chunk))).alias("chunk_no"))
    part = F.expr(f"substring(v, cast(greatest(chunk_no * {chunk} - o, 0) + 1 as int), cast(least((chunk_no + 1) * {chunk}, o + length(v)) - greatest(chunk_no * {chunk}, o) as int))")
    pieces = cut.select("contig", "chunk_no", "o", part.alias("p")).groupBy("contig", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("o", "p"))).alias("x"))
    return pieces.select("contig", "chunk_no", (F.col("chunk_no") * chunk).alias("start"), F.array_join(F.col("x.p"), "").alias("bases"))


def trim(ref: str, alt: str, pos: int) -> tuple[str, str, int]:
    """Without the shared start, then without the shared end; each allele keeps a base."""
    n = 0
    while n < min(len(ref), len(alt)) - 1 and ref[n] == alt[n]:
        n += 1
    ref, alt, pos = ref[n:], alt[n:], pos + n
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    return ref, alt, pos


def left_align(ref: str, alt: str, pos: int, before: str) -> tuple[str, str, int, bool]:
    """An indel moved left while its last bases agree; `before` holds the bases up to pos - 1. Last: whether `before` ran out."""
    at = len(before)
    while len(ref) != len(alt) and ref[-1] == alt[-1] and pos > 1:
        if not at:
            return ref, alt, pos, True
        at -= 1
        ref, alt, pos = before[at] + ref[:-1], before[at] + alt[:-1], pos - 1
    return ref, alt, pos, False


def aligned(ref: str, alt: str, pos: int, before: str, whole: bool) -> tuple[str, str, int, bool]:
    """Trimmed and left-aligned; last: whether more of the reference before it is needed."""
    first = ref.upper()
    ref, alt, at = trim(first, alt.upper(), pos)
    if len(ref) == len(alt):
        return ref, alt, at, False
    ref, alt, at, short = left_align(ref, alt, at, before + first[: at - pos])
    ref, alt, at = trim(ref, alt, at)
    return ref, alt, at, short and not whole


def normalize(records: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records (chrom, pos, ref, alt, ...) with normalised pos, ref, alt and norm_status.

    Each record meets the chunk it starts in, the one after and the one before, by equality joins (chr and no chr are one
    name); a shift over more than a whole chunk of repeats is reported as REPEAT and left as far as it got. norm_status:
    NORMALIZED, UNCHANGED, REF_MISMATCH, NO_REFERENCE, SYMBOLIC or REPEAT.
    """
    bare = lambda c: F.regexp_replace(c, "(?i)^chr", "")
    r = reference.select(bare("contig").alias("__c"), F.col("chunk_no").alias("__k"), "bases")
    own = records.withColumns({"__c": bare("chrom"), "__at": F.floor((F.col("pos") - 1) / chunk)})
    for name, d in (("__prev", -1), ("__here", 0), ("__next", 1)):
        own = own.join(r.select("__c", (F.col("__k") - d).alias("__at"), F.col("bases").alias(name)), ["__c", "__at"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for pos, ref, alt, at, prev, here, after in zip(g["pos"], g["ref"], g["alt"], g["__at"], g["__prev"], g["__here"], g["__next"], strict=True):
                prev, here, after = prev or "", here or "", after or ""
                if not set((ref + alt).upper()) <= set("ACGTN"):
                    rows.append((pos, ref, alt, "SYMBOLIC"))
                elif not here:
                    rows.append((pos, ref, alt, "NO_REFERENCE"))
                else:
                    off = int(pos) - 1 - int(at) * chunk
                    if (here + after)[off : off + len(ref)] != ref.upper():
                        rows.append((pos, ref, alt, "REF_MISMATCH"))
                    else:
                        a, b, p, short = aligned(ref, alt, int(pos), prev + here[:off], int(at) <= 1)
                        rows.append((p, a, b, "REPEAT" if short else "NORMALIZED" if (p, a, b) != (pos, ref, alt) else "UNCHANGED"))
            p, a, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield g.drop(columns=["__c", "__at", "__prev", "__here", "__next"]).assign(pos=list(p), ref=list(a), alt=list(b), norm_status=list(s))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", norm_status string"
    return own.mapInPandas(run, ddl)
