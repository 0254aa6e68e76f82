"""A corpus pipeline over `documents`: languages, lines, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of `documents`; a null or empty text, a null id or source and repeated
rows pass every stage with the results that the operators' docstrings name, and further columns, whole, of
any name that starts with none of `__`, `language ` and `mix `.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.base import named, table, written
from cohortlens.llm.encoding import vocabulary
from cohortlens.llm.language import held_out, identify, train
from cohortlens.llm.lines import dedup_lines
from cohortlens.llm.mixing import mix
from cohortlens.llm.packing import pack
from cohortlens.llm.simhash import near_dedup

#: A document stays if its largest language has at least this share of it.
LEAST_SHARE = 0.4
#: Words of a shingle, and bits by which fingerprints of near copies may differ: about what a similarity of 0.9 leaves.
#: That of 0.8 would be 10 bits, whose candidate keys would agree in blocks of five bits only and propose nearly all pairs.
WORDS, RADIUS = 5, 6


def own(docs: DataFrame) -> list:
    return [named(c) for c in docs.columns]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter, or in which no language has LEAST_SHARE, go."""
    seen = identify(docs, train(docs.where(~held_out())), keep=docs.columns, prefix="language ")
    return seen.where((F.col("`language lang_pred`") != "und") & (F.col("`language score`") >= LEAST_SHARE)).select(*own(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or place has, n_chars anew; documents that consist of such lines only go."""
    out = dedup_lines(docs, counts=("__n_lines", "__n_dropped"))
    out = out.where((F.col("__n_dropped") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component over shingles of WORDS words."""
    return near_dedup(docs, width=WORDS, radius=RADIUS).select(*own(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times."""
    taken = mix(docs, keep=docs.columns, prefix="mix ", store=False).where("`mix copies` > 0")
    return taken.select(*own(docs), F.explode(F.sequence(F.lit(1), F.col("mix copies").cast("int"))).alias("mix nth")).select(*own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids."""
    return pack(docs, vocabulary("word_bpe_49k.json"), keep_ids=False)


STAGES = [("language", languages), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: Fingerprints, union-find and packing have no SQL form here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
