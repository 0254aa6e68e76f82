"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once: a document's measurements and one integer of failure bits are the ledger. A policy is a
named version that says which bits reject a document; applying another version, or asking what each rule alone costs,
needs the bits only and never the text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import table

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits never change their meaning; new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "no_letters", "n_letters * 2 < word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rejects: tuple[str, ...]

    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rejects)


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_windows")),
        Policy("web-1", ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words", "long_words", "no_letters")),
        Policy("strict-1", tuple(r.name for r in RULES)),
    )
}


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows, in order. A space parts words, which hold none, so windows differ as texts do."""
    at = lambda k: F.slice(words, k, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(F.size(words) >= 3, F.zip_with(F.zip_with(at(1), at(2), lambda a, b: F.concat_ws(" ", a, b)), at(3), lambda ab, c: F.xxhash64(ab, c))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters. A null text measures 0 everywhere.

    Window equality is that of 64-bit hashes within one text. Texts without a repeated window, nearly all, stop at a
    hash set; only the others sort their windows. Columns of docs with these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    d = d.withColumn("__h", _windows(F.col("__words"))).withColumn("__u", F.size(F.array_distinct("__h")))
    # Places of windows that occur again: sorted by (hash, place), a window equals a neighbour.
    d = d.withColumn("__s", F.when(F.col("__u") < F.size("__h"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    shown = lambda x, k: ((k > 0) & (F.get(F.col("__s"), k - 1)["h"] == x["h"])) | (F.coalesce(F.get(F.col("__s"), k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("__p", F.sort_array(F.transform(F.filter("__s", shown), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    return d.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(bare).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "n_letters": (F.length(bare) - F.length(F.translate(bare, "0123456789.,;:!?()[]{}\"'-_/\\@#*$%&|<>+=~^`", ""))).cast("bigint"),
        }
    ).withColumn("n_letters", F.col("word_chars") - F.col("n_letters")).drop("__words", "__lines", "__h", "__u", "__s", "__p")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, one bit a rule. No shuffle; one row in, one row out, repeated rows too."""
    bits = None
    for r in RULES:
        bit = F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, text_col).withColumn("failed", bits)


def kept(version: str) -> Column:
    """Whether the policy keeps a row of the ledger."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[version].mask()).cast("bigint")) == 0


def ablations(book: DataFrame, version: str) -> DataFrame:
    """(rule, n_failed, n_only): how many documents each rule of the policy rejects, and how many it alone rejects.

    Counts over the bits, summed before the shuffle; one row a rule.
    """
    mask = POLICIES[version].mask()
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("bigint"))
    sums = []
    for r in RULES:
        if mask >> r.bit & 1:
            sums += [F.count_if(F.getbit("failed", F.lit(r.bit)) == 1).alias(f"f{r.bit}"), F.count_if(hit == 1 << r.bit).alias(f"o{r.bit}")]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in RULES if mask >> r.bit & 1])
    return book.agg(*sums).select(F.inline(rows))


def op9(spark, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~kept("base-1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept("web-1").alias("kept"), "failed")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(translate(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'), '0123456789.,;:!?()[]{}"''-_/\@#*$%&|<>+=~^`', '')) AS n_letters FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
  + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_letters * 2 < word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept, failed FROM f
"""
