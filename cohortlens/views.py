"""The engine's views of the star-schema tables: cohort, observations, copy numbers, predictions, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, grp, nation): a customer is a sample, two market segments are the cases."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "case").otherwise("control").alias("grp"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an order line: its customer observed at a part, with status by return flag (R, A, else unavailable)."""
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    status = F.when(F.col("l_returnflag") == "R", "Detected").when(F.col("l_returnflag") == "A", "Not detected").otherwise("Data unavailable")
    start = F.col("l_partkey") * 1000 + F.col("l_linenumber")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return rows.select(
        F.col("o_custkey").alias("sample_id"), F.col("p_brand").alias("gene"), F.col("p_type").alias("kind"), F.col("l_partkey").alias("part"), status.alias("status"), F.col("l_quantity").alias("depth"), F.col("l_discount").alias("vaf"),
        F.col("l_tax").alias("error_rate"), F.col("p_brand").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), F.when(F.col("l_linenumber") <= 2, "SNV").when(F.col("l_linenumber") <= 4, "INDEL").otherwise("CNV").alias("feature_type"),
        F.ln(F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice")).alias("log2_ratio"), F.col("o_orderpriority").alias("stage"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
    ).join(cohort(spark, sf_dir).select("sample_id", "grp"), "sample_id")


#: The same views for the oracle.
COHORT_SQL = "cohort AS (SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'case' ELSE 'control' END AS grp, c_nationkey AS nation, c_mktsegment AS segment FROM customer)"
OBS_SQL = (
    COHORT_SQL
    + """, obs AS (SELECT o_custkey AS sample_id, p_brand AS gene, p_type AS kind, l_partkey AS part, CASE l_returnflag WHEN 'R' THEN 'Detected' WHEN 'A' THEN 'Not detected' ELSE 'Data unavailable' END AS status,
 CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS v, l_quantity AS depth, l_discount AS vaf, l_tax AS error_rate, p_brand AS chrom, l_partkey * 1000 + l_linenumber AS start_, l_partkey * 1000 + l_linenumber + l_quantity::BIGINT AS end_,
 CASE WHEN l_linenumber <= 2 THEN 'SNV' WHEN l_linenumber <= 4 THEN 'INDEL' ELSE 'CNV' END AS feature_type, ln(l_extendedprice / l_quantity / p_retailprice) AS log2_ratio, o_orderpriority AS stage, grp, l_orderkey AS order_id, l_linenumber AS line_no
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN cohort ON sample_id = o_custkey)"""
)


def fisher_sql(source: str, keys: str, a: str, b: str, c: str, d: str) -> str:
    """CTEs fm, fx and fisher (keys, p): two-sided exact p of the four cells of each row of a relation."""

    def log_p(x: str) -> str:
        up = " + ".join(f"lgamma({v} + 1.0)" for v in ("r1", "r2", "c1", "(n - c1)"))
        down = " - ".join(f"lgamma({v} + 1.0)" for v in ("n", x, f"(r1 - {x})", f"(c1 - {x})", f"(r2 - c1 + {x})"))
        return f"{up} - {down}"

    return f"""fm AS (SELECT {keys}, ({a})::BIGINT AS a, ({a} + {b})::BIGINT AS r1, ({c} + {d})::BIGINT AS r2, ({a} + {c})::BIGINT AS c1, ({a} + {b} + {c} + {d})::BIGINT AS n FROM {source}),
fx AS (SELECT *, unnest(generate_series(greatest(0, c1 - r2), least(r1, c1))) AS x FROM fm),
fl AS (SELECT {keys}, n, {log_p("x")} AS l, {log_p("a")} AS lo FROM fx),
fisher AS (SELECT {keys}, CASE WHEN any_value(n) = 0 THEN 1.0 ELSE least(1.0, sum(CASE WHEN l <= lo + 1e-7 THEN exp(l) ELSE 0 END)) END AS p FROM fl GROUP BY {keys})"""
