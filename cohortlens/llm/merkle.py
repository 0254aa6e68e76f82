"""A Merkle manifest of a dataset: a tree of each source's rows, a tree of the sources' roots, and a proof a row.

Ranks are written in digits of base 16. Within a block of 16^3 ranks the last digit is grouped away, then the next, then
the next: each grouping nests the structs of its children and hashes them, and as all three group by columns that hold
the block, one exchange serves them. Blocks are the leaves of the next pass, so a tree of any size takes a pass for
three digits, and no row of a table holds more than 4096 leaves. Proofs go the other way: a block that knows the path
above it passes it on, each transform adds the step of a level and each explode gives the children with their paths.
A block meets the path above it by a grouping of both, so there is no join of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import free_names, table, written
from cohortlens.llm.ranks import in_order, numbered

FAN, DIGITS = 16, 3
BITS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<l:string,r:string>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8."""
    return F.sha2(text, 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of values in turn: `-` for null, else the UTF-8 byte count, `:` and the value."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]))


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _applies(level: int) -> Column:
    """Whether a tree of __n leaves still has several nodes at a level."""
    return F.col("__n") > FAN**level


def _blocks(nodes: DataFrame, level: int, own: list[str]) -> DataFrame:
    """nodes (__t, __n, __i, __h, own...) -> (__t, __n, __b, __h, __kids): a row a block, hashes of three levels nested."""
    digit = lambda k: F.shiftright("__i", BITS * k).bitwiseAND(FAN - 1).cast("int").alias(f"__d{k}")
    rows = nodes.select("__t", "__n", F.shiftright("__i", BITS * DIGITS).alias("__b"), *[digit(k) for k in range(DIGITS)], F.struct("__h", *own).alias("__x"))
    rows = rows.repartition("__t", "__b")
    for k in range(DIGITS):
        keys = ["__t", "__n", "__b", *[f"__d{j}" for j in range(k + 1, DIGITS)]]
        run = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"__d{k}", "__x"))).alias("__run"))
        kids = run.select(*keys, F.col("__run.__x").alias("__kids"))
        h = F.when(_applies(level + k), digest(_joined(F.col("__kids.__h")))).otherwise(F.element_at("__kids.__h", 1))
        rows = kids.select(*keys, F.struct(h.alias("__h"), "__kids").alias("__x"))
    return rows.select("__t", "__n", "__b", "__x.__h", "__x.__kids")


def rollup(nodes: DataFrame, own: list[str], name: str) -> list[DataFrame]:
    """The written block tables of every tree, leaves' blocks first; in the last each tree has one block, its root."""
    most = nodes.agg(F.max("__n")).first()[0] or 0
    tables, level = [], 0
    while not tables or most > FAN**level:
        tables.append(written(_blocks(nodes, level, own), f"{name}-blocks"))
        nodes, own = tables[-1].select("__t", "__n", F.col("__b").alias("__i"), "__h"), []
        level += DIGITS
    return tables


def _children(rows: DataFrame, level: int, carried: list[str]) -> DataFrame:
    """A row a child of __kids, with its step put before __path and its rank as __b."""
    hashes = F.col("__kids.__h")

    def stepped(kid: Column, i: Column) -> Column:
        step = F.struct(_joined(F.slice(hashes, F.lit(1), i)).alias("l"), _joined(F.slice(hashes, i + 2, F.lit(FAN))).alias("r"))
        return F.struct(kid.alias("kid"), F.when(_applies(level), F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>")).alias("step"), i.cast("bigint").alias("i"))

    out = rows.select("__t", "__n", "__b", "__path", *carried, F.explode(F.transform("__kids", stepped)).alias("__c"))
    return out.select("__t", "__n", (F.col("__b") * FAN + F.col("__c.i")).alias("__b"), F.concat("__c.step", "__path").alias("__path"), *carried, "__c.kid.*")


def unrolled(tables: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(__t, __n, __b, __path, carried..., __h, own...): every leaf with the steps from it upwards.

    above has (__t, __path, carried...) for every tree: what stands above its root, and what its leaves are told.
    """
    known = above.withColumn("__b", F.lit(0).cast("bigint"))
    for i in range(len(tables) - 1, -1, -1):
        own = tables[i].select("__t", "__n", "__b", "__kids")
        both = own.unionByName(known.select("__t", "__b", "__path", *carried), allowMissingColumns=True)
        first = lambda c: F.first(c, ignorenulls=True).alias(c)
        known = both.groupBy("__t", "__b").agg(*map(first, ["__n", "__kids", "__path", *carried]))
        for k in range(DIGITS - 1, -1, -1):
            known = _children(known, i * DIGITS + k, carried)
        if i:
            known = known.drop("__h")
    return known


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with a path's siblings."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["l"], h, step["r"])))


def siblings(path: Column) -> Column:
    """The siblings' digests of a path as one string, from the leaf's run upwards, left to right."""
    return _joined(F.transform(path, lambda step: F.concat(step["l"], step["r"])))


def manifest(rows: DataFrame, order: list[str], leaf_col: str = "leaf", tree_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(keep..., tree, leaf, subroot, root, path): each row's proof, an array of struct(l, r) of siblings' digests from its
    run up to the root.

    Leaves of a tree ascend by `order` (nulls first; what is equal there by leaf), sixteen consecutive nodes become the
    digest of their digests while there are several; trees' roots, by tree in UTF-8 order with null first, likewise. A
    lone leaf is its tree's root. A null tree is a tree of its own, a repeated row is a leaf each time, an empty table
    has no rows and no root. Leaves must not be null. keep may not hold a name of the result or one that starts with
    "__" (ValueError).
    """
    keep = list(order) if keep is None else keep
    free_names(keep, ["tree", "leaf", "subroot", "root", "path"])
    by = [f"__o{i}" for i in range(len(order))]
    slim = rows.select(F.col(f"`{tree_col}`").cast("string").alias("__t"), *[F.col(f"`{c}`").alias(o) for c, o in zip(order, by, strict=True)], F.col(f"`{leaf_col}`").alias("__h"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    own = [f"__k{i}" for i in range(len(keep))]
    leaves = numbered(in_order(slim, ["__t", *by, "__h"], "merkle"), ["__t"], "merkle").select("__t", "__n", "__i", "__h", *own)
    trees = rollup(leaves, own, "merkle")
    tops = trees[-1].select(F.col("__t").alias("__name"), "__h")
    tops = numbered(in_order(tops, ["__name"], "merkle-trees"), [], "merkle-trees").select(F.lit(0).alias("__t"), "__n", "__i", "__h", "__name")
    upper = rollup(tops, ["__name"], "merkle-upper")
    nothing = F.array().cast(f"array<{_STEP}>")
    heads = upper[-1].select("__t", nothing.alias("__path"), F.col("__h").alias("__root"))
    proven = unrolled(upper, heads, ["__root"])
    above = proven.select(F.col("__name").alias("__t"), "__path", "__root", F.col("__h").alias("__sub"))
    out = unrolled(trees, above, ["__root", "__sub"])
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], F.col("__t").alias("tree"), F.col("__h").alias("leaf"), F.col("__sub").alias("subroot"), F.col("__root").alias("root"), F.col("__path").alias("path"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what they say of texts of which one in five has been lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lowered = leaf_digest(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    leaves = docs.select("doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), tampered.alias("tampered"))
    proofs = manifest(leaves, ["doc_id"], keep=["doc_id", "tampered"])
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, parts: str, depth: int) -> str:
    """CTEs {name}0.. of a tree's nodes (s, i, n, h) with l and r, from {name}_leaves (s, i, n, h)."""
    out, before = [], f"{name}_leaves"
    for k in range(depth + 1):
        run = f"PARTITION BY {parts}, i // {FAN} ORDER BY i"
        out.append(
            f"{name}{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM "
            + (before if not k else f"(SELECT {parts}, i // {FAN} AS i, n, CASE WHEN n > {FAN}::BIGINT ** {k - 1} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY {parts}, i // {FAN}, n)")
            + ")"
        )
    return ",\n".join(out)


def _climb(name: str, source: str, parts: str, depth: int) -> str:
    """CTEs {name}_up0.. that fold a row's h by its tree's levels and gather its siblings; pos is its rank in the tree."""
    out, before = [], source
    for k in range(depth):
        out.append(
            f"{name}_up{k} AS (SELECT x.* EXCLUDE (fold, proof, pos), x.pos // {FAN} AS pos, CASE WHEN t.n > {FAN}::BIGINT ** {k} THEN sha256(t.l || x.fold || t.r) ELSE x.fold END AS fold, x.proof || CASE WHEN t.n > {FAN}::BIGINT ** {k} THEN t.l || t.r ELSE '' END AS proof FROM {before} x JOIN {name}{k} t ON {parts} AND t.i = x.pos)"
        )
        before = f"{name}_up{k}"
    return ",\n".join(out)


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


#: Five levels of documents and four of sources: enough for 16^5 documents a source and 16^4 sources. crc32 is spelled
#: out bit by bit over the few bytes of an id.
_DEPTH, _TOPS = 5, 4
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
_LEAF = " || ".join(_field_sql(c) for c in FIELDS)
_LOW = " || ".join(_field_sql(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in FIELDS)
OP11_SQL = f"""WITH d AS (SELECT doc_id, source AS s, sha256({_LEAF}) AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN sha256({_LOW}) END AS low FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
doc_leaves AS (SELECT s, i, n, leaf AS h FROM ranked),
{_levels("doc", "s", _DEPTH)},
top_leaves AS (SELECT 0 AS z, s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM doc{_DEPTH}),
{_levels("top", "z", _TOPS)},
start AS (SELECT doc_id, s, leaf, i AS pos, coalesce(low, leaf) AS fold, '' AS proof FROM ranked),
{_climb("doc", "start", "t.s IS NOT DISTINCT FROM x.s", _DEPTH)},
middle AS (SELECT x.* EXCLUDE (pos), u.i AS pos, u.h AS subroot FROM doc_up{_DEPTH - 1} x JOIN top_leaves u ON u.s IS NOT DISTINCT FROM x.s),
{_climb("top", "middle", "true", _TOPS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM top_up{_TOPS - 1}, (SELECT h FROM top{_TOPS})"""
