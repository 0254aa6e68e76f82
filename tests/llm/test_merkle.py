import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Root of a list of digests, and each place's steps (left, right) upwards."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run, p = place // 16 * 16, place % 16
            steps[i].append(("".join(nodes[run : run + p]), "".join(nodes[run + p + 1 : run + 16])))
            at[i] = place // 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), steps


def brute(rows):
    """{row as op11 gives it: times}."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    lows = str.maketrans(M.UPPER, M.LOWER)
    own, roots = {}, []
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, steps = climb([leaf(r) for r in trees[s]])
        roots.append(root)
        own[s] = steps
    root, upper = climb(roots)
    out = Counter()
    for s, sub, above in zip(names, roots, upper, strict=True):
        for r, below in zip(trees[s], own[s], strict=True):
            fold = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                fold = leaf([*r[:4], None if r[4] is None else r[4].translate(lows)])
            for left, right in below + above:
                fold = h(left, fold, right)
            out[(r[0], leaf(r), sub, root, h(*[x for step in below + above for x in step]), fold, fold == root)] += 1
    return out


def corpus(n, sources):
    rng = random.Random(n)
    rows = [(i, rng.choice(sources), rng.choice(["en", "fr", None]), rng.randrange(9), rng.choice(["Some Text", "lower", "Élan Ünd 漢字", "", None, "A" * 5000])) for i in rng.sample(range(10 * n), n)]
    return rows


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r) for r in M.op11(spark, str(tmp_path)).collect())


def test_against_brute_force(spark, tmp_path):
    rows = corpus(700, ["a"] * 6 + ["b", "é", "Z", None])
    rows += [rows[0]] * 3 + [(None, "a", None, None, None), (None, None, "x", 1, "T"), (5, "lone", "en", 1, "One")]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_more_than_a_block_of_leaves_and_of_trees(spark, tmp_path):
    """4,500 leaves in one tree take two passes; 300 trees take three levels; a third of the rows are one row."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(3000)] + [(7, "hot", "en", 7, "Same")] * 1500 + [(i, f"s{i}", None, i, None) for i in range(300)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_and_lone(spark, tmp_path):
    assert run(spark, tmp_path / "none", []) == Counter()
    rows = [(1, None, None, None, None)]
    got = run(spark, tmp_path / "one", rows)
    assert got == brute(rows)
    ((_, own, sub, root, proof, _, _),) = got
    assert own == sub == root and proof == h("")


def test_manifest_keeps_columns_of_any_name(spark):
    rows = [(i, "a", f"v{i}", i) for i in range(20)]
    data = spark.createDataFrame(rows, "`doc.id` bigint, source string, `n.x` string, i bigint").withColumn("leaf", M.leaf_digest(F.col("`doc.id`")))
    out = M.manifest(data, ["doc.id"], keep=["doc.id", "n.x", "i"])
    assert out.columns == ["doc.id", "n.x", "i", "tree", "leaf", "subroot", "root", "path"]
    got = out.withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 20 and all(r["n.x"] == f"v{r['doc.id']}" and r.i == r["doc.id"] and r.folded == r.root for r in got)
    for name in ("root", "__t"):
        with pytest.raises(ValueError):
            M.manifest(data.withColumn(name, F.lit(1)), ["doc.id"], keep=[name])


def test_any_changed_field_is_seen(spark):
    a, b = spark.range(1).select(M.leaf_digest(F.lit("ab"), F.lit("c")).alias("a"), M.leaf_digest(F.lit("a"), F.lit("bc")).alias("b")).first()
    assert a != b and a == leaf(["ab", "c"])
