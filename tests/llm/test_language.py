import zlib

import numpy as np

from cohortlens.llm import language as L

EN = "the cat and the dog went with that other thing through the house when they were there "
DE = "der hund und die katze gingen durch das haus weil sie nicht mehr dort waren und schliefen "


def model(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    return docs, L.train(docs)


def test_mixture_shares_and_selection():
    p = np.array([[1.0, 1e-6, 1e-6]] * 70 + [[1e-6, 1.0, 1e-6]] * 30)
    pi = L.mixture(p)
    assert abs(pi[0] - 0.7) < 0.02 and abs(pi[1] - 0.3) < 0.02 and pi[2] == 0
    assert L.mixture(np.array([[1.0, 0.9, 0.8]] * 50)).argmax() == 0


def test_identify(spark):
    docs, m = model(spark)
    assert m.langs == ["de", "en"]
    rows = [(1, EN), (2, DE), (3, EN * 3 + DE), (4, None), (5, ""), (6, "123 !? ½ _"), (7, "the " * 30000), (2, DE), (None, EN)]
    got = {(r.doc_id, r.x): (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, x int"), m, keep=["doc_id", "x"]).collect()}
    assert len(got) == len(rows)
    assert [got[(r[0], i)][0] for i, r in enumerate(rows)] == ["en", "de", "en", "und", "und", "und", "en", "de", "en"]
    assert 0.6 < got[(3, 2)][1] < 0.9 and all(0 <= s <= 1 for _, s in got.values())


def test_nothing_to_learn_from(spark):
    docs, _ = model(spark)
    empty = L.train(docs.limit(0))
    assert [r.lang_pred for r in L.identify(docs.limit(2), empty).collect()] == ["und", "und"]
    assert L.identify(docs.limit(0), empty).count() == 0


def test_held_out(spark):
    df = spark.range(50).select("id", L.held_out("id").alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = L.op10(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
