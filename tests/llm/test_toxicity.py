import random
import zlib

import numpy as np

from cohortlens.llm import toxicity as X

BASE = ["the", "house", "went", "along", "river", "quiet", "morning", "paper", "window", "garden", "letter", "stone"]
BAD = ["vileword", "nastyone", "scumling"]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(BASE) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.randrange(20, 300))]
        if i % 3 == 0:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_learns_and_shares_subwords():
    texts, labels = corpus(240, 1)
    model = X.fit(texts, labels, buckets=1 << 13)
    scorer = X.Scorer(model)
    unseen, truth = corpus(150, 2)
    got = np.array(scorer.score(unseen)) >= 0.3
    assert (got == np.array(truth)).mean() > 0.97
    clean = " ".join(BASE * 6)
    scores = scorer.score([clean, clean + " vilewrod", clean + " nasty0ne scumlings", None, "", "!!! ..."])
    assert scores[0] < scores[1] and scores[2] >= 0.3 and scores[3] == scores[4] == scores[5] < 0.3
    assert all(0 <= s <= 1 for s in scores)


def test_long_text_keeps_its_few_words():
    texts, labels = corpus(240, 1)
    scorer = X.Scorer(X.fit(texts, labels, buckets=1 << 13))
    long = " ".join(BASE * 2000)
    assert scorer.score([long])[0] < 0.3 <= scorer.score([long + " vileword nastyone scumling"])[0]


def test_one_class_or_nothing_to_learn_from():
    for texts, labels in (([], []), (["a b"], [0]), (["", ""], [0, 1])):
        assert all(0 <= s <= 1 for s in X.Scorer(X.fit(texts, labels, buckets=64)).score(["a b", None]))


def test_rows(spark):
    texts, labels = corpus(120, 3)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(500, None, "s"), (3, texts[3], "s"), (None, "vileword", "s")], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = X.train(docs, marks)
    got = X.score(docs, model).collect()
    assert len(got) == 123 and all(0 <= r.score <= 1 for r in got)
    assert X.score(docs.limit(0), model).count() == 0
    assert X.train(docs.limit(0), marks.limit(0)).bias < 0.1


def test_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    got = X.op8(spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.8 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.03 * len(got)
