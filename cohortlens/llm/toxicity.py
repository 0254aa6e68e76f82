"""Toxicity by subword bags: character n-gram and word embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its subwords' embeddings (the word itself and its character n-grams, hashed to buckets), so
an unseen misspelling shares most of its vectors with the word it stands for. A bag is a window of words, its vector the
mean of theirs; the linear softmax reads bags. A document's score is its most toxic window's, so a few words count in a
long document too. Training starts from all windows alike, then follows each document's most toxic one.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import mapped, free_names, named, small_batches, table

WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
#: Expected labelled documents of each class that training reads, on the driver.
TRAIN_DOCS = 1200
MAX_WORDS = 600_000


@dataclass
class Model:
    subwords: np.ndarray  # buckets x 2: embeddings times the softmax layer, which is all that a score needs
    bias: float
    buckets: int
    window: int
    shortest: int
    longest: int
    scale: float = 1.0
    blank: float = 0.0


def buckets_of(word: str, buckets: int, shortest: int, longest: int) -> list[int]:
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode("utf-8", "surrogatepass"))]
    for n in range(shortest, longest + 1):
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass"), n) for i in range(len(marked) - n + 1) if len(marked) > n]
    return [x % buckets for x in out]


def subwords_of(words: list[str], buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one after the other, and how many each word has."""
    flat, sizes = array("i"), array("i")
    for w in words:
        own = buckets_of(w, buckets, shortest, longest)
        flat.extend(own)
        sizes.append(len(own))
    return np.array(flat, dtype=np.int32), np.array(sizes, dtype=np.int64)


def least_bag(window: int) -> int:
    """A bag of fewer words is made up to so many with blanks, each with the typical margin of clean bags."""
    return max(1, window // 2)


def bag_starts(n: int, window: int) -> np.ndarray:
    """Where n words are cut into bags of even sizes, of at most window words."""
    k = -(-n // window)
    return np.arange(k) * n // k


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 16, dim: int = 8, window: int = 6, shortest: int = 3, longest: int = 5, epochs: int = 120, rate: float = 0.05, decay: float = 1e-5, seed: int = 11, prior: float | None = None) -> Model:
    """Trains on four fifths of the documents and sets the score's scale and offset on the others, which it never saw; then trains on all.

    prior: the share of label 1 where scores are wanted, as sampling may have changed it; that of labels by default.
    """
    if len(texts) < 50:
        return train_bags(texts, labels, buckets, dim, window, shortest, longest, epochs, rate, decay, seed)
    model = train_bags([t for i, t in enumerate(texts) if i % 5], [y for i, y in enumerate(labels) if i % 5], buckets, dim, window, shortest, longest, epochs, rate, decay, seed)
    z = np.array(Scorer(model).margins(texts[::5]))
    y = np.array(labels[::5], dtype=float)
    if 0 < y.sum() < len(y):
        prior = float(y.mean()) if prior is None else prior
        weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
        unit = max(1e-6, float(np.abs(z - np.median(z)).mean()))
        x, ab = np.stack([z / unit, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
        for _ in range(60):  # Newton steps of a ridged logistic fit
            p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
            grad = x.T @ (weight * (p - y)) + 1e-3 * ab * [1, 0]
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
            ab = ab - 0.5 * np.linalg.solve(hess, grad)
        model = train_bags(texts, labels, buckets, dim, window, shortest, longest, epochs, rate, decay, seed)
        if ab[0] > 0:
            model.scale, model.bias = float(ab[0] / unit), float(ab[1] + ab[0] / unit * model.bias)
    return model


def train_bags(texts: list[str], labels: list[int], buckets: int, dim: int, window: int, shortest: int, longest: int, epochs: int, rate: float, decay: float, seed: int) -> Model:
    """Full-batch Adam on the embeddings and the softmax layer together; classes weigh the same."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in tokens(t)], dtype=np.int64) for t in texts]
    used = [i for i, d in enumerate(docs) if len(d)]
    y = np.array([labels[i] for i in used], dtype=np.int64)
    if not used or len(set(y.tolist())) < 2:
        share = float(np.mean(labels)) if labels else 0.0
        return Model(np.zeros((buckets, 2)), math.log((share + 1e-3) / (1 - share + 1e-3)), buckets, window, shortest, longest)
    flat = np.concatenate([docs[i] for i in used])
    sizes = np.array([len(docs[i]) for i in used])
    per = -(-sizes // window)
    first_bag = np.r_[0, np.cumsum(per)[:-1]]
    bag_doc = np.repeat(np.arange(len(used)), per)
    starts = np.concatenate([s + bag_starts(n, window) for s, n in zip(np.r_[0, np.cumsum(sizes)[:-1]], sizes, strict=True)])
    bag_size = np.diff(np.r_[starts, len(flat)])
    bag_of = np.repeat(np.arange(len(starts)), bag_size)
    bag_size = np.maximum(bag_size, least_bag(window))
    ids, sub_n = subwords_of(list(index), buckets, shortest, longest)
    sub_start, word_of = np.r_[0, np.cumsum(sub_n)[:-1]], np.repeat(np.arange(len(sub_n), dtype=np.int32), sub_n)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    e, w, b = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for epoch in range(1, epochs + 1):
        # With two classes the softmax depends on the margin of the two outputs only.
        words = np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[ids], sub_start) / sub_n
        margin = np.bincount(bag_of, weights=words[flat], minlength=len(starts)) / bag_size + (b[1] - b[0])
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))
        if epoch <= epochs // 4:
            pick = 1.0 / per[bag_doc]
        else:
            best = np.maximum.reduceat(margin, first_bag)
            top = margin == best[bag_doc]
            pick = top / np.bincount(bag_doc, weights=top)[bag_doc]
        g = (p - y[bag_doc]) * pick * weight[bag_doc]
        by_word = np.bincount(flat, weights=(g / bag_size)[bag_of], minlength=len(sub_n)) / sub_n
        h = np.bincount(ids, weights=by_word[word_of], minlength=buckets).astype(np.float32)
        eh, sign = e.T @ h, np.array([-1, 1], np.float32)
        grads = (np.outer(h, w[:, 1] - w[:, 0]) + decay * e, np.outer(eh, sign) + decay * w, sign * np.float32(g.sum()))
        for x, grad, m in zip((e, w, b), grads, moments, strict=True):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.001 * (grad * grad - m[1])
            x -= (rate * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)).astype(np.float32)
    blank = float(np.median(margin[y[bag_doc] == 0])) - float(b[1] - b[0])
    return Model(e @ w, float(b[1] - b[0]), buckets, window, shortest, longest, blank=min(0.0, blank))


class Scorer:
    """Scores texts; each distinct word's part of the margin is computed once and kept, up to max_words."""

    def __init__(self, model: Model, max_words: int = MAX_WORDS):
        self.m, self.max_words, self.store = model, max_words, {}
        self.margin = model.subwords[:, 1] - model.subwords[:, 0]

    def margins(self, texts: list[str | None]) -> list[float]:
        """The largest margin of a document's windows, with the bias; that of no words is a clean bag's."""
        m = self.m
        if len(self.store) > self.max_words:
            self.store.clear()
        cut = [tokens(t) for t in texts]
        new = list({w for c in cut for w in c} - self.store.keys())
        if new:
            ids, n = subwords_of(new, m.buckets, m.shortest, m.longest)
            sums = np.add.reduceat(self.margin[ids], np.r_[0, np.cumsum(n)[:-1]])
            self.store.update(zip(new, (sums / n).tolist(), strict=True))
        out = []
        for words in cut:
            best = m.blank
            if words:
                s = np.fromiter(map(self.store.__getitem__, words), np.float64, len(words))
                s = np.r_[s, np.full(max(0, least_bag(m.window) - len(s)), m.blank)]
                starts = bag_starts(len(s), m.window)
                best = float((np.add.reduceat(s, starts) / np.diff(np.r_[starts, len(s)])).max())
            out.append(m.scale * best + m.bias)
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        return [1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z)))) for z in self.margins(texts)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_DOCS) -> Model:
    """Fits on about per_class labelled documents of each class (or all there are), chosen by a hash of the id.

    Of an id with several labels the greater counts, of one with several texts the least; rows without an id or a label
    of 0 or 1 are left out. The driver gets about 2 * per_class whole texts, one an id, and no more.
    """
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, per_class / n))) for k, n in counts.items()], F.lit(0.0))
    chosen = own.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    # The chosen ids are a bounded sample (per_class), so they may be broadcast.
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: (r.i, r.t or ""))
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return fit([r.t or "" for r in rows], [r.y for r in rows], prior=min(0.5, max(0.01, n1 / (n0 + n1))) if n0 and n1 else None)


_LOADED: dict[int, Scorer] = {}


def _score(batches: Iterator[pa.RecordBatch], model, key: int) -> Iterator[pa.RecordBatch]:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Scorer(Model(*model.value))
    for batch in batches:
        got = pa.array(_LOADED[key].score(batch.column(0).to_pylist()), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], [*batch.schema.names[1:], "score"])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep..., score): 0 to 1, higher is likelier toxic. Null and empty texts have the score of no words; other columns are not read. keep may not have a column score (ValueError)."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    free_names(keep, ["score"])
    kept = docs.select(F.col(text_col).alias("__text"), *[named(c) for c in keep])
    shared = spark.sparkContext.broadcast((model.subwords, model.bias, model.buckets, model.window, model.shortest, model.longest, model.scale, model.blank))  # buckets x 2 numbers
    key = shared._jbroadcast.id()
    return mapped(kept, lambda b: _score(b, shared, key), "score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
