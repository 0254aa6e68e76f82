"""Language identification by mixtures: each document's language shares by expectation-maximisation.

A word's likelihood in a language comes from character trigrams (interpolated with bigrams and single characters). A
document is a mixture of languages; EM over its words gives the shares, and languages are dropped, smallest share first,
while the penalised likelihood (BIC) does not fall. The prediction is the largest share that is left.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.base import mapped, free_names, named, small_batches, table

WORD = re.compile(r"[^\W\d_]+")
#: Expected labelled documents of each language that the n-gram counts are learned from.
TRAIN_DOCS = 1500
MAX_WORDS, SMOOTH = 400_000, (0.7, 0.2, 0.099, 0.001)


@dataclass
class NgramModel:
    """Log likelihoods of trigrams, one column a language; words start and end with a space."""

    langs: list[str]
    index: dict[str, int]
    logs: np.ndarray  # the last row stands for unseen trigrams

    @classmethod
    def fit(cls, words: dict[str, Counter]) -> NgramModel:
        langs = sorted(words)
        grams = [[Counter() for _ in range(4)] for _ in langs]  # trigrams, their first two characters, bigrams' ends given one, single characters
        for own, lang in zip(grams, langs, strict=True):
            for word, n in words[lang].items():
                padded = f"  {word} "
                for i in range(len(padded) - 2):
                    g = padded[i : i + 3]
                    own[0][g] += n
                    own[1][g[:2]] += n
                    own[2][g[1:]] += n
                    own[3][g[2]] += n
        index = {g: i for i, g in enumerate(sorted({g for own in grams for g in own[0]}))}
        logs = np.zeros((len(index) + 1, len(langs)))
        for k, own in enumerate(grams):
            total, firsts = max(1, sum(own[3].values())), defaultdict(int)
            for g, n in own[2].items():
                firsts[g[0]] += n
            a, b, c, d = SMOOTH
            for g, i in index.items():
                three = own[0][g] / own[1][g[:2]] if own[1][g[:2]] else 0.0
                two = own[2][g[1:]] / firsts[g[1]] if firsts[g[1]] else 0.0
                logs[i, k] = a * three + b * two + c * own[3][g[2]] / total + d * 0.01
            logs[-1, k] = d * 0.01
        return cls(langs, index, np.log(logs))

    def words(self, words: list[str]) -> np.ndarray:
        """Likelihood of each word in each language, as a share of its best one."""
        ids, starts, unseen = [], [], len(self.index)
        for w in words:
            starts.append(len(ids))
            padded = f"  {w} "
            ids += [self.index.get(padded[i : i + 3], unseen) for i in range(len(padded) - 2)]
        if not words:
            return np.zeros((0, len(self.langs)))
        logs = np.add.reduceat(self.logs[ids], starts, axis=0)
        return np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -30.0))


def shares(p: np.ndarray, start: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Mixture shares that EM finds, and the log likelihood. p: a row a word; columns of share 0 stay out."""
    pi, n = start, len(p)
    for _ in range(steps):
        new = pi * (p.T @ (1.0 / (p @ pi))) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(np.log(p @ pi).sum())


def mixture(p: np.ndarray) -> np.ndarray:
    """Shares of the languages that the penalised likelihood selects."""
    k, n = p.shape[1], len(p)
    pi, fit = shares(p, np.full(k, 1.0 / k))
    price = 0.5 * np.log(n + 1.0) + 1.0
    while (pi > 0).sum() > 1:
        least = np.where(pi > 0, pi, np.inf).argmin()
        start = pi.copy()
        start[least] = 0.0
        if start.sum() <= 0:
            break
        fewer, fit_fewer = shares(p, start / start.sum())
        if not fit_fewer + price >= fit:
            break
        pi, fit = fewer, fit_fewer
    return pi


class Identifier:
    def __init__(self, model: NgramModel, max_words: int = MAX_WORDS):
        self.model, self.max_words, self.store = model, max_words, {}
        self.rows = np.zeros((0, len(model.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.store) > self.max_words:
            self.store, self.rows = {}, np.zeros((0, len(self.model.langs)))
        cut = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for c in cut for w in c} - self.store.keys())
        if new and self.model.langs:
            base = len(self.store)
            self.store.update(zip(new, range(base, base + len(new)), strict=True))
            if base + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), base + len(new)), self.rows.shape[1]))
                grown[:base] = self.rows[:base]
                self.rows = grown
            self.rows[base : base + len(new)] = self.model.words(new)
        out = []
        for text, words in zip(texts, cut, strict=True):
            if not self.model.langs or not any(any(c.isalpha() for c in w) for w in words):
                out.append(("und", 0.0))
                continue
            pi = mixture(self.rows[np.fromiter(map(self.store.__getitem__, words), np.int64, len(words))])
            best = int(pi.argmax())
            out.append((self.model.langs[best], min(1.0, float(pi[best]))))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> NgramModel:
    """n-gram counts of about per_lang documents of each language, chosen by a hash of the id, so rows that repeat an id are taken together; rows without text or language are left out."""
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    counts = {r.l: r.n for r in own.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return NgramModel([], {}, np.zeros((1, 0)))
    share = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, per_lang / n))) for k, n in counts.items()])
    sample = own.where(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    words = sample.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("l", "w").agg(F.count("*").alias("n"))
    found: dict[str, Counter] = defaultdict(Counter)
    for r in words.toLocalIterator(prefetchPartitions=True):
        found[r.l][r.w] += r.n
    return NgramModel.fit(found)


_LOADED: dict[int, Identifier] = {}


def _predict(batches: Iterator[pa.RecordBatch], model, key: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Identifier(NgramModel(*model.value))
    for batch in batches:
        got = _LOADED[key].predict(batch.column(0).to_pylist())
        columns = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *names])


def identify(docs: DataFrame, model: NgramModel, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(keep..., lang_pred, score): a language of the model, or `und` with score 0 if the text is null or has no letter.

    score is the largest language's share of the document. Whole texts are read; other columns never are. prefix stands
    before the two new names, which keep may not have (ValueError).
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    names = [prefix + "lang_pred", prefix + "score"]
    free_names(keep, names)
    kept = docs.select(F.col(text_col).alias("__text"), *[named(c) for c in keep])
    shared = spark.sparkContext.broadcast((model.langs, model.index, model.logs))  # as large as the alphabet's trigrams that the bounded sample has
    key = shared._jbroadcast.id()
    return mapped(kept, lambda b: _predict(b, shared, key, names), f"`{names[0]}` string, `{names[1]}` double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
