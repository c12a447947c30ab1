"""Toxicity of texts by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all labelled texts, their labels unseen, are the
unlabelled ones. With the class prior p the risk of a classifier is
p * loss(positives as 1) + max(0, loss(unlabelled as 0) - p * loss(positives as 0)): the
second part is the corrected risk of the unknown negatives, and where it falls below 0 its
gradient is turned round, so the classifier can't gain by fitting the unlabelled texts.

Features are the different words of a text and the different beginnings of its words, hashed.
Those that are most clearly over-represented among the positives form the vocabulary; numpy fits one
logistic model per seed, each in a Spark task of its own, and the score is their mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import stored

#: Bounds of the texts that are learnt from, of the vocabulary, and number of models.
POSITIVES, UNLABELLED, FEATURES, MODELS = 8192, 16_384, 4096, 3
#: Lengths of the word beginnings that are features; a word is one as well.
PREFIXES = (4, 5, 6)
STEPS, RATE, DECAY = 300, 0.05, 3e-4
#: Least likelihood ratio of a feature of the vocabulary.
RATIO = 12
#: Words whose features a worker keeps.
_KEPT = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, in 32 bits with sign."""
    forms = {word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)}
    return [xxhash.xxh32_intdigest(x) - (1 << 31) for x in forms]


class Features(dict):
    """Features of the words seen lately: of those in the vocabulary, or all of them."""

    def __init__(self, vocabulary: dict[int, int] | None = None):
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= _KEPT:
            self.clear()
        found = (f for w in _LETTERS.findall(chunk) for f in word_features(w))
        found = tuple(found) if self.vocabulary is None else tuple(self.vocabulary[f] for f in found if f in self.vocabulary)
        self[chunk] = found
        return found

    def of(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set((text or "").lower().split())))


def select_features(sample: DataFrame, most: int) -> list[int]:
    """The features that positives have most clearly more often than expected, by likelihood ratio; ``most`` at most."""
    n = sample.agg(*(F.coalesce(F.sum(x.cast("int")), F.lit(0)) for x in (F.col("positive"), ~F.col("positive")))).first()
    each = sample.select("positive", F.explode("features").alias("f")).groupBy("f")
    counts = each.agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    expected = n[0] * F.greatest("u", F.lit(0.5)) / max(1, n[1])
    ratio = 2 * (F.col("p") * F.log(F.col("p") / expected) - F.col("p") + expected)
    clear = counts.filter("p > 1").filter(F.col("p") > expected).withColumn("ratio", ratio).filter(F.col("ratio") > RATIO)
    return [r.f for r in clear.orderBy(F.desc("ratio"), "f").limit(most).collect()]


def _columns(vocabulary: dict[int, int]):
    """Features as their numbers in the vocabulary."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(vocabulary), np.int32)
        number = np.array([vocabulary[f] for f in known.tolist()], np.int32)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat
            ends = np.append(0, np.cumsum(np.bincount(owner[hit], minlength=len(lists))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number[at[hit]]))], names=["positive", "columns"]
            )

    return columns


class Model:
    """Logistic model of features: ``weights`` and ``bias``."""

    def __init__(self, size: int):
        self.weights, self.bias = np.zeros(size), 0.0

    def fit(self, rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> None:
        """``rows``, ``columns``: text and feature of every occurrence; ``positive``: of every text."""
        random, n = np.random.default_rng(seed), len(positive)
        # Each model sees every text with a weight of its own.
        share = random.exponential(1, n)
        p = np.where(positive, share, 0) / share[positive].sum()
        u = np.where(positive, 0, share) / share[~positive].sum()
        size = len(self.weights)
        x = np.zeros(size + 1)
        x[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))  # where the search starts
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, STEPS + 1):
            z = x[-1] + np.bincount(rows, x[:-1][columns], n)
            chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss = np.logaddexp(0, z)  # of the label 0
            negative = u @ loss - prior * (p @ loss)
            pull = (u - prior * p) * chance
            g = prior * p * (chance - 1) + pull if negative >= 0 else -pull
            gradient = np.append(np.bincount(columns, g[rows], size), g.sum())
            gradient[:-1] += DECAY * x[:-1]
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias = x[:-1], float(x[-1])


def _texts_to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Features()
    for batch in batches:
        found = [np.fromiter(sorted(known.of(t.as_py())), np.int32) for t in batch.column(1)]
        ends = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        values = np.concatenate([np.empty(0, np.int32), *found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["positive", "features"])


def _train(prior: float, size: int):
    def train(texts: pd.DataFrame) -> pd.DataFrame:
        seed, positive = int(texts["seed"].iloc[0]), texts["positive"].to_numpy(bool)
        sets = texts["columns"].tolist()
        columns, rows = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        model = Model(size)
        model.fit(rows, columns, positive, prior, seed)
        return pd.DataFrame({"seed": [seed], "bias": [model.bias], "weights": [model.weights]})

    return train


class Classifier:
    """Score column of the fitted models; without models every score is ``prior``."""

    def __init__(self, vocabulary: dict[int, int], biases: list[float], weights: list[list[float]], prior: float):
        self.vocabulary, self.biases, self.prior = vocabulary, np.array(biases), prior
        self.weights = np.array(weights).reshape(len(biases), len(vocabulary))

    def score(self, text: Column) -> Column:
        """0 to 1, a function of the text alone; NULL counts as the empty text."""
        vocabulary, weights, biases, prior = self.vocabulary, self.weights, self.biases, self.prior

        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Features(vocabulary)
            for batch in texts:
                out = []
                for t in batch:
                    z = biases + weights[:, list(known.of(t))].sum(1)
                    out.append(float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30))))) if len(biases) else prior)
                yield pd.Series(out, dtype="float64")

        score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(text)


def held_out(id_col: str) -> Column:
    """Whether a document's labels are kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Classifier:
    """Fit on the labelled documents that aren't held out: about ``positives`` of those with
    label 1, and about ``unlabelled`` of all of them, whatever the label, by a hash of the id.

    The class prior is the share of label 1 among these documents. Rows without id or label
    teach nothing; of several labels of a document the largest counts, of several texts that of
    the smallest hash, so a repeated id teaches once. Without any positive there is no
    model, and every score is 0.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not toxic:
        return Classifier({}, [], [], 0.0)
    prior = toxic / n
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    # A text of both kinds appears twice, once as a positive and once as an unlabelled one.
    as_positive = known.filter("toxic").filter(chance < positives / toxic).select("id", F.lit(True).alias("positive"))
    as_other = known.filter(chance < unlabelled / n).select("id", F.lit(False).alias("positive"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Some 25,000 ids at most: the texts stay where they are, and one of each id is taken.
    sample = texts.join(F.broadcast(as_positive.union(as_other)), "id")
    sample = sample.groupBy("id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("positive", "text")
    sample = stored(sample.mapInArrow(_texts_to_features, "positive boolean, features array<int>"), "features")
    vocabulary = {f: i for i, f in enumerate(select_features(sample, features))}
    if not vocabulary:
        return Classifier({}, [], [], prior if sample.filter("positive").count() else 0.0)
    small = sample.mapInArrow(_columns(vocabulary), "positive boolean, columns array<int>")
    seeds = small.select(F.explode(F.array(*map(F.lit, range(MODELS)))).alias("seed"), "positive", "columns")
    fit = seeds.groupBy("seed").applyInPandas(_train(prior, len(vocabulary)), "seed int, bias double, weights array<double>")
    models = sorted(fit.collect(), key=lambda m: m.seed)
    return Classifier(vocabulary, [m.bias for m in models], [m.weights for m in models], prior)
