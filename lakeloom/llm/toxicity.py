"""Toxicity by class-conditional Kneser-Ney models over the letters of words and over neighbouring words.

Each class has its own counts of the longest n-grams; what they discount goes to one backoff model of continuation
counts that both classes share, so expressions too rare to tell the classes apart weigh nothing. Words are scored by
the difference of the two log-likelihoods, per letter; pairs of neighbours that came several times by the difference
that the pair makes, so that expressions of several harmless words are told too. A document is scored by its most
telling words and pairs and by its means, all normalised by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import Words, arrow_batches, chunks, mix, table
from lakeloom.llm._labels import held_out, labelled_sample, logistic, sigmoid

#: Letters (bytes) of an n-gram, its end included.
ORDER = 8
#: Labelled documents of each class that the models learn from, at most.
PER_CLASS = 2000
PARTS, PART, THRESHOLD = 3, 1, 0.7
#: Folds of the sample, and numbers that sum up a document.
FOLDS, EVIDENCE = 5, 5
#: Occurrences of a pair of words in the sample from which on it is a feature.
PAIRS_FROM = 3
_EDGE = np.uint8(32)


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct word, and for each word the place of its like among them."""
    codes, unique = pd.factorize(words.hash)
    first = np.full(len(unique), len(codes), np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    return first, codes


def word_grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the chosen words, each byte and the word's end with the ORDER - 1 bytes before them packed into
    an integer, and where each word's begin."""
    start, end = words.start[chosen], words.end[chosen]
    length = end - start
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    total = int(begin[-1])
    word = np.repeat(np.arange(len(chosen)), length + 1)
    place = np.arange(total) - begin[:-1][word]
    letter = np.where(place < length[word], words.raw[np.minimum(start[word] + place, len(words.raw) - 1)], _EDGE).astype(np.uint64)
    grams = letter.copy()
    for back in range(1, ORDER):
        earlier = np.full(total, np.uint64(_EDGE))
        inside = place >= back
        earlier[inside] = letter[np.flatnonzero(inside) - back]
        grams |= earlier << np.uint64(8 * back)
    return grams, begin[:-1]


def pair_hashes(words: Words) -> np.ndarray:
    """A hash of each word and the one before it; a text's first word has 0 before it."""
    before = np.concatenate(([np.uint64(0)], words.hash[:-1])) if len(words.hash) else words.hash.copy()
    before[words.first[:-1][words.first[:-1] < len(before)]] = 0
    return mix(mix(before) + words.hash)


@dataclass
class Model:
    """Log-likelihood ratios of n-grams seen in training, and of contexts followed by something unseen."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    weights: np.ndarray

    def words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each word and its letters, its end included."""
        first, codes = distinct_words(words)
        grams, begin = word_grams(words, first)
        value = _look_up(self.contexts, self.context_ratio, grams >> np.uint64(8), 0.0)
        value = _look_up(self.grams, self.gram_ratio, grams, value)
        return np.add.reduceat(value, begin)[codes], (words.end - words.start + 1).astype(np.float64)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """For each text: its most telling word's ratio per letter, that of its four best and of all words; what its
        most telling pair of words adds, and all pairs on average."""
        words, out = Words(texts), np.zeros((len(texts), EVIDENCE))
        if not len(words.start):
            return out
        ratio, letters = self.words(words)
        each, pair = ratio / letters, _look_up(self.pairs, self.pair_ratio, pair_hashes(words), 0.0)
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            if a < b:
                top = np.sort(each[a:b])[::-1][:4]
                out[i] = top[0], top.sum() / 4, ratio[a:b].sum() / letters[a:b].sum(), pair[a:b].max(), pair[a:b].mean()
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(np.column_stack((self.evidence(texts), np.ones(len(texts)))) @ self.weights)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(other, wanted.shape).astype(np.float64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.75


def _shared(grams: np.ndarray) -> np.ndarray:
    """Interpolated continuation probability of each distinct n-gram's last byte after all but its first byte."""
    lower = 1.0 / 256
    for n in range(1, ORDER):
        mask = np.uint64((1 << 8 * n) - 1)
        longer = np.unique(grams & np.uint64((1 << 8 * (n + 1)) - 1))  # each brings one preceding byte
        keys, count = np.unique(longer & mask, return_counts=True)
        context, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(inverse, count)
        kinds = np.bincount(inverse)
        d = _discount(count)
        at = np.searchsorted(keys, grams & mask)
        c = inverse[at]
        lower = (count[at] - d + d * kinds[c] * lower) / total[c]
    return lower


def fit_ratios(grams: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
    """A model without weights from distinct n-grams, sorted, and their counts in the two classes."""
    shared = _shared(grams)
    contexts, inverse = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, backoff = [], []
    for count in (ordinary, toxic):
        total, kinds = np.bincount(inverse, count), np.bincount(inverse, count > 0)
        d = _discount(count)
        share = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        seen = np.where(total[inverse] > 0, np.maximum(count - d, 0) / np.maximum(total[inverse], 1), 0.0)
        logs.append(np.log(seen + share[inverse] * shared))
        backoff.append(np.log(share))
    none = np.empty(0, np.uint64), np.empty(0, np.float32)
    return Model(grams, (logs[1] - logs[0]).astype(np.float32), contexts, (backoff[1] - backoff[0]).astype(np.float32), *none, np.zeros(EVIDENCE + 1))


def fit_pairs(pairs: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and the difference of their log-probabilities in the classes: discounted counts over the class's
    pairs, and what is discounted dealt out by the counts of both classes together."""
    both = (ordinary + toxic) / max(1, (ordinary + toxic).sum())
    logs = []
    for count in (ordinary, toxic):
        d, total = _discount(count), max(1, count.sum())
        logs.append(np.log(np.maximum(count - d, 0) / total + d * (count > 0).sum() / total * both + 1e-12))
    by = np.argsort(pairs)
    return pairs[by], (logs[1] - logs[0]).astype(np.float32)[by]


def _fold(column):
    return F.pmod(F.xxhash64(column, F.lit("fold")), F.lit(FOLDS)).cast("int")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = PARTS, part: int = PART, per_class: int = PER_CLASS) -> Model:
    """Ratios from the whole sample; each document's evidence is weighed as models of the other folds see it."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, parts, part, per_class).withColumn("fold", _fold(F.col("doc_id")))
    columns = [f"n{k}" for k in range(2 * FOLDS)]  # n of label y in fold f: 2 f + y

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = 2 * batch.column(3).to_numpy(zero_copy_only=False) + batch.column(2).to_numpy(zero_copy_only=False)
            for at, some in chunks(batch.column(1).to_pylist()):
                words = Words(some)
                owner = np.repeat(kind[at : at + len(some)], np.diff(words.first))
                keys, inverse = np.unique(pair_hashes(words), return_inverse=True)
                n = [np.bincount(inverse[owner == k], minlength=len(keys)).astype(np.int64) for k in range(2 * FOLDS)]
                yield pa.record_batch([pa.array(keys.view(np.int64)), *map(pa.array, n)], names=["gram", *columns])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = 2 * batch.column(3).to_numpy(zero_copy_only=False) + batch.column(2).to_numpy(zero_copy_only=False)
            for at, some in chunks(batch.column(1).to_pylist()):
                words = Words(some)
                if not len(words.start):
                    continue
                first, codes = distinct_words(words)
                grams, begin = word_grams(words, first)
                owner = np.repeat(kind[at : at + len(some)], np.diff(words.first))
                word = np.repeat(np.arange(len(first)), np.diff(np.append(begin, len(grams))))
                keys, inverse = np.unique(grams, return_inverse=True)
                n = [np.bincount(inverse, np.bincount(codes[owner == k], minlength=len(first))[word]).astype(np.int64) for k in range(2 * FOLDS)]
                yield pa.record_batch([pa.array(keys.view(np.int64)), *map(pa.array, n)], names=["gram", *columns])

    def gathered(f, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys, sorted, and their counts by fold and label; those with fewer in all stay in Spark."""
        summed = sample.mapInArrow(f, "gram long, " + ", ".join(f"{c} long" for c in columns)).groupBy("gram").agg(*[F.sum(c).cast("int").alias(c) for c in columns])
        got = summed.where(sum((F.col(c) for c in columns), F.lit(0)) >= least).toArrow()
        keys = got["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array([got[c].to_numpy()[order] for c in columns]).reshape(FOLDS, 2, len(keys))

    with arrow_batches(spark):
        (grams, n), (pairs, m) = gathered(count, 1), gathered(count_pairs, PAIRS_FROM)

    def without(fold: int | None) -> Model:
        kept = n.sum(axis=0) - (n[fold] if fold is not None else 0)
        used = kept.sum(axis=0) > 0
        model = fit_ratios(grams[used], kept[0][used], kept[1][used])
        kept = m.sum(axis=0) - (m[fold] if fold is not None else 0)
        used = kept.sum(axis=0) >= PAIRS_FROM
        model.pairs, model.pair_ratio = fit_pairs(pairs[used], kept[0][used], kept[1][used])
        return model

    others = [without(f) for f in range(FOLDS)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(3).to_numpy(zero_copy_only=False)
            for at, some in chunks(batch.column(1).to_pylist()):
                e = np.zeros((len(some), EVIDENCE))
                for f in range(FOLDS):
                    own = np.flatnonzero(fold[at : at + len(some)] == f)
                    if len(own):
                        e[own] = others[f].evidence([some[i] for i in own])
                yield pa.record_batch([batch.column(2).slice(at, len(some)), *map(pa.array, e.T)], names=["label", *evidence])

    evidence = [f"e{k}" for k in range(EVIDENCE)]
    with arrow_batches(spark):
        seen = sample.mapInArrow(weigh, "label int, " + ", ".join(f"{c} double" for c in evidence)).toPandas()
    seen = seen.sort_values(["label", *evidence])
    model, y = without(None), seen["label"].to_numpy()
    if 0 < y.sum() < len(y):
        model.weights = logistic(seen[evidence].to_numpy(), y)
    else:
        model.weights = np.array([4.0, 4.0, 0.0, 0.0, 0.0, -4.0])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = PARTS, part: int = PART, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) for each row of docs.

    Labels are learnt only from documents whose crc32(doc_id as text) mod parts isn't part, from at most per_class of
    each label, whole texts, chosen by hash. Null, empty and blank texts get the score of no evidence. Texts of any
    length are read whole. Rows that repeat stay; other columns are ignored; a null doc_id stays null and isn't held out; an empty table gives an empty result.
    Without labels of both kinds the evidence is weighed by fixed numbers.
    """
    model = train(docs, labels, label, parts, part, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in chunks(batch.column(1).to_pylist()):
                yield pa.record_batch([batch.column(0).slice(at, len(some)), pa.array(model.score(some))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
