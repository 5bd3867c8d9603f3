"""A quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams of words and of word shapes. Each is scaled by its log-count ratio between the
classes, documents are brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A
logistic curve, fitted on documents that the model hasn't seen, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm._common import Words, arrow_batches, chunks, mix, table
from lakeloom.llm._labels import held_out, labelled_sample, logistic, sigmoid

#: Bits of the feature space, longest n-gram of shapes and longest n-gram of words.
BITS, LONGEST, WORDS = 20, 3, 2
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1500
PARTS, PART, THRESHOLD = 4, 2, 0.7


def _classes() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 65, 97, 48, 97
    return kind


_KIND = _classes()
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[bytes], seen: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted indexes of each text's n-grams of words and of word shapes. seen: all false, of 2^BITS, and such again
    afterwards.

    A word's shape is its run of letter cases, digits and signs without repetitions (`Ab12,` is `Aa0,`), marked if the
    word is the one before it again.
    """
    words = Words(texts, lower=False)
    if len(words.start):
        kind = _KIND[words.raw]
        change = np.concatenate(([True], kind[1:] != kind[:-1]))
        change[words.start] = True
        length = words.end - words.start
        inside = np.zeros(len(kind) + 1, np.int64)
        np.add.at(inside, words.start, 1), np.subtract.at(inside, words.end, 1)
        at = np.flatnonzero(change & (np.cumsum(inside[:-1]) > 0))
        first = np.searchsorted(at, words.start)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        shape = mix(np.add.reduceat(mix(kind[at].astype(np.uint64) + (np.minimum(place, 31).astype(np.uint64) << np.uint64(8))), first))
        again = np.concatenate(([False], words.hash[1:] == words.hash[:-1]))
        again[words.first[:-1][words.first[:-1] < len(again)]] = False
        shape[again] ^= _AGAIN
    else:
        shape = words.hash
    for a, b in zip(words.first[:-1], words.first[1:]):
        for of, longest, kind in ((shape, LONGEST, 0), (words.hash, WORDS, 1)):
            gram = np.full(b - a, kind, np.uint64)
            for n in range(1, longest + 1):
                if b - a < n:
                    break
                gram = mix(gram[: b - a - n + 1] * _AGAIN + of[a + n - 1 : b])
                seen[gram >> np.uint64(64 - BITS)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    ratio: np.ndarray
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        x = self.ratio[found]
        return float(sigmoid(self.slope * self.margin(found, x) + self.shift))

    def margin(self, found: np.ndarray, x: np.ndarray) -> float:
        return float(self.weight[found] @ x) / (float(np.sqrt(x @ x)) or 1.0) + self.bias


def fit(found: list[np.ndarray], y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 1) -> Model:
    """Naive Bayes ratios and hinge-loss weights; every fifth document only places the logistic curve."""
    none = Model(np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0, 0.0)
    if not (0 < y.sum() < len(y)):
        none.shift = (4.0 if y.sum() else -4.0) if len(y) else 0.0
        return none
    spare = np.arange(len(y)) % 5 == 4
    if len(set(y[spare])) < 2 or len(set(y[~spare])) < 2:
        spare = np.zeros(len(y), bool)
    counts = np.ones((2, 1 << BITS))
    for f, label, off in zip(found, y, spare):
        if not off:
            counts[label][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = [(f, ratio[f] / (np.linalg.norm(ratio[f]) or 1.0), 1.0 if label else -1.0) for f, label, off in zip(found, y, spare) if not off]
    weight, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x, sign = rows[i]
            norm = 2.0 if len(f) else 1.0  # the constant counts as a feature of value one
            new = min(cost, max(0.0, alpha[i] + (1 - sign * (weight[f] @ x + bias)) / norm))
            step = (new - alpha[i]) * sign
            if step:
                weight[f] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    model = Model(weight, bias, ratio, 1.0, 0.0)
    test = spare if spare.any() else np.ones(len(y), bool)
    margins = np.array([model.margin(f, ratio[f]) for f, use in zip(found, test) if use])
    model.slope, model.shift = map(float, logistic(margins[:, None], y[test]))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = PARTS, part: int = PART, per_class: int = PER_CLASS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for at, some in chunks(batch.column(1).to_pylist()):
                found = [f.astype(np.int32) for f in features(some, seen)]
                yield pa.record_batch([batch.column(0).slice(at, len(some)), batch.column(2).slice(at, len(some)), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "found"])

    with arrow_batches(docs.sparkSession):
        sample = labelled_sample(docs, labels, label, parts, part, per_class).mapInArrow(run, "doc_id long, label int, found array<int>").toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    found, y = sample["found"].combine_chunks(), sample["label"].to_numpy()
    return fit([found[int(i)].values.to_numpy().astype(np.int64) for i in order], y[order].astype(np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = PARTS, part: int = PART, threshold: float = THRESHOLD, per_class: int = PER_CLASS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) for each row of docs.

    Labels are learnt only from documents whose crc32(doc_id as text) mod parts isn't part, from at most per_class
    of each label, whole texts, chosen by hash. Null texts count as empty; an empty text gets the score of no features.
    Without labels of both kinds all scores are the same. Texts of any length are read whole. Rows that repeat stay; other columns are ignored, but for
    those of keep, given back last as `_` and their name; a null doc_id stays null and isn't held out; an empty table
    gives an empty result.
    """
    model = train(docs, labels, label, parts, part, per_class)
    model.weight, model.ratio = model.weight.astype(np.float32), model.ratio.astype(np.float32)  # 2^BITS values each, whatever the input

    kept = ["_" + c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for at, part_ in chunks(batch.column(1).to_pylist()):
                score = [model.score(f) for f in features(part_, seen)]
                yield pa.record_batch([batch.column(0).slice(at, len(part_)), pa.array(score, pa.float64()), *(c.slice(at, len(part_)) for c in batch.columns[2:])], names=["doc_id", "score", *kept])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias("_" + c) for c in keep))
    scored = rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *rows.schema.fields[2:]]))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
