"""Language-model scores by cross-entropy difference.

A target model counts the n-grams of documents known to be good, a background model those of all documents. Both share
one vocabulary, the orders, the smoothing and, after scaling, the size. A document's score is the mean over its words
of the background loss minus the target loss. Documents are dealt into two folds by their texts, and each fold is
scored by counts of the other one, so that no document and no copy of it speaks for itself.

All words and all pairs of words are counted, and the counts grow with the corpus. The loss of a word after its history is
a part of the word, a part of the history and, where the other fold has the pair, a part of the pair. A first pass
counts words; the frequent ones, few whatever the corpus, go to the tasks that read the texts. A second pass deals
pairs and rare words, with the documents they stand in, to partitions: sorted keys, packed as differences. There each
is counted whole and gives its part straight back to its documents, so no table of pairs is written. Pairs so frequent
that their documents would crowd a partition send counts alone, and a third pass adds their parts where it reads the
texts, with those of the frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import Words, arrow_batches, chunks, cut, drop_cut, maybe_broadcast, mix, table

#: Words with more than 2^-BITS of all occurrences are frequent, so at most 2^BITS are; words that a task reads before it
#: hands on what it has; weight of the unigram behind a history.
BITS, RUN, PRIOR = 20, 1 << 19, 50.0
#: Documents of a run from which on a pair sends counts alone; words of a partition; hot pairs of one pass.
CROWD, PART_WORDS, HOT_PAIRS = 16, 1 << 20, 1 << 20
#: The history where a text begins.
BEGIN = np.uint64(0)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def histories(words: Words) -> np.ndarray:
    """For each word of some texts, the one before it, or BEGIN."""
    h = np.concatenate(([BEGIN], words.hash[:-1])) if len(words.hash) else words.hash.copy()
    h[words.first[:-1][words.first[:-1] < len(h)]] = BEGIN
    return h


def pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(history) * _ODD + word)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as planes of the bytes of their differences, which compress well, and columns of small numbers."""
    out = [np.int64(len(keys)).tobytes(), np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    for c in columns:
        kind = np.min_scalar_type(int(c.max())) if len(c) else np.dtype(np.uint8)
        out += [bytes([kind.itemsize]), c.astype(kind).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [np.cumsum(np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)], 8 + 8 * n
    while at < len(data):
        kind = np.dtype(f"u{data[at]}")
        out.append(np.frombuffer(data, kind, n, at + 1))
        at += 1 + n * kind.itemsize
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((mix(keys) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def dealt(kind: str, uid: int, parts: int, owner: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, kind, uid, packed rows) of what each partition gets, by owner."""
    part = part_of(owner, parts)
    order = np.lexsort((keys, part))
    part, keys, columns = part[order], keys[order], [c[order] for c in columns]
    for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else ():
        yield int(part[rows[0]]), kind, uid, pack(keys[rows], *(c[rows] for c in columns))


_DEALT = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("uid", pa.int64()), ("data", pa.binary())])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """The words of about RUN words of text at a time, their documents' keys and kinds (2 fold + wanted)."""
    texts, keys, kinds, size = [], [], [], 0
    for batch in batches:
        for at, part in chunks(batch.column(0).to_pylist()):
            texts += part
            keys.append(batch.column(1).to_numpy(zero_copy_only=False)[at : at + len(part)])
            kinds.append(batch.column(2).to_numpy(zero_copy_only=False)[at : at + len(part)])
            size += sum(map(len, part)) // 6
            if size >= RUN:
                yield Words(texts), np.concatenate(keys), np.concatenate(kinds).astype(np.int64)
                texts, keys, kinds, size = [], [], [], 0
    if texts:
        yield Words(texts), np.concatenate(keys), np.concatenate(kinds).astype(np.int64)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, list[np.ndarray]]]]:
    """What each partition got (kind, uid, columns), one after the other; rows come sorted by partition."""
    now, held = None, []
    for batch in batches:
        for part, kind, uid, data in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and held:
                yield held
                held = []
            now = part
            held.append((kind, uid, unpack(data)))
    if held:
        yield held


def summed(inverse: np.ndarray, size: int, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts t0, a0, t1, a1 of each group from rows of kinds 2 fold + wanted."""
    c = [np.bincount(inverse[kind == k], n[kind == k], minlength=size).astype(float) for k in range(4)]
    return np.array([c[1], c[0] + c[1], c[3], c[2] + c[3]])


class Losses:
    """What turns counts into losses: for documents of a fold (0, 1) and the sides target and background, in this order,
    the counts that score them, their scale and the smoothed whole."""

    def __init__(self, models: list[tuple[int, float, float]]) -> None:
        self.count, self.scale, self.whole = (np.array(x) for x in zip(*models))

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """PRIOR times a word's own probability, 4 x words."""
        return (counts[self.count] * self.scale[:, None] + 0.5) * (PRIOR / self.whole[:, None])

    def after(self, counts: np.ndarray) -> np.ndarray:
        return np.log(counts[self.count] * self.scale[:, None] + PRIOR)

    def pair(self, counts: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """A pair's own part, 4 x pairs; a pair that one fold lacks has none."""
        both = (counts[1] > 0) & (counts[3] > 0)
        return np.where(both, -np.log1p(counts[self.count] * self.scale[:, None] / alone), 0.0)


def fold(text):
    """0 or 1, the same for equal texts; null counts as empty."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit("fold")), F.lit(2)).cast("int")


def score_documents(docs: DataFrame, target: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score for each row of docs.

    target has the doc_id of documents that the target model learns from; repeated and null ids in it don't matter.
    Losses are means over a text's words, in nats; score is background_loss - target_loss, higher for documents nearer
    to the target. Null, empty and blank texts have no words, null losses and score 0. Rows that repeat count and stay
    as often as they come; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    Without target documents both models are as flat as their smoothing allows. bits only moves work between tasks and
    joins; the losses are the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("wanted", F.lit(1))
    known = maybe_broadcast(known, target.count(), 24)
    # of equal texts the keys are equal, and so are the means; the last bit is the fold
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(fold(F.col("text")).cast("long"))
    rows_in = rows.join(known, "doc_id", "left").select("text", key.alias("key"), (2 * fold(F.col("text")) + F.coalesce("wanted", F.lit(0))).alias("kind"))
    letters = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(letters) // (6 * PART_WORDS)))
    names = ("t0", "a0", "t1", "a1", "ht0", "ha0", "ht1", "ha1")

    def deal(df: DataFrame, run) -> DataFrame:
        out = df.mapInArrow(run, "part long, kind string, uid long, data binary")
        return out.repartition(parts, "part").sortWithinPartitions("part")

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), _DEALT)], schema=_DEALT)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, _, kinds in runs(batches):
            n = np.diff(w.first)
            keys, of = np.unique(w.hash, return_inverse=True)
            kind = np.repeat(kinds, n)
            last = w.first[1:][n > 0] - 1
            counts = [np.bincount(of[kind == k], minlength=len(keys)) for k in range(4)] + [np.bincount(of[last[kind[last] == k]], minlength=len(keys)) for k in range(4)]
            if len(keys):
                yield batch_of(list(dealt("w", 0, parts, keys, keys, *counts)))

    def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            keys, of = np.unique(np.concatenate([x[0] for _, _, x in held]), return_inverse=True)
            c = [np.bincount(of, np.concatenate([x[k] for _, _, x in held]), minlength=len(keys)).astype(np.int64) for k in range(1, 9)]
            n, last = ([x[1], x[0] + x[1], x[3], x[2] + x[3]] for x in (c[:4], c[4:]))
            yield pa.record_batch([pa.array(keys.view(np.int64)), *map(pa.array, n), *(pa.array(x - y) for x, y in zip(n, last))], names=["w", *names])

    with arrow_batches(spark):
        words = cut(deal(rows_in, count_words).mapInArrow(sum_words, "w long, " + ", ".join(f"{c} long" for c in names)))
    sums = words.agg(F.count("*").alias("size"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    size, total = sums["size"] + 2, sums["a0"] + sums["a1"]
    # each fold is scored by the other one, its background scaled to the size of the target
    models = []
    for o in (1, 0):
        scale = sums[f"t{o}"] / sums[f"a{o}"] if sums[f"a{o}"] else 1.0
        models += [(2 * o, 1.0, sums[f"t{o}"] + 0.5 * size), (2 * o + 1, scale, sums[f"t{o}"] + 0.5 * size)]
    losses = Losses(models)
    top = words.where(F.col("a0") + F.col("a1") > total / (1 << bits)).select("w", *names).toArrow()  # 2^bits rows at most, whatever the corpus
    drop_cut(words)
    hashes = top["w"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], np.array([top[c].to_numpy()[order] for c in names], float).reshape(8, -1)
    begin = len(hashes)  # the history where a text begins is frequent too: each text that has words has it once
    alone = losses.alone(counts[:4])
    after = np.column_stack((losses.after(counts[4:]), losses.after(np.array([[float(sums[c] - sums["h" + c])] for c in names[:4]]))))

    def places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's place among the frequent ones (-1: rare), its history and the history's place."""
        h = histories(w)
        if begin:
            at = np.minimum(np.searchsorted(hashes, w.hash), begin - 1)
            mine = np.where(hashes[at] == w.hash, at, -1)
        else:
            mine = np.full(len(w.hash), -1)
        before = np.concatenate(([begin], mine[:-1])) if len(mine) else mine
        before[w.first[:-1][np.diff(w.first) > 0]] = begin
        return mine, h, before

    def collapse(keys: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of the same key and document as one: key, document, how many, and the sums of more."""
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))) if len(keys) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        return keys[first], doc[first], n, *(np.add.reduceat(m[order], first) if len(first) else m for m in more)

    def deal_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, (w, keys, kinds) in enumerate(runs(batches)):
            uid = TaskContext.get().partitionId() << 24 | number
            found = [(uid % parts, "d", uid, pack(np.arange(len(keys), dtype=np.uint64), keys.view(np.uint64)))]
            doc = np.repeat(np.arange(len(keys)), np.diff(w.first))
            mine, h, before = places(w)
            both = (mine >= 0) & (before >= 0)
            k, d, n = collapse(before[both].astype(np.uint64) << np.uint64(21) | mine[both].astype(np.uint64), doc[both])
            unique, of, docs_of = np.unique(k, return_inverse=True, return_counts=True)
            crowd = docs_of[of] >= CROWD
            found += dealt("f", uid, parts, k[~crowd], k[~crowd], d[~crowd] * 4 + kinds[d[~crowd]], n[~crowd])
            if crowd.any():
                u, of = np.unique(k[crowd], return_inverse=True)
                found += dealt("c", uid, parts, u, u, *(np.bincount(of[kinds[d[crowd]] == x], n[crowd][kinds[d[crowd]] == x], minlength=len(u)).astype(np.int64) for x in range(4)))
            side = (mine >= 0) & (before < 0)
            if side.any():  # a frequent word after a rare one: by the rare one
                pair = pair_hash(h[side], w.hash[side])
                k, d, n = collapse(pair, doc[side])
                unique, one = np.unique(pair, return_index=True)
                to = one[np.searchsorted(unique, k)]
                found += dealt("h", uid, parts, h[side][to], k, mine[side][to], d * 4 + kinds[d], n)
            rare = mine < 0
            if rare.any():  # a rare word: all that it takes is where it goes
                ends = np.zeros(len(mine), np.int64)
                ends[w.first[1:][np.diff(w.first) > 0] - 1] = 1
                pair = pair_hash(h[rare], w.hash[rare])
                k, d, n, last = collapse(pair, doc[rare], ends[rare])
                unique, one = np.unique(pair, return_index=True)
                owner = w.hash[rare][one[np.searchsorted(unique, k)]]
                found += dealt("r", uid, parts, owner, k, owner, d * 4 + kinds[d], n, last)
            yield batch_of(found)

    made_schema = pa.schema([("uid", pa.int64()), ("keys", pa.binary()), ("sums", pa.binary()), ("pair", pa.int64()), *((c, pa.int64()) for c in names[:4])])

    def made(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in made_schema], schema=made_schema)

    def parts_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            rows_of = {kind: [(uid, x) for k, uid, x in held if k == kind] for kind in "dfchr"}
            for uid, (_, keys) in rows_of["d"]:
                yield made(uid=[uid], keys=[keys.astype(np.uint64).tobytes()])

            def gathered(kind: str) -> list[np.ndarray]:
                columns = [np.concatenate(c) for c in zip(*(x for _, x in rows_of[kind]))]
                return [*columns, np.repeat([uid for uid, _ in rows_of[kind]], [len(x[0]) for _, x in rows_of[kind]])]

            def given(uid: np.ndarray, doc_kind: np.ndarray, *terms: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
                """Sums by document of terms (how often, values as 4 x groups, each row's group), packed by run."""
                model = 2 * (doc_kind >> 1 & 1)
                sides = [sum(n * v[model + s, at] for n, v, at in terms) for s in (0, 1)]
                some = np.flatnonzero((sides[0] != 0) | (sides[1] != 0))
                uids, at = np.unique(uid[some], return_inverse=True)
                ids, of = np.unique(at << 32 | doc_kind[some] >> 2, return_inverse=True)
                own = [np.bincount(of, x[some], len(ids)).astype(np.float32) for x in sides]
                ends = np.searchsorted(ids >> 32, np.arange(len(uids) + 1))
                doc = (ids & 0xFFFFFFFF).astype(np.uint64)
                return made(uid=uids, sums=[pack(doc[a:b], *(x[a:b].view(np.uint32) for x in own)) for a, b in zip(ends[:-1], ends[1:])])

            if rows_of["f"] or rows_of["c"]:
                k, doc_kind, n, uid = gathered("f") if rows_of["f"] else [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 3
                crowd = gathered("c") if rows_of["c"] else [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 5
                doc_kind = doc_kind.astype(np.int64)
                unique, of = np.unique(np.concatenate((k, crowd[0])), return_inverse=True)
                c = summed(of[: len(k)], len(unique), doc_kind & 3, n)
                more = [np.bincount(of[len(k) :], crowd[1 + x], minlength=len(unique)) for x in range(4)]
                c += np.array([more[1], more[0] + more[1], more[3], more[2] + more[3]])
                own = losses.pair(c, alone[:, (unique & np.uint64((1 << 21) - 1)).astype(np.int64)])
                if len(k):
                    yield given(uid, doc_kind, (n, own, of[: len(k)]))
                hot = np.unique(of[len(k) :])
                hot = hot[(c[1, hot] > 0) & (c[3, hot] > 0)]
                if len(hot):
                    yield made(pair=unique[hot].view(np.int64), **{x: c[i, hot].astype(np.int64) for i, x in enumerate(names[:4])})
            if rows_of["h"]:
                k, word, doc_kind, n, uid = gathered("h")
                doc_kind = doc_kind.astype(np.int64)
                unique, one, of = np.unique(k, return_index=True, return_inverse=True)
                yield given(uid, doc_kind, (n, losses.pair(summed(of, len(unique), doc_kind & 3, n), alone[:, word[one].astype(np.int64)]), of))
            if rows_of["r"]:
                k, owner, doc_kind, n, last, uid = gathered("r")
                doc_kind, n, last = doc_kind.astype(np.int64), n.astype(np.int64), last.astype(np.int64)
                own_words, of_word = np.unique(owner, return_inverse=True)
                c = summed(of_word, len(own_words), doc_kind & 3, n)
                own_alone = losses.alone(c)
                unique, one, of = np.unique(k, return_index=True, return_inverse=True)
                own = losses.pair(summed(of, len(unique), doc_kind & 3, n), own_alone[:, of_word[one]])
                own_after = losses.after(summed(of_word, len(own_words), doc_kind & 3, n - last))
                yield given(uid, doc_kind, (n, own, of), (n, -np.log(own_alone), of_word), (n - last, own_after, of_word))

    schema = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in made_schema)
    with arrow_batches(spark):
        given_back = cut(deal(rows_in, deal_pairs).mapInArrow(parts_of_documents, schema))
    hot = given_back.where("pair is not null")
    slices = max(1, -(-hot.count() // HOT_PAIRS))

    def score(pairs: np.ndarray, own: np.ndarray, words_too: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, keys, _ in runs(batches):
                n = np.diff(w.first)
                doc = np.repeat(np.arange(len(keys)), n)
                model = 2 * (keys[doc] & 1)
                mine, _, before = places(w)
                sides = np.zeros((2, len(doc)))
                at_word, at_before = np.flatnonzero(mine >= 0), np.flatnonzero(before >= 0)
                both = np.flatnonzero((mine >= 0) & (before >= 0)) if len(pairs) else []
                if len(both):
                    k = before[both].astype(np.uint64) << np.uint64(21) | mine[both].astype(np.uint64)
                    at = np.minimum(np.searchsorted(pairs, k), len(pairs) - 1)
                    both, at = both[pairs[at] == k], at[pairs[at] == k]
                for s in (0, 1):
                    if words_too:
                        sides[s, at_word] -= log_alone[model[at_word] + s, mine[at_word]]
                        sides[s, at_before] += after[model[at_before] + s, before[at_before]]
                    if len(both):
                        sides[s, both] += own[model[both] + s, at]
                yield pa.record_batch([pa.array(keys), pa.array(n if words_too else np.zeros(len(n), np.int64)), pa.array(np.full(len(n), int(words_too))), *(pa.array(np.bincount(doc, x, len(keys)).astype(float)) for x in sides)], names=["key", "n_words", "copies", "target", "background"])

        return run

    log_alone, scored = np.log(alone), None
    for k in range(slices):
        some = hot.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).select("pair", *names[:4]).toArrow()  # about HOT_PAIRS rows
        pairs = some["pair"].to_numpy().view(np.uint64)
        order = np.argsort(pairs)
        pairs = pairs[order]
        own = losses.pair(np.array([some[c].to_numpy()[order] for c in names[:4]], float).reshape(4, -1), alone[:, (pairs & np.uint64((1 << 21) - 1)).astype(np.int64)])
        one = rows_in.mapInArrow(score(pairs, own, not k), "key long, n_words long, copies long, target double, background double")
        scored = one if scored is None else scored.unionByName(one)

    def sum_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys and sums of the documents of each run; its rows come one after the other."""
        now, keys, sums = None, None, np.zeros((2, 0))

        def whole() -> pa.RecordBatch:
            none = np.zeros(len(keys), np.int64)
            own = np.pad(sums, ((0, 0), (0, len(keys) - sums.shape[1])))
            return pa.record_batch([pa.array(keys), pa.array(none), pa.array(none), *map(pa.array, own)], names=["key", "n_words", "copies", "target", "background"])

        for batch in batches:
            for uid, own_keys, own in zip(*(c.to_pylist() for c in batch.columns)):
                if uid != now:
                    if now is not None:
                        yield whole()
                    now, keys, sums = uid, None, np.zeros((2, 0))
                if own_keys is not None:
                    keys = np.frombuffer(own_keys, np.int64)
                if own:
                    doc, *parts_ = unpack(own)
                    sums = np.pad(sums, ((0, 0), (0, max(0, int(doc[-1]) + 1 - sums.shape[1]))))
                    sums[:, doc.astype(np.int64)] += np.stack([x.astype(np.uint32).view(np.float32) for x in parts_])
        if now is not None:
            yield whole()

    back = given_back.where("pair is null").select("uid", "keys", "sums").repartition("uid").sortWithinPartitions("uid")
    back = back.mapInArrow(sum_back, "key long, n_words long, copies long, target double, background double")
    with arrow_batches(spark):
        by_text = cut(scored.unionByName(back).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_words", "copies", "target", "background"))))
    drop_cut(given_back)
    by_text = by_text.select("key", (F.col("n_words") / F.col("copies")).cast("long").alias("n_words"), *(F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).alias(f"{c}_loss") for c in ("target", "background")))
    out = rows.select("doc_id", key.alias("key")).join(by_text, "key", "left").drop("key")
    return out.withColumn("score", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much likelier every document is under a model of documents labelled good than under one of all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good)
