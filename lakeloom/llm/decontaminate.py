"""Benchmark decontamination by embedding edit distance into Hamming distance.

Windows of a document that are as long as a benchmark item, and the items themselves, go through random walks (CGK):
at each step the symbol under the pointer is put out and a random function of step and symbol says whether the pointer
moves on. Sequences few edits apart give outputs that agree in many places, so bit sampling, a few output places hashed
together and the draw repeated, makes similar windows and items collide. Exact edit distance confirms.

Symbols are words. Of k + 1 pieces of an item one is whole in every stretch within k edits of it. So only windows that
begin at most k words from where such a piece would place them are walked, which loses nothing: to walk every window of
every item length would take over a hundred times the time. Items too short for an edit are found as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import Words, chunks, cut, mix, table

#: Edits allowed, as a share of an item's words, and the fewest words of an item that is looked for: all are.
RATE, LEAST_WORDS = 0.2, 1
#: Walks, samples of each walk's output and places in a sample: pairs at the allowed distance collide with probability
#: over 0.99 (tests measure it).
WALKS, SAMPLES, PLACES = 12, 16, 2
#: What the tasks hold of the items that one pass over the documents looks for, in bytes, and what an item takes there
#: besides its text: its bucket keys, their owners and the seeds.
SLICE_BYTES, ITEM_BYTES = 64 << 20, 4096
#: Hits of seeds that are expanded at once.
AT_ONCE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = np.frombuffer(bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256)), np.uint8)


def symbols(texts: list[bytes]) -> Words:
    """Words of ASCII letters and digits and of all other bytes, A-Z lower-cased; signs part words as spaces do."""
    return Words([t.translate(_SIGNS.tobytes()) for t in texts])


def walk(windows: np.ndarray, steps: int) -> np.ndarray:
    """The outputs (walk, row, step) of WALKS random walks over each row of symbols; 0 past a row's end."""
    rows, n = windows.shape
    padded = np.concatenate((windows, np.zeros((rows, 1), np.uint64)), axis=1).ravel()
    begin = np.tile(np.arange(rows) * (n + 1), WALKS)
    seed = np.repeat(mix(np.arange(1, WALKS + 1, dtype=np.uint64) * _ODD), rows)
    at = np.zeros(rows * WALKS, np.int64)
    out = np.empty((steps, rows * WALKS), np.uint64)
    for step in range(steps):
        out[step] = now = padded[begin + at]
        move = mix((now ^ seed) + np.uint64(step * int(_ODD) % (1 << 64))) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), n)
    return out.reshape(steps, WALKS, rows).transpose(1, 2, 0)


@cache
def sampled_places(n: int) -> np.ndarray:
    """(walk, sample, place): from the first 2 n outputs, where most walks are still inside a window of n symbols."""
    rng = np.random.default_rng(n)
    return np.sort(np.argsort(rng.random((WALKS, SAMPLES, 2 * n)), axis=2)[:, :, :PLACES], axis=2)


def keys(windows: np.ndarray) -> np.ndarray:
    """WALKS * SAMPLES bucket keys of each window, each telling its draw apart from the others."""
    rows, n = windows.shape
    walked = walk(windows, 2 * n)
    out = np.empty((rows, WALKS, SAMPLES), np.uint64)
    for w in range(WALKS):
        key = np.broadcast_to(np.arange(w * SAMPLES, (w + 1) * SAMPLES, dtype=np.uint64), (rows, SAMPLES))
        for place in sampled_places(n)[w].T:
            key = mix(key * _ODD + walked[w][:, place])
        out[:, w] = key
    return out.reshape(rows, -1)


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between item and any stretch of text, and where the first such stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, symbol in enumerate(item, 1):
        change = np.concatenate(([i], np.minimum(row[:-1] + (text != symbol), row[1:] + 1)))
        row = np.minimum.accumulate(change - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many symbols, by the place where it begins."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - size + 1]
    for k in range(1, size):
        out = mix(out * _ODD + hashes[k : len(hashes) - size + 1 + k])
    return out


class Seeds:
    """The pieces of items that begin with the same number of words: sorted gram hashes, item groups and places."""

    def __init__(self, size: int, found: list[tuple[int, int, int]]) -> None:
        self.size = size
        rows = sorted(set(found))
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.group, self.place = np.array([r[1:] for r in rows], np.int64).T
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hash >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where each seed begins in the symbols, its group and its place in the item, in bounded runs."""
        g = grams(hashes, self.size)
        at = np.flatnonzero(self.maybe[g >> np.uint64(44)])
        low, high = np.searchsorted(self.hash, g[at], "left"), np.searchsorted(self.hash, g[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        run = np.cumsum(n) // AT_ONCE
        for k in np.unique(run):
            mine, a, m = at[run == k], low[run == k], n[run == k]
            seed = np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(mine, m), self.group[seed], self.place[seed]


class Items:
    """Distinct benchmark items by length, their words, their seeds and their bucket keys."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float, least_words: int) -> None:
        words = symbols(texts)
        by_length: dict[int, dict[bytes, list[int]]] = {}
        for i, a, b in zip(ids, words.first[:-1], words.first[1:]):
            if b - a >= least_words and b > a:
                by_length.setdefault(int(b - a), {}).setdefault(words.hash[a:b].tobytes(), []).append(i)
        self.groups, seeds = [], {}
        for n, items in sorted(by_length.items()):
            rows, k = np.frombuffer(b"".join(items), np.uint64).reshape(-1, n), int(rate * n)
            key = keys(rows) if k else whole_keys(rows)
            order = np.argsort(key.ravel(), kind="stable")
            size = n // (k + 1)
            for row in rows:
                for place in (n * np.arange(k + 1)) // (k + 1):
                    seeds.setdefault(size, []).append((int(grams(row[place : place + size], size)[0]), len(self.groups), int(place)))
            self.groups.append((n, k, list(items.values()), rows, key.ravel()[order], order // key.shape[1]))
        self.seeds = [Seeds(size, found) for size, found in sorted(seeds.items())]

    def starts(self, words: Words, text_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each group with seeds in the texts, the words at which windows begin."""
        opened: dict[int, np.ndarray] = {}
        for s in self.seeds:
            for at, group, place in s.hits(words.hash):
                inside = at + s.size <= words.first[1:][text_of[at]]
                at, group, place = at[inside], group[inside], place[inside]
                for g in np.unique(group):
                    k, mine = self.groups[g][1], group == g
                    begin, t = (at - place)[mine], text_of[at[mine]]
                    bounds = words.first[t], words.first[t + 1] - 1
                    change = opened.setdefault(g, np.zeros(len(words.hash) + 1, np.int64))
                    change += np.bincount(np.clip(begin - k, *bounds), minlength=len(change))
                    change -= np.bincount(np.clip(begin + k, *bounds) + 1, minlength=len(change))
        for g in sorted(opened):
            yield g, np.flatnonzero(np.cumsum(opened[g][:-1]) > 0)

    def find(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, edits, word at which the nearest stretch ends) of each item found in each text."""
        if not self.seeds or not len(words.hash):
            return
        size = np.diff(words.first)
        text_of = np.repeat(np.arange(len(size)), size)
        for g, starts in self.starts(words, text_of):
            n, k, ids, rows, key, owner = self.groups[g]
            found = [np.empty((0, 2), np.int64)]  # item, start
            for some in np.array_split(starts, max(1, len(starts) * n // 100_000)):
                place = some[:, None] + np.arange(n)
                inside = place < words.first[1:][text_of[some]][:, None]
                windows = np.where(inside, words.hash[np.minimum(place, len(words.hash) - 1)], np.uint64(0))
                mine = keys(windows) if k else whole_keys(windows)
                low, high = np.searchsorted(key, mine.ravel(), "left"), np.searchsorted(key, mine.ravel(), "right")
                hit = np.flatnonzero(high > low)
                for part in np.array_split(hit, max(1, int((high - low).sum()) // AT_ONCE)):
                    m = (high - low)[part]
                    item = owner[np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                    found.append(np.unique(np.column_stack((item, some[np.repeat(part // mine.shape[1], m)])), axis=0))
            pairs = np.unique(np.concatenate(found), axis=0)
            edges = np.flatnonzero((pairs[1:, 0] != pairs[:-1, 0]) | (text_of[pairs[1:, 1]] != text_of[pairs[:-1, 1]])) + 1
            for own in np.split(pairs, edges) if len(pairs) else ():
                o, at, best, t = int(own[0, 0]), own[:, 1], None, int(text_of[own[0, 1]])
                for run in np.split(at, np.flatnonzero(np.diff(at) > n) + 1):  # stretches that overlap, taken as one
                    a, b = max(int(words.first[t]), int(run[0]) - k), min(int(words.first[t + 1]), int(run[-1]) + n + k)
                    edits, stop = edits_within(rows[o], words.hash[a:b])
                    if edits <= k and (best is None or edits < best[0]):
                        best = edits, a + stop - int(words.first[t])
                        if not edits:
                            break
                if best:
                    yield from ((t, i, *best) for i in ids[o])


def whole_keys(rows: np.ndarray) -> np.ndarray:
    """One hash of each whole row: the key of items that allow no edit."""
    out = rows[:, 0]
    for column in rows.T[1:]:
        out = mix(out * _ODD + column)
    return out[:, None]


def slices(items: DataFrame) -> list[str]:
    """Conditions that cut the benchmark into parts whose models are of bounded size."""
    size = items.agg(F.coalesce(F.sum(8 * F.octet_length("text") + ITEM_BYTES), F.lit(0))).first()[0]
    n = -(-int(size) // SLICE_BYTES) or 1
    return [f"pmod(xxhash64(text), {n}) = {k}" for k in range(n)]


def _models(benchmark: DataFrame, rate: float, least_words: int) -> Iterator[Items]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    for condition in slices(items):
        part = items.where(condition).orderBy("item_id", "text").collect()  # a slice of bounded size
        yield Items([r.item_id for r in part], [r.text.encode("utf-8", "surrogatepass") for r in part], rate, least_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word: each benchmark item within int(rate * its words) word edits of some
    stretch of a document, with the fewest edits found and where that stretch ends.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. Items of under 1 / rate words must stand
    as they are. Null items, items without words and those under least_words are left out. Null, empty and blank documents
    hold nothing. Rows of docs that repeat are reported each, rows with a null doc_id too; items that repeat, once for
    each item_id; rows with a null item_id are left out. Texts of any length are searched whole. Other columns are
    ignored, whatever their names. Empty tables give an empty result. A large benchmark is looked for slice by slice,
    each of bounded size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(model: Items) -> DataFrame:
        n_of = {i: g[0] for g in model.groups for ids in g[2] for i in ids}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for at, some in chunks(batch.column(1).to_pylist()):
                    hits = [(ids[at + t], i, e, n_of[i], stop) for t, i, e, stop in model.find(symbols(some))]
                    if hits:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*hits)], names=["doc_id", "item_id", "edits", "item_words", "end_word"])

        return rows.mapInArrow(run, "doc_id long, item_id long, edits long, item_words long, end_word long")

    found = None
    for model in _models(benchmark, rate, least_words):
        part = search(model)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text find_leaks finds no item, in one pass for each slice of the benchmark and without
    a shuffle. Each row is judged by its own text, whatever its other columns hold; rows without words stay."""
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, model: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, some in chunks(batch.column(at).to_pylist()):
                    for t, *_ in model.find(symbols(some)):
                        clean[first + t] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    whole = docs
    for model in _models(benchmark, rate, least_words):
        # one slice's worker at a time: what a slice leaves is written before the next one
        docs = without(docs if docs is whole else cut(docs), model)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
