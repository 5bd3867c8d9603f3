"""Token counts by rank-synchronous merging.

Pre-tokens of a batch are held as one ragged array of symbols. In each step every sequence finds its lowest-ranked
adjacent pair and all sequences merge theirs at once; a sequence is done when no adjacent pair has a rank. What counts
is the number of symbols left. Vocabularies are read from a file whose path is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import chunks, table

#: Unicode white space, as the vocabulary's library has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The same for texts of characters on which the two engines' classes agree; it takes half the time.
_SPLIT_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_LATIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02c1]*")
#: Distinct pre-tokens whose counts a Python worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 250_000
#: Symbols that are merged together.
BLOCK = 1 << 16


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level pair-merging vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a plain byte-level vocabulary")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take in their surroundings aren't supported")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        self.byte_id = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of ranks where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge(self, tokens: list[str]) -> np.ndarray:
        """The number of symbols that each pre-token ends with."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        out = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(out, kind="stable")  # sequences of like length end after like numbers of steps
        block = np.cumsum(out[order]) // BLOCK
        for some in np.split(order, np.flatnonzero(np.diff(block)) + 1):
            out[some] = self._merge_block([raw[i] for i in some])
        return out

    def _merge_block(self, raw: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), out)
        none = len(self.keys)
        # rank: of the pair that each symbol begins; none for the last of a sequence
        rank = np.full(len(sym), none)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.ranks(sym[:-1], sym[1:]), none)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            live = least < none
            if not live.any():
                break
            hit = rank == np.repeat(np.where(live, least, -1), size)
            left = np.flatnonzero(hit)
            # of pairs that overlap (a a a) every second one merges, from the left
            run = np.flatnonzero(np.diff(left, prepend=-2) != 1)
            odd = (np.arange(len(left)) - np.repeat(run, np.diff(np.append(run, len(left))))) % 2
            left = left[odd == 0]
            sym[left] = self.made[rank[left]]
            out -= np.bincount(seq[left], minlength=len(out))
            keep = np.repeat(live, size)  # sequences without a ranked pair are done
            keep[left + 1] = False
            at = np.cumsum(keep)[left] - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            # the pairs on either side of a merged symbol are new
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched] = none
            touched = touched[touched < len(sym) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        found, special = [], []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            special.append(len(parts) - 1)
            words: list[str] = []
            for p in parts:
                words += (_SPLIT_LATIN if _LATIN.fullmatch(p) else _SPLIT).findall(p)
            found.append(words)
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*found)
        if new:
            new = list(new)
            self.known.update(zip(new, self.merge(new).tolist()))
        return [n + sum(map(self.known.__getitem__, w)) for n, w in zip(special, found)]


_LOADED: dict[str, BytePairs] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs.

    vocabulary: path of a byte-level vocabulary file, at the same place on every executor. Special strings inside texts
    count as one token each. Null texts count as empty: no bytes, no tokens. Rows that repeat stay as often as they
    come, a null doc_id stays null, other columns are ignored and an empty table gives an empty result.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = BytePairs(vocabulary)
        model = _LOADED[vocabulary]
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                n = model.counts([b.decode("utf-8", "surrogatepass") for b in part])
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array(n, pa.int64())], schema=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary of 50,257 entries."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
