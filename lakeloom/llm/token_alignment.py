"""Alignment of two tokenizers' tokens and corpus-wide counts of linked ids.

Both tokenizers cut a text's bytes; where both end a token, a group ends. Every pair of an A and a B token of one group is a
link, and a pair of ids counts once for each document that links it.

Texts are encoded in runs of bounded size. Both vocabularies treat what stands between two places "no white space, then a
space" on its own, so a Python worker encodes each such piece once and remembers it. A run sends its distinct pairs, with
the number of its documents that hold each, to stripes of A ids. There dense blocks of counts (ids of the stripe times all B
ids) add them up by np.add.at; row maxima tell the highest count of each A id. The blocks then answer the runs, whose links
wait by run, and every document adds up its own. A stripe's pairs are dealt over as many tasks as their measured size asks
for, so a frequent token isn't hot, and blocks are bounded by the vocabularies, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import arrow_batches, chunks, cut, drop_cut, table
from lakeloom.llm.token_count import _byte_alphabet

#: Bytes of a block of counts; of the pairs that one task adds up; of the texts of a run and of a part of a long text.
BLOCK_BYTES, TASK_BYTES, RUN_BYTES, PART = 96 << 20, 64 << 20, 4 << 20, 1 << 20
#: Pieces that a Python worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 300_000
#: Documents of a run, at most: they are numbered by 16 bits.
RUN_DOCS = 60_000

_SEAM = re.compile(r"(?<=\S) (?!\Z)")
_ODD = re.compile(r" (?<=\s )")  # a space after white space
#: How a byte-level vocabulary splits texts (fixed value), and pieces of characters on which all libraries agree about it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[\x20-\x7e\n\t\xa1-\u017f]*[\x21-\x7e\xa1-\u017f]")


class Vocabularies:
    """The two tokenizers, the bytes of their ids, and what is known of pieces of text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in _byte_alphabet().items()}
        self.n_a, self.n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        names = [self.a.id_to_token(i) for i in range(self.n_a)]
        self.bytes_a = [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.signs = {c: np.array([f"{i}{c}" for i in range(max(self.n_a, self.n_b))], object) for c in ",|;"}
        # whether pieces of a text can be encoded one by one: no token reaches over a seam
        split = spec.get("pre_tokenizer") or {}
        self.seams = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not any("▁" in p.lstrip("▁") for p in pieces)
        self.ranks = self._ranks(spec, byte) if self.seams else None
        self.forget()

    def _ranks(self, spec: dict, byte: dict[str, int]):
        """The same vocabulary for the faster of the two libraries, if ids are in the order of merges."""
        import tiktoken

        vocab, model = spec["model"]["vocab"], spec["model"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if model.get("ignore_merges") or sorted(set(made)) != made or {*vocab.values()} - {*made} - {i for t, i in vocab.items() if len(t) == 1} - {t["id"] for t in spec["added_tokens"]} or made[0] < 256:
            return None
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={self.bytes_a[i]: i for t, i in vocab.items() if i not in {x["id"] for x in spec["added_tokens"]}}, special_tokens={})

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # whether bytes agree, A tokens, B tokens, groups, links
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each piece's pairs
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, each without the space before it, in lists of bounded size."""
        if not self.seams:
            yield [text]
            return
        start = 0
        while len(text) - start > PART and (seam := _SEAM.search(text, start + PART)):
            yield self._split(text[start : seam.start()])
            start = seam.end()
        yield self._split(text[start:])

    @staticmethod
    def _split(text: str) -> list[str]:
        odd = text[0] == " " or text[-1].isspace() or _ODD.search(text)
        return _SEAM.split(text) if odd else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode pieces with both tokenizers, cut them into groups and keep what they hold, for all of them at once."""
        plain = [p for p in new if self.ranks and _PLAIN.fullmatch(p)]
        odd = [*set(new).difference(plain)]
        new = plain + odd
        raw = [b" " + p.encode() for p in new]
        ids_a, ids_b = [e.ids for e in self.a.encode_batch_fast([" " + p for p in odd], add_special_tokens=False)], self.b.encode(new, num_threads=1)
        # plain pieces are encoded in one go; as no token reaches over a seam, their ends tell the pieces apart
        once = np.array(self.ranks.encode_ordinary("".join(" " + p for p in plain)) if plain else [], np.int64)
        length, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (raw, ids_b))
        n_plain = np.diff(np.searchsorted(np.cumsum(self.length_a[once]), np.cumsum(length[: len(plain)])) + 1, prepend=0)
        n_a = np.concatenate((n_plain, np.fromiter(map(len, ids_a), np.int64, len(odd))))
        a, b = np.concatenate((once, np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum() - len(once)))), np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        of_a, of_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        sizes = (np.bincount(of_a, self.length_a[a], len(new)) == length) & (np.bincount(of_b, self.length_b[b], len(new)) == length)
        bytes_a, bytes_b, whole = b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist())), b"".join(raw)
        ok = sizes
        if not (sizes.all() and bytes_a == whole and bytes_b == whole):
            joined = lambda ids, names: b"".join(names[i] for i in ids)
            ok = sizes & np.array([joined(x, self.bytes_a) == r and joined(y, self.bytes_b) == r for x, y, r in zip(np.split(a, np.cumsum(n_a)[:-1]), ids_b, raw)])
            a, of_a, b, of_b = a[ok[of_a]], of_a[ok[of_a]], b[ok[of_b]], of_b[ok[of_b]]
            n_a, n_b = n_a * ok, n_b * ok
        # pieces stand one behind the other, so ends of tokens are places in all of them together
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        of_group = of_a[first_a]
        links = size_b[group_a]
        pair = np.repeat(a * self.n_b, links) + b[np.repeat(first_b[group_a] - np.cumsum(links) + links, links) + np.arange(links.sum())]
        key, times = np.unique(np.repeat(of_a, links) * (self.n_a * self.n_b) + pair, return_counts=True)
        of_pair, pair = np.divmod(key, self.n_a * self.n_b)
        n_pairs = np.bincount(of_pair, minlength=len(new))
        # A tokens of a group, then its B tokens, each with the sign that follows it
        text = np.empty(len(a) + len(b), object)
        last_a, last_b = first_a[group_a] + size_a[group_a] - 1 == np.arange(len(a)), first_b[group_b] + size_b[group_b] - 1 == np.arange(len(b))
        text[np.arange(len(a)) + first_b[group_a]] = np.where(last_a, self.signs["|"][a], self.signs[","][a])
        text[np.arange(len(b)) + (first_a + size_a)[group_b]] = np.where(last_b, self.signs[";"][b], self.signs[","][b])
        text, at = text.tolist(), 0
        for k, n in enumerate((n_a + n_b).tolist(), len(self.known)):
            self.texts.append("".join(text[at : at + n]))
            self.known[new[k - len(self.facts)]] = k
            at += n
        facts = np.column_stack((ok, n_a, n_b, np.bincount(of_group, minlength=len(new)), np.bincount(of_a, links, len(new)))).astype(np.int64)
        self.facts, self.size = np.concatenate((self.facts, facts)), np.concatenate((self.size, n_pairs))
        self.at = np.concatenate((self.at, len(self.pairs) + np.cumsum(n_pairs) - n_pairs))
        self.pairs, self.times = np.concatenate((self.pairs, pair)), np.concatenate((self.times, times))

    def _numbered(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The pieces of some parts as numbers of known ones."""
        new = set().union(*parts).difference(self.known)
        if new and len(self.known) + len(new) > REMEMBERED and self.held == 0:
            self.forget()
            new = set().union(*parts)
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, p), np.int64, len(p)) for p in parts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: A tokens, B tokens, groups, links and the digest; and sorted by pair, then text: pairs, the text that
        has each and how often."""
        facts, digests = np.zeros((len(texts), 4), np.int64), [hashlib.sha256() for _ in texts]
        tail, where, which = [""] * len(texts), [], []
        waiting, size, self.held = [], 0, 0
        for d, part in chain(((d, p) for d, t in enumerate(texts) if t for p in self.pieces(t)), [(None, [])]):
            if d is not None:
                waiting.append((d, part))
                size += sum(map(len, part))
            if waiting and (d is None or size > 4 * PART):
                for (e, p), own in zip(waiting, self._numbered([p for _, p in waiting])):
                    said = tail[e] + "".join(map(self.texts.__getitem__, own.tolist()))
                    tail[e] = said[-1:]  # the last sign of a text is left out
                    digests[e].update(said[:-1].encode())
                    where.append(np.full(len(own), e))
                    which.append(own)
                self.held += len(waiting)  # numbers of this run stand as long as it lasts
                waiting, size = [], 0
        none = np.zeros(0, np.int64)
        where, which = np.concatenate([none, *where]), np.concatenate([none, *which])
        key, n = np.unique(where * (len(self.known) + 1) + which, return_counts=True)
        where, which = np.divmod(key, len(self.known) + 1)
        good = np.array([bool(t) for t in texts])
        good[where[self.facts[which, 0] == 0]] = False
        where, which, n = where[good[where]], which[good[where]], n[good[where]]
        np.add.at(facts, where, self.facts[which, 1:] * n[:, None])
        size = self.size[which]
        place = np.repeat(self.at[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key, times = self.pairs[place] * (RUN_DOCS + 1) + np.repeat(where, size), self.times[place] * np.repeat(n, size)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pair, doc = np.divmod(key[first], RUN_DOCS + 1)
        return facts, [h.hexdigest() if ok else "" for h, ok in zip(digests, good)], pair, doc, np.add.reduceat(times[order], first) if len(first) else none


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def _loaded(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Vocabularies(path_a, path_b)
    return _LOADED[path_a, path_b]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, that number of bytes first."""
    most = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[b[0]], offset=1)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, run_bytes: int = RUN_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    path_a: a byte-level vocabulary, path_b: a piece model that puts a space before each text, at the same place on every
    executor. A encodes a space and the text, B the text; special strings are plain text. A pair of ids counts once for each
    row of docs that links it; n_best: links whose pair has the highest count of its A id (ties too); count_sum: the counts
    of all links. Null and empty texts, and those whose tokens' bytes aren't a space and the text, have no tokens: zeros and
    an empty digest. Texts of any length are read whole; rows that repeat stay, and count, as often as they come; a null id
    stays null; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = _loaded(path_a, path_b)
    n_a, n_b = sizes.n_a, sizes.n_b
    stripes = -(-n_a * n_b * 8 // block_bytes)
    block_rows = -(-n_a // stripes)
    facts_of = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    doc_fields = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in facts_of.split(", ")])
    columns = {"run": pa.int64(), "stripe": pa.int32(), "pairs": pa.binary(), "n": pa.binary(), "doc": pa.binary(), "times": pa.binary(), "docs": pa.list_(doc_fields)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run a row with its documents, and a row for each stripe with its pairs, the number of the run's documents
        that hold each, which these are and how often each links it."""
        known, run = _loaded(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, part in chunks(batch.column(1).to_pylist(), run_bytes):
                for at in range(0, len(part), RUN_DOCS):
                    some = part[at : at + RUN_DOCS]
                    facts, digests, pair, doc, times = known.encode([b.decode("utf-8", "surrogatepass") for b in some])
                    ids = batch.column(0).slice(start + at, len(some))
                    whole = pa.StructArray.from_arrays([ids, *(pa.array(facts[:, i]) for i in range(4)), pa.array(digests)], fields=list(doc_fields))
                    rows = {c: [] for c in columns if c != "docs"}
                    first = np.flatnonzero(np.diff(pair, prepend=-1))
                    in_a, in_b = np.divmod(pair[first], n_b)
                    n = np.diff(np.append(first, len(pair)))
                    order = np.argsort(in_a % stripes, kind="stable")
                    stripe = (in_a % stripes)[order]
                    edges = np.concatenate((np.flatnonzero(np.diff(stripe, prepend=-1)), [len(stripe)]))
                    for a, b in zip(edges[:-1], edges[1:]):
                        own = order[a:b]
                        links = np.repeat(first[own] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())
                        for c, x in zip(rows, (run, stripe[a], _packed(in_a[own] // stripes * n_b + in_b[own]), _packed(n[own]), _packed(doc[links]), _packed(times[links]))):
                            rows[c].append(x)
                    docs_of = pa.ListArray.from_arrays(pa.array([0, *[len(some)] * (len(rows["run"]) + 1)], pa.int32()), whole)
                    arrays = [pa.array([None if c not in ("run", "stripe") else run if c == "run" else -1, *rows[c]], columns[c]) for c in rows]
                    yield pa.RecordBatch.from_arrays([*arrays, docs_of], names=list(columns))
                    run += 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each stripe's pairs, added up in a dense block, with the row's maximum."""
        block, now = np.zeros(block_rows * n_b, np.int64), None

        def out() -> pa.RecordBatch:
            full = np.flatnonzero(block)
            most = block.reshape(block_rows, n_b).max(axis=1)
            row = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_packed(full)]), pa.array([_packed(block[full])]), pa.array([_packed(most)])], names=["stripe", "pairs", "n", "most"])
            block[full] = 0
            return row

        for batch in batches:
            for stripe, pairs, n in zip(batch.column("stripe").to_pylist(), batch.column("pairs").to_pylist(), batch.column("n").to_pylist()):
                if stripe != now:
                    if now is not None:
                        yield out()
                    now = stripe
                np.add.at(block, _unpacked(pairs).astype(np.int64), _unpacked(n).astype(np.int64))
        if now is not None:
            yield out()

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe's counts come first and fill its block; then each run gets those of its pairs, and which are the highest."""
        block, most, filled, now = np.zeros(block_rows * n_b, np.int64), None, None, None
        for batch in batches:
            runs, stripes_of, counts, best = [], [], [], []
            for run, stripe, pairs, n, top in zip(*(batch.column(c).to_pylist() for c in ("run", "stripe", "pairs", "n", "most"))):
                pairs = _unpacked(pairs).astype(np.int64)
                if top is not None:
                    if stripe != now:
                        if filled is not None:
                            block[filled] = 0
                        now, filled, most = stripe, pairs, _unpacked(top)
                        block[pairs] = _unpacked(n)
                    continue
                count = block[pairs]
                runs.append(run)
                stripes_of.append(stripe)
                counts.append(_packed(count))
                best.append(_packed((count == most[pairs // n_b]).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(stripes_of, pa.int32()), pa.array(counts, pa.binary()), pa.array(best, pa.binary())], names=["run", "stripe", "count", "best"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's documents come first, then for each stripe its links and the answer to them."""
        docs_of, sums, links = None, None, None

        def out() -> pa.RecordBatch:
            whole = docs_of.flatten()
            return pa.RecordBatch.from_arrays([*whole, pa.array(sums[0]), pa.array(sums[1])], names=[*(f.name for f in doc_fields), "n_best", "count_sum"])

        for batch in batches:
            texts = batch.column("docs")
            for i, (stripe, n, doc, times, count, best) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("stripe", "n", "doc", "times", "count", "best")))):
                if stripe < 0:
                    if docs_of is not None:
                        yield out()
                    docs_of = texts[i].values
                    sums = np.zeros((2, len(docs_of)), np.int64)
                elif count is None:
                    links = _unpacked(n), _unpacked(doc), _unpacked(times).astype(np.int64)
                else:
                    n, doc, times = links
                    np.add.at(sums[0], doc, np.repeat(_unpacked(best), n) * times)
                    np.add.at(sums[1], doc, np.repeat(_unpacked(count).astype(np.int64), n) * times)
        if docs_of is not None:
            yield out()

    with arrow_batches(spark):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        packed = cut(rows.mapInArrow(encode, f"run long, stripe int, pairs binary, n binary, doc binary, times binary, docs array<struct<{facts_of.replace(' ', ':').replace(',:', ',')}>>"))
        links = packed.where("stripe >= 0")
        weight = links.groupBy("stripe").agg(F.sum(F.length("pairs") + F.length("n")).alias("bytes"))
        salts = spark.createDataFrame([(r.stripe, 1 + r.bytes // task_bytes) for r in weight.collect()], "stripe int, salts long")  # a row for each stripe
        pairs = links.select("run", "stripe", "pairs", "n").join(F.broadcast(salts), "stripe").withColumn("salt", F.pmod(F.xxhash64("run"), F.col("salts")))
        first = pairs.repartition("stripe", "salt").sortWithinPartitions("stripe").select("stripe", "pairs", "n")
        kind = "stripe int, pairs binary, n binary, most binary"
        counts = cut(first.mapInArrow(added, kind).select("stripe", "pairs", "n").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(added, kind))
        blocks = counts.join(F.broadcast(salts), "stripe").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("run", F.lit(-1).cast("long"))
        asked = blocks.unionByName(pairs.drop("n"), allowMissingColumns=True).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "run")
        answers = asked.select("run", "stripe", "pairs", "n", "most").mapInArrow(answered, "run long, stripe int, count binary, best binary")
        by_run = packed.drop("pairs").unionByName(answers, allowMissingColumns=True).withColumn("answer", F.col("count").isNotNull())
        by_run = by_run.repartition("run").sortWithinPartitions("run", "stripe", "answer")
        out = cut(by_run.mapInArrow(summed, f"{facts_of}, n_best long, count_sum long"))
        drop_cut(packed)
        drop_cut(counts)
    return out


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document's byte-level tokens to its pieces, and how they stand in the corpus."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
