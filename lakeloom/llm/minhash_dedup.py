"""Near-duplicate groups by MinHash: universal hash minima, banding, verified links, connected components.

Documents are compared by their sets of distinct word shingles. Equal sets collapse to one node first, so copies cost
one row each. Bands of minima put nodes into buckets; the last bits of the minima screen the pairs of a bucket, and the
whole sets, made anew from the texts, decide. Components come from alternating large-star and small-star steps.

A bucket's pairs are never joined as rows. Rounds first give each node the likeliest partner of another component among
a few hubs of each of its buckets, drawn anew each round, which is linear in the bucket; groups of copies fall together
in them. What then still lies apart in a bucket meets in the last round: members outside its largest component, dealt
into blocks, against blocks of all its members, compared inside tasks. A longer sketch, made for these nodes alone,
screens once more, and a pair counts only in the first bucket that it shares. So every pair that shares a bucket, passes
the screens and isn't connected already is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lakeloom.llm._common import Words, arrow_batches, chunks, cut, drop_cut, maybe_broadcast, mix, table

#: 40 bands of 7 minima: two sets at similarity 0.8 share a bucket with probability 1 - (1 - 0.8^7)^40 > 0.9999.
BANDS, ROWS = 40, 7
#: Bits of minima that may differ in a pair that is compared in full: of 280, 28 do on average at similarity 0.8, with
#: a deviation of 5.02; this is 4.2 deviations more (1.3 in 100,000 such pairs have more).
DIFFER = 49
#: Hubs of a bucket in a round, rounds with hubs at most, and members of a bucket in a block.
HUBS, ROUNDS, BLOCK = 32, 2, 2048
#: Bits of the sketch of the last round, and how many may differ: 204.8 do on average at similarity 0.8, with a deviation
#: of 13.6, so this too is over 4.2 deviations more.
SKETCH, SKETCH_DIFFER = 2048, 262
#: Longs that hold the bits, and pairs compared at once.
LONGS, AT_ONCE = -(-BANDS * ROWS // 64), 1 << 18
_BITS = [f"b{k}" for k in range(LONGS)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; with fewer words than size, the whole sequence is one shingle."""
    h = words.hash
    for a, b in zip(words.first[:-1], words.first[1:]):
        if a == b:
            yield np.empty(0, np.uint64)
            continue
        w = min(size, b - a)
        acc = h[a : b - w + 1].copy()
        for k in range(1, w):
            acc = mix(acc * _ODD + h[a + k : b - w + 1 + k])
        yield np.unique(mix(acc + np.uint64(w)))


def _coefficients(seed: int, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(seed).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of (a x + b) mod 2^32 over 32-bit shingles x."""
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(x), 256):
        block = x[k : k + 256, None] * a
        block += b
        m = block.min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return low.astype(np.uint64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)
    for column in minima.reshape(BANDS, ROWS).T:
        key = mix(key * _ODD + column)
    return key.view(np.int64)


def last_bits(minima: np.ndarray) -> np.ndarray:
    """A bit of each minimum, packed into longs."""
    return np.packbits(np.pad((mix(minima) & np.uint64(1)).astype(np.uint8), (0, -len(minima) % 64))).view(np.int64)


def _profile(size: int):
    """doc_id, text, k1, k2 and more columns in; for each row n_shingles, node and check (128 bits of its set), bands
    and a bit of each minimum out, and the columns but for the text."""
    a, b = _coefficients(1)
    own = {"n_shingles": pa.int64(), "node": pa.int64(), "check": pa.int64(), "bands": pa.list_(pa.int64())} | dict.fromkeys(_BITS, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, part in chunks(texts):
                n, ids, bands, bits = [], [], [], []
                for s in shingle_sets(Words(part), size):
                    n.append(len(s))
                    if not len(s):
                        ids.append((None, None)), bands.append(None), bits.append((None,) * LONGS)
                        continue
                    m = signature(s, a, b)
                    ids.append(tuple(np.frombuffer(hashlib.md5(s.tobytes()).digest(), np.int64).tolist()))
                    bands.append(band_keys(m)), bits.append(tuple(last_bits(m).tolist()))
                values = [n, *zip(*ids), bands, *zip(*bits)]
                kept = [c.slice(at, len(part)) for i, c in enumerate(batch.columns) if i != 1]
                names = [x for i, x in enumerate(batch.schema.names) if i != 1]
                yield pa.record_batch([*kept, *(pa.array(v, kind) for v, kind in zip(values, own.values()))], names=[*names, *own])

    return run, [T.StructField(x, T.ArrayType(T.LongType()) if x == "bands" else T.LongType()) for x in own]


def _sketches(size: int):
    """node, text in; node and its longer sketch followed by its band keys out."""
    (a, b), (c, d) = _coefficients(1), _coefficients(2, SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                out = [np.concatenate((last_bits(signature(s, c, d)), band_keys(signature(s, a, b)))).tobytes() for s in shingle_sets(Words(part), size)]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(out, pa.binary())], names=["node", "sketch"])

    return run, "node long, sketch binary"


def _linked(size: int, percent: int):
    @F.pandas_udf(T.BooleanType())
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for at, part in chunks([t for pair in zip(x, y) for t in pair]):
            out.extend(shingle_sets(Words(part), size))
        both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(out[::2], out[1::2])]
        return pd.Series([100 * n >= percent * (len(p) + len(q) - n) for n, p, q in zip(both, out[::2], out[1::2])], dtype=bool)

    return linked


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of links (a, b), by alternating large-star and small-star.

    Returns node, comp. Stops when a round leaves the set of links as it was; each round is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = cut(small)
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        drop_cut(edges)
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


def _screen(percent: int, best: bool):
    """Rows (bucket, i, j, side, node, comp, n, bits), sorted by the first four; pairs of a left (side 0) and a right
    node of the same bucket, i and j out that pass the screen, as a, b, differ; with best, one for each right row.
    Where sketches follow the bits, they screen too, and a pair is given out by the first bucket that it shares."""
    longs = 7 + LONGS
    fields = ("a", "b", "differ")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Whole runs of equal (bucket, i, j), about AT_ONCE / 32 rows at a time."""
        held: list[np.ndarray] = []
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns[:longs]]
            own += [np.frombuffer(b"".join(c.to_pylist()), np.int64).reshape(batch.num_rows, -1) for c in batch.columns[longs:]]
            held.append(np.column_stack(own))
            if sum(map(len, held)) >= AT_ONCE // 32:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                if len(last):
                    yield rows[: last[-1] + 1]
                    rows = rows[last[-1] + 1 :]
                held = [rows]
        if held and sum(map(len, held)):
            yield np.concatenate(held)

    def compared(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        change = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        first = np.append(np.flatnonzero(change), len(rows))
        lefts = np.add.reduceat((rows[:, 3] == 0).astype(np.int64), first[:-1])
        rights = np.diff(first) - lefts
        upto = np.concatenate(([0], np.cumsum(lefts * rights)))
        comp, n, bits, sketch, bands = rows[:, 5], rows[:, 6], rows[:, 7:longs].astype(np.uint64), rows[:, longs:][:, : SKETCH // 64].astype(np.uint64), rows[:, longs:][:, SKETCH // 64 :]
        for at in range(0, int(upto[-1]), AT_ONCE):
            t = np.arange(at, min(at + AT_ONCE, int(upto[-1])))
            run = np.searchsorted(upto, t, "right") - 1
            x, y = np.divmod(t - upto[run], rights[run])
            x, y = x + first[run], y + first[run] + lefts[run]
            apart = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[apart], y[apart]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            near = differ <= DIFFER
            x, y, differ = x[near], y[near], differ[near]
            if bands.shape[1] and len(x):
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= SKETCH_DIFFER
                x, y, differ = x[near], y[near], differ[near]
                same = bands[x] == bands[y]
                first_shared = bands[x, same.argmax(axis=1)] == rows[x, 0]
                x, y, differ = x[first_shared], y[first_shared], differ[first_shared]
            yield x, y, differ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            node = rows[:, 4]
            for x, y, differ in compared(rows):
                if best:
                    order = np.lexsort((node[x], differ, node[y]))
                    x, y, differ = x[order], y[order], differ[order]
                    keep = np.concatenate(([True], node[y][1:] != node[y][:-1])) if len(y) else np.empty(0, bool)
                    x, y, differ = x[keep], y[keep], differ[keep]
                yield pa.record_batch([pa.array(node[y]), pa.array(node[x]), pa.array(differ)], names=fields)

    return run, "a long, b long, differ long"


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Two documents are linked if
    100 * |intersection| >= percent * |union| of their distinct shingles. group tells the components apart, and
    component_id is the smallest doc_id of one. Null, empty or blank texts have no shingles, are linked with nothing,
    have a null group and are kept. Rows that repeat are returned as often as they come. Rows with a null doc_id share
    in their component; where no row of it has a doc_id, component_id is null and all its rows are kept. Other columns
    of docs are ignored, whatever their names, but for those of keep, given back last as `_` and their name. Texts of
    any length are read whole. An empty table gives an empty result.
    """
    with arrow_batches(docs.sparkSession):
        return _near_duplicates(docs, shingle_words, percent, id_col, text_col, keep)


def _near_duplicates(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("again"), text).alias("k2"), *(F.col(c).alias("_" + c) for c in keep))
    run, added = _profile(size)
    profile = cut(keyed.mapInArrow(run, T.StructType([f for f in keyed.schema.fields if f.name != "text"] + added)))
    while True:
        one = [F.first(c).alias(c) for c in ("n_shingles", "bands", *_BITS)]
        nodes = cut(profile.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("lowest"), F.min(F.struct("k1", "k2")).alias("key"), F.min("check").alias("c1"), F.max("check").alias("c2"), *one))
        if nodes.where("c1 <> c2").isEmpty():
            break
        drop_cut(nodes)  # two sets share 64 bits: all nodes are named anew from 128
        profile = profile.withColumn("node", F.xxhash64("node", "check"))
    rows = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    members = rows.join(maybe_broadcast(shared, shared.count(), 16), "bucket")
    members = cut(members.join(nodes.select("node", F.col("n_shingles").alias("n"), *_BITS), "node").select("bucket", "node", "n", *_BITS))
    wanted = cut(members.select("node").distinct().join(nodes.select("node", "key.*"), "node"))
    n_wanted = wanted.count()
    found = [nodes, shared, members, wanted]
    if n_wanted:
        # the whole texts of nodes that share a bucket with others, by 128 bits of the text; copies fall together first
        texts = keyed.select("text", "k1", "k2").join(maybe_broadcast(wanted, n_wanted, 32), ["k1", "k2"])
        texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))
        comp, more = _grow(members, texts, size, percent)
        found += [texts, comp, *more]
    else:
        comp = docs.sparkSession.createDataFrame([], "node long, comp long")
    named = nodes.select("node", "lowest").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # few nodes are linked: the others are components of their own, and need no grouping
    least = named.join(comp.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("lowest").alias("least"))
    by_node = cut(named.join(least, "comp", "left").select("node", F.coalesce("least", "lowest").alias("component_id"), F.col("comp").alias("group")))
    for x in found:
        drop_cut(x)
    kept = ["_" + c for c in keep]
    some = profile.where("node is not null").select("doc_id", "n_shingles", "node", *kept).join(by_node, "node").drop("node")
    none = profile.where("node is null").select("doc_id", "n_shingles", *kept, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    stays = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    return some.unionByName(none).select("doc_id", "n_shingles", "component_id", stays.alias("kept"), "group", *kept)


def _grow(members: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """node, comp over the links among members of the buckets (bucket, node, n, bits), and the tables behind it."""
    spark, linked = members.sparkSession, _linked(size, percent)
    columns = ["bucket", "i", "j", "side", "node", "comp", "n", *_BITS]

    def screened(left: DataFrame, right: DataFrame, best: bool) -> DataFrame:
        run, schema = _screen(percent, best)
        both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
        both = both.select(*(F.col(c).cast("long").alias(c) for c in columns), *(() if best else ("sketch",)))
        return both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(run, schema)

    def block(salt: str, n):
        return F.pmod(F.xxhash64("node", F.lit(salt)), n)

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        near = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return near.where(linked("x", "y")).select("a", "b")

    links, comp, tested, made, turn, last = None, None, None, [], 0, False
    while not last:
        last = turn == ROUNDS
        placed = members.withColumn("comp", F.col("node")) if comp is None else members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket", "m")
        mixed = cut(placed.join(apart, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK)))
        if not last:
            order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(turn)), "node")
            hubs = mixed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS)
            hubs = hubs.withColumn("i", F.lit(0)).withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)")))
            pairs = screened(hubs, mixed.withColumns({"i": F.lit(0), "j": block("j", F.col("blocks"))}), True)
            pairs = pairs.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("best")).select("a", "best.b")
        else:
            sizes = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
            top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"))
            top = top.select("bucket", "top", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("others"))
            apart = cut(texts.join(mixed.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(*_sketches(size)))
            made.append(apart)
            dealt = mixed.join(top, "bucket").join(apart, "node")
            left = dealt.where("comp <> top").withColumn("i", block("i", F.col("others"))).withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)")))
            right = dealt.withColumn("j", block("j", F.col("blocks"))).withColumn("i", F.explode(F.expr("sequence(0L, others - 1)")))
            pairs = screened(left, right, False)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        fresh = cut(confirm(pairs))
        drop_cut(mixed)
        tested = pairs if tested is None else tested.unionByName(pairs)
        made += [pairs, fresh]
        if fresh.isEmpty():
            turn = ROUNDS
            continue
        turn += 1
        links = fresh if links is None else links.unionByName(fresh)
        comp = components(links)
        made.append(comp)
    return (spark.createDataFrame([], "node long, comp long") if comp is None else comp), made


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents over two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80).drop("group")


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT walk.a, both_.b FROM walk JOIN both_ ON walk.b = both_.a),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_ USING (doc_id)
"""
