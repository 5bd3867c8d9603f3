"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors belong to the nearest of a bounded number of centres. What is left of a vector is rotated and kept as one bit
for each component, with its length and how well the bits align with it. A query's inner product with a coded vector is
estimated from the bits and these two numbers; the estimate's error bound tells which vectors are scored in full.

Equal vectors are searched as one. Cells are cut into blocks of bounded size. A task holds one block at a time and reads
the queries that want it as a stream, so the index is shuffled once, however many queries there are, and neither a hot
cell nor a hot vector gathers in one task. A query skips a cell if even the best vector that the cell's
radius allows is worse than the k-th best that a bounded part of the index has for it; that loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import arrow_batches, cut, table

#: Vectors in a block of the index, on average; most cells, each with four vectors of the sample at least.
BLOCK, MOST_CELLS = 4096, 4096
#: Vectors that the centres are fitted on, at most, and those that give each query its first threshold.
SAMPLE, PROBE = 16_384, 8192
#: Width of the error bound in deviations of the estimate.
WIDTH = 3.0


@dataclass
class Codes:
    """Centres of cells and the rotation; fitted on a bounded sample."""

    centres: np.ndarray
    rotation: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> Codes:
        dim = sample.shape[1]
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        centres = sample[:cells].copy()
        for _ in range(rounds if cells > 1 else 1):
            near = Codes.nearest(sample, centres)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, sample)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        return Codes(centres, q * np.sign(np.diag(r)))

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length of the rest, its alignment with its bits, and the bits packed, of each row."""
        cell = self.nearest(x, self.centres)
        rest = (x - self.centres[cell]) @ self.rotation.T
        length = np.linalg.norm(rest, axis=1)
        align = np.abs(rest).sum(axis=1) / np.where(length > 0, length, 1) / math.sqrt(x.shape[1])
        return cell, length, np.where(length > 0, align, 1.0), np.packbits(rest > 0, axis=1)

    def estimate(self, queries: np.ndarray, cell: int, length: np.ndarray, align: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries with coded vectors of a cell, and the width of each one's error."""
        dim = queries.shape[1]
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        turned = (queries @ self.rotation.T).astype(np.float32)
        scale = (length / (math.sqrt(dim) * align)).astype(np.float32)
        middle = (queries @ self.centres[cell]).astype(np.float32)[:, None] + (turned @ signs.T) * scale
        spread = length * np.sqrt(np.maximum(1 - align**2, 0)) / align / math.sqrt(max(dim - 1, 1)) * WIDTH
        size = np.linalg.norm(queries, axis=1)
        slack = 1e-5 * (size[:, None] * (length + np.linalg.norm(self.centres[cell])))
        return middle, (size[:, None] * spread + slack).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs of rows of x and y, in double precision."""
    out = np.empty(len(rows))
    step = max(1, (1 << 22) // x.shape[1])
    for a in range(0, len(rows), step):
        out[a : a + step] = np.einsum("ij,ij->i", x[rows[a : a + step]], y[columns[a : a + step]])
    return out


def best_of_block(codes: Codes, queries: np.ndarray, floor: np.ndarray, vectors: np.ndarray, coded: tuple, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of each query's k best of a block that reach its floor (ties: the smaller first_id)."""
    found = []
    for a in range(0, len(queries), 512):
        q, low = queries[a : a + 512], floor[a : a + 512]
        middle, width = codes.estimate(q, *coded)
        n = min(k, len(vectors))
        top = np.argpartition(-middle, n - 1, axis=1)[:, :n]
        if n == k:
            sure = exact(q, vectors, np.repeat(np.arange(len(q)), n), top.ravel()).reshape(-1, n).min(axis=1)
            low = np.maximum(low, sure)
        row, column = np.nonzero(middle + width >= low[:, None])
        score = exact(q, vectors, row, column)
        keep = score >= low[row]
        row, column, score = row[keep], column[keep], score[keep]
        order = np.lexsort((first_id[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        start = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - start[row] < k
        found.append((row[keep] + a, column[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK, probe_rows: int = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the largest inner product with each row for which asked holds.

    A query's own row is no candidate; ties go to the smaller vec_id; with fewer candidates all are returned. Vectors
    that are null, empty, zero or hold null or non-finite components, rows with a null id, and vectors of another length
    than the most common one (ties: the shorter) take no part. A row that comes again with the same id and vector counts
    once; an id with several vectors is searched once for each of them. Other columns are ignored; an empty table gives
    an empty result. Centres are fitted on SAMPLE rows at most; every row is indexed. block_rows and probe_rows bound what a
    task holds and what gives the first thresholds; results don't depend on them, but for the error bound of the codes.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    key = ["k1", "k2"]

    # one row for each distinct vector, with its k + 1 smallest ids: more of its copies no result can hold
    by_id = Window.partitionBy(*key).orderBy("vec_id")
    ids = rows.select(*key, "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    ids = ids.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shape = rows.groupBy(*key).agg(F.first("v").alias("v"), F.max("asked").alias("asked"))
    with arrow_batches(spark):
        whole = cut(shape.join(ids, key))
        n, n_asked = whole.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))).first()
        sample = whole.select(*key, "v").orderBy(*key).limit(SAMPLE).toArrow()
        probe = _matrix(sample["v"], dim)
        codes = Codes.fit(probe, min(MOST_CELLS, max(1, len(probe) // 4), max(1, n // block_rows)))
        probe, probe_key = probe[:probe_rows].astype(np.float32), np.column_stack([sample[c].to_numpy()[:probe_rows] for c in key])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, length, align, bits = codes.encode(_matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(length), pa.array(align), pa.array([x.tobytes() for x in bits], pa.binary())], names=[*b.schema.names, "cell", "length", "align", "bits"])

        coded = cut(whole.mapInArrow(encode, f"k1 long, k2 long, v {rows.schema['v'].dataType.simpleString()}, asked boolean, ids array<long>, cell int, length double, align double, bits binary"))
        cells = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("radius")).orderBy("cell").collect()  # MOST_CELLS rows
        radius, blocks, first, at = np.zeros(len(codes.centres)), np.zeros(len(codes.centres), int), np.zeros(len(codes.centres), int), 0
        for r in cells:
            radius[r.cell], blocks[r.cell], first[r.cell] = r.radius, -(-r.n // block_rows), at
            at += blocks[r.cell]

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query, its threshold and the blocks of the cells that may hold better vectors."""
            for b in batches:
                q = _matrix(b.column("v"), dim)
                own = np.column_stack([b.column(c).to_numpy() for c in key])
                floor, lists = np.empty(len(q)), []
                for i in range(0, len(q), 512):
                    score = q[i : i + 512].astype(np.float32) @ probe.T
                    score[(own[i : i + 512, None, 0] == probe_key[None, :, 0]) & (own[i : i + 512, None, 1] == probe_key[None, :, 1])] = -np.inf
                    size = np.linalg.norm(q[i : i + 512], axis=1)
                    floor[i : i + 512] = np.partition(score, -k, axis=1)[:, -k] - 1e-5 * size * np.linalg.norm(probe, axis=1).max() if score.shape[1] > k else -np.inf
                    most = q[i : i + 512] @ codes.centres.T + size[:, None] * radius * (1 + 1e-9)
                    for m, f in zip(most, floor[i : i + 512]):
                        use = np.flatnonzero((m >= f) & (blocks > 0))
                        lists.append(np.concatenate([np.arange(first[c], first[c] + blocks[c], dtype=np.int32) for c in use]) if len(use) else [])
                yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("v"), pa.array(floor), pa.array(lists, pa.list_(pa.int32()))], names=["k1", "k2", "v", "floor", "wanted"])

        kind_of = rows.schema["v"].dataType.simpleString()
        queries = coded.where("asked").select(*key, "v").mapInArrow(wanted, f"k1 long, k2 long, v {kind_of}, floor double, wanted array<int>")
        queries = queries.select(F.explode("wanted").alias("block"), F.lit(1).alias("side"), *key, "v", "floor")
        place = spark.createDataFrame([(int(r.cell), int(first[r.cell]), int(blocks[r.cell])) for r in cells], "cell int, first int, blocks int")
        index = coded.join(F.broadcast(place), "cell").withColumn("block", (F.col("first") + F.pmod("k2", F.col("blocks"))).cast("int"))
        index = index.select("block", F.lit(0).alias("side"), *key, "v", "cell", "ids", "length", "align", "bits")
        fields = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of a block come first, then its queries; one block is held, and a batch of queries."""
            now, held, index_block = None, [], None
            for batch in batches:
                at = batch.column("block").to_numpy()
                side = batch.column("side").to_numpy()
                for a, b in zip(*(np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (side[1:] != side[:-1]), [True])))[x] for x in (slice(None, -1), slice(1, None)))):
                    part = batch.slice(a, b - a)
                    if at[a] != now:
                        now, held, index_block = at[a], [], None
                    if side[a] == 0:
                        held.append(part)
                        continue
                    if index_block is None and held:
                        right = pa.Table.from_batches(held)
                        own = right["ids"].combine_chunks()
                        bits = np.frombuffer(b"".join(right["bits"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
                        codes_of = (right["cell"][0].as_py(), right["length"].to_numpy(), right["align"].to_numpy(), bits)
                        index_block = _matrix(right["v"], dim), codes_of, own, own.values.to_numpy()[own.offsets.to_numpy()[:-1]]
                    if index_block is not None:
                        x, codes_of, own, least = index_block
                        row, column, score = best_of_block(codes, _matrix(part.column("v"), dim), part.column("floor").to_numpy(), x, codes_of, least, k + 1)
                        row = pa.array(row)
                        yield pa.RecordBatch.from_arrays([part.column("k1").take(row), part.column("k2").take(row), pa.array(score), own.take(pa.array(column))], schema=fields)

        both = index.unionByName(queries, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "side")
        found = both.mapInArrow(search, "q1 long, q2 long, score double, ids array<long>")
        per_query = Window.partitionBy("q1", "q2")
        found = found.withColumn("n", F.row_number().over(per_query.orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= k + 1)
        found = found.select("q1", "q2", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(per_query.orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
        lists = cut(found.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("best")))
    asking = rows.where("asked").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("vec_id").alias("query_id")).distinct()
    near = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asking.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(near).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
