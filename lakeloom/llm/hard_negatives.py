"""Hard negatives by partial inner products after an orthogonal PCA rotation.

Vectors become integers, so scores are exact. A rotation fitted on a bounded sample puts most of every vector's length into its
leading components. A pair's product is added up over leading components first; what is left lies between plus and minus
the product of the two residual norms, with some slack for rounding. A pair whose interval misses what its anchor looks for
is discarded there; what survives all components is scored with integers.

Two passes over the same tiles: the nearest rows of the anchor's label, then, within the windows that their scores give, the
highest rows of other labels. Rows are dealt into blocks and anchors into groups by hash; a task holds one block, meets
anchors as a stream, and nothing is dealt by label or vector, so neither can be hot. A bounded probe gives each
anchor its first thresholds; results don't depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import arrow_batches, cut, table

#: Bytes of a block's vectors; anchors of a group, and those that meet a block at once.
BLOCK_BYTES, GROUP, AT_ONCE = 1 << 20, 2048, 256
#: Rows that the rotation is fitted on, and of them those that give first thresholds, at most.
SAMPLE, PROBE = 16_384, 2048
#: Rounding of the rotation and the partial sums, as a share of the product of two norms.
SLACK = 1e-9
#: Vectors from this squared norm on take no part: below it every product is exact as a double, too.
TOO_LONG = 2.0**52


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Rotation:
    """An orthogonal basis by falling share of the sample's squared length, and the stages in which components are added."""

    def __init__(self, sample: np.ndarray) -> None:
        dim = sample.shape[1]
        x = sample.astype(np.float64)
        self.basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        ends = sorted({max(1, dim // 4), max(1, dim // 2), dim})
        self.stages = list(zip([0, *ends[:-1]], ends))

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, the norm of what is left of each after every stage, and norms."""
        turned = x.astype(np.float64) @ self.basis
        rest = np.stack([np.sqrt((turned[:, end:] ** 2).sum(axis=1)) for _, end in self.stages])
        return turned, rest, np.sqrt((turned**2).sum(axis=1))

    def survivors(self, left: tuple, right: tuple, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The allowed pairs (rows of left, rows of right) whose products may lie between low and high of their left row."""
        (q, q_rest, q_norm), (x, x_rest, x_norm) = left, right
        part, pairs = np.zeros((len(q), len(x))), None
        for (start, end), of_q, of_x in zip(self.stages, q_rest, x_rest):
            if pairs is None:
                part += q[:, start:end] @ x[:, start:end].T
                width = np.outer(of_q, of_x) + SLACK * np.outer(q_norm, x_norm)
                allowed = allowed & (part + width >= low[:, None]) & (part - width <= high[:, None])
                if np.count_nonzero(allowed) * 8 < allowed.size:  # few are left: no more whole products
                    pairs = np.nonzero(allowed)
                    part = part[pairs]
            else:
                row, column = pairs
                part = part + np.einsum("ij,ij->i", q[row, start:end], x[column, start:end])
                width = of_q[row] * of_x[column] + SLACK * q_norm[row] * x_norm[column]
                keep = (part + width >= low[row]) & (part - width <= high[row])
                pairs, part = (row[keep], column[keep]), part[keep]
        return np.nonzero(allowed) if pairs is None else pairs


def exact(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Integer inner products of the given pairs of rows."""
    out = np.empty(len(rows), np.int64)
    step = max(1, (1 << 20) // x.shape[1])
    for a in range(0, len(rows), step):
        out[a : a + step] = np.einsum("ij,ij->i", x[rows[a : a + step]], y[columns[a : a + step]])
    return out


def _best(row: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Where each row's k highest scores stand (ties: the smaller tie)."""
    order = np.lexsort((tie, -score, row))
    sorted_rows = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < k]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """tile, side and rows of each run of a batch."""
    tile, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
    edge = np.flatnonzero((tile[1:] != tile[:-1]) | (side[1:] != side[:-1])) + 1
    for a, b in zip([0, *edge], [*edge, len(tile)]):
        if b > a:
            yield tile[a], side[a], batch.slice(a, b - a)


class _Side:
    """Ids, labels and vectors of some rows."""

    def __init__(self, data: pa.RecordBatch | pa.Table, rotation: Rotation, dim: int) -> None:
        whole = data.combine_chunks() if isinstance(data, pa.Table) else data
        column = lambda name: (c.combine_chunks() if isinstance(c := whole.column(name), pa.ChunkedArray) else c)
        self.row, self.label = column("row").to_numpy(), column("label").to_numpy()
        ids = column("vec_id")
        self.ids, self.tie = ids, ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.x = _integers(column("v"), dim)
        self.turned = rotation.turn(self.x)

    def part(self, a: int, b: int) -> tuple:
        t, rest, norm = self.turned
        return t[a:b], rest[:, a:b], norm[a:b]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, group: int = GROUP, probe: int = PROBE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row for which is_anchor holds, its
    first `positives` other rows of the same label, and for each of them the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Each component x counts as floor(scale * x). Scores are integer inner products with the anchor; higher ones come first,
    ties by the smaller id, a null id last, then by row. With fewer rows all are returned. Labels are integers.
    Rows with a null label, a null or empty vector or null or non-finite components take no part, nor do vectors of another
    length than the most common one (ties: the shorter), nor those whose integers' squares add up to TOO_LONG. Every row
    counts as itself, rows with the same id or vector too; a zero vector is a vector. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where(F.col("label").isNotNull() & fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale))).where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < TOO_LONG)
    whole = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # written once, so a row keeps its number
    shape = whole.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).orderBy(F.desc("n"), "dim").first()
    if shape is None or not shape["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n, n_anchors = shape
    whole = whole.where(F.size("v") == dim)
    sample = whole.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("row", "vec_id", "label", "v").limit(SAMPLE).toArrow()
    rotation = Rotation(_integers(sample["v"].combine_chunks(), dim))
    first = sample.slice(0, probe).combine_chunks()
    first_row, first_label, first_x = first["row"].to_numpy(), first["label"].to_numpy(), _integers(first["v"].combine_chunks(), dim).astype(np.float64)
    first_norm = np.sqrt((first_x**2).sum(axis=1))

    def floors(k: int, same: bool):
        """Gives anchors the k-th best score that the probe has for each of their windows, as its lower end."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lows, highs = b.column("low").to_pylist(), b.column("high").to_pylist()
                x, row, label = _integers(b.column("v"), dim).astype(np.float64), b.column("row").to_numpy(), b.column("label").to_numpy()
                for a in range(0, len(x), AT_ONCE):
                    q = x[a : a + AT_ONCE]
                    slack = SLACK * np.outer(np.sqrt((q**2).sum(axis=1)), first_norm)
                    score = q @ first_x.T
                    allowed = ((label[a : a + AT_ONCE, None] == first_label) == same) & (row[a : a + AT_ONCE, None] != first_row)
                    for i, (s, w, ok) in enumerate(zip(score, slack, allowed), a):
                        for j, (lo, hi) in enumerate(zip(lows[i], highs[i])):
                            sure = s[ok & (s - w >= lo) & (s + w <= hi)]
                            if len(sure) >= k:
                                lows[i][j] = max(lo, np.partition(sure, -k)[-k] - w.max())
                columns = {c: b.column(c) for c in b.schema.names} | {"low": pa.array(lows, pa.list_(pa.float64()))}
                yield pa.RecordBatch.from_pydict(columns)

        return run

    def search(k: int, same: bool):
        """Rows of a block come first, then anchors; gives each anchor's k best of the block in each of its windows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, block = None, [], None
            for batch in batches:
                for tile, side, part in _runs(batch):
                    if tile != now:
                        now, held, block = tile, [], None
                    if side == 0:
                        held.append(part)
                        continue
                    if block is None and held:
                        block, held = _Side(pa.Table.from_batches(held), rotation, dim), []
                    if block is not None:
                        yield from found(_Side(part, rotation, dim), part.column("low").to_pylist(), part.column("high").to_pylist(), block, k, same)

        return run

    def found(asked: _Side, lows: list, highs: list, block: _Side, k: int, same: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(asked.row), AT_ONCE):
            b = min(a + AT_ONCE, len(asked.row))
            allowed = ((asked.label[a:b, None] == block.label) == same) & (asked.row[a:b, None] != block.row)
            hull = np.array([(min(lo), max(hi)) for lo, hi in zip(lows[a:b], highs[a:b])])
            row, column = rotation.survivors(asked.part(a, b), block.turned, hull[:, 0], hull[:, 1], allowed)
            score = exact(asked.x[a:b], block.x, row, column)
            for j in range(max(map(len, lows[a:b]))):
                least = np.array([lo[j] if j < len(lo) else np.inf for lo in lows[a:b]])
                most = np.array([hi[j] if j < len(hi) else -np.inf for hi in highs[a:b]])
                inside = np.flatnonzero((score >= least[row]) & (score <= most[row]))
                inside = inside[_best(row[inside], score[inside], block.tie[column[inside]], k)]
                r, c = row[inside], column[inside]
                yield pa.RecordBatch.from_arrays([pa.array(asked.row[a:b][r]), pa.array(np.full(len(r), j, np.int32)), block.ids.take(pa.array(c)), pa.array(block.row[c]), pa.array(score[inside])], names=["row", "place", "other_id", "other_row", "score"])

    n_blocks, n_groups = math.ceil(n * dim * 8 / block_bytes), math.ceil(n_anchors / group)
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block, in_group = F.pmod(F.xxhash64("row"), F.lit(n_blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_groups))
    right = whole.select(upto(n_groups).alias("g"), "*").select((block * n_groups + F.col("g")).alias("tile"), F.lit(0).alias("side"), "row", "vec_id", "label", "v")
    schema = "row long, vec_id long, label long, v array<bigint>, low array<double>, high array<double>"

    def nearest(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """row, place, other_id, other_row, score, n: each anchor's k best in each of its windows."""
        left = anchors.mapInArrow(floors(k, same), schema).select(upto(n_blocks).alias("b"), "*").select((F.col("b") * n_groups + in_group).alias("tile"), F.lit(1).alias("side"), "row", "vec_id", "label", "v", "low", "high")
        tiles = right.unionByName(left, allowMissingColumns=True).repartition("tile").sortWithinPartitions("tile", "side")
        hits = tiles.mapInArrow(search(k, same), "row long, place int, other_id long, other_row long, score long")
        first_ones = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other_row")
        return hits.withColumn("n", F.row_number().over(first_ones)).where(F.col("n") <= k)

    with arrow_batches(spark):
        anchors = whole.where("anchor")
        all_scores = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
        near = nearest(anchors.select("row", "vec_id", "label", "v", all_scores[0].alias("low"), all_scores[1].alias("high")), positives, True)
        near = cut(near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "other_id", "score"))).alias("near")))
        # windows in whole scores; that of a negative score is empty
        positive = "s.score >= 0"
        windows = F.expr(f"transform(near, s -> if({positive}, double((s.score * {low} + 99) div 100), double(1)))"), F.expr(f"transform(near, s -> if({positive}, double((s.score * {high}) div 100), double(0)))")
        asking = anchors.select("row", "vec_id", "label", "v").join(near, "row")
        hits = nearest(asking.select("row", "vec_id", "label", "v", windows[0].alias("low"), windows[1].alias("high")), negatives, False)
        found_for = hits.join(asking.select("row", F.col("vec_id").alias("anchor_id"), "near"), "row")
        of = F.get("near", F.col("place"))
        return cut(found_for.select("anchor_id", of["other_id"].alias("positive_id"), F.col("n").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose vec_id is divisible by 100, with the labels of every seventh moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id, o.label, list_inner_product(a.e, o.e)::BIGINT AS score FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = anchor_label),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
