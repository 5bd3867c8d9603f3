"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a hashed order and laid end to end; their words are cut into equal blocks. Slots of
the mix are points of the golden-ratio sequence, mapped through the sources' cumulative shares; the k-th slot of a
source takes its k-th block, beginning anew after the last. Any run of slots holds the sources close to their shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import cut, maybe_broadcast, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A source has about so many blocks, none longer than so many words.
BLOCKS, LONGEST_BLOCK = 4096, 65_536
#: Slots are ranked in runs of so many.
RUN = 65_536
#: 2^32 divided by the golden ratio: its multiples mod 2^32 are the points.
_GOLDEN, _ONE = 2654435769, 1 << 32
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """ordinal, source, source_size, target for each (source, source_size): weights repeat over sources by code point,
    null last; a target stops at most times its source's size and the excess goes to the others by weight."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") - 1) % len(weights) + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ordinal", F.row_number().over(by_name)).withColumn("w", w.cast("double")).withColumn("top", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("top") / F.col("w"), "ordinal")
    s = s.withColumn("before", F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(Window.partitionBy()) * share - F.col("before")) / F.col("open")
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))).over(Window.partitionBy()))
    return s.select("ordinal", "source", "source_size", F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, ordinal, rank, block: which block of which source each slot takes. sources has ordinal, slots, blocks."""
    spark = sources.sparkSession
    upto = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.withColumn("_upto", F.sum("slots").over(upto)).withColumn("_all", F.sum("slots").over(Window.partitionBy()))
    s = s.where("slots > 0").selectExpr("ordinal", "blocks", f"((_upto - slots) * {_ONE}L) div _all AS low", f"(_upto * {_ONE}L) div _all AS high", "_all")
    n, total = s.agg(F.count("*"), F.coalesce(F.max("_all"), F.lit(0))).first()
    cells = s.select("ordinal", "blocks", "low", "high", F.explode(F.expr("sequence(low div 1048576, (high - 1) div 1048576)")).alias("cell"))
    slots = spark.range(total).selectExpr("id AS slot", f"(id * {_GOLDEN}L) % {_ONE}L AS point").withColumn("cell", F.expr("point div 1048576"))
    cells = maybe_broadcast(cells, n + 4096, 48)
    dealt = slots.join(cells, "cell").where("point >= low AND point < high").selectExpr("slot", "ordinal", "blocks", f"slot div {RUN} AS run")
    runs = dealt.groupBy("ordinal", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ordinal").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("ordinal", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("ordinal", "run").orderBy("slot"))).join(runs, ["ordinal", "run"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("_k") - 1)
    return ranked.where(F.col("rank") < MOST * F.col("blocks")).select("slot", "ordinal", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size: number of `[^\\x20\\x09-\\x0D]+` in the text (null or blank: 0). Documents of a source stand in the order of the
    md5 of their ids (ties: id, then size; a null id last). taken counts repeats; it is at most twice the size. Sources
    of no words have target 0. A null source is a source of its own. Rows that repeat take part one by one. Reruns
    agree. An empty table gives an empty result; other columns are ignored, but for those of keep, which break further
    ties and are given back last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    rows = cut(rows)
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sources = sources.withColumn("length", F.expr(f"greatest(1L, least({LONGEST_BLOCK}L, source_size div {BLOCKS}))"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("length")).cast("long")).otherwise(F.lit(0)))
    n = sources.count()
    placed = rows.join(maybe_broadcast(sources.drop("slots", "blocks"), n, 256), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # positions in two steps, so that no task orders a whole source: within buckets of the hash, then over the buckets
    placed = placed.withColumn("_md5", F.md5(F.col("doc_id").cast("string"))).withColumn("_bucket", F.coalesce(F.substring("_md5", 1, 3), F.concat(F.lit("~"), F.lpad(F.col("size").cast("string"), 12, "0"))))
    buckets = placed.groupBy("ordinal", "_bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("ordinal").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("ordinal", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("ordinal", "_bucket").orderBy("_md5", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("size").over(within)).join(buckets, ["ordinal", "_bucket"])
    placed = placed.select("doc_id", "ordinal", "size", "source_size", "target", "length", (F.col("_offset") + F.col("_end") - F.col("size")).alias("start"), (F.col("_offset") + F.col("_end")).alias("end"), *keep)
    placed = cut(placed)

    pieces = placed.where("size > 0").select("doc_id", "ordinal", "start", "end", "length", F.explode(F.expr("sequence(start div length, (end - 1) div length)")).alias("block"))
    pieces = pieces.select("ordinal", "block", "start", (F.least("end", (F.col("block") + 1) * F.col("length")) - F.greatest("start", F.col("block") * F.col("length"))).alias("words"))
    taken = schedule(sources).groupBy("ordinal", "block").agg(F.count("*").alias("times"))
    taken = pieces.join(taken, ["ordinal", "block"]).groupBy("ordinal", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # start tells apart all documents of a source that have words
    keyed = placed.withColumn("_key", F.when(F.col("size") > 0, F.col("start")))
    out = keyed.join(taken.select("ordinal", F.col("start").alias("_key"), "taken"), ["ordinal", "_key"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), *keep)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH w(k, weight) AS (VALUES (0, 3.0::DOUBLE), (1, 1.0::DOUBLE), (2, 2.0::DOUBLE)),
rows_ AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ordinal FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source)),
weighed AS (SELECT n.*, weight, (source_size * {MOST})::DOUBLE AS top FROM named n JOIN w ON (ordinal - 1) % 3 = k),
filled AS (SELECT *, coalesce(sum(top) OVER (ORDER BY top / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY top / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS everything FROM weighed),
level_ AS (SELECT max((everything * {SHARE}::DOUBLE - before) / open) AS level FROM filled WHERE (everything * {SHARE}::DOUBLE - before) / open <= top / weight),
sources AS (SELECT ordinal, source, source_size, least(top, coalesce(level * weight, top)) AS target, greatest(1, least({LONGEST_BLOCK}, source_size // {BLOCKS}))::BIGINT AS length FROM filled, level_),
sized AS (SELECT *, ceil(source_size / length)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN round(target / length)::BIGINT ELSE 0 END AS slots FROM sources),
bounds AS (SELECT *, sum(slots) OVER (ORDER BY ordinal)::BIGINT AS upto, sum(slots) OVER ()::BIGINT AS total FROM sized),
slots_ AS (SELECT i AS slot, (i * {_GOLDEN}) % {_ONE} AS point FROM (SELECT unnest(range((SELECT max(total) FROM bounds))) AS i)),
dealt AS (SELECT slot, ordinal, blocks, row_number() OVER (PARTITION BY ordinal ORDER BY slot) - 1 AS rank FROM slots_ JOIN bounds
    ON point >= ((upto - slots) * {_ONE}) // total AND point < (upto * {_ONE}) // total),
times AS (SELECT ordinal, rank % blocks AS block, count(*) AS times FROM dealt WHERE rank < {MOST} * blocks GROUP BY ALL),
placed AS (SELECT doc_id, size, ordinal, source_size, target, length, row_number() OVER () AS rn,
    (sum(size) OVER (PARTITION BY ordinal ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM rows_ r JOIN sized s ON r.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT rn, ordinal, size, stop, length, unnest(range((stop - size) // length, (stop - 1) // length + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT rn, sum((least(stop, (p.block + 1) * length) - greatest(stop - size, p.block * length)) * t.times)::BIGINT AS taken FROM pieces p JOIN times t ON p.ordinal = t.ordinal AND p.block = t.block GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (rn)
"""
