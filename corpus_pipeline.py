"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import cut, maybe_broadcast, table
from lakeloom.llm.decontaminate import drop_leaks
from lakeloom.llm.line_dedup import drop_boilerplate
from lakeloom.llm.minhash_dedup import near_duplicates
from lakeloom.llm.quality import score_quality
from lakeloom.llm.source_mix import mix_sources

#: Documents below this quality score are rejected.
LEAST_QUALITY = 0.5


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """What a stage looks at, mark, 128 bits that tell unequal rows apart, and row, the whole row, whatever its columns' names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(*columns, F.md5(F.to_json(whole)).alias("mark"), whole.alias("row"))


def _whole(row: str, docs: DataFrame) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier doesn't reject, each by its own text; all columns stay as they are, whatever their
    names. Null and empty texts are scored like others; an empty table stays empty."""
    scored = score_quality(_rows(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), keep=("row",))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*_whole("_row", docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of texts and counts n_chars anew; documents that lose all their lines go, texts that were
    null or blank before stay. All other columns stay as they are, whatever their names; an empty table stays empty."""
    out = drop_boilerplate(_rows(docs, "source", "text")).where((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*(changed.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id (null last; ties by a digest of the row, so
    reruns agree). Rows that are equal in all columns are one. Rows without words all stay; null ids and texts are no error;
    all columns stay as they are, whatever their names; an empty table stays empty."""
    marked = _rows(docs, "doc_id", "text")
    groups = cut(near_duplicates(marked, keep=("mark",)).where("group is not null").groupBy("group", "doc_id", F.col("_mark").alias("mark")).agg(F.count("*").alias("rows")))
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best"), F.sum("rows").alias("of")).where("of > 1")
    # only rows of groups of several are touched: of the best one's rows one stays, the others go
    several = cut(groups.join(best, "group").select("mark", (F.col("best.mark") == F.col("mark")).alias("stays"), "rows"))
    gone = maybe_broadcast(several.where("not stays or rows > 1").select("mark", "stays"), several.count(), 48)
    told = marked.select("mark", "row").join(gone, "mark", "left")
    out = told.where("stays is null").select(*_whole("row", docs))
    if several.where("stays and rows > 1").isEmpty():
        return out
    return out.unionByName(told.where("stays").groupBy("mark").agg(F.first("row").alias("row")).select(*_whole("row", docs)))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, each judged by its own text; null and blank texts stay, and all columns as
    they are, whatever their names; an empty table stays empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words, with size, source_size, target and taken added; where docs has such a column, that one
    stays and the added one's name ends with as many `_` as it takes. Equal rows take part one by one; null ids, sources and
    texts are no error; an empty table stays empty."""
    marked = _rows(docs, "doc_id", "source", "text")
    taken = cut(mix_sources(marked.drop("row"), keep=("mark",))).where("taken > 0")
    once = marked.select("mark", "row")
    if not taken.groupBy("mark").count().where("count > 1").isEmpty():  # the mix has each of equal rows, so one is enough here
        once = once.groupBy("mark").agg(F.first("row").alias("row"))
    used, added = {c.lower() for c in docs.columns}, []
    for c in ("size", "source_size", "target", "taken"):
        name = c
        while name in used:
            name += "_"
        added.append(F.col(c).alias(name))
    return taken.drop("doc_id").join(once, "mark").select(*_whole("row", docs), *added)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_copies),
    ("decontamination", benchmark_free),
    ("source mix", mixed),
]

#: No SQL for the classifier, near-duplicates and edit distances; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
