"""Boilerplate lines by site-relative frequency.

Pages of a host are counted for each of their lines; a line on more than a given share of its host's pages is dropped
from all of them. Only line hashes are shuffled, never texts: the lines of one host that exceed a share r number at
most (mean distinct lines of its pages) / r, so each host's list is bounded and joins back to the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import cut, maybe_broadcast, table

#: A line must stand on more than this share of its host's pages, and on two pages at least: a line of one page alone
#: doesn't repeat.
RATIO, MIN_PAGES = 0.1, 2


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with boilerplate lines taken out of their texts, and n_lines, n_dropped added.

    Lines end at each newline and are compared whole. A line goes if it stands on at least min_pages pages of its host
    and on more than ratio of them; a page that repeats a line counts once, and then loses each repetition. Blank
    lines stay. Rows that repeat count as pages of their own. Pages with a null host form one host. A null text stays
    null with no lines, an empty one has one blank line; a page that loses all lines stays with an empty text. Texts of
    any length are read whole. Columns keep their names, whatever they are, and their order; n_lines and n_dropped of
    docs itself are replaced. An empty table gives an empty result.
    """
    text, host = F.col(text_col).cast("string"), F.col(host_col).cast("string")
    shown = lambda x: x.rlike(r"[^ \t\r]")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.coalesce(host, F.lit("")).alias("host"), host.isNull().alias("no_host"), F.split(text, "\n", -1).alias("lines"), F.struct(*(F.col(c) for c in kept)).alias("row"))
    hashes = F.transform(F.filter("lines", shown), lambda x: F.xxhash64(x))
    on = rows.select("host", "no_host", F.array_distinct(hashes).alias("on_page"))
    pages = on.groupBy("host", "no_host").agg(F.count("*").alias("pages"))
    counts = on.select("host", "no_host", F.explode("on_page").alias("line")).groupBy("host", "no_host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(pages, ["host", "no_host"]).where(F.col("n") > ratio * F.col("pages"))
    lists = cut(often.groupBy("host", "no_host").agg(F.collect_set("line").alias("boilerplate")))
    n, longest = lists.agg(F.count("*"), F.coalesce(F.max(F.size("boilerplate")), F.lit(0))).first()
    lists = maybe_broadcast(lists, n, 64 + 8 * longest)

    # a page meets its host's list once, by hashing; its lines are looked up among what both share
    found = rows.join(lists, ["host", "no_host"], "left").withColumn("hits", F.coalesce(F.array_intersect(hashes, "boilerplate"), F.array().cast("array<bigint>")))
    stays = lambda x: ~(shown(x) & F.array_contains(F.col("hits"), F.xxhash64(x)))
    left = F.when(F.size("hits") == 0, F.col("lines")).otherwise(F.filter("lines", stays))
    found = found.select("row", "lines", left.alias("left"))
    n_lines = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    n_left = F.coalesce(F.when(F.col("left").isNotNull(), F.size("left")), F.lit(0)).cast("long")
    whole = F.array_join("left", "\n")
    return found.select(*((whole if c == text_col else F.col("row")[c]).alias(c) for c in kept), n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: counts and a digest of the text."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


ORACLE_SQL = f"""
WITH lines AS (SELECT DISTINCT rn, source, line FROM (
    SELECT rn, source, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS rn, source, text FROM documents))
  WHERE regexp_matches(line, '[^ \\t\\r]')),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (SELECT l.source, l.line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  GROUP BY l.source, l.line, p.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * p.pages),
drops AS (SELECT source, list(line) AS dropped FROM often GROUP BY source),
kept AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines,
  list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(o.dropped, []), x)) AS left_lines
  FROM documents d LEFT JOIN drops o ON d.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(left_lines), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN length(array_to_string(left_lines, chr(10)))::BIGINT END AS kept_chars,
  CASE WHEN text IS NOT NULL THEN md5(array_to_string(left_lines, chr(10))) END AS text_md5
FROM kept
"""
