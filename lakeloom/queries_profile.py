"""A profile of the tables' columns, from which the queries of schemas draw their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import table

#: Columns whose profile is taken: keys, and some others of each table.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand"),
    "orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus"),
    "documents": ("doc_id", "lang", "source"),
    "labels": ("doc_id", "quality"),
}

PROFILE = "profile(tab, col, n, nulls, kinds, is_pk, least_value) AS (" + " UNION ALL ".join(f"SELECT '{t}', '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), count(*) > 0 AND count(*) = count(DISTINCT {c}), min({c})::VARCHAR FROM {t}" for t, some in COLUMNS.items() for c in some) + ")"


def profile(spark: SparkSession, d: str) -> DataFrame:
    """tab, col, n, nulls, kinds, is_pk, least_value of each column: rows, those without a value, distinct values, and whether
    these tell all rows apart. One row of a table is told apart by column before anything is counted, so each table is read
    once, and values are counted by (column, value)."""
    parts = []
    for name, columns in COLUMNS.items():
        cells = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns))
        parts.append(table(spark, d, name).select(F.lit(name).alias("tab"), F.inline(cells)))
    values = reduce(DataFrame.unionByName, parts).groupBy("tab", "col", "v").agg(F.count("*").alias("times"))
    nulls = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("times"))), F.lit(0))
    out = values.groupBy("tab", "col").agg(F.sum("times").alias("n"), nulls.alias("nulls"), F.count("v").alias("kinds"), F.min("v").alias("least_value"))
    return out.select("tab", "col", "n", "nulls", "kinds", (F.col("n") == F.col("kinds")).alias("is_pk"), "least_value")


#: Tables and columns under names as catalogs have them: T_ for what a key names, L_ for lists of it, SL_ for dictionaries of lists.
NAMED = "named AS (SELECT CASE tab WHEN 'lineitem' THEN 'L_ORDER' WHEN 'region' THEN 'SL_ORDER' WHEN 'labels' THEN 'LABELS' WHEN 'documents' THEN 'T_DOC' ELSE 'T_' || upper(regexp_replace(tab, 'omer$|lier$|s$', '')) END AS t, CASE WHEN col = 'doc_id' THEN 'DOC_ID' ELSE upper(regexp_replace(regexp_replace(col, '^._', ''), 'key$', '_id')) END AS c, is_pk, n FROM profile)"


def named(spark: SparkSession, d: str) -> DataFrame:
    """table, column, is_pk, n: the profile under such names."""
    t, c = F.col("tab"), F.col("col")
    table_name = F.when(t == "lineitem", "L_ORDER").when(t == "region", "SL_ORDER").when(t == "labels", "LABELS").when(t == "documents", "T_DOC").otherwise(F.concat(F.lit("T_"), F.upper(F.regexp_replace(t, "omer$|lier$|s$", ""))))
    column = F.when(c == "doc_id", "DOC_ID").otherwise(F.upper(F.regexp_replace(F.regexp_replace(c, "^._", ""), "key$", "_id")))
    return profile(spark, d).select(table_name.alias("table"), column.alias("column"), "is_pk", "n")
