"""Queries of retrieval and access, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import retrieval
from lakeloom.functions import text as fx
from lakeloom.queries import query
from lakeloom.sources.tables import merge_by, table

_UNITS = """u AS (SELECT p_partkey AS unit_id, p_name AS subject, 'made of ' || lower(p_type) AS text, CASE p_partkey % 4 WHEN 0 THEN 'approved_canonical' WHEN 1 THEN 'source_backed_direct' WHEN 2 THEN 'source_backed_partial' ELSE 'other' END AS mode,
CASE p_partkey % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'public_authority' ELSE 'vendor' END AS ownership, 't' || (p_partkey % 2) AS tenant, CASE WHEN p_partkey % 5 = 0 THEN 'hr' END AS role, CASE WHEN p_partkey % 7 = 0 THEN 'read' END AS permission,
CASE p_partkey % 6 WHEN 0 THEN 'all_client_users' WHEN 3 THEN 'hr_only' ELSE 'administrators' END AS audience, p_brand FROM part)"""
#: What a user of tenant t0 with the role hr and no permissions may see.
_ALLOWED = "(ownership <> 'client' OR (tenant = 't0' AND permission IS NULL AND audience IN ('all_client_users', 'hr_only')))"


def _units(spark, d):
    k = F.col("p_partkey")
    some = lambda cond, v: F.when(cond, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        k.alias("unit_id"), F.col("p_name").alias("subject"), F.concat(F.lit("made of "), "p_type").alias("text"), F.when(k % 4 == 0, "approved_canonical").when(k % 4 == 1, "source_backed_direct").when(k % 4 == 2, "source_backed_partial").otherwise("other").alias("mode"),
        F.when(k % 3 == 0, "client").when(k % 3 == 1, "public_authority").otherwise("vendor").alias("ownership"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant"), some(k % 5 == 0, "hr").alias("roles"), some(k % 7 == 0, "read").alias("permissions"),
        F.when(k % 6 == 0, "all_client_users").when(k % 6 == 3, "hr_only").otherwise("administrators").alias("audience"), F.array("p_brand").alias("brands"),
    )


@query(f"WITH {_UNITS} SELECT unit_id, ownership FROM u WHERE {_ALLOWED}")
def allowed_units(spark, d):
    """What a user may see of each owner's rows."""
    return _units(spark, d).where(retrieval.allowed({"tenant": "t0", "roles": ["hr"]})).select("unit_id", "ownership")


@query(f"""WITH {_UNITS}, t AS (SELECT *, subject || ' ' || text AS t FROM u WHERE {_ALLOWED} AND p_brand = 'Brand#2'),
o AS (SELECT *, len(list_filter(string_split(t, ' '), lambda w: w IN ('small', 'ring', 'economy'))) + CASE WHEN contains(t, 'small ring') THEN 2 ELSE 0 END + contains(t, 'smal')::INT + contains(t, 'ring')::INT + contains(t, 'econom')::INT AS o,
  contains('small ring economy', subject) OR contains(subject, 'small ring economy') AS e FROM t),
b AS (SELECT *, CASE WHEN mode = 'approved_canonical' THEN CASE WHEN e OR o >= 8 THEN 0 ELSE 1 END WHEN ownership = 'client' THEN 2 WHEN ownership = 'public_authority' THEN 3 WHEN mode = 'source_backed_direct' THEN 4 WHEN mode = 'source_backed_partial' THEN 5 ELSE 6 END AS i FROM o WHERE o > 0 OR e)
SELECT unit_id, ['approved_canonical_exact_subject', 'approved_canonical_lexical_alias', 'authorized_client_exact', 'verified_public_authority_exact', 'source_backed_direct', 'source_backed_partial', 'insufficient'][i + 1] AS bucket,
(1000 - 100 * i + o + CASE WHEN e THEN 50 ELSE 0 END)::INT AS score FROM b ORDER BY score DESC, unit_id LIMIT 40""")
def lexical_search(spark, d):
    """Units that share words with a question, by bucket, overlap and exact subject, within a scope and a user's rights."""
    return retrieval.lexical_search(_units(spark, d), "Small ring, ECONOMY?", {"tenant": "t0", "roles": ["hr"]}, {"brands": "Brand#2"}, 40)


@query(f"""WITH h AS (SELECT doc_id, source, (doc_id % 50) / 100.0 AS base, translate(lower(text), '{fx.MARKED}', '{fx.PLAIN}') AS t FROM documents),
s AS (SELECT doc_id, source, base + 0.18 / 2 * (contains(t, 'thea')::INT + contains(t, 'tion')::INT) + CASE WHEN contains(t, 'inge') AND contains(t, 'tion') THEN 0.24 WHEN contains(t, 'tion') THEN 0.12 ELSE 0 END + CASE WHEN contains(t, 'erth') THEN 0.38 ELSE 0 END AS score FROM h)
SELECT source, doc_id, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 0.3 ORDER BY s.score DESC, source, doc_id LIMIT 50""")
def reranked_hits(spark, d):
    """Scores with what words, definitions and sections add; the threshold is applied to the sum."""
    rows = table(spark, d, "documents").select("doc_id", "source", "text", ((F.col("doc_id") % 50) / 100.0).cast("double").alias("score"))
    rules = ([(r"\bwhat\b", ("inge", "tion"), 0.24), (r"\bwhat\b", ("tion",), 0.12)], [(r"never", ("erth",), 0.9)], [(r"how", ("erth",), 0.38)])
    hits = retrieval.reranked(rows, "What and how?", ["theast", "tion"], rules)
    return retrieval.merge_hits(hits, ["source", "doc_id"], 0.3, 50).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT doc_id, (doc_id % 50) / 100.0 AS score, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h ORDER BY rank LIMIT 8)
SELECT rank::INT AS rank, doc_id, CASE WHEN length(t) <= n THEN t ELSE substr(t, 1, ((n - 3) * 3) // 4) || ' … ' || right(t, n - 3 - ((n - 3) * 3) // 4) END AS passage FROM (SELECT *, CASE WHEN rank = 1 THEN 1400 ELSE 650 END AS n FROM r)""")
def prompt_context(spark, d):
    """Passages of the best hits: the first one longer than the others."""
    rows = table(spark, d, "documents").select("doc_id", "text", ((F.col("doc_id") % 50) / 100.0).alias("score")).orderBy(F.desc("score"), "doc_id").limit(8)
    return retrieval.context(rows, ["doc_id"], [])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name || chr(10) || chr(10) || p_type END AS embedded FROM part")
def embedded_texts(spark, d):
    """Summary and text as they are embedded."""
    return table(spark, d, "part").select("p_partkey", retrieval.embedded_text(F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")), F.concat("p_type", F.lit("\n"))).alias("embedded"))


@query("""WITH g AS (SELECT source, doc_id, n_chars % 100 AS score FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, doc_id, n_chars % 90 FROM documents WHERE doc_id % 3 = 0)
SELECT source, doc_id, max(score) AS score FROM g WHERE score >= 20 GROUP BY ALL ORDER BY score DESC, source, doc_id LIMIT 60""")
def merged_collections(spark, d):
    """Hits of two collections as one, the better of each key."""
    rows = table(spark, d, "documents")
    hits = rows.where("doc_id % 2 = 0").select("source", "doc_id", (F.col("n_chars") % 100).alias("score")).unionByName(rows.where("doc_id % 3 = 0").select("source", "doc_id", (F.col("n_chars") % 90).alias("score")))
    return retrieval.merge_hits(hits, ["source", "doc_id"], 20, 60)


@query("""SELECT vec_id, label FROM embeddings WHERE NOT (label IN (2, 4)) AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0) UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 10 = 0""")
def upserted_vectors(spark, d):
    """Vectors of two kinds deleted, then some replaced by id."""
    from lakeloom.sources.tables import without

    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return merge_by(without(rows, F.col("label").isin(2, 4)), rows.where("vec_id % 10 = 0").withColumn("label", F.lit(99)), "vec_id")


@query("""SELECT conv_id, turn, string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roles FROM conversations""")
def recent_roles(spark, d):
    """Who spoke in the last three turns."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(by), ",").alias("roles"))


@query("""SELECT source, type, count(*) AS chunks FROM (SELECT source, 'global_documentation' AS type FROM documents WHERE doc_id % 3 <> 0) GROUP BY ALL""")
def replaced_source(spark, d):
    """An import that replaces: the old chunks of its sources go first, whatever their ids."""
    from lakeloom.sources.tables import import_chunks

    rows = table(spark, d, "documents").select("doc_id", "source", F.lit("client_documentation").alias("type"))
    new = rows.where("doc_id % 3 <> 0").withColumn("type", F.lit("global_documentation"))
    return import_chunks(rows, new, "source", "merge").groupBy("source", "type").agg(F.count("*").alias("chunks"))




@query("""SELECT p_type AS source_type, count(*) AS chunks, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS sources, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS modules, '' AS topics FROM part GROUP BY 1""")
def pack_manifest(spark, d):
    """What a pack holds of each kind."""
    from lakeloom.sources.tables import manifest

    rows = table(spark, d, "part").select(F.col("p_type").alias("source_type"), F.col("p_brand").alias("source"), F.col("p_name").alias("module"))
    return manifest(rows).withColumns({c: F.array_join(c, ",") for c in ("sources", "modules", "topics")})


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY n_chars, text) - 1)::INT AS chunk_index FROM (SELECT min(doc_id) AS doc_id, source, n_chars, text FROM documents GROUP BY source, n_chars, text)")
def numbered_chunks(spark, d):
    """The running number of each chunk in its source."""
    from lakeloom.sources.tables import numbered

    rows = table(spark, d, "documents").groupBy("source", "n_chars", "text").agg(F.min("doc_id").alias("doc_id")).withColumnRenamed("n_chars", "start")
    return numbered(rows).select("doc_id", "source", "chunk_index")


@query("SELECT unit_id, mode FROM (SELECT p_partkey AS unit_id, CASE p_partkey % 4 WHEN 0 THEN 'approved_canonical' WHEN 1 THEN 'source_backed_direct' WHEN 2 THEN 'source_backed_partial' ELSE 'other' END AS mode, p_brand, p_partkey % 2 AS t FROM part) WHERE p_brand IN ('Brand#2', 'Brand#3') AND t = 1 AND mode IN ('source_backed_direct', 'other')")
def payload_filter(spark, d):
    """Filters on payloads: equal, one of several, a member of an array."""
    rows = _units(spark, d)
    must = {"brands": ["Brand#2", "Brand#3"], "tenant": "t1", "mode": ["source_backed_direct", "other"]}
    return rows.where(retrieval.payload(must, dict(rows.dtypes))).select("unit_id", "mode")


@query("""WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(q.v, p.v) AS score FROM p q JOIN p ON CASE q.vec_id % 3 WHEN 0 THEN true WHEN 1 THEN p.label IN (q.label, (q.label + 1) % 10) ELSE p.label = 3 END),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def searched_many(spark, d):
    """The ten nearest of every vector at once, each among the labels that its filter allows."""
    rows, k = table(spark, d, "embeddings"), F.col("vec_id")
    allowed = F.when(k % 3 == 1, F.array(F.col("label"), (F.col("label") + 1) % 10)).when(k % 3 == 2, F.array(F.lit(3)))
    asked = rows.select(k.alias("query_id"), F.col("embedding").alias("vector"), allowed.alias("label"))
    found = retrieval.search_many(asked, rows.select(k.alias("id"), F.col("embedding").alias("vector"), "label"), 10, ["label"])
    return found.withColumn("score", F.round("score", 6))
