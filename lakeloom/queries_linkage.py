"""Queries that link records, over parts as records, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import linkage
from lakeloom.queries import query
from lakeloom.sources.cuts import cut
from lakeloom.sources.tables import table


def records(spark, d):
    """Parts as records: their payloads, scopes and hints follow from their numbers, so that every relation comes up."""
    k = F.col("p_partkey")
    text = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
    size = F.col("p_size").cast("string")
    payload = F.map_filter(F.create_map(F.lit("value"), F.when(k % 9 != 0, (F.col("p_size") % 10).cast("string")), F.lit("path"), F.when(k % 4 == 0, F.concat(F.lit("p"), (F.col("p_size") % 3).cast("string")))), lambda _, v: v.isNotNull())
    return table(spark, d, "part").select(
        k.alias("id"), F.concat_ws("/", "p_brand", "p_type").alias("kind"), F.initcap("p_name").alias("subject"), F.lit("Size").alias("predicate"), size.alias("object"),
        F.concat("p_name", F.lit(", of (size) "), size).alias("statement"), F.md5(F.concat("p_name", size)).alias("signature"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), payload.alias("payload"),
        text(k % 6 == 0, F.concat(F.lit("h"), (F.col("p_size") % 5).cast("string"))).alias("hints"),
        F.when(k % 5 < 3, F.array(F.lit("hr"))).when(k % 5 == 3, F.array(F.lit(" EDU"))).otherwise(F.array().cast("array<string>")).alias("families"),
        F.array().cast("array<string>").alias("surfaces"), text(k % 2 == 0, F.lit("d")).alias("domains"), text(k % 7 == 0, F.lit("v2")).alias("versions"), F.array().cast("array<string>").alias("dates"),
        F.when(k % 11 == 0, "client_specific_candidate").when(k % 13 == 0, "requires_review").otherwise("global_candidate").alias("scope"), F.lit("verified").alias("currentness"), F.lit("low").alias("risk"),
        F.when(k % 17 == 0, "mobile").otherwise(" ").alias("platform"), text(k % 10 == 0, F.lit(" Kadry")).alias("areas"), text(k % 19 == 0, F.lit("2024")).alias("contexts"),
    )


_RECORDS = """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_brand || '/' || p_type AS kind, lower(p_name) AS subject, p_size::VARCHAR AS object, lower(p_name) || ' of size ' || p_size AS statement, md5(p_name || p_size) AS signature, 's' || (p_partkey % 3) AS source,
CASE WHEN p_partkey % 9 <> 0 THEN (p_size % 10)::VARCHAR END AS value, CASE WHEN p_partkey % 4 = 0 THEN 'p' || (p_size % 3) END AS path, CASE WHEN p_partkey % 6 = 0 THEN 'h' || (p_size % 5) END AS hint,
CASE WHEN p_partkey % 5 < 3 THEN 'hr' WHEN p_partkey % 5 = 3 THEN 'edu' END AS family, CASE WHEN p_partkey % 2 = 0 THEN 'd' END AS domain, CASE WHEN p_partkey % 7 = 0 THEN 'v2' END AS version,
CASE WHEN p_partkey % 11 = 0 THEN 'client_specific_candidate' WHEN p_partkey % 13 = 0 THEN 'requires_review' ELSE 'global_candidate' END AS scope,
CASE WHEN p_partkey % 17 = 0 THEN 'mobile' ELSE 'unknown' END AS platform, CASE WHEN p_partkey % 10 = 0 THEN 'kadry' END AS area, CASE WHEN p_partkey % 19 = 0 THEN '2024' END AS ctx FROM part),
u AS (SELECT *, (family IS NULL AND domain IS NULL) OR (scope = 'requires_review' AND family IS NULL AND version IS NULL) AS unknown,
  concat_ws('|', coalesce(family, '-'), coalesce(domain, '-'), coalesce(version, '-'), scope, platform, coalesce(area, '-'), coalesce(ctx, '-')) AS part_key FROM c),
r AS (SELECT u.*, copies FROM u JOIN (SELECT min(id) AS id, count(*) AS copies FROM u GROUP BY kind, subject, object, statement, signature, source, value, path, hint, family, domain, version, scope, platform, area, ctx) USING (id)),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.signature = r.signature AS s1, l.subject = r.subject AS s2, l.subject = r.subject AND l.object = r.object AND l.value IS NOT DISTINCT FROM r.value AS s3, coalesce(l.hint = r.hint, false) AS s4
  FROM r l JOIN r ON l.kind = r.kind AND l.id < r.id),
pairs AS (SELECT * FROM p WHERE s1 OR s2 OR s3 OR s4)"""
_FACTS = """, f AS (SELECT left_id, right_id, l.part_key = r.part_key AND NOT (l.unknown OR r.unknown) AS compatible, l.unknown OR r.unknown AS unknown, l.subject = r.subject AS sub, l.object = r.object AS obj, s3 AS same_key,
  l.statement = r.statement AS st, l.value IS NOT DISTINCT FROM r.value AS val, l.path IS NOT DISTINCT FROM r.path AS pat, coalesce(l.value, l.object) <> coalesce(r.value, r.object) AS differs, l.family <> r.family AS fam,
  l.version IS DISTINCT FROM r.version AS ver, (l.scope = 'client_specific_candidate') AS lc, (r.scope = 'client_specific_candidate') AS rc, l.source <> r.source AS src, l.value <> r.value AS cfg, l.path <> r.path AS proc,
  s1 OR l.subject = r.subject OR (length(l.subject) > 3 AND length(r.subject) > 3 AND (contains(l.subject, r.subject) OR contains(r.subject, l.subject))) AS akin,
  (l.value IS NOT NULL AND r.value IS NULL)::INT + (l.path IS NOT NULL AND r.path IS NULL)::INT AS more_l, (r.value IS NOT NULL AND l.value IS NULL)::INT + (r.path IS NOT NULL AND l.path IS NULL)::INT AS more_r,
  coalesce(l.value <> r.value, false) OR coalesce(l.path <> r.path, false) AS clash, (l.value IS NOT NULL OR r.value IS NOT NULL) AS any_key,
  len(list_distinct(list_intersect(string_split(l.statement, ' '), string_split(r.statement, ' ')))) * 1.0 / greatest(len(list_distinct(string_split(l.statement, ' '))), len(list_distinct(string_split(r.statement, ' ')))) AS alike
  FROM pairs JOIN r l ON l.id = left_id JOIN r ON r.id = right_id),
decisions AS (SELECT left_id, right_id, compatible, unknown, CASE WHEN compatible AND sub AND obj AND st AND val AND pat THEN 'exact_duplicate' WHEN compatible AND sub AND differs THEN 'conflict'
  WHEN akin AND unknown THEN 'requires_review' WHEN akin AND fam THEN 'product_variant' WHEN akin AND ver THEN 'version_variant' WHEN akin AND (lc <> rc OR (lc AND rc AND src)) THEN 'client_variant'
  WHEN akin AND cfg AND sub THEN 'configuration_variant' WHEN akin AND proc THEN 'process_variant'
  WHEN compatible AND sub AND NOT clash AND more_l > 0 AND more_r > 0 THEN 'requires_review' WHEN compatible AND sub AND NOT clash AND more_l + more_r > 0 THEN 'enrich_existing'
  WHEN compatible AND 1 + (sub AND (NOT any_key OR val) AND (any_key OR obj))::INT + same_key::INT + obj::INT >= 2 THEN 'semantic_duplicate' WHEN compatible AND alike >= 0.7 THEN 'requires_review'
  WHEN compatible THEN 'unrelated' ELSE 'requires_review' END AS relation FROM f)"""
_CLUSTERS = """, links AS (SELECT left_id AS a, right_id AS b FROM decisions WHERE relation <> 'unrelated' UNION SELECT right_id, left_id FROM decisions WHERE relation <> 'unrelated'),
walk(a, b) AS (SELECT id, id FROM r UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
member AS (SELECT a AS id, min(b) AS cluster FROM walk GROUP BY a),
ends AS (SELECT left_id AS id, relation, compatible, unknown FROM decisions UNION ALL SELECT right_id, relation, compatible, unknown FROM decisions)"""


def _normal(spark, d):
    return linkage.representatives(linkage.normalised(records(spark, d)))


@query(_RECORDS.replace("RECURSIVE ", "") + """, k AS (SELECT id, unnest(list_distinct(list_filter(['kind:' || kind, 'subject:' || subject, 'predicate:size', 'family:' || family, 'domain:' || domain, 'version:' || version, 'hint:' || hint,
  CASE WHEN scope = 'client_specific_candidate' THEN 'scope:client' END] || list_transform(list_filter(string_split(subject, ' '), lambda t: length(t) > 1), lambda t: 'token:' || t), lambda x: x IS NOT NULL))) AS key FROM u)
SELECT key, count(*) AS records, min(id) AS first_id FROM k GROUP BY key""")
def blocking_keys(spark, d):
    """Everything by which records may meet, and how many do."""
    keys = linkage.blocking_keys(linkage.normalised(records(spark, d)))
    return keys.groupBy("key").agg(F.count("*").alias("records"), F.min("id").alias("first_id"))


@query(_RECORDS.replace("RECURSIVE ", "") + """ SELECT u.id, min(u.id) OVER (PARTITION BY kind, subject, object, statement, signature, source, value, path, hint, family, domain, version, scope, platform, area, ctx) AS class FROM u""")
def record_classes(spark, d):
    """The class of equal records that each belongs to."""
    return linkage.classes(linkage.normalised(records(spark, d)))


@query(_RECORDS.replace("RECURSIVE ", "") + """ SELECT left_id, right_id, array_to_string(list_filter([CASE WHEN s1 THEN 'shared_candidate_signature' END, CASE WHEN s4 THEN 'shared_correlation_hint' END,
CASE WHEN s3 THEN 'shared_kind_specific_semantic_key' END, CASE WHEN s2 THEN 'shared_non_generic_subject' END], lambda x: x IS NOT NULL), ',') AS signals FROM pairs""")
def record_pairs(spark, d):
    """Pairs of records of a kind with a strong signal in common."""
    return linkage.record_pairs(cut(_normal(spark, d))).withColumn("signals", F.array_join("signals", ","))


@query(_RECORDS.replace("RECURSIVE ", "") + _FACTS + " SELECT left_id, right_id, relation, compatible FROM decisions")
def relation_classes(spark, d):
    """What each pair of records is to the other."""
    return linkage.relations(_normal(spark, d)).select("left_id", "right_id", "relation", "compatible")


@query(_RECORDS + _FACTS + _CLUSTERS + """, facts AS (SELECT cluster, bool_or(relation = 'conflict') AS conflict, bool_or(relation = 'requires_review') AS review, bool_and(NOT compatible AND NOT unknown) AS apart FROM ends JOIN member USING (id) GROUP BY cluster)
SELECT id, cluster, CASE WHEN conflict IS NULL THEN 'insufficient_evidence' WHEN conflict THEN 'conflicting' WHEN apart THEN 'incompatible_variants' WHEN review THEN 'correlated_requires_review' ELSE 'correlated' END AS status FROM member LEFT JOIN facts USING (cluster)""")
def record_clusters(spark, d):
    """Clusters of related records and their states."""
    rows = cut(_normal(spark, d))
    decisions = linkage.telling(rows)
    return linkage.clusters(rows, decisions, linkage.links(rows, decisions))


@query(_RECORDS + _FACTS + _CLUSTERS + """, placed AS (SELECT member.id, cluster, part_key FROM member JOIN r USING (id)),
kinds AS (SELECT cluster, part_key, bool_or(relation = 'conflict') AS conflict, bool_or(ends_with(relation, '_variant')) AS variant, bool_or(relation = 'requires_review') AS review, bool_or(relation = 'exact_duplicate') AS exact,
  bool_or(relation = 'semantic_duplicate') AS semantic, bool_or(relation = 'enrich_existing') AS enriched, bool_and(relation = 'requires_review') AS only_review FROM ends JOIN placed USING (id) GROUP BY ALL)
SELECT cluster, min(id) AS first_id, count(*) AS occurrences, CASE WHEN any_value(conflict) THEN 'proposed_with_conflict' WHEN any_value(variant) THEN 'proposed_with_variants' WHEN any_value(review) THEN 'requires_review' ELSE 'proposed' END AS status,
CASE WHEN any_value(exact) THEN 'exact_collapsed' WHEN any_value(semantic) THEN 'semantically_grouped' WHEN any_value(enriched) THEN 'enriched' WHEN any_value(conflict) THEN 'conflict_partitioned' WHEN any_value(variant) THEN 'variant_partitioned'
WHEN count(*) > 1 AND any_value(only_review) THEN 'requires_review_before_merge' ELSE 'not_merged' END AS merge_status FROM placed LEFT JOIN kinds USING (cluster, part_key) GROUP BY cluster, part_key""")
def proposed_records(spark, d):
    """One record for each cluster and place where it applies."""
    rows = cut(_normal(spark, d))
    decisions = linkage.telling(rows)
    return linkage.proposed_records(rows, linkage.clusters(rows, decisions, linkage.links(rows, decisions)), decisions).drop("partition")


@query("""SELECT kind, subject, min(id) AS first_id, array_to_string(list_sort(list_distinct(flatten(list([source, 'size ' || object])))), ',') AS evidence, count(*) AS occurrences FROM
(SELECT p_partkey AS id, p_brand AS kind, p_name AS subject, 's' || (p_partkey % 3) AS source, p_size::VARCHAR AS object FROM part) GROUP BY kind, subject""")
def merged_evidence(spark, d):
    """Records of a kind and subject fall together, with the evidence of all."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("first_id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("subject"), F.array(F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("evidence"))
    return linkage.merged_evidence(rows, ["kind", "subject"], "evidence", "first_id").withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT c_custkey, c_custkey % 5 IN (0, 1) AS by_name, c_custkey % 100 = 42 AS by_number FROM customer")
def identity_match(spark, d):
    """People by name in either order, or by number whatever its leading zeros."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "Nowak Żaneta").when(k % 5 == 1, " ŻANETA   Nowak").when(k % 5 == 2, "Nowak Anna").when(k % 5 == 3, "Żaneta Nowakowska").otherwise(F.col("c_name"))
    number = F.lpad((k % 100).cast("string"), 8, "0")
    return table(spark, d, "customer").select("c_custkey", linkage.same_person(name, number, "żaneta NOWAK").alias("by_name"), linkage.same_person(name, number, "0042").alias("by_number"))


@query("""WITH known AS (SELECT DISTINCT p_name AS name FROM part), asked AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) ELSE replace(p_name, 'e', 'xy') END AS name FROM part)
SELECT a.name, k.name AS suggestion, levenshtein(a.name, k.name)::INT AS distance FROM asked a JOIN known k ON levenshtein(a.name, k.name) BETWEEN 1 AND 2 WHERE a.name NOT IN (SELECT name FROM known)""")
def name_suggestions(spark, d):
    """Known names within two letters of unknown ones."""
    k = F.col("p_partkey") % 3
    asked = table(spark, d, "part").select(F.when(k == 0, F.col("p_name")).when(k == 1, F.expr("substring(p_name, 2)")).otherwise(F.replace("p_name", F.lit("e"), F.lit("xy"))).alias("name"))
    return linkage.suggestions(asked, table(spark, d, "part").select(F.col("p_name").alias("name")))


@query(_RECORDS.replace("RECURSIVE ", "") + """ SELECT left_id, right_id, concat_ws(',', CASE WHEN l.platform <> r.platform THEN 'platform' END, CASE WHEN l.family IS DISTINCT FROM r.family THEN 'families' END, CASE WHEN l.domain IS DISTINCT FROM r.domain THEN 'domains' END,
CASE WHEN l.area IS DISTINCT FROM r.area THEN 'areas' END, CASE WHEN l.version IS DISTINCT FROM r.version THEN 'versions' END, CASE WHEN l.ctx IS DISTINCT FROM r.ctx THEN 'contexts' END, CASE WHEN l.scope <> r.scope THEN 'scope' END) AS differences FROM pairs JOIN r l ON l.id = left_id JOIN r ON r.id = right_id""")
def applicability_differences(spark, d):
    """In what the places differ where paired records apply."""
    both = linkage.record_pairs(cut(_normal(spark, d)), fields=linkage.APPLIES)
    found = linkage.differences(lambda c: F.col(f"left_{c}"), lambda c: F.col(f"right_{c}"))
    return both.select("left_id", "right_id", F.array_join(found, ",").alias("differences"))
