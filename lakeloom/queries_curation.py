"""Queries of curation rules, ledgers and accounts, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import candidates, curation, ledger, policy
from lakeloom.queries import query
from lakeloom.sources.cuts import cut
from lakeloom.sources.tables import table

_LEDGER = """l AS (SELECT event_id AS seq, CASE value::INT % 9 WHEN 0 THEN 'revoke' WHEN 1 THEN 'supersede' WHEN 2 THEN 'defer' WHEN 3 THEN 'reject' WHEN 4 THEN 'request_more_evidence' ELSE 'approve' END AS kind,
CASE WHEN event_id = 200 THEN NULL ELSE user_id % 40 END AS record, event_id * 3 AS revision, user_id AS task FROM (SELECT event_id, user_id, CASE WHEN event_id = 200 THEN 0 ELSE floor(value) END AS value FROM events))"""


def _ledger(spark, d):
    v = F.when(F.col("event_id") == 200, 0).otherwise(F.floor("value")) % 9
    kind = F.when(v == 0, "revoke").when(v == 1, "supersede").when(v == 2, "defer").when(v == 3, "reject").when(v == 4, "request_more_evidence").otherwise("approve")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") != 200, F.col("user_id") % 40).alias("record"), (F.col("event_id") * 3).alias("revision"), F.col("user_id").alias("task"))


@query(f"""WITH {_LEDGER}, m AS (SELECT *, lag(revision) OVER (PARTITION BY record ORDER BY seq) AS prior FROM l WHERE kind IN ('approve', 'supersede') AND record IS NOT NULL),
t AS (SELECT record, max(seq) AS made_at, arg_max(revision, seq) AS revision, arg_max(coalesce(CASE WHEN kind = 'supersede' THEN prior END, -1), seq) AS previous FROM m GROUP BY record),
v AS (SELECT record, max(seq) AS gone FROM l WHERE kind = 'revoke' AND record IS NOT NULL GROUP BY record), a AS (SELECT max(seq) AS gone_all FROM l WHERE kind = 'revoke' AND record IS NULL)
SELECT record, revision, CASE WHEN greatest(coalesce(gone, -1), coalesce(gone_all, -1)) > made_at THEN 'revoked' ELSE 'approved' END AS status, nullif(previous, -1) AS previous FROM t LEFT JOIN v USING (record), a""")
def approved_records(spark, d):
    """A ledger of approvals, supersessions and revocations folded into what stands."""
    return curation.approved_records(_ledger(spark, d))


_APPROVED = f"""WITH {_LEDGER}, m AS (SELECT *, lag(revision) OVER (PARTITION BY record ORDER BY seq) AS prior FROM l WHERE kind IN ('approve', 'supersede') AND record IS NOT NULL),
t AS (SELECT record, max(seq) AS made_at, arg_max(revision, seq) AS revision, arg_max(coalesce(CASE WHEN kind = 'supersede' THEN prior END, -1), seq) AS previous FROM m GROUP BY record),
v AS (SELECT record, max(seq) AS gone FROM l WHERE kind = 'revoke' AND record IS NOT NULL GROUP BY record), a AS (SELECT max(seq) AS gone_all FROM l WHERE kind = 'revoke' AND record IS NULL)
SELECT record, revision, CASE WHEN greatest(coalesce(gone, -1), coalesce(gone_all, -1)) > made_at THEN 'revoked' ELSE 'approved' END AS status, nullif(previous, -1) AS previous FROM t LEFT JOIN v USING (record), a"""


def _in_two(spark, d):
    rows = _ledger(spark, d)
    old = F.col("seq") < 700
    return ledger.folded(rows.where(~old), cut(ledger.folded(rows.where(old))))


@query(_APPROVED)
def advanced_records(spark, d):
    """The same ledger folded in two steps: the second starts from the state of the first."""
    return ledger.view(_in_two(spark, d))


@query(f"""WITH v AS ({_APPROVED}), h AS (SELECT sha256(coalesce(record::VARCHAR, '') || '|' || coalesce(revision::VARCHAR, '') || '|' || status || '|' || coalesce(previous::VARCHAR, '')) AS h FROM v)
SELECT count(*) AS rows, concat_ws('-', {", ".join(f"(sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR" for i in range(4))}) AS digest FROM h""")
def ledger_view_hash(spark, d):
    """A digest of what stands, whatever the order of its rows."""
    return ledger.view_hash(ledger.view(_in_two(spark, d)), "record", "revision", "status", "previous")


@query("""WITH e AS (SELECT event_id, 'evt:' || sha256('{"kind":"' || event_type || '","user":' || user_id || '}') AS content_id FROM events) SELECT content_id, count(*) AS events, min(event_id) AS first_event FROM e GROUP BY 1""")
def event_ids(spark, d):
    """Ids of events by their content: the same decision has the same id."""
    rows = table(spark, d, "events").select("event_id", ledger.event_id({"user": F.col("user_id"), "kind": F.col("event_type")}).alias("content_id"))
    return rows.groupBy("content_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("""WITH s AS (SELECT event_id + 1 AS seq, sha256(event_id || '|' || event_type) AS good FROM events), x AS (SELECT seq, CASE WHEN seq % 50 = 0 THEN upper(good) ELSE good END AS sha, good, CASE WHEN seq % 70 = 0 THEN 'x' WHEN seq > 1 THEN 'prior' END AS prev FROM s WHERE seq % 90 <> 0), p AS (SELECT seq + 1 AS seq, sha AS prior FROM x)
SELECT seq, 'content' AS fault FROM x WHERE sha <> good UNION ALL SELECT seq, 'gap' FROM x LEFT JOIN p USING (seq) WHERE p.prior IS NULL AND seq > 1 UNION ALL SELECT x.seq, 'link' FROM x JOIN p ON p.seq = x.seq JOIN s ON s.seq = x.seq - 1 WHERE CASE prev WHEN 'prior' THEN s.good ELSE prev END <> p.prior""")
def ledger_faults(spark, d):
    """Where a chain with changed, missing and wrongly linked events breaks."""
    rows = table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))
    good = F.sha2("payload", 256)
    prior = rows.select((F.col("seq") + 1).alias("seq"), good.alias("prior"))
    chain = rows.join(prior, "seq", "left").where("seq % 90 <> 0").select("seq", "payload", F.when(F.col("seq") % 50 == 0, F.upper(good)).otherwise(good).alias("event_sha"), F.when(F.col("seq") % 70 == 0, "x").otherwise(F.col("prior")).alias("previous_sha"))
    return ledger.chain_faults(chain, F.col("payload"))


@query(f"""WITH {_LEDGER} SELECT task, CASE arg_max(kind, seq) WHEN 'defer' THEN 'deferred' WHEN 'request_more_evidence' THEN 'requires_more_evidence' WHEN 'reject' THEN 'rejected' ELSE 'decided' END AS status FROM l GROUP BY task""")
def task_states(spark, d):
    """What a ledger leaves each task in."""
    return curation.task_states(_ledger(spark, d))


@query("""WITH t AS (SELECT c_custkey AS task, CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal > 9000 THEN 'high' WHEN c_custkey % 3 = 0 THEN 'low' ELSE 'normal' END AS priority, c_mktsegment AS reasons FROM customer)
SELECT task, priority, reasons FROM t ORDER BY list_position(['critical', 'high', 'normal', 'low'], priority), reasons, task LIMIT 70""")
def review_queue(spark, d):
    """The first seventy tasks of a review, in the order of work."""
    p = F.when(F.col("c_acctbal") < 0, "critical").when(F.col("c_acctbal") > 9000, "high").when(F.col("c_custkey") % 3 == 0, "low").otherwise("normal")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), p.alias("priority"), F.array("c_mktsegment").alias("reasons"))
    return curation.review_queue(rows, 70).withColumn("reasons", F.array_join("reasons", "|"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) >= 200 AS limit_reached FROM orders ORDER BY o_orderkey LIMIT 200")
def capped_orders(spark, d):
    """The default cap, and whether it cut anything."""
    return curation.capped(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 200, "o_orderkey")


@query("SELECT n_nationkey, n_name, count(*) OVER () >= 25 AS limit_reached FROM nation ORDER BY n_nationkey LIMIT 25")
def capped_nations(spark, d):
    """A cap that as many rows meet as it allows counts as reached."""
    return curation.capped(table(spark, d, "nation").select("n_nationkey", "n_name"), 25, "n_nationkey")


@query("SELECT count(*)::BIGINT AS created, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS returned, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS accepted, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R'))::BIGINT AS other, true AS balanced FROM lineitem")
def reconciled_items(spark, d):
    """Counters of a life cycle, and whether they add up."""
    f = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(F.lit(1).alias("created"), (f == "R").alias("returned"), (f == "A").alias("accepted"), (~f.isin("A", "R")).alias("other"))
    return curation.reconciled(rows, "created", "returned", "accepted", "other")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 <> 3)
SELECT coalesce(e.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'stored' END AS outcome FROM e FULL JOIN s ON e.k = s.k""")
def accounted_customers(spark, d):
    """Keys that should be stored against those that are."""
    return curation.accounted(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT arg_min(doc_id, (n_chars, doc_id)) AS kept, array_to_string(list_sort(list(doc_id)), ',') AS occurrences FROM documents GROUP BY lang, source, text HAVING count(*) > 1")
def scoped_duplicates(spark, d):
    """Equal texts within a scope: one stays, the others are remembered."""
    out = curation.exact_groups_by_scope(table(spark, d, "documents"), ["lang", "source"], F.col("text"), "doc_id", "n_chars")
    return out.where(F.size("occurrences") > 1).withColumn("occurrences", F.array_join("occurrences", ","))


@query("SELECT doc_id, sha256(text) AS content_sha, sha256(doc_id || ':' || sha256(text)) AS revision FROM documents")
def source_inventory(spark, d):
    """Fingerprints of sources and their revisions."""
    return curation.inventory(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS asset, count(*) AS files, length(any_value(text))::INT AS chars FROM documents GROUP BY 1")
def stored_assets(spark, d):
    """Contents stored once, by their hashes."""
    from lakeloom.sources.tables import store_assets

    return store_assets(table(spark, d, "documents"), "text").select("asset", "files", F.length("content").alias("chars"))


@query("""WITH n AS (SELECT p_partkey AS k, p_size % 5 AS a, p_name AS b FROM part WHERE p_partkey % 7 <> 0), t AS (SELECT p_partkey AS k, p_size % 4 AS a, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS b FROM part WHERE p_partkey % 5 <> 0),
f AS (SELECT coalesce(n.k, t.k) AS k, n.k IS NULL OR t.k IS NULL AS lost, n.a IS DISTINCT FROM t.a AS x, n.b IS DISTINCT FROM t.b AS y FROM n FULL JOIN t ON n.k = t.k)
SELECT k, CASE WHEN lost THEN 'missing' ELSE concat_ws(',', CASE WHEN x THEN 'a_changed' END, CASE WHEN y THEN 'b_changed' END) END AS reasons, lost OR x OR y AS stale FROM f""")
def stale_keys(spark, d):
    """What changed between two states of a key."""
    p = table(spark, d, "part")
    now = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("a"), F.col("p_name").alias("b"))
    then = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4).alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("b"))
    return curation.staleness(now, then, "k", ["a", "b"]).withColumn("reasons", F.array_join("reasons", ","))


#: Items of orders as observations of a part: some share an origin, some only a node, some have neither.
_OBSERVED = """o AS (SELECT l_partkey AS candidate, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 3 = 0 THEN 'origin' || (l_suppkey % 3) END AS origin, CASE WHEN l_linenumber % 3 = 1 THEN 'node' || (l_suppkey % 5) END AS node,
CASE WHEN l_orderkey % 11 > 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'oracle_metadata_ddl' WHEN 1 THEN 'application_label' ELSE 'sql_usage' END END AS family, CASE l_returnflag WHEN 'A' THEN 'verified_exact' WHEN 'R' THEN 'verified_composed' END AS strength,
[CASE WHEN l_linestatus = 'F' THEN 'identity' ELSE 'relation' END, 's' || (l_suppkey % 3)] AS supports, l_orderkey || '/' || l_linenumber AS payload FROM lineitem),
f AS (SELECT *, coalesce(origin, node, sha256(payload)) AS lineage FROM o WHERE family IS NOT NULL),
l AS (SELECT candidate, lineage, arg_min(family, seq) AS family, arg_min(coalesce(strength, 'supported_by_single_authoritative_mapping'), seq) AS strength, list_sort(list_distinct(flatten(list(supports)))) AS supports, count(*) - 1 AS folded FROM f GROUP BY ALL)"""


def _observed(spark, d):
    rows, k = table(spark, d, "lineitem"), F.col("l_suppkey")
    n = F.col("l_linenumber")
    family = F.when(F.col("l_orderkey") % 11 > 0, F.when(k % 4 == 0, "oracle_metadata_ddl").when(k % 4 == 1, "application_label").otherwise("sql_usage"))
    strength = F.when(F.col("l_returnflag") == "A", "verified_exact").when(F.col("l_returnflag") == "R", "verified_composed")
    text = lambda name, m: F.concat(F.lit(name), (k % m).cast("string"))
    supports = F.array(F.when(F.col("l_linestatus") == "F", "identity").otherwise("relation"), text("s", 3))
    payload = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string"))
    # lines of equal numbers: the one that stands first in the table
    number = F.col("l_orderkey") * 10 + n
    seq = F.when(number.isNotNull(), F.struct(number.alias("n"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return rows.select(F.col("l_partkey").alias("candidate"), seq.alias("seq"), F.when(n % 3 == 0, text("origin", 3)).alias("origin"), F.when(n % 3 == 1, text("node", 5)).alias("node"), family.alias("family"), strength.alias("strength"), supports.alias("supports"), payload.alias("payload"))


@query(f"""WITH {_OBSERVED} SELECT candidate, lineage, 'ev:' || family || ':' || left(sha256(lineage), 12) AS evidence_id, family, strength, array_to_string(supports, ',') AS supports, folded FROM l""")
def evidence_lineages(spark, d):
    """Observations of one origin as one, with all that they support."""
    return policy.lineages(_observed(spark, d)).withColumn("supports", F.array_join("supports", ","))


_INDEPENDENT = f"""{_OBSERVED}, p AS (SELECT ps AS candidate, count(*) AS n FROM (SELECT o_orderkey % 200 AS ps FROM orders WHERE o_orderstatus = 'P') GROUP BY 1),
g AS (SELECT candidate, count(*) AS groups, list_sort(list_distinct(list(family))) AS families, bool_or(strength = 'verified_exact') AS exact, bool_or(strength = 'verified_composed') AS composed, sum(folded)::BIGINT AS folded FROM l GROUP BY 1),
i AS (SELECT coalesce(g.candidate, p.candidate) AS candidate, coalesce(groups, 0) AS groups, coalesce(families, []) AS families, CASE WHEN groups IS NULL THEN 'inferred' WHEN len(families) >= 2 THEN 'supported_by_multiple_independent_edges' WHEN exact THEN 'verified_exact' WHEN composed THEN 'verified_composed' ELSE 'supported_by_single_authoritative_mapping' END AS strength, coalesce(folded, 0) AS folded, coalesce(n, 0) AS prior_approvals FROM g FULL JOIN p ON g.candidate = p.candidate)"""


def _independent(spark, d):
    approvals = table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 200).alias("candidate"))
    return policy.independent_evidence(_observed(spark, d), approvals)


@query(f"""WITH {_INDEPENDENT} SELECT candidate, groups, array_to_string(families, ',') AS families, strength, folded, prior_approvals FROM i""")
def independent_evidence(spark, d):
    """What each candidate's evidence amounts to; earlier approvals don't count as evidence."""
    return _independent(spark, d).withColumn("families", F.array_join("families", ","))


#: Facts about candidates, drawn from their keys so that every rule and state comes up.
_CLASSES = ("concept", "relation", "temporal", "value", "identity", "display")
_FACTS = """fact AS (SELECT candidate, CASE candidate % 5 WHEN 0 THEN 'normal_reference' WHEN 1 THEN 'temporal_sensitive' WHEN 2 THEN 'configuration_sensitive' WHEN 3 THEN 'payroll_sensitive' ELSE 'identity_sensitive' END AS rc, CASE WHEN candidate % 41 = 0 THEN 'conflicting' WHEN candidate % 43 = 0 THEN 'heuristic' ELSE strength END AS strength, groups % 4 AS groups,
list_filter([CASE WHEN candidate % 7 > 0 THEN 'concept' END, CASE WHEN candidate % 3 > 0 THEN 'relation' END, CASE WHEN candidate % 4 > 0 THEN 'temporal' END, CASE WHEN candidate % 6 > 0 THEN 'value' END, CASE WHEN candidate % 8 > 0 THEN 'identity' END, CASE WHEN candidate % 9 = 0 THEN 'display' END], lambda x: x IS NOT NULL) AS classes,
CASE WHEN candidate % 29 = 0 THEN ['a', 'b'] ELSE [] END AS conflicts, CASE WHEN candidate % 31 = 0 THEN ['x'] ELSE [] END AS ambiguities, CASE WHEN candidate % 13 = 0 THEN ['open_cardinality'] WHEN candidate % 13 = 1 THEN ['other'] ELSE [] END AS gaps, candidate % 23 = 0 AS mism, candidate % 37 = 0 AS infer, candidate % 47 = 0 AS heur, candidate % 3 = 0 AS expands,
CASE (candidate // 3) % 4 WHEN 0 THEN 'proven' WHEN 1 THEN 'partial' WHEN 2 THEN 'unproven' ELSE 'conflicting' END AS scope, CASE candidate % 10 WHEN 8 THEN 'unresolved' WHEN 9 THEN 'unproven' WHEN 7 THEN 'partial' ELSE 'proven' END AS grain, candidate % 11 > 0 AS facets, candidate % 12 > 0 AS exact, candidate % 14 > 0 AS eg, candidate % 16 > 0 AS ed, candidate % 2 = 0 AS dl, CASE WHEN candidate % 17 = 0 THEN ['role:pending', 'other:missing'] ELSE [] END AS inactive FROM i)"""


def _facts(spark, d):
    k, of = F.col("candidate"), lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    classes = F.array_compact(F.array(*(F.when(ok, F.lit(n)) for n, ok in zip(_CLASSES, (k % 7 > 0, k % 3 > 0, k % 4 > 0, k % 6 > 0, k % 8 > 0, k % 9 == 0)))))
    return _independent(spark, d).select(
        "candidate", pick(k % 5, "normal_reference", "temporal_sensitive", "configuration_sensitive", "payroll_sensitive", "identity_sensitive").alias("risk_class"), F.when(k % 41 == 0, "conflicting").when(k % 43 == 0, "heuristic").otherwise(F.col("strength")).alias("strength"),
        (F.col("groups") % 4).alias("groups"), classes.alias("classes"), F.when(k % 29 == 0, of("a", "b")).otherwise(of()).alias("conflicts"), F.when(k % 31 == 0, of("x")).otherwise(of()).alias("ambiguities"), F.when(k % 13 == 0, of("open_cardinality")).when(k % 13 == 1, of("other")).otherwise(of()).alias("gaps"),
        (k % 23 == 0).alias("hash_mismatch"), (k % 37 == 0).alias("inferred_only"), (k % 47 == 0).alias("heuristic_only"), (k % 3 == 0).alias("expands"), pick(F.floor(k / 3) % 4, "proven", "partial", "unproven", "conflicting").alias("scope"),
        F.when(k % 10 == 8, "unresolved").when(k % 10 == 9, "unproven").when(k % 10 == 7, "partial").otherwise("proven").alias("grain"), (k % 11 > 0).alias("facets_separated"), (k % 12 > 0).alias("exact_identity"), (k % 14 > 0).alias("employee_grain"), (k % 16 > 0).alias("employee_dependency"), (k % 2 == 0).alias("display_linked"),
        F.when(k % 17 == 0, of("role:pending", "other:missing")).otherwise(of()).alias("inactive"),
    )


@query(f"""WITH {_INDEPENDENT}, {_FACTS}, n AS (SELECT *, infer OR heur OR strength IN ('inferred', 'heuristic') AS inferred, len(conflicts) > 0 OR strength = 'conflicting' AS conf, grain = 'unresolved' OR len(list_filter(gaps, lambda g: regexp_matches(g, 'cardinality|multi_current|tie_ambiguity'))) > 0 AS open,
  CASE WHEN rc IN ('configuration_sensitive', 'payroll_sensitive') THEN 2 ELSE 1 END AS least, CASE rc WHEN 'normal_reference' THEN ['concept'] WHEN 'temporal_sensitive' THEN ['concept', 'relation', 'temporal'] WHEN 'configuration_sensitive' THEN ['concept', 'relation'] WHEN 'payroll_sensitive' THEN ['concept', 'value'] ELSE ['identity', 'concept'] END AS needs,
  list_contains(classes, 'concept') OR list_contains(classes, 'display') AS meant FROM fact),
m AS (SELECT *, mism OR conf OR inferred OR len(ambiguities) > 0 AS ends FROM n),
t AS (SELECT *, list_concat([{{'r': 'stale.graphHashMismatch', 'q': 'hash_match', 'a': CASE WHEN mism THEN 'mismatch' ELSE 'match' END, 'p': NOT mism, 'b': true}}],
  list_filter([CASE WHEN NOT mism THEN {{'r': 'ambiguityConflict.conflict', 'q': 'no_conflicts', 'a': coalesce(nullif(array_to_string(conflicts, ','), ''), 'none'), 'p': NOT conf, 'b': true}} END,
    CASE WHEN NOT mism AND NOT conf THEN {{'r': 'strength.blockedInferredHeuristic', 'q': 'not_inferred_or_heuristic', 'a': strength, 'p': NOT inferred, 'b': true}} END,
    CASE WHEN NOT mism AND NOT conf AND NOT inferred THEN {{'r': 'ambiguityConflict.ambiguity', 'q': 'no_ambiguities', 'a': coalesce(nullif(array_to_string(ambiguities, ','), ''), 'none'), 'p': len(ambiguities) = 0, 'b': true}} END,
    CASE WHEN NOT ends THEN {{'r': 'risk.minimumIndependentObservationGroups', 'q': '>=' || least, 'a': groups::VARCHAR, 'p': groups >= least, 'b': true}} END], lambda x: x IS NOT NULL),
  CASE WHEN ends THEN [] ELSE list_transform(needs, lambda c: {{'r': 'risk.requiredSemanticClass.' || c, 'q': 'has_' || c, 'a': CASE WHEN list_contains(classes, c) THEN 'present' ELSE 'missing' END, 'p': list_contains(classes, c), 'b': true}}) END,
  CASE WHEN ends THEN [] ELSE list_filter([CASE WHEN rc <> 'identity_sensitive' THEN {{'r': 'risk.businessMeaningBeyondDdl', 'q': 'business_meaning_not_ddl_alone', 'a': CASE WHEN meant THEN 'present' ELSE 'ddl_or_missing' END, 'p': meant, 'b': true}} END,
    CASE WHEN rc = 'identity_sensitive' THEN {{'r': 'identity.facetSeparated', 'q': 'facet_separated', 'a': facets::VARCHAR, 'p': facets, 'b': true}} END, CASE WHEN rc = 'identity_sensitive' THEN {{'r': 'identity.exactSemanticEvidence', 'q': 'exact_identity_semantic_evidence', 'a': CASE WHEN exact THEN 'present' ELSE 'missing_or_ddl_only' END, 'p': exact, 'b': true}} END,
    CASE WHEN rc = 'identity_sensitive' THEN {{'r': 'identity.employeeGrainDependency', 'q': 'employee_grain_dependency_satisfied', 'a': ed::VARCHAR, 'p': ed, 'b': true}} END,
    CASE WHEN expands THEN {{'r': 'scope.explicitAssessment', 'q': 'assessment_present', 'a': scope, 'p': true, 'b': false}} END, CASE WHEN expands THEN {{'r': 'scope.unprovenBlocks', 'q': 'proven', 'a': scope, 'p': scope = 'proven', 'b': true}} END,
    CASE WHEN expands AND scope = 'conflicting' THEN {{'r': 'scope.conflicting', 'q': 'not_conflicting', 'a': 'conflicting', 'p': false, 'b': true}} END, {{'r': 'grain.assessmentPresent', 'q': 'grain_assessment', 'a': grain, 'p': grain <> 'unproven', 'b': true}},
    CASE WHEN rc = 'normal_reference' THEN {{'r': 'grain.employeeGrainEvidence', 'q': 'employee_grain_evidence', 'a': CASE WHEN eg THEN 'present' ELSE 'missing' END, 'p': eg AND grain <> 'unproven', 'b': true}} END, CASE WHEN list_contains(classes, 'display') THEN {{'r': 'grain.displayLinkedToPosition', 'q': 'display_linked', 'a': dl::VARCHAR, 'p': dl, 'b': true}} END,
    CASE WHEN rc = 'temporal_sensitive' OR open THEN {{'r': 'grain.cardinalityResolved', 'q': 'cardinality_resolved', 'a': CASE WHEN open THEN 'unresolved' ELSE 'resolved' END, 'p': NOT open, 'b': true}} END,
    {{'r': 'strength.sufficientClass', 'q': 'one_of:{"|".join(policy.SUFFICIENT)}', 'a': strength, 'p': strength IN {policy.SUFFICIENT}, 'b': true}},
    {{'r': 'dependencies.reuseActivation', 'q': 'no_inactive_reuse_deps', 'a': CASE WHEN len(inactive) > 0 THEN 'role,other' ELSE 'none' END, 'p': len(inactive) = 0, 'b': false}}], lambda x: x IS NOT NULL) END) AS rules FROM m),
v AS (SELECT *, list_transform(list_filter(rules, lambda r: r.b AND NOT r.p), lambda r: r.r) AS failed FROM t),
w AS (SELECT *, CASE WHEN mism THEN 'stale' WHEN conf THEN 'conflicting' WHEN inferred THEN 'needs_more_evidence' WHEN len(ambiguities) > 0 THEN 'ambiguous' WHEN len(failed) > 0 THEN 'needs_more_evidence' ELSE 'sufficient_for_decision' END AS assessment, CASE WHEN ends THEN [] ELSE inactive END AS dead FROM v)
SELECT candidate, assessment, CASE assessment WHEN 'sufficient_for_decision' THEN 'ready_for_approval_decision' WHEN 'ambiguous' THEN 'blocked_ambiguity' WHEN 'conflicting' THEN 'blocked_conflict' WHEN 'stale' THEN 'blocked_stale' ELSE 'blocked_more_evidence' END AS readiness, array_to_string(failed, ',') AS failed,
array_to_string(list_transform(rules, lambda r: r.r || '|' || r.q || '|' || r.a || '|' || CASE WHEN r.p THEN 1 ELSE 0 END || CASE WHEN r.b THEN 1 ELSE 0 END), ';') AS rules, len(dead) > 0 OR assessment <> 'sufficient_for_decision' OR (expands AND scope <> 'proven') AS reuse_blocked,
array_to_string(list_concat(list_transform(dead, lambda x: 'inactive_dependency:' || x), CASE WHEN expands AND scope <> 'proven' THEN ['scope_expansion_' || scope] ELSE [] END, list_transform(failed, lambda x: 'rule:' || x)), ',') AS block_reasons FROM w""")
def evidence_verdicts(spark, d):
    """Candidates judged by a policy of five risk classes, with the trace of its rules."""
    out = policy.assessed(_facts(spark, d), policy.policy_rows(spark))
    line = lambda r: F.concat_ws("|", r["rule"], r["required"], r["actual"], F.concat(r["passed"].cast("int").cast("string"), r["blocking"].cast("int").cast("string")))
    return out.withColumns({"rules": F.array_join(F.transform("rules", line), ";"), "failed": F.array_join("failed", ","), "block_reasons": F.array_join("block_reasons", ",")})


@query("""WITH f AS (SELECT p_partkey AS k, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'application_semantic' END, CASE WHEN p_partkey % 3 = 0 THEN 'application_technical' END, CASE WHEN p_partkey % 5 < 3 THEN 'oracle_structural' END, CASE WHEN p_partkey % 7 = 0 THEN 'schema_convention' END], lambda x: x IS NOT NULL) AS f, p_size AS z FROM part),
s AS (SELECT *, list_contains(f, 'application_semantic') AS meant, len(list_intersect(f, ['application_technical', 'oracle_structural', 'implementation_usage'])) AS tech, z % 5 > 0 AND z % 7 > 0 AND (z % 3 > 0 OR z % 4 > 0) AS sound FROM f),
r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'conflicting' WHEN k % 19 = 0 THEN 'ambiguous' WHEN z % 11 = 0 OR z % 13 = 0 OR f = ['schema_convention'] THEN 'insufficient' WHEN k % 4 = 0 AND sound AND meant THEN 'proven_exact' WHEN meant AND tech >= 2 AND sound THEN 'strong_inference_readonly' ELSE 'insufficient' END AS status FROM s)
SELECT k, status, CASE status WHEN 'proven_exact' THEN 'eligible_for_bounded_readonly' WHEN 'strong_inference_readonly' THEN 'eligible_for_bounded_readonly_pilot' ELSE 'blocked' END AS eligibility FROM r""")
def role_statuses(spark, d):
    """How sure roles are, and whether a bounded read may use them."""
    k, z = F.col("p_partkey"), F.col("p_size")
    families = F.array_compact(F.array(*(F.when(ok, F.lit(f)) for ok, f in ((k % 2 == 0, "application_semantic"), (k % 3 == 0, "application_technical"), (k % 5 < 3, "oracle_structural"), (k % 7 == 0, "schema_convention")))))
    flags = {"contradicted": k % 17 == 0, "rivals": k % 19 == 0, "documentation_only": z % 11 == 0, "model_only": z % 13 == 0, "name_only": families == F.array(F.lit("schema_convention")), "direct_proof": k % 4 == 0, "whole_path": z % 5 > 0, "types_fit": z % 7 > 0, "needs_time": z % 3 == 0, "time_ok": z % 4 > 0}
    facts = table(spark, d, "part").select(k.alias("k"), families.alias("families"), *(c.alias(n) for n, c in flags.items()))
    return policy.role_status(facts).select("k", "status", "eligibility")


@query("""WITH c AS (SELECT l_partkey AS o, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 'temporal_predicate' WHEN 2 THEN 'negative_usage' WHEN 3 THEN CASE WHEN l_partkey % 6 = 0 THEN 'current_snapshot_source' ELSE 'label' END ELSE 'label' END AS ct, CASE l_suppkey % 9 WHEN 0 THEN 'valid_from' WHEN 1 THEN 'valid_to' WHEN 2 THEN 'assignment_grain' END AS rh,
  CASE WHEN l_partkey % 5 < 2 THEN 'schema_convention' ELSE 'implementation_usage' END AS fam, CASE WHEN l_quantity > 20 THEN 'col' || (l_suppkey % 4) END AS col FROM lineitem WHERE l_discount > 0.07),
s AS (SELECT o, arg_min(col, seq) FILTER (rh = 'valid_from' AND col IS NOT NULL AND NOT starts_with(ct, 'negative_')) AS fc, arg_min(col, seq) FILTER (rh = 'valid_to' AND col IS NOT NULL AND NOT starts_with(ct, 'negative_')) AS tc, bool_or(fam = 'implementation_usage' AND (coalesce(rh IN ('valid_from', 'valid_to'), false) OR ct IN ('temporal_predicate', 'temporal_period_labels', 'period_semantics', 'current_snapshot_source'))) AS sup, bool_or(ct = 'current_snapshot_source' OR coalesce(rh = 'assignment_grain', false)) AS snap FROM c GROUP BY o),
g AS (SELECT p_partkey AS o, p_size % 8 AS z, p_size % 3 = 0 AS weak FROM part), j AS (SELECT g.o, z, p.p_size % 10 > 0 AS needs, sup, snap, coalesce(fc, CASE WHEN z < 3 AND NOT weak THEN 'data_od' END) AS f, coalesce(tc, CASE WHEN z < 2 AND NOT weak THEN 'data_do' END) AS t, CASE WHEN z = 2 AND NOT weak THEN 'aktualny' END AS flag FROM g JOIN part p ON p_partkey = g.o LEFT JOIN s ON s.o = g.o),
m AS (SELECT *, CASE WHEN NOT needs THEN 'unresolved' WHEN flag IS NOT NULL AND coalesce(sup, false) THEN 'exact_current_flag' WHEN f IS NOT NULL AND t IS NOT NULL AND coalesce(sup, false) THEN 'effective_date_range' WHEN f IS NOT NULL AND t IS NOT NULL THEN 'unresolved' WHEN snap THEN 'current_snapshot_source' ELSE 'unresolved' END AS mode FROM j)
SELECT o AS object, mode, CASE WHEN needs AND f IS NOT NULL AND t IS NOT NULL AND mode <> 'exact_current_flag' THEN f END AS valid_from, CASE WHEN needs AND f IS NOT NULL AND t IS NOT NULL AND mode <> 'exact_current_flag' THEN t END AS valid_to, CASE WHEN mode = 'exact_current_flag' THEN flag END AS current_flag FROM m""")
def temporal_roles(spark, d):
    """How the current row of each object is told: by a flag, a range, a snapshot, or not at all."""
    p, i = table(spark, d, "part"), table(spark, d, "lineitem").where("l_discount > 0.07")
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    kind = F.when(n == 1, "temporal_predicate").when(n == 2, "negative_usage").when((n == 3) & (F.col("l_partkey") % 6 == 0), "current_snapshot_source").otherwise("label")
    hint = F.when(k % 9 == 0, "valid_from").when(k % 9 == 1, "valid_to").when(k % 9 == 2, "assignment_grain")
    claims = i.select(F.col("l_partkey").alias("object"), (F.col("l_orderkey") * 10 + n).alias("seq"), kind.alias("claim_type"), hint.alias("role_hint"), F.when(F.col("l_partkey") % 5 < 2, "schema_convention").otherwise("implementation_usage").alias("family"), F.when(F.col("l_quantity") > 20, F.concat(F.lit("col"), (k % 4).cast("string"))).alias("column"))
    z = F.col("p_size") % 8
    role = lambda name, column, ok, seq: F.when(ok, F.struct(F.lit(name).alias("role"), F.lit(column).alias("column"), F.lit(seq).alias("seq")))
    guessed = F.array_compact(F.array(role("valid_from", "data_od", z < 3, 1), role("valid_to", "data_do", z < 2, 2), role("current_flag", "aktualny", z == 2, 3)))
    inferred = p.select(F.col("p_partkey").alias("object"), (F.col("p_size") % 3 == 0).alias("convention_only"), F.inline(guessed))
    return policy.temporal_roles(p.select(F.col("p_partkey").alias("object"), (F.col("p_size") % 10 > 0).alias("needs_time")), claims, inferred)


@query("""SELECT 'orders' AS name, count(*) AS rows, count(*) AS keys, 'proven' AS verdict FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), 'unproven' FROM lineitem UNION ALL SELECT 'none', 0, 0, 'not_evaluable' UNION ALL SELECT 'union', count(*), count(*), 'supported_partial' FROM customer""")
def key_verdicts(spark, d):
    """Whether keys still tell rows apart."""
    o, i, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    parts = [("orders", curation.key_kept(o, ["o_orderkey"])), ("lineitem", curation.key_kept(i, ["l_orderkey"])), ("none", curation.key_kept(o.limit(0), ["o_orderkey"])), ("union", curation.key_kept(c, ["c_custkey"], F.lit(True)))]
    out = None
    for name, df in parts:
        own = df.select(F.lit(name).alias("name"), "rows", "keys", "verdict")
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH o AS (SELECT p_brand AS a, p_type AS b, max(p_size) / 50.0 AS confidence, count(*) AS use_count, CASE WHEN p_brand = 'Brand#2' THEN 'seed' ELSE 'learned' END AS source FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2, 5), n AS (SELECT p_brand AS a, p_type AS b, p_size / 50.0 AS confidence, 'learned' AS source FROM part WHERE p_partkey % 2 = 1)
SELECT a, b, max(confidence)::DOUBLE AS confidence, sum(use_count)::BIGINT AS use_count, CASE WHEN bool_or(source = 'seed') THEN 'seed' ELSE max(source) END AS source FROM (SELECT * FROM o UNION ALL SELECT a, b, confidence, 1, source FROM n) GROUP BY a, b""")
def upserted_links(spark, d):
    """Links learned again: the highest confidence, uses added, seeds stay seeds."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), (F.col("p_size") / 50.0).cast("double").alias("confidence"), "p_partkey")
    old = p.where("p_partkey % 2 = 0").groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.count("*").alias("use_count")).withColumn("source", F.when(F.col("a") == "Brand#2", "seed").otherwise("learned"))
    return curation.upserted_links(old, p.where("p_partkey % 2 = 1").withColumn("source", F.lit("learned")), ["a", "b"])


@query("""WITH p AS (SELECT page_id AS k, 'clip ' || md5(page_id::VARCHAR)[:9] AS b FROM pages), l AS (SELECT k, 'in/x\\' || CASE WHEN k % 5 = 0 THEN upper(b) ELSE b END || '.json' AS name, CASE WHEN k % 5 = 0 THEN upper(b) ELSE b END AS base FROM p WHERE k % 7 > 0),
r AS (SELECT k, 'out/' || base AS name, base FROM (SELECT k, CASE WHEN k % 6 = 0 THEN b || 'x' ELSE b END AS base FROM p WHERE k % 4 > 0)) , r2 AS (SELECT * FROM r UNION ALL SELECT k, 'more/' || base, base FROM r WHERE k % 9 = 0),
g AS (SELECT lower(base) AS key, count(*) AS n, min({'name': name, 'base': base}) AS o FROM r2 GROUP BY 1), m AS (SELECT l.*, lower(l.base) AS key, n, o FROM l LEFT JOIN g ON g.key = lower(l.base)),
s AS (SELECT a.key, min({'d': levenshtein(a.key, g.key), 'k': g.key, 'n': g.o.name}) AS s FROM (SELECT DISTINCT key FROM m WHERE n IS NULL) a JOIN g ON levenshtein(a.key, g.key) BETWEEN 1 AND 2 GROUP BY 1)
SELECT name AS left_name, CASE WHEN n = 1 THEN o.name END AS right_name, s.n AS suggested, CASE WHEN m.n = 1 AND o.base = m.base THEN 'exact' WHEN m.n = 1 THEN 'case_insensitive_exact' WHEN m.n > 1 THEN 'ambiguous' WHEN s IS NOT NULL THEN 'requires_confirmation' ELSE 'missing' END AS outcome FROM m LEFT JOIN s ON s.key = m.key
UNION ALL SELECT NULL, name, NULL, 'orphan' FROM r2 WHERE lower(base) NOT IN (SELECT lower(base) FROM l)""")
def paired_files(spark, d):
    """Transcripts and folders of frames of the same name, and names that are only similar."""
    k, b = F.col("page_id"), F.concat(F.lit("clip "), F.substring(F.md5(F.col("page_id").cast("string")), 1, 9))
    p = table(spark, d, "pages")
    left = p.where(k % 7 > 0).select(F.concat(F.lit("in/x\\"), F.when(k % 5 == 0, F.upper(b)).otherwise(b), F.lit(".json")).alias("name"))
    base = F.when(k % 6 == 0, F.concat(b, F.lit("x"))).otherwise(b)
    right = p.where(k % 4 > 0).select(F.concat(F.lit("out/"), base).alias("name"))
    return curation.paired_files(left, right.unionByName(p.where((k % 4 > 0) & (k % 9 == 0)).select(F.concat(F.lit("more/"), base).alias("name"))))


@query("""SELECT p_type AS target, count(*) AS uses, count(DISTINCT p_brand) AS users FROM part GROUP BY 1""")
def impact_counts(spark, d):
    """How often each target is used, and by how many."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("target")).agg(F.count("*").alias("uses"), F.count_distinct("p_brand").alias("users"))


#: Sections planted with what the rules look for, a line each, by a part's size; the lines between mean nothing.
_LINES = (
    (2, "1. Krok dla {name}"), (3, "- drugi krok"), (5, "Wybierz pozycje {name}"), (7, "Pole musi miec wartosc {name}"), (4, "Po tym status zmienia się na zamkniety"), (11, "przejdzie z roboczy do gotowy"),
    (6, "Formularz korzysta z obiektu {brand}.X1"), (9, "Konfiguracja parametru PAR_{size}"), (8, "Umowa terminowa oznacza zobowiazanie na czas {name}"), (10, "SUMA = A + {size}"), (12, "To jest dokument faktury"), (13, "Uwaga: limit wynosi {size}"), (14, "Scenariusz testowy"), (15, "Status zmienia się na aktywny"),
)
_SECTION = "s AS (SELECT p_partkey AS id, CASE WHEN p_size % 16 = 0 THEN 'Proces ' || p_name ELSE 'Tytul ' || p_size END AS title, array_to_string(list_filter([CASE WHEN p_size % 16 = 0 THEN 'wejscie' END, " + ", ".join(f"CASE WHEN p_size % {m} = 0 THEN '" + t.replace("{name}", "' || p_name || '").replace("{brand}", "' || replace(p_brand, '#', '') || '").replace("{size}", "' || p_size || '") + "' END" for m, t in _LINES) + ", CASE WHEN p_size % 16 = 0 THEN 'Warunek: a' || chr(10) || 'Wynik: b' END], lambda x: x IS NOT NULL), chr(10)) AS t, p_size AS z, p_name AS n, replace(p_brand, '#', '') AS b FROM part)"


def _sections(spark, d):
    name, size, brand = F.col("p_name"), F.col("p_size").cast("string"), F.replace("p_brand", F.lit("#"), F.lit(""))

    def line(text: str):
        import re

        by = {"name": name, "size": size, "brand": brand}
        return F.concat(*(by[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", text) if x))

    process = F.col("p_size") % 16 == 0
    lines = [F.when(process, "wejscie"), *(F.when(F.col("p_size") % m == 0, line(t)) for m, t in _LINES), F.when(process, "Warunek: a\nWynik: b")]
    title = F.when(process, F.concat(F.lit("Proces "), name)).otherwise(F.concat(F.lit("Tytul "), size))
    return table(spark, d, "part").select(F.col("p_partkey").alias("section_id"), title.alias("title"), F.array_join(F.array_compact(F.array(*lines)), "\n").alias("text"))


_CANDIDATES = f"""WITH {_SECTION}, steps AS (SELECT *, (z % 2 = 0)::INT + (z % 3 = 0)::INT AS k FROM s), c AS (
SELECT id, 'process_step' AS kind, 'Krok dla ' || n AS label, 1 AS steps FROM s WHERE z % 2 = 0 UNION ALL SELECT id, 'process_step', 'drugi krok', 1 FROM s WHERE z % 3 = 0 UNION ALL SELECT id, 'procedure', title, k FROM steps WHERE k = 2
UNION ALL SELECT id, 'action', 'Wybierz pozycje ' || n, 0 FROM s WHERE z % 5 = 0 UNION ALL SELECT id, 'validation_rule', 'Pole musi miec wartosc ' || n, 0 FROM s WHERE z % 7 = 0
UNION ALL SELECT id, 'state_transition', '→ zamkniety', 0 FROM s WHERE z % 4 = 0 UNION ALL SELECT id, 'state_transition', 'roboczy → gotowy', 0 FROM s WHERE z % 11 = 0
UNION ALL SELECT id, 'technical_relation', 'form_uses_object: ' || b || '.X1', 0 FROM s WHERE z % 6 = 0 UNION ALL SELECT id, 'parameter', 'PAR_' || z, 0 FROM s WHERE z % 9 = 0 UNION ALL SELECT id, 'business_concept', 'Umowa terminowa', 0 FROM s WHERE z % 8 = 0
UNION ALL SELECT id, 'calculation_rule', 'Reguła obliczeniowa', 0 FROM s WHERE z % 10 = 0 UNION ALL SELECT id, 'document_type', 'Dokument faktury / e-faktura', 0 FROM s WHERE z % 12 = 0 UNION ALL SELECT id, 'warning', 'Ostrzeżenie', 0 FROM s WHERE z % 13 = 0 UNION ALL SELECT id, 'test_case', 'Przypadek testowy', 0 FROM s WHERE z % 14 = 0
UNION ALL SELECT id, 'business_process', title, k FROM steps WHERE z % 16 = 0 AND k = 2)"""


@query(f"""{_CANDIDATES} SELECT id AS section_id, kind, label, steps::INT AS steps FROM c""")
def extracted_candidates(spark, d):
    """Candidates of fourteen kinds that rules find in sections of lines."""
    return candidates.extracted(_sections(spark, d)).select("section_id", "kind", "label", "steps")


@query(f"""{_CANDIDATES}, g AS (SELECT *, CASE WHEN id % 9 = 0 THEN 0 ELSE 1 END AS evidence, CASE WHEN id % 4 = 1 THEN CASE kind WHEN 'parameter' THEN 'Opis' WHEN 'business_concept' THEN 'uwagi' ELSE label END ELSE label END AS l, id % 4 = 2 AS bare FROM c),
o AS (SELECT *, CASE WHEN evidence = 0 THEN 'missing_evidence' WHEN kind = 'business_concept' AND l = 'uwagi' THEN 'generic_heading_as_business_concept' WHEN kind = 'parameter' AND l = 'Opis' THEN 'generic_table_column_as_parameter' WHEN kind = 'test_case' AND id NOT IN (SELECT id FROM s WHERE z % 9 = 0) THEN 'test_case_missing_structure' WHEN bare THEN CASE kind WHEN 'business_concept' THEN 'business_concept_weak_context' WHEN 'parameter' THEN 'parameter_missing_config_evidence'
  WHEN 'calculation_rule' THEN 'calculation_rule_missing_formula' WHEN 'action' THEN 'action_missing_verb' WHEN 'validation_rule' THEN 'validation_rule_missing_constraint' WHEN 'test_case' THEN 'test_case_missing_structure' WHEN 'technical_relation' THEN 'technical_relation_missing_link' WHEN 'process_step' THEN 'process_step_missing_order' WHEN 'procedure' THEN 'procedure_missing_steps' WHEN 'business_process' THEN 'business_process_missing_structure' END END AS code FROM g)
SELECT id AS section_id, kind, l AS label, CASE WHEN code IS NULL THEN 'accept' WHEN code IN ('business_concept_weak_context', 'process_step_missing_order') THEN 'downgrade' ELSE 'reject' END AS outcome, code, CASE WHEN code IN ('business_concept_weak_context', 'process_step_missing_order') OR code IS NULL THEN NULL WHEN code = 'generic_heading_as_business_concept' THEN 'generic_heading' WHEN code = 'generic_table_column_as_parameter' THEN 'generic_table_column' WHEN code = 'parameter_missing_config_evidence' THEN 'weak_parameter_evidence' WHEN code = 'missing_evidence' THEN 'missing_source_evidence' ELSE 'missing_kind_specific_evidence' END AS reason FROM o""")
def quality_gates(spark, d):
    """What the gates of each kind make of candidates; some are robbed of their label, statement or evidence first."""
    rows, k = candidates.extracted(_sections(spark, d)), F.col("section_id")
    label = F.when((k % 4 == 1) & (F.col("kind") == "parameter"), "Opis").when((k % 4 == 1) & (F.col("kind") == "business_concept"), "uwagi").otherwise(F.col("label"))
    bare = k % 4 == 2
    rows = rows.withColumns({"label": label, "evidence": F.when(k % 9 == 0, 0).otherwise(1), "statement": F.when(bare, "puste").otherwise(F.col("statement")), "steps": F.when(bare, 0).otherwise(F.col("steps")), "name": F.when(~bare, F.col("name"))})
    return candidates.gated(rows).select("section_id", "kind", "label", "outcome", "code", "reason")


@query("""SELECT DISTINCT l_orderkey, l_partkey AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE 'red%'""")
def tagged_links(spark, d):
    """Links by the tags that they carry."""
    links = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("tag_id"))
    return curation.tagged(links, table(spark, d, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("tag")), "red%")
