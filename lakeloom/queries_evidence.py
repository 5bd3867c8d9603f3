"""Queries of rules over evidence, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators import classify, evidence, runs
from lakeloom.queries import query
from lakeloom.sources.tables import table


@query('SELECT p_partkey AS "Number", p_name AS "Name", p_brand FROM part')
def labelled_parts(spark, d):
    """The first columns under their labels."""
    return evidence.labelled(table(spark, d, "part"), {"p_partkey": "Number", "p_name": "Name", "p_size": "Size"}, 3)


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'e' || length(text) END AS explicit, CASE WHEN role = 'user' THEN 'i' || (length(text) % 7) END AS implicit FROM conversations)
SELECT conv_id, turn, coalesce(explicit, implicit, last_value(coalesce(explicit, implicit) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS filter FROM t""")
def carried_filters(spark, d):
    """Filters of turns: explicit, implicit, or carried over from before."""
    user = F.col("role") == "user"
    explicit, implicit = F.when(user & (F.col("turn") % 4 == 0), F.concat(F.lit("e"), F.length("text").cast("string"))), F.when(user, F.concat(F.lit("i"), (F.length("text") % 7).cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", evidence.carried_filter(explicit, implicit, "conv_id", "turn").alias("filter"))


_INTENTS = ("source_disclosure", "comparison", "currentness", "procedure", "rules_details", "definition", "other")
_SHAPES = ("rules_pointer", "procedural", "definitional", "comparative", "rules_content", "other")


@query(f"""WITH q AS (SELECT p_partkey AS k, {list(_INTENTS)}[p_partkey % 7 + 1] AS intent, p_size % 5 <> 0 AS related, list_distinct(CASE WHEN p_size % 11 = 0 THEN [] ELSE [{list(_SHAPES)}[p_size % 6 + 1], {list(_SHAPES)}[p_partkey % 6 + 1]] END) AS s, p_size % 2 = 0 AS strong, p_size % 3 = 0 AS partial, p_partkey % 2 = 0 AS cited,
  ['answerable', 'partially_answerable', 'insufficient', 'blocked'][p_partkey % 4 + 1] AS answer FROM part),
c AS (SELECT *, CASE WHEN len(s) = 0 OR (NOT related AND intent <> 'source_disclosure') THEN 'not_related' WHEN intent = 'source_disclosure' THEN 'related_but_not_answering'
  WHEN intent = 'rules_details' THEN CASE WHEN list_contains(s, 'rules_pointer') THEN CASE WHEN list_has_any(s, ['rules_content', 'procedural', 'definitional']) THEN 'answers_question' ELSE 'related_but_not_answering' END WHEN list_has_any(s, ['rules_content', 'definitional', 'other', 'procedural']) THEN 'partially_answers_question' ELSE 'related_but_not_answering' END
  WHEN intent = 'definition' THEN CASE WHEN list_contains(s, 'definitional') THEN 'answers_question' ELSE 'partially_answers_question' END WHEN intent = 'procedure' THEN CASE WHEN NOT list_contains(s, 'procedural') THEN 'related_but_not_answering' WHEN partial THEN 'partially_answers_question' ELSE 'answers_question' END
  WHEN intent IN ('comparison', 'currentness') THEN 'related_but_not_answering' WHEN strong THEN 'answers_question' ELSE 'partially_answers_question' END AS coverage FROM q)
SELECT k, coverage, CASE WHEN answer IN ('blocked', 'insufficient') OR coverage = 'answers_question' THEN answer WHEN coverage = 'not_related' THEN 'insufficient' WHEN coverage = 'partially_answers_question' THEN 'partially_answerable' WHEN cited THEN 'partially_answerable' ELSE 'insufficient' END AS answer FROM c""")
def answer_coverage(spark, d):
    """How far claims answer questions, and what that leaves of an answer."""
    k, n = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    shapes = F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(pick(_SHAPES, n), pick(_SHAPES, k))))
    covered = evidence.coverage(pick(_INTENTS, k), n % 5 != 0, shapes, n % 2 == 0, n % 3 == 0)
    answer = pick(("answerable", "partially_answerable", "insufficient", "blocked"), k)
    return table(spark, d, "part").select(k.alias("k"), covered.alias("coverage"), evidence.answerable(answer, covered, k % 2 == 0).alias("answer"))




#: Significant words in DuckDB: strip_accents would fold an ł as well, which the rule doesn't.
_STOP = ", ".join(f"'{w}'" for w in (*runs.COMMON, *runs.SHORT_NAMES))


def _significant(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({c}), '{fx.MARKS}', '{fx.BARE}'), '[^a-z0-9ąćęłńóśźż]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP}))"


def _islands(least: int, left: str, right: str) -> str:
    gram = lambda t, key, at: f"(SELECT {key}, i - 1 AS {at}, array_to_string(w[i:i+{least - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {least - 2})) AS i FROM {t} WHERE len(w) >= {least}))"
    return f"""m AS (SELECT DISTINCT {left}, {right}, la, ra FROM {gram('a', left, 'la')} JOIN {gram('c', right, 'ra')} USING (g)), n AS (SELECT *, la - row_number() OVER (PARTITION BY {left}, {right}, la - ra ORDER BY la) AS island FROM m),
r AS (SELECT {left}, {right}, min(la) AS la, min(ra) AS ra, count(*) + {least - 1} AS length FROM n GROUP BY {left}, {right}, la - ra, island)"""


@query(f"""WITH a AS (SELECT doc_id, {_significant('text')} AS w FROM documents), c AS (SELECT item_id, {_significant('text')} AS w FROM benchmark), {_islands(10, 'doc_id', 'item_id')}
SELECT doc_id AS answer_id, item_id AS claim_id, la::INT AS answer_at, ra::INT AS claim_at, length::INT AS length FROM r""")
def verbatim_answers(spark, d):
    """Runs of ten significant words or more that documents have from benchmark items, and where."""
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text")
    return runs.verbatim_runs(answers, table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text"))


@query(f"""WITH s AS (SELECT doc_id, regexp_extract_all('X: „' || replace(text, chr(10), '” ja „') || '”.', '[„""«»]([^„""«»]{{16,}})[”“"»]', 1) AS qs FROM documents), q AS (SELECT doc_id, unnest(qs) AS said, unnest(range(len(qs))) AS quote FROM s),
a AS (SELECT {{'d': doc_id, 'q': quote}} AS q, trim(said) AS said, {_significant('trim(said)')} AS w FROM q), k AS (SELECT item_id, trim(regexp_replace(text, '^[-–•\\s]+', '')) AS core FROM benchmark), c AS (SELECT item_id, core, {_significant('core')} AS w FROM k WHERE length(core) >= 24), {_islands(6, 'q', 'item_id')},
few AS (SELECT q, said, a.w AS w, unnest(range(1, len(c.w) - len(a.w) + 2)) AS pos, c.item_id, c.core, c.w AS cw FROM a JOIN c ON contains(c.core, a.said) WHERE len(a.w) BETWEEN 1 AND 5), f AS (SELECT q, item_id, pos - 1 AS ra, len(w) AS length FROM few WHERE cw[pos:pos+len(w)-1] = w),
u AS (SELECT q, item_id, ra, length FROM r UNION ALL SELECT * FROM f) SELECT q.d AS answer_id, item_id AS claim_id, q.q::INT AS quote, (arg_min(ra, (-length, ra)))::INT AS claim_at, max(length)::INT AS length FROM u GROUP BY q, item_id""")
def quoted_claims(spark, d):
    """Quotations, here each line of a document, that have six significant words in a row from a benchmark item or stand in it."""
    said = F.concat(F.lit("X: „"), F.replace("text", F.lit("\n"), F.lit("” ja „")), F.lit("”."))
    answers = table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), said.alias("text"))
    return runs.quoted_claims(answers, table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text"))


@query("""SELECT p_partkey AS id, concat_ws(',', CASE WHEN lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size < 10) THEN 'lexicon' END, CASE WHEN lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 45) THEN 'help' END) AS anchors FROM part""")
def record_anchors(spark, d):
    """Indexes that already know a record's label."""
    p = table(spark, d, "part")
    label = F.upper("p_name").alias("label")
    out = evidence.anchors(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), {"lexicon": p.where("p_size < 10").select(label), "help": p.where("p_size > 45").select(label)})
    return out.withColumn("anchors", F.array_join("anchors", ","))


@query("""WITH f AS (SELECT p_partkey AS question_id, unnest(list_filter([CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 'colour' END, CASE WHEN contains(' ' || p_name || ' ', ' blue ') THEN 'colour' END, CASE WHEN contains(p_name, 'ring') THEN 'shape' END, CASE WHEN p_name = 'red ring' THEN 'pair' END], lambda x: x IS NOT NULL)) AS concept FROM part),
g AS (SELECT DISTINCT * FROM f) SELECT question_id, 'painted' AS rule FROM g WHERE concept = 'colour' UNION ALL SELECT a.question_id, 'both' FROM g a JOIN g b USING (question_id) WHERE a.concept = 'colour' AND b.concept = 'shape'""")
def lexicon_rules(spark, d):
    """Concepts that questions name, and the rules whose concepts are all there."""
    lexicon = spark.createDataFrame([("colour", "Red"), ("colour", "blue"), ("shape", "RING"), ("pair", "red, ring")], "concept string, alias string")
    rules = spark.createDataFrame([("painted", "colour"), ("both", "colour"), ("both", "shape"), ("never", "shape"), ("never", "taste")], "rule string, concept string")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat(F.initcap("p_name"), F.lit("?")).alias("text"))
    return evidence.satisfied(evidence.concepts(asked, lexicon), rules)


@query("SELECT q AS question_id, arg_min(dim, (-(sep * 10 + ev), dim)) AS dimension FROM (SELECT p_partkey % 100 AS q, p_type AS dim, p_size % 4 AS sep, p_partkey % 6 AS ev FROM part WHERE p_size % 3 <> 0) GROUP BY q")
def clarifications(spark, d):
    """The one question worth asking."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k % 100).alias("question_id"), F.col("p_type").alias("dimension"), (F.col("p_size") % 4).alias("separates"), (k % 6).alias("evidence"), (F.col("p_size") % 3 != 0).alias("resolvable"))
    return evidence.clarified(rows)


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS t, length(o_orderkey::VARCHAR) AS n, o_orderdate AS o FROM orders)
SELECT k, concat_ws(';', CASE WHEN n >= 4 THEN '1:code:' || k END, (n + 5) || ':date:' || strftime(o, '%Y-%m-%d')) AS spans FROM m""")
def typed_spans(spark, d):
    """Typed spans of a text with their places."""
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    found = evidence.spans(text, {"date": r"\d{4}-\d{2}-\d{2}", "code": r"^\d{4,}"})
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["start"].cast("string"), s["kind"], s["value"])), ";").alias("spans"))


@query("""WITH a AS (SELECT p_brand AS subject, p_type AS role FROM part GROUP BY ALL), b AS (SELECT p_brand AS subject, p_type AS role, min(p_name) AS target, arg_min('h' || (p_partkey % 2), (p_name, p_partkey % 2)) AS h FROM part WHERE p_size % 10 = 0 GROUP BY ALL)
SELECT subject, role, CASE WHEN target IS NULL THEN 'unresolved' WHEN h = 'h0' THEN 'resolved' ELSE 'stale' END AS status, CASE WHEN h = 'h0' THEN target END AS target FROM a LEFT JOIN b USING (subject, role)""")
def bound_roles(spark, d):
    """Roles by approved bindings; those made from another source are stale."""
    p = table(spark, d, "part")
    rows = p.groupBy("p_brand", "p_type", "p_name", "p_size").agg(F.min(F.col("p_partkey") % 2).alias("h"))
    one = rows.where("p_size % 10 = 0").groupBy(F.col("p_brand").alias("subject"), F.col("p_type").alias("role")).agg(F.min(F.struct("p_name", "h")).alias("b"))
    bindings = one.select("subject", "role", F.lit("approved").alias("status"), F.col("b.p_name").alias("target"), F.concat(F.lit("h"), F.col("b.h").cast("string")).alias("source_hash"))
    bindings = bindings.unionByName(bindings.limit(1).withColumns({"status": F.lit("proposed"), "target": F.lit("")}))
    return evidence.bound_roles(p.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("role")).distinct(), bindings, "h0")


@query("""WITH b AS (SELECT p_partkey AS role, p_size % 5 > 0 AS ok, p_size % 2 = 0 AS month, CASE WHEN p_size % 7 > 0 THEN p_brand END AS a, CASE WHEN p_size % 9 > 0 THEN p_type END AS b, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS s, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS e, CASE p_partkey % 5 WHEN 0 THEN false END AS o FROM part),
w AS (SELECT *, ok AND a IS NOT NULL AND (month OR b IS NOT NULL) AS whole FROM b)
SELECT role, CASE WHEN NOT ok THEN 'missing' WHEN whole THEN 'resolved' ELSE 'incomplete' END AS status, CASE WHEN whole THEN CASE WHEN month THEN a || ' >= month_start' ELSE a || CASE WHEN coalesce(s, true) THEN ' <= today' ELSE ' < today' END END END AS lower,
CASE WHEN whole THEN CASE WHEN month THEN a || ' < next_month_start' ELSE b || CASE WHEN coalesce(e, true) THEN ' >= today' ELSE ' > today' END || CASE WHEN coalesce(o, true) THEN ' or null' ELSE '' END END END AS upper FROM w""")
def temporal_rules(spark, d):
    """Comparisons that temporal bindings give."""
    k, z = F.col("p_partkey"), F.col("p_size")
    month, first = z % 2 == 0, F.when(z % 7 > 0, F.col("p_brand"))
    rows = table(spark, d, "part").select(
        k.alias("role"), F.when(z % 5 > 0, "approved").otherwise("proposed").alias("status"), F.when(month, "half_open_date_interval").otherwise("effective_on_date").alias("type"), F.when(month, first).alias("date_column"), F.when(~month, first).alias("valid_from"),
        F.when(z % 9 > 0, F.col("p_type")).alias("valid_to"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("start_inclusive"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("end_inclusive"), F.when(k % 5 == 0, False).alias("open_end"),
    )
    return evidence.temporal_rules(rows)


@query("""WITH r AS (SELECT p_brand AS a, p_name AS x, CASE WHEN p_size % 10 = 0 THEN p_brand ELSE 'Brand#' || (p_size % 5) END AS b, p_type AS y FROM part)
SELECT DISTINCT b AS inner_table, x AS outer_column, y AS inner_column FROM r WHERE a = 'Brand#1' UNION SELECT a, y, x FROM r WHERE b = 'Brand#1' AND a <> 'Brand#1'""")
def oriented_relations(spark, d):
    """Relations, written either way, as columns of an outer table and an inner one."""
    other = F.when(F.col("p_size") % 10 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("Brand#"), (F.col("p_size") % 5).cast("string")))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("a_table"), F.col("p_name").alias("a_column"), other.alias("b_table"), F.col("p_type").alias("b_column"))
    return evidence.oriented(rows, "Brand#1")


@query("""WITH o AS (SELECT p_brand AS concept, p_name AS target, ['semantic', 'join', 'name'][p_size % 3 + 1] AS family FROM part WHERE p_size < 30)
SELECT concept, target, array_to_string(list_sort(list_distinct(list(family))), ',') AS families, count(*) AS observations, CASE WHEN count(DISTINCT family) >= 2 AND bool_or(family = 'semantic') THEN 'strong' WHEN count(DISTINCT family) >= 2 THEN 'supporting' ELSE 'weak' END AS strength FROM o GROUP BY concept, target""")
def discovered_candidates(spark, d):
    """What observations say of each candidate target."""
    family = F.element_at(F.array(*map(F.lit, ("semantic", "join", "name"))), (F.col("p_size") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").where("p_size < 30").select(F.col("p_brand").alias("concept"), F.col("p_name").alias("target"), family.alias("family"))
    return evidence.discovered(rows).withColumn("families", F.array_join("families", ","))


@query("""WITH r AS (SELECT DISTINCT p_brand AS subject, p_type AS role FROM part), c AS (SELECT p_brand AS subject, p_type AS role, max((p_size % 7 < 1)::INT) AS strong FROM part WHERE p_size > 44 GROUP BY ALL)
SELECT subject, role, CASE WHEN strong IS NULL THEN 'missing' WHEN strong = 1 THEN 'closed' ELSE 'open' END AS state FROM r LEFT JOIN c USING (subject, role)""")
def evidence_gaps(spark, d):
    """Required evidence that is closed, open or missing."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("role"), "p_size")
    return evidence.gaps(p, p.where("p_size > 44").withColumn("strength", F.when(F.col("p_size") % 7 < 1, "exact").otherwise("weak")))


_LINKS = "l AS (SELECT p_brand AS a, p_type AS b, p_size % 4 = 0 AS x FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_type, p_brand, false FROM part WHERE p_partkey % 3 = 1)"


def _links(spark, d):
    p = table(spark, d, "part")
    one = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.when(F.col("p_size") % 4 == 0, "structural").otherwise("usage").alias("family"))
    return one.unionByName(p.where("p_partkey % 3 = 1").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.lit("usage").alias("family")))


@query(f"""WITH {_LINKS}, e AS (SELECT a, b, bool_or(x) AS x FROM (SELECT a, b, x FROM l UNION ALL SELECT b, a, x FROM l) GROUP BY a, b)
SELECT f.a AS subject, f.b AS assignment, s.b AS dictionary, CASE WHEN f.x AND s.x THEN 'proven_exact' ELSE 'strong_inference_readonly' END AS status FROM e f JOIN e s ON f.b = s.a WHERE f.a IN ('Brand#1', 'Brand#2', 'Brand#3') AND s.b IN ('Brand#3', 'Brand#4') AND f.b IN (SELECT p_type FROM part) AND f.a <> s.b""")
def relation_paths(spark, d):
    """Ways from subjects over assignments to dictionaries."""
    side = lambda *names: spark.createDataFrame([(n,) for n in names], "object string")
    return evidence.relation_paths(_links(spark, d), side("Brand#1", "Brand#2", "Brand#3"), table(spark, d, "part").select(F.col("p_type").alias("object")), side("Brand#3", "Brand#4"))


@query("""WITH c AS (SELECT p_size % 20 AS subject, p_partkey AS object, p_size AS score, p_partkey % 2 AS r FROM part), l AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part UNION SELECT p_partkey, p_partkey + 101 FROM part)
SELECT x.subject, x.object AS a, y.object AS b, (x.score + y.score)::INT AS score, row_number() OVER (PARTITION BY x.subject ORDER BY x.score + y.score DESC, x.object, y.object)::INT AS place FROM c x JOIN l ON x.object = l.a JOIN c y ON y.object = l.b AND x.subject = y.subject WHERE x.r = 0 AND y.r = 1""")
def binding_hypotheses(spark, d):
    """Pairs of linked candidates for two roles, the best first."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    rows = p.select((F.col("p_size") % 20).alias("subject"), F.when(k % 2 == 0, "holder").otherwise("post").alias("role"), k.alias("object"), F.col("p_size").cast("int").alias("score"))
    links = p.select(k.alias("a"), (k + 1).alias("b")).union(p.select(k.alias("a"), (k + 101).alias("b")))
    return evidence.hypotheses(rows, links, "holder", "post")


@query("""WITH e AS (SELECT p_brand AS decision, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS refs, count(DISTINCT p_type)::INT AS n FROM part WHERE p_size < 20 GROUP BY 1)
SELECT decision, refs AS evidence, n AS items, sha256(refs) AS fingerprint, decision = 'Brand#7' AS stale FROM e UNION ALL SELECT 'none', '', 0, sha256(''), false""")
def review_packs(spark, d):
    """Evidence packed by decision, with a guard against what changed."""
    rows = table(spark, d, "part").where("p_size < 20").select(F.col("p_brand").alias("decision"), F.col("p_type").alias("ref"))
    decisions = rows.select("decision").distinct().select("decision", F.when(F.col("decision") == "Brand#7", "old").alias("fingerprint")).unionByName(spark.createDataFrame([("none", None)], "decision string, fingerprint string"))
    return evidence.review_packs(decisions, rows).withColumn("evidence", F.array_join("evidence", "|"))


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 13 = 0 THEN CASE WHEN p_size % 4 > 0 THEN 'requires_currentness_verification' ELSE 'unsupported' END WHEN p_partkey % 7 = 0 AND p_size % 4 > 0 THEN 'conflicting' WHEN p_partkey % 5 = 0 AND p_size % 3 = 0 THEN 'blocked' WHEN p_size % 3 = 0 OR p_size % 4 = 0 THEN 'unsupported'
WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'requires_review' ELSE 'supported' END ELSE 'partially_supported' END AS status FROM part""")
def question_statuses(spark, d):
    """How well questions are covered."""
    k, n = F.col("p_partkey"), F.col("p_size")
    status = evidence.question_status(n % 13 == 0, F.when(k % 7 == 0, 1).otherwise(0), k % 5 == 0, n % 3, n % 4, k % 3, k % 2 == 0, F.lit(0))
    return table(spark, d, "part").select(k.alias("k"), status.alias("status"))


@query("""WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS step, ['pass', 'skipped', 'blocked', 'fail', 'error'][CASE WHEN o_orderkey % 40 = 0 THEN 5 WHEN o_orderkey % 30 = 0 THEN 4 WHEN o_orderkey % 20 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END] AS o FROM orders)
SELECT case_id, CASE WHEN bool_or(o = 'error') THEN 'error' WHEN bool_or(o = 'fail') THEN 'fail' WHEN bool_or(o = 'blocked') THEN 'blocked' WHEN bool_or(o = 'pass') THEN 'pass' ELSE 'not_run' END AS verdict, string_agg(step || ':' || o, ',' ORDER BY step) AS trace FROM c GROUP BY case_id""")
def evaluation_verdicts(spark, d):
    """Verdicts of cases with their traces."""
    k = F.col("o_orderkey")
    outcome = F.when(k % 40 == 0, "error").when(k % 30 == 0, "fail").when(k % 20 == 0, "blocked").when(k % 2 == 0, "skipped").otherwise("pass")
    return evidence.verdicts(table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("step"), outcome.alias("outcome")))


@query("""WITH f AS (SELECT p_brand AS form, p_name AS label, count(DISTINCT p_partkey) AS n, min(p_partkey) AS field FROM part WHERE p_size < 10 GROUP BY ALL), a AS (SELECT DISTINCT p_brand AS form, p_name AS label FROM part)
SELECT a.form, a.label, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN field END AS field FROM a LEFT JOIN f USING (form, label)""")
def form_fields(spark, d):
    """Fields by label within a form."""
    p = table(spark, d, "part")
    forms = p.select(F.col("p_brand").alias("form_id"), F.upper("p_brand").alias("name")).distinct()
    fields = p.where("p_size < 10").select(F.col("p_brand").alias("form_id"), F.col("p_partkey").alias("field"), F.concat(F.lit(" "), F.initcap("p_name")).alias("label"))
    return evidence.form_fields(p.select(F.col("p_brand").alias("form"), F.col("p_name").alias("label")).distinct(), forms, fields)


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS fk, o_orderkey % 7 = 0 AS same FROM orders")
def entity_flags(spark, d):
    """Flags that a comparison of codes gives, with leading zeros kept."""
    code = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 3, "0")
    return table(spark, d, "orders").select("o_orderkey", fx.equal_text(code(5), "000").alias("fk"), fx.lexicon_match(code(7), "exact_phrase", "000").alias("same"))


#: Questions, claims and segments planted by a part's size, with what each is.
_QUESTIONS = (("Skąd to wiesz?", "source_disclosure"), ("Czym różni się A od B", "comparison"), ("Czy system to obsługuje", "currentness"), ("JAK WYKONAĆ KOREKTĘ", "procedure"), ("Jakie są zasady premii", "rules_details"), ("Co to jest RCP", "definition"), ("Dzień dobry", "other"))
_CLAIMS = (("Zasady są określone w regulaminie", "rules_pointer"), ("Zasady są określone: kwota 100, prawo do", "rules_content"), ("Najpierw akceptacja", "procedural"), ("RCP oznacza rejestr", "definitional"), ("To różni oba", "comparative"), ("Wersja aktualna", "currentness_claim"), ("Pracownik powinien", "rules_content"), ("nic", "other"))
_SPOKEN = (("Czy WIDAĆ mój ekran", "screen_share_check"), ("czy mnie słychać?", "audio_problem"), ("robimy PRZERWĘ", "break_announcement"), ("Dziękuję za uwagę", "training_admin"), ("ok. ok. ok.", "repeated_phrase"), ("yyyy.", "repeated_phrase"), ("mikrofon", "audio_problem"), ("mikrofon i formularz", "content"), ("robimy przerwę, RCP", "content"), ("ok", "uncertain"), ("zwykłe zdanie", "content"))


def _planted(rows: tuple, at):
    return F.element_at(F.array(*(F.lit(t) for t, _ in rows)), (at % len(rows) + 1).cast("int"))


def _expected(rows: tuple, at: str) -> str:
    return f"[{', '.join(repr(k) for _, k in rows)}][{at} % {len(rows)} + 1]"


@query(f"""SELECT p_partkey, {_expected(_QUESTIONS, 'p_size')} AS intent, {_expected(_CLAIMS, 'p_partkey')} AS shape, {_expected(_SPOKEN, 'p_size')} AS noise, p_size % 7 = 4 AND p_partkey % 8 IN (0, 1) OR p_size % 7 = 5 AND p_partkey % 8 = 3 OR p_size % 7 = 1 AND p_partkey % 8 = 4 AS on_topic FROM part""")
def classified_texts(spark, d):
    """What questions ask for, what claims are like, what is noise, and whether a claim is on a question's topic."""
    z, k = F.col("p_size"), F.col("p_partkey")
    q, c = _planted(_QUESTIONS, z), _planted(_CLAIMS, k)
    return table(spark, d, "part").select("p_partkey", classify.query_intent(q).alias("intent"), classify.claim_shape(c).alias("shape"), classify.transcript_noise(_planted(_SPOKEN, z)).alias("noise"), classify.on_topic(q, c).alias("on_topic"))
