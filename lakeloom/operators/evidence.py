"""Rules over gathered evidence, as column expressions and joins: coverage, leaks, lexicons, bindings, hypotheses, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx


def labelled(rows: DataFrame, labels: dict[str, str], most: int | None = None) -> DataFrame:
    """The first most columns, those that have a label under it."""
    return rows.select(*(F.col(c).alias(labels.get(c, c)) for c in rows.columns[:most]))


def carried_filter(explicit: Column, implicit: Column, key: str, order: str) -> Column:
    """The filter that holds for a turn: its own, explicit before implicit, else the last that a turn before it had."""
    own = F.coalesce(explicit, implicit)
    return F.coalesce(own, F.last(own, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def coverage(intent: Column, related: Column, shapes: Column, strong: Column, partial: Column) -> Column:
    """How far claims answer a question, from its intent, whether a claim is on its topic, and the shapes of the claims."""
    has = lambda *names: F.arrays_overlap(shapes, F.array(*map(F.lit, names)))
    rules = F.when(has("rules_pointer"), F.when(has("rules_content", "procedural", "definitional"), "answers_question").otherwise("related_but_not_answering")).when(has("rules_content", "definitional", "other", "procedural"), "partially_answers_question").otherwise("related_but_not_answering")
    return (
        F.when(F.size(shapes) == 0, "not_related")
        .when(~related & (intent != "source_disclosure"), "not_related")
        .when(intent == "source_disclosure", "related_but_not_answering")
        .when(intent == "rules_details", rules)
        .when(intent == "definition", F.when(has("definitional"), "answers_question").otherwise("partially_answers_question"))
        .when(intent == "procedure", F.when(has("procedural"), F.when(partial, "partially_answers_question").otherwise("answers_question")).otherwise("related_but_not_answering"))
        .when(intent.isin("comparison", "currentness"), "related_but_not_answering")
        .otherwise(F.when(strong, "answers_question").otherwise("partially_answers_question"))
    )


def answerable(answerability: Column, covered: Column, cited: Column) -> Column:
    """answerability after coverage had its say: it only ever falls."""
    related = F.when(answerability == "answerable", F.when(cited, "partially_answerable").otherwise("insufficient")).when((answerability == "partially_answerable") & ~cited, "insufficient").otherwise("partially_answerable")
    return (
        F.when(answerability.isin("blocked", "insufficient") | (covered == "answers_question"), answerability)
        .when(covered == "related_but_not_answering", related)
        .when((covered == "partially_answers_question") & (answerability == "answerable"), "partially_answerable")
        .when(covered == "not_related", "insufficient")
        .otherwise(answerability)
    )


def anchors(records: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """id, anchors: the names of the indexes (each with a column label) that hold a record's (id, label) folded label."""
    out = records.select("id", fx.normal_words(F.col("label")).alias("_l"))
    for name, index in known.items():
        labels = index.select(fx.normal_words(F.col("label")).alias("_l"), F.lit(name).alias(f"_{name}")).distinct()
        out = out.join(labels, "_l", "left")
    return out.select("id", F.array_compact(F.array(*(F.col(f"_{n}") for n in known))).alias("anchors"))


def concepts(questions: DataFrame, lexicon: DataFrame, longest: int = 4) -> DataFrame:
    """question_id, concept of each entry of a lexicon (concept, alias) whose words stand together in a question
    (question_id, text), marks aside. Runs of at most longest words meet aliases by an equi-join."""
    words = F.split(fx.folded(fx.normal_words(F.col("text"))), " ")
    runs = questions.select("question_id", words.alias("w")).select("question_id", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("w") >= F.col("n"))
    at = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    said = runs.select("question_id", F.explode(F.array_distinct(at)).alias("a"))
    return said.join(lexicon.select("concept", fx.folded(fx.normal_words(F.col("alias"))).alias("a")).distinct(), "a").select("question_id", "concept").distinct()


def satisfied(found: DataFrame, rules: DataFrame) -> DataFrame:
    """question_id, rule of each rule (rule, concept for each concept that it needs) all of whose concepts were found."""
    asked = rules.groupBy("rule").agg(F.count_distinct("concept").alias("needs"))
    hits = found.join(rules.select("rule", "concept").distinct(), "concept").groupBy("question_id", "rule").agg(F.count("*").alias("has"))
    return hits.join(asked, "rule").where("has = needs").select("question_id", "rule")


def clarified(dimensions: DataFrame) -> DataFrame:
    """question_id, dimension: the one question worth asking of each: among what a user can resolve, that which parts most
    hypotheses (ten each) and has most evidence; ties: by name."""
    own = dimensions.where("resolvable")
    return own.groupBy("question_id").agg(F.min_by("dimension", F.struct((-(F.col("separates") * 10 + F.col("evidence"))).alias("s"), F.col("dimension"))).alias("dimension"))


def spans(text: Column, patterns: dict[str, str]) -> Column:
    """Typed spans (kind, start from 1, value) of all matches of each pattern, in the order of the text."""

    def of(kind: str, pattern: str) -> Column:
        found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
        before = lambda parts, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda s, p: s + F.length(p))
        return F.transform(found, lambda v, i: F.struct((before(pieces, i + 1) + before(found, i) + 1).alias("start"), F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_sort(F.concat(*(of(k, p) for k, p in patterns.items())))


def bound_roles(asked: DataFrame, bindings: DataFrame, source_hash: str) -> DataFrame:
    """subject, role, status, target for each role asked for: resolved by an approved binding, stale if that was made from
    another source, unresolved otherwise."""
    own = bindings.where("status = 'approved'").groupBy("subject", "role").agg(F.min_by(F.struct("target", "source_hash"), "target").alias("b"))
    fresh = F.col("b.source_hash") == source_hash
    out = asked.join(own, ["subject", "role"], "left")
    return out.select("subject", "role", F.when(F.col("b").isNull(), "unresolved").when(fresh, "resolved").otherwise("stale").alias("status"), F.when(fresh, F.col("b.target")).alias("target"))


def temporal_rules(bindings: DataFrame) -> DataFrame:
    """role, status, lower, upper: the comparisons that a temporal binding gives: a half-open month on one column, or a day
    within two columns with their inclusivity and an end that may be open; missing if it isn't approved, incomplete without
    its columns."""
    approved = F.col("status").eqNullSafe("approved")
    month = F.col("type") == "half_open_date_interval"
    whole = F.when(month, F.col("date_column").isNotNull()).otherwise(F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull())
    ok = approved & whole
    starts, ends = F.coalesce("start_inclusive", F.lit(True)), F.coalesce("end_inclusive", F.lit(True))
    lower = F.when(month, F.concat("date_column", F.lit(" >= month_start"))).otherwise(F.concat("valid_from", F.when(starts, " <= today").otherwise(" < today")))
    upper = F.when(month, F.concat("date_column", F.lit(" < next_month_start"))).otherwise(F.concat("valid_to", F.when(ends, " >= today").otherwise(" > today"), F.when(F.coalesce("open_end", F.lit(True)), " or null").otherwise("")))
    status = F.when(~approved, "missing").when(ok, "resolved").otherwise("incomplete")
    return bindings.select("role", status.alias("status"), F.when(ok, lower).alias("lower"), F.when(ok, upper).alias("upper"))


def oriented(relations: DataFrame, outer: str) -> DataFrame:
    """inner_table, outer_column, inner_column of relations (a_table, a_column, b_table, b_column) that touch an outer table,
    whichever way they were written."""
    ahead = relations.where(F.col("a_table") == outer).select(F.col("b_table").alias("inner_table"), F.col("a_column").alias("outer_column"), F.col("b_column").alias("inner_column"))
    back = relations.where((F.col("b_table") == outer) & (F.col("a_table") != outer)).select(F.col("a_table").alias("inner_table"), F.col("b_column").alias("outer_column"), F.col("a_column").alias("inner_column"))
    return ahead.unionByName(back).distinct()


def discovered(observations: DataFrame) -> DataFrame:
    """concept, target, families, observations, strength: what each target has for it; strong from two families on, one of
    them semantic, else supporting from two on, else weak."""
    out = observations.groupBy("concept", "target").agg(F.array_sort(F.collect_set("family")).alias("families"), F.count("*").alias("observations"))
    two = F.size("families") >= 2
    return out.withColumn("strength", F.when(two & F.array_contains("families", "semantic"), "strong").when(two, "supporting").otherwise("weak"))


def gaps(required: DataFrame, collected: DataFrame) -> DataFrame:
    """subject, role, state for each required piece of evidence: closed by an exact or strong one, open if only weaker ones
    were collected, missing if none was."""
    best = collected.groupBy("subject", "role").agg(F.max(F.when(F.col("strength").isin("exact", "strong"), 2).otherwise(1)).alias("b"))
    out = required.select("subject", "role").distinct().join(best, ["subject", "role"], "left")
    return out.select("subject", "role", F.when(F.col("b") == 2, "closed").when(F.col("b") == 1, "open").otherwise("missing").alias("state"))


def relation_paths(relations: DataFrame, subjects: DataFrame, assignments: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """subject, assignment, dictionary, status of each way from a subject over an assignment to a dictionary, along
    relations (a, b, family) either way; proven_exact if both are structural. Each side has one column, object."""
    both = relations.select("a", "b", "family").unionByName(relations.select(F.col("b").alias("a"), F.col("a").alias("b"), "family"))
    both = both.groupBy("a", "b").agg(F.bool_or(F.col("family") == "structural").alias("exact"))
    first = both.join(subjects.select(F.col("object").alias("a")).distinct(), "a", "left_semi").join(assignments.select(F.col("object").alias("b")).distinct(), "b", "left_semi").select(F.col("a").alias("subject"), F.col("b").alias("assignment"), F.col("exact").alias("x"))
    second = both.join(dictionaries.select(F.col("object").alias("b")).distinct(), "b", "left_semi").select(F.col("a").alias("assignment"), F.col("b").alias("dictionary"), F.col("exact").alias("y"))
    status = F.when(F.col("x") & F.col("y"), "proven_exact").otherwise("strong_inference_readonly")
    return first.join(second, "assignment").where("subject <> dictionary").select("subject", "assignment", "dictionary", status.alias("status"))


def hypotheses(candidates: DataFrame, links: DataFrame, first: str, second: str) -> DataFrame:
    """subject, a, b, score, place: pairs of a candidate for the first role and a linked one for the second, the best first.
    candidates: subject, role, object, score; links: a, b. Candidates that nothing links are in no hypothesis."""
    side = lambda role, name: candidates.where(F.col("role") == role).select("subject", F.col("object").alias(name), F.col("score").alias(f"_{name}"))
    found = side(first, "a").join(links.select("a", "b").distinct(), "a").join(side(second, "b"), ["subject", "b"])
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), "a", "b"))
    return found.select("subject", "a", "b", (F.col("_a") + F.col("_b")).alias("score")).withColumn("place", place)


def review_packs(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """decision, evidence, items, fingerprint, stale for each decision (decision, fingerprint when it was shown, or null): its
    evidence in order, and whether that has changed since."""
    packed = evidence.groupBy("decision").agg(F.array_sort(F.collect_set("ref")).alias("evidence"))
    out = decisions.select("decision", F.col("fingerprint").alias("_shown")).join(packed, "decision", "left")
    refs = F.coalesce("evidence", F.array().cast("array<string>"))
    print_ = F.sha2(F.array_join(refs, "|"), 256)
    return out.select("decision", refs.alias("evidence"), F.size(refs).alias("items"), print_.alias("fingerprint"), (F.col("_shown").isNotNull() & (F.col("_shown") != print_)).alias("stale"))


def question_status(currentness: Column, conflicts: Column, blocked: Column, found: Column, evidence: Column, missing: Column, uncertain: Column, variants: Column) -> Column:
    """How well a question is covered; rules in order, the first that holds decides."""
    return (
        F.when(currentness, F.when(evidence > 0, "requires_currentness_verification").otherwise("unsupported"))
        .when((conflicts > 0) & (evidence > 0), "conflicting")
        .when(blocked & (found == 0), "blocked")
        .when((found == 0) | (evidence == 0), "unsupported")
        .when(missing == 0, F.when(uncertain, "requires_review").otherwise("supported"))
        .when(found > 0, "partially_supported")
        .when(variants > 0, "requires_review")
        .otherwise("unsupported")
    )


def verdicts(checks: DataFrame) -> DataFrame:
    """case_id, verdict, trace of each case (case_id, step, outcome: pass, fail, error, skipped, blocked): error before fail
    before blocked; not_run without steps that ran, pass otherwise; the trace has the steps in order."""
    has = lambda o: F.bool_or(F.col("outcome") == o)
    out = checks.groupBy("case_id").agg(has("error").alias("e"), has("fail").alias("f"), has("blocked").alias("b"), has("pass").alias("p"), F.array_sort(F.collect_list(F.struct("step", "outcome"))).alias("t"))
    verdict = F.when(F.col("e"), "error").when(F.col("f"), "fail").when(F.col("b"), "blocked").when(F.col("p"), "pass").otherwise("not_run")
    return out.select("case_id", verdict.alias("verdict"), F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["step"].cast("string"), x["outcome"])), ",").alias("trace"))


def form_fields(asked: DataFrame, forms: DataFrame, fields: DataFrame) -> DataFrame:
    """form, label, status, field for each label asked for in a form: forms (form_id, name) by name, then the form's fields
    (form_id, field, label) by label, folded: resolved by one field, ambiguous by several, unresolved by none."""
    named = forms.select("form_id", fx.graph_term(F.col("name")).alias("_f"))
    own = named.join(fields, "form_id").select("_f", fx.graph_term(F.col("label")).alias("_l"), "field")
    hits = own.groupBy("_f", "_l").agg(F.count_distinct("field").alias("n"), F.min("field").alias("field"))
    out = asked.withColumns({"_f": fx.graph_term(F.col("form")), "_l": fx.graph_term(F.col("label"))}).join(hits, ["_f", "_l"], "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("form", "label", status.alias("status"), F.when(F.col("n") == 1, F.col("field")).alias("field"))
