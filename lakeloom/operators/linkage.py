"""Linking records that speak of the same thing: blocking keys, pairs, relations, clusters and proposed records.

A record has id, kind, subject, predicate, object, statement, signature, source, payload (map of strings), hints (array)
and where it applies: the arrays families, surfaces, domains, areas, versions, dates, contexts and the strings platform,
scope, currentness, risk (platform, areas and contexts may be missing).
Records that are equal in all of these are one class; pairs are drawn between classes by equi-joins on strong signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.sources.cuts import cut
from lakeloom.operators import graph

#: Subjects too general to link two records by, and payload entries that name a thing (fixed values).
GENERAL = ("procedura", "parametry", "korekta", "ostrzeżenie", "reguła obliczeniowa")
NAMING = ("code", "componentCode", "functionName", "status", "parameterName", "value", "formLabel", "fieldLabel")
#: Payload entries that two records must share to have the same content (fixed values).
CONTENT = ("code", "componentCode", "functionName", "status", "parameterName", "value", "condition", "effect")
#: Fields that say where a record applies.
APPLIES = ("platform", "families", "surfaces", "domains", "areas", "versions", "dates", "contexts", "scope", "currentness", "risk")
#: What an unsaid field of these counts as (fixed values).
UNSAID = {"platform": "unknown", "scope": "requires_review", "currentness": "not_verified", "risk": "unknown"}
#: Relations by which records are merged (fixed values).
MERGING = ("exact_duplicate", "semantic_duplicate", "enrich_existing")
_ARRAYS = ("families", "surfaces", "domains", "areas", "versions", "dates", "contexts")
#: Records of a key that meet as one block.
BLOCK = 1000


def _sorted(c: Column) -> Column:
    return F.array_sort(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def _entries(payload: Column, names: tuple[str, ...] | None = None) -> Column:
    """Entries of a map as one sorted text; with names, those alone."""
    found = F.array_sort(F.map_entries(F.coalesce(payload, F.create_map().cast("map<string,string>"))))
    found = found if names is None else F.filter(found, lambda e: e["key"].isin(*names))
    return F.to_json(found)


def normalised(records: DataFrame) -> DataFrame:
    """records with texts folded, arrays sorted, and the keys that rules compare: partition, content and class_key."""
    none = {c: F.array().cast("array<string>") if c in _ARRAYS else F.lit("") for c in ("platform", "areas", "contexts") if c not in records.columns}
    records = records.withColumns(none) if none else records
    said = {c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", other).otherwise(F.col(c)) for c, other in UNSAID.items()}
    out = records.withColumns({c: _sorted(F.col(c)) for c in _ARRAYS} | said | {c: fx.normal_words(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "predicate", "object", "statement")})
    out = out.withColumn("hints", F.array_distinct(F.filter(F.transform(F.coalesce("hints", F.array().cast("array<string>")), fx.normal_words), lambda x: x != "")))
    partition = F.sha2(F.to_json(F.struct(*APPLIES), {"ignoreNullFields": "false"}), 256)
    key = F.sha2(F.concat_ws("\x01", "kind", "subject", "predicate", "object", _entries(F.col("payload"), NAMING)), 256)
    whole = F.sha2(F.to_json(F.struct("kind", "subject", "predicate", "object", "statement", "signature", "source", "hints", *APPLIES, _entries(F.col("payload")).alias("payload")), {"ignoreNullFields": "false"}), 256)
    unknown = (F.size("families") + F.size("domains") == 0) | (F.col("scope").eqNullSafe("requires_review") & (F.size("families") + F.size("versions") == 0))
    return out.withColumns({"partition": partition, "semantic_key": key, "unknown": unknown, "class_key": whole})


def blocking_keys(records: DataFrame) -> DataFrame:
    """id, key: everything by which a normalised record may meet another one, as `sort:value`."""
    one = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(name + ":"), c)))
    many = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name + ":"), x))
    tokens = F.filter(F.split("subject", " "), lambda t: F.length(t) > 1)
    parts = [one("kind", F.col("kind")), one("subject", F.col("subject")), one("predicate", F.col("predicate")), many("token", tokens), F.when(F.col("scope") == "client_specific_candidate", F.array(F.lit("scope:client")))]
    parts += [many(n, F.col(c)) for n, c in (("family", "families"), ("surface", "surfaces"), ("domain", "domains"), ("version", "versions"), ("date", "dates"), ("hint", "hints"))]
    none = F.array().cast("array<string>")
    return records.select("id", F.explode(F.array_distinct(F.concat(*(F.coalesce(p, none) for p in parts)))).alias("key"))


def classes(records: DataFrame) -> DataFrame:
    """id, class: the smallest id among the normalised records that are equal to each in every field."""
    least = records.groupBy("class_key").agg(F.min("id").alias("class"))
    return records.select("id", "class_key").join(least, "class_key").select("id", "class")


def representatives(records: DataFrame) -> DataFrame:
    """One normalised record of each class, that of the smallest id, with its number of copies."""
    rest = [c for c in records.columns if c != "class_key"]
    best = records.groupBy("class_key").agg(F.min_by(F.struct(*rest), "id").alias("r"), F.count("*").alias("copies"))
    return best.select("class_key", "r.*", "copies")


def _keyed(records: DataFrame, carried: list[str], general: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Records under each of their signals (kind, signal, value), and the values that several have: how many (n), and whether
    relations there are to be looked at pair by pair (pure) as all apply to one known place.

    A value whose records all have one subject that isn't general is left out: they meet there.
    """
    named = lambda n, c, ok: F.when(ok, F.struct(F.lit(n).alias("signal"), c.alias("value")))
    firm = F.when((F.col("subject") != "") & ~F.col("subject").isin(*general), F.col("subject"))
    found = F.array(
        named("shared_non_generic_subject", firm, firm.isNotNull()),
        named("shared_candidate_signature", F.col("signature"), F.col("signature").isNotNull()),
        named("shared_kind_specific_semantic_key", F.col("semantic_key"), F.lit(True)),
    )
    found = F.concat(F.filter(found, lambda x: x.isNotNull()), F.transform("hints", lambda h: F.struct(F.lit("shared_correlation_hint").alias("signal"), h.alias("value"))))
    keyed = records.select(*carried, firm.alias("firm"), F.explode(found).alias("s")).select("*", "s.signal", "s.value").drop("s")
    facts = [F.count("*").alias("n"), F.count("firm").alias("firms"), F.min("firm").alias("least"), F.max("firm").alias("most")]
    if "partition" in carried:
        places = [f("partition").alias(a) for f, a in ((F.min, "low"), (F.max, "high"))]
        facts += [*places, F.min(F.when(F.col("unknown"), F.col("id"))).alias("hub"), F.min_by("id", "partition").alias("hub_low"), F.max_by("id", "partition").alias("hub_high")]
    shared = keyed.groupBy("kind", "signal", "value").agg(*facts).where("n > 1").where("signal = 'shared_non_generic_subject' or firms < n or least < most")
    if "partition" in carried:
        shared = shared.withColumn("pure", F.col("hub").isNull() & (F.col("low") == F.col("high")))
    return keyed, shared.drop("firms", "least", "most")


def _meetings(records: DataFrame, carried: list[str], general: tuple[str, ...], block: int) -> DataFrame:
    """left_*, right_* (the columns carried), signals, pure of each two records of a kind with a signal in common.

    Two records meet under each value that they share, and the first one of these gives them out (subject, signature, semantic
    key, then the least hint), so no list of pairs is shuffled.
    """
    carried = list(dict.fromkeys(["id", "kind", "subject", "signature", "semantic_key", "hints", *carried]))
    keyed, shared = _keyed(records, carried, general)
    key = ["kind", "signal", "value"]
    pure = [c for c in ("pure",) if c in shared.columns]
    met = keyed.join(shared.select(*key, *pure, F.ceil(F.col("n") / block).alias("blocks")).hint("merge"), key).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    every = F.expr("sequence(0L, blocks - 1)")
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in (*(c for c in carried if c != "kind"), "firm")]
    left = met.select(*key, *pure, *side("left"), F.col("own").alias("i"), F.explode(every).alias("j"))
    right = met.select(*key, *side("right"), F.explode(every).alias("i"), F.col("own").alias("j"))
    both = lambda c: F.coalesce(F.col(f"left_{c}") == F.col(f"right_{c}"), F.lit(False))
    subject, signature, semantic = both("firm"), both("signature"), both("semantic_key")
    hint = F.array_min(F.array_intersect("left_hints", "right_hints"))
    is_ = lambda s: F.col("signal") == s
    first = is_("shared_non_generic_subject") | (~subject & (is_("shared_candidate_signature") | (~signature & (is_("shared_kind_specific_semantic_key") | (~semantic & is_("shared_correlation_hint") & (hint == F.col("value")))))))
    pairs = left.join(right.hint("merge"), [*key, "i", "j"]).where(F.col("left_id") < F.col("right_id")).where(first)
    said = F.array(F.when(signature, "shared_candidate_signature"), F.when(F.arrays_overlap("left_hints", "right_hints"), "shared_correlation_hint"), F.when(semantic, "shared_kind_specific_semantic_key"), F.when(subject, "shared_non_generic_subject"))
    return pairs.withColumn("signals", F.array_compact(said))


def record_pairs(records: DataFrame, general: tuple[str, ...] = GENERAL, block: int = BLOCK, fields: tuple[str, ...] = ()) -> DataFrame:
    """left_id, right_id, signals of each two normalised records of one kind with a strong signal in common: signature,
    subject that isn't general, semantic key or hint; with fields, also these of both, as left_ and right_.

    An equi-join on (kind, signal, value). Records of a value with over block of them are dealt into blocks, and each
    two blocks meet in a task of their own; none is left out, and pairs leave the join as they are. Pass representatives, so
    that copies don't pair.
    """
    pairs = _meetings(records, list(fields), general, block)
    return pairs.select("left_id", "right_id", "signals", *(f"{p}_{c}" for p in ("left", "right") for c in fields))


def relation(x: Callable[[str], Column], y: Callable[[str], Column], least_signals: int = 2) -> Column:
    """The relation of two normalised records of one kind, with their payloads' entries as text; rules in strict order, the first
    that holds decides.

    exact_duplicate, conflict, a variant, enrich_existing, semantic_duplicate, requires_review, unrelated.
    """
    same = lambda c: x(c) == y(c)
    get = lambda r, *names: F.coalesce(*(F.try_element_at(r("payload"), F.lit(n)) for n in names))
    text = lambda r, *names: F.coalesce(get(r, *names), F.lit(""))
    differ = lambda a, b: (a != "") & (b != "") & (a != b)
    unknown = x("unknown") | y("unknown")
    compatible = same("partition") & ~unknown
    whole = same("entries")
    exact = compatible & same("subject") & same("predicate") & same("object") & same("statement") & whole

    value = lambda r: F.coalesce(get(r, "value", "effect", "requiredValue"), r("object"))
    condition = lambda r: F.coalesce(get(r, "condition"), r("predicate"))
    conflict = compatible & same("subject") & (condition(x) == condition(y)) & differ(value(x), value(y))

    inside = (F.length(x("subject")) > 3) & (F.length(y("subject")) > 3) & (x("subject").contains(y("subject")) | y("subject").contains(x("subject")))
    akin = same("subject") | F.coalesce(same("signature"), F.lit(False)) | inside
    some = lambda c: F.size(x(c)) + F.size(y(c)) > 0
    both = lambda c: (F.size(x(c)) > 0) & (F.size(y(c)) > 0)
    client = lambda r: F.coalesce(r("scope") == "client_specific_candidate", F.lit(False))
    ruled = (get(x, "regulatory").isNotNull() | get(y, "regulatory").isNotNull() | (x("kind") == "temporal_rule")) & ((text(x, "regulatory") != text(y, "regulatory")) | ~same("dates"))
    stale = F.coalesce((x("currentness") == "not_verified") | (y("currentness") == "not_verified"), F.lit(False)) | (text(x, "regulatory") != text(y, "regulatory"))
    variant = (
        F.when(unknown, "requires_review")
        .when(~same("families") & both("families"), "product_variant")
        .when(~same("surfaces") & some("surfaces"), "product_surface_variant")
        .when(~same("versions") & some("versions"), "version_variant")
        .when(~same("dates") & some("dates"), "temporal_variant")
        .when((client(x) != client(y)) | (client(x) & client(y) & ~x("source").eqNullSafe(y("source"))), "client_variant")
        .when(stale & ruled, "regulatory_variant")
        .when((get(x, "configurationValue", "value") != get(y, "configurationValue", "value")) & same("subject"), "configuration_variant")
        .when(differ(text(x, "processVariant", "path"), text(y, "processVariant", "path")), "process_variant")
        .when(differ(text(x, "scenario"), text(y, "scenario")), "scenario_variant")
    )

    keys = lambda r: F.map_keys(F.coalesce(r("payload"), F.create_map().cast("map<string,string>")))
    more_x, more_y = F.size(F.array_except(keys(x), keys(y))), F.size(F.array_except(keys(y), keys(x)))
    clash = F.exists(F.array_intersect(keys(x), keys(y)), lambda k: F.try_element_at(x("payload"), k) != F.try_element_at(y("payload"), k))
    added = compatible & same("subject") & ~clash & (more_x + more_y > 0)
    enriched = F.when(added & (more_x > 0) & (more_y > 0), "requires_review").when(added, "enrich_existing")

    compared = [(get(x, k).isNotNull() | get(y, k).isNotNull(), text(x, k) == text(y, k)) for k in CONTENT]
    equal, any_key = F.lit(True), F.lit(False)
    for there, ok in compared:
        equal, any_key = equal & (~there | ok), any_key | there
    content = same("subject") & same("predicate") & equal & (any_key | same("object"))
    names = lambda r: F.filter(F.array(*(F.trim(text(r, k)) for k in ("code", "componentCode", "functionName", "formLabel", "fieldLabel", "status"))), lambda v: v != "")
    identified = F.arrays_overlap(names(x), names(y))
    effect = lambda r: F.coalesce(get(r, "effect"), r("object"))
    mutual = (condition(x) != "") & (effect(x) != "") & (fx.plain_words(condition(x)) == fx.plain_words(condition(y))) & (fx.plain_words(effect(x)) == fx.plain_words(effect(y)))
    signals = F.lit(1) + sum((F.coalesce(s, F.lit(False)).cast("int") for s in (content, same("semantic_key"), identified, mutual)), F.lit(0))
    words = lambda r: F.filter(F.split(r("statement"), " "), lambda t: t != "")
    alike = fx.overlap(words(x), words(y)) >= 0.7
    meaning = F.when(compatible & (signals >= least_signals), "semantic_duplicate").when(compatible & alike, "requires_review")

    rest = F.when(compatible, "unrelated").otherwise("requires_review")
    return F.when(exact, "exact_duplicate").when(conflict, "conflict").otherwise(F.coalesce(F.when(akin, variant), enriched, meaning, rest))


def differences(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """The fields in which two normalised records apply to different things."""
    return F.array_compact(F.array(*(F.when(~x(c).eqNullSafe(y(c)), F.lit(c)) for c in APPLIES)))


#: What relation() reads of a record, and what is made of it once.
_READ = ("partition", "unknown", "predicate", "object", "statement", "source", "payload", "families", "surfaces", "versions", "dates", "scope", "currentness", "entries")


def _decided(records: DataFrame, least_signals: int, general: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """left_id, right_id, signals, relation, compatible, unknown, pure: each pair where it meets."""
    records = cut(records.withColumn("entries", _entries(F.col("payload"))))  # both sides and the signals read them
    pairs = _meetings(records, list(_READ), general, block)
    x, y = (lambda c: F.col(c if c == "kind" else f"left_{c}")), (lambda c: F.col(c if c == "kind" else f"right_{c}"))
    unknown = x("unknown") | y("unknown")
    return pairs.select("left_id", "right_id", "signals", relation(x, y, least_signals).alias("relation"), ((x("partition") == y("partition")) & ~unknown).alias("compatible"), unknown.alias("unknown"), "pure")


def relations(records: DataFrame, least_signals: int = 2, general: tuple[str, ...] = GENERAL) -> DataFrame:
    """left_id, right_id, signals, relation, compatible, unknown for each pair of normalised records with a signal."""
    return _decided(records, least_signals, general).drop("pure")


def telling(records: DataFrame, least_signals: int = 2, general: tuple[str, ...] = GENERAL, block: int = BLOCK) -> DataFrame:
    """left_id, right_id, relation, compatible, unknown: of relations() so many that, with links(), clusters() and
    proposed_records() give the same as with all: of each record one with each relation and reach, and all that link records of
    a value whose records apply to one known place. Pairs are collapsed where they meet, before the shuffle."""
    pairs = _decided(records, least_signals, general, block)
    kept = F.when(F.col("pure") & (F.col("relation") != "unrelated"), F.col("right_id")).alias("kept")
    one = lambda a, b, k: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), k)
    ends = pairs.select("relation", "compatible", "unknown", F.inline(F.array(one("left_id", "right_id", kept), one("right_id", "left_id", F.lit(None).cast(pairs.schema["right_id"].dataType).alias("kept")))))
    told = ends.groupBy("id", "relation", "compatible", "unknown", "kept").agg(F.min("other").alias("other"))
    return cut(told.select(F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id"), "relation", "compatible", "unknown").distinct())


def links(records: DataFrame, decisions: DataFrame, general: tuple[str, ...] = GENERAL) -> DataFrame:
    """src, dst: links that connect what all decisions but unrelated ones connect; decisions: of telling().

    No two records are unrelated if one is unknown or if they apply to different places. So of a value's records all are linked
    to an unknown one, or, if their places differ, to one of the lowest or one of the highest place.
    """
    keyed, shared = _keyed(records, ["id", "kind", "partition", "unknown"], general)
    met = keyed.join(shared.where("not pure").drop("n", "pure", "high").hint("merge"), ["kind", "signal", "value"])
    hub = F.coalesce("hub", F.when(F.col("partition") == F.col("low"), F.col("hub_high")).otherwise(F.col("hub_low")))
    stars = met.select(F.col("id").alias("src"), hub.alias("dst")).where("src <> dst")
    return stars.unionByName(decisions.where("relation <> 'unrelated'").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")))


def clusters(records: DataFrame, decisions: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """id, cluster (its smallest id), status for each record: what decisions other than unrelated connect. decisions: of
    relations(), or of telling() with linked, its links().

    status: conflicting, incompatible_variants, correlated_requires_review, correlated, insufficient_evidence.
    """
    if linked is None:
        linked = decisions.where("relation <> 'unrelated'").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))
    comp = graph.components(linked)
    member = records.select("id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    applies = F.when(F.col("compatible"), "compatible").when(F.col("unknown"), "unknown").otherwise("incompatible")
    # both ends of a decision are looked at: an unrelated pair may touch two clusters
    ends = decisions.select(F.explode(F.array_distinct(F.array("left_id", "right_id"))).alias("id"), "relation", applies.alias("applies"))
    facts = ends.join(member, "id").groupBy("cluster").agg(F.collect_set("relation").alias("kinds"), F.collect_set("applies").alias("applies"))
    has = lambda k: F.array_contains("kinds", k)
    status = F.when(F.col("kinds").isNull(), "insufficient_evidence").when(has("conflict"), "conflicting").when((F.size("applies") == 1) & F.array_contains("applies", "incompatible"), "incompatible_variants").when(has("requires_review"), "correlated_requires_review").otherwise("correlated")
    return member.join(facts, "cluster", "left").select("id", "cluster", status.alias("status"))


def proposed_records(records: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """cluster, partition, first_id, occurrences, status, merge_status: one proposed record for each cluster and place
    where its records apply. members: id, cluster; decisions: of relations()."""
    placed = members.select("id", "cluster").join(records.select("id", "partition"), "id")
    ends = decisions.select(F.explode(F.array("left_id", "right_id")).alias("id"), "relation")
    kinds = ends.join(placed, "id").groupBy("cluster", "partition").agg(F.collect_set("relation").alias("kinds"))
    groups = placed.groupBy("cluster", "partition").agg(F.min("id").alias("first_id"), F.count("*").alias("occurrences"))
    has = lambda *names: F.coalesce(F.arrays_overlap("kinds", F.array(*map(F.lit, names))), F.lit(False))
    variant = F.coalesce(F.exists("kinds", lambda k: k.endswith("_variant")), F.lit(False))
    status = F.when(has("conflict"), "proposed_with_conflict").when(variant, "proposed_with_variants").when(has("requires_review"), "requires_review").otherwise("proposed")
    merge = (
        F.when(has("exact_duplicate"), "exact_collapsed")
        .when(has("semantic_duplicate"), "semantically_grouped")
        .when(has("enrich_existing"), "enriched")
        .when(has("conflict"), "conflict_partitioned")
        .when(variant, "variant_partitioned")
        .when((F.col("occurrences") > 1) & (F.size("kinds") == 1) & has("requires_review"), "requires_review_before_merge")
        .otherwise("not_merged")
    )
    return groups.join(kinds, ["cluster", "partition"], "left").select("cluster", "partition", "first_id", "occurrences", status.alias("status"), merge.alias("merge_status"))


def merged_evidence(rows: DataFrame, key: list[str], evidence: str, order: str) -> DataFrame:
    """One row of each key, that of the least order, with the distinct evidence of all and the number collapsed."""
    rest = [c for c in rows.columns if c not in (*key, evidence)]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence), F.count("*").alias("occurrences"))
    return best.select(*key, "r.*", evidence, "occurrences")


def same_person(name: Column, number: Column, wanted: str) -> Column:
    """Whether a person has that name, in either order of its words, or that number, leading zeros aside."""
    words = F.array_sort(F.split(fx.folded(F.trim(name)), r"\s+"))
    asked = F.array_sort(F.split(fx.folded(F.trim(F.lit(wanted))), r"\s+"))
    bare = lambda c: F.regexp_replace(c, r"^0+(?=.)", "")
    return (words == asked) | (F.lit(wanted).rlike(r"^\d+$") & (bare(number.cast("string")) == bare(F.lit(wanted))))


def _shortened(c: Column, most: int) -> Column:
    """Hashes of all texts that are left of a text when at most so many letters are taken out."""
    less = lambda t: F.when(t != "", F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    left = F.array(F.array(c))
    for _ in range(most):
        left = F.transform(left, lambda ts: F.array_distinct(F.concat(ts, F.flatten(F.transform(ts, less)))))
    return F.transform(left[0], lambda t: F.xxhash64(t))


def suggestions(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """name, suggestion, distance: for each name that isn't known, the known ones within so many letters' edits (one at
    least). Both sides have a column name; none is accepted by itself.

    Of two names within k edits the same text is left when some k letters or fewer are taken out of each, so names meet by such
    texts: only those within 2 k edits do, whatever else they have in common. A name of n letters has about n^k / k! of
    them.
    """
    lost = names.select("name").distinct().join(known.select("name"), "name", "left_anti")
    own, other = lost.select("name", F.explode(_shortened(F.col("name"), most)).alias("h")), known.select(F.col("name").alias("suggestion")).distinct().select("suggestion", F.explode(_shortened(F.col("suggestion"), most)).alias("h"))
    # sizes are guessed before texts are made of names, so the smaller side would be sent to every task
    near = own.join(other.hint("merge"), "h").where(F.abs(F.length("name") - F.length("suggestion")) <= most).select("name", "suggestion").distinct()
    near = near.withColumn("distance", F.levenshtein("name", "suggestion"))
    return near.where((F.col("distance") >= 1) & (F.col("distance") <= most))
