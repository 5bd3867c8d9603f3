"""Exact duplicates, record comparison, priorities and the decision ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.linkage import suggestions


def exact_groups(rows: DataFrame, key: list[Column], id_col: str) -> DataFrame:
    """first_id, copies, extra of each group of rows with the same key; only hashes are shuffled."""
    keyed = rows.select(F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))), 256).alias("_k"), F.col(id_col).alias("_id"))
    return keyed.groupBy("_k").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies", (F.col("copies") - 1).alias("extra"))


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key and whether both sides have the same value, different ones, or only one side has the key."""
    r = right.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    both = left.select(key, value).join(r, F.col(key) == F.col("_k"), "full")
    outcome = F.when(F.col("_k").isNull(), "left_only").when(F.col(key).isNull(), "right_only").when(F.col(value).eqNullSafe(F.col("_v")), "identical").otherwise("different")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), outcome.alias("outcome"))


def priority(rules: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """The highest score of the rules that hold (none: 0) and their names in order."""
    score = F.greatest(F.lit(0), F.lit(0), *(F.when(c, s).otherwise(0) for _, c, s in rules))
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c, _ in rules)), lambda x: x.isNotNull())
    return score, F.array_join(F.array_sort(names), ",")


#: What a decision leaves a task in; others that make records leave it decided (fixed values).
TASK_STATES = {"defer": "deferred", "request_more_evidence": "requires_more_evidence", "reject": "rejected", "close_gap_as_no_evidence": "rejected"}


def task_states(ledger: DataFrame, key: str = "task", order: str = "seq") -> DataFrame:
    """task, status: what the last event of each task leaves it in."""
    state = F.coalesce(F.create_map(*(F.lit(x) for kv in TASK_STATES.items() for x in kv))[F.col("kind")], F.lit("decided"))
    return ledger.groupBy(key).agg(F.max_by(state, order).alias("status"))


def approved_records(ledger: DataFrame) -> DataFrame:
    """record, revision, status, previous of each record of a ledger (seq, kind, record, revision): the fold of its events.

    approve and every other kind that makes a record puts its revision in place, supersede likewise and remembers the one
    before, revoke marks what stands then; a revoke without a record marks all that stand. Later approvals bring a record
    back. Events without effect on records are left out. As the last making event decides what stands and a revoke only
    marks it, no ordered walk is needed: one aggregation for each record and one value for the whole ledger.
    """
    effective = ledger.where(~F.col("kind").isin(*TASK_STATES))
    everywhere = effective.where("kind = 'revoke' and record is null").agg(F.max("seq").alias("all_revoked"))
    own = effective.where("record is not null")
    made = own.where("kind <> 'revoke'")
    before = F.lag("revision").over(Window.partitionBy("record").orderBy("seq"))
    made = made.withColumn("previous", F.when(F.col("kind") == "supersede", before))
    stands = made.groupBy("record").agg(F.max("seq").alias("at"), F.max_by(F.struct("revision", "previous"), "seq").alias("r"))
    revoked = own.where("kind = 'revoke'").groupBy("record").agg(F.max("seq").alias("revoked"))
    out = stands.join(revoked, "record", "left")
    gone = F.greatest(F.coalesce("revoked", F.lit(-1)), F.coalesce(everywhere.scalar(), F.lit(-1))) > F.col("at")
    return out.select("record", "r.revision", F.when(gone, "revoked").otherwise("approved").alias("status"), "r.previous")


#: Order of the classes of a review queue (fixed values).
URGENCY = ("critical", "high", "normal", "low")


def review_queue(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """tasks (task, priority, reasons) in the order of work: by class, then reasons, then task."""
    rank = F.array_position(F.array(*map(F.lit, URGENCY)), F.col("priority"))
    out = tasks.orderBy(F.when(rank == 0, len(URGENCY) + 1).otherwise(rank), F.array_join("reasons", "|"), "task")
    return out if limit is None else out.limit(limit)


def capped(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """At most limit rows, and limit_reached: whether there are as many as the limit, so that more may have been cut."""
    first = rows.orderBy(*order).limit(limit)
    return first.withColumn("limit_reached", F.count("*").over(Window.partitionBy()) >= limit)


def reconciled(rows: DataFrame, created: str, *parts: str) -> DataFrame:
    """One row: the sums of created and of its parts, and balanced: whether the parts make up the whole."""
    sums = rows.agg(*(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in (created, *parts)))
    return sums.withColumn("balanced", F.col(created) == sum((F.col(p) for p in parts), F.lit(0)))


def accounted(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, outcome: stored, missing or unexpected for each key of either side; both sides may repeat keys."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    s = stored.select(key).distinct().withColumn("_s", F.lit(True))
    return e.join(s, key, "full").select(key, F.when(F.col("_s").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("stored").alias("outcome"))


def exact_groups_by_scope(rows: DataFrame, scope: list[str], text: Column, id_col: str, order: str) -> DataFrame:
    """kept, occurrences: of rows with the same scope and text the first by order stays, with the ids of all."""
    keyed = rows.select(F.sha2(F.to_json(F.struct(*scope, text.alias("_text")), {"ignoreNullFields": "false"}), 256).alias("_k"), F.col(id_col).alias("_id"), F.col(order).alias("_o"))
    return keyed.groupBy("_k").agg(F.min_by("_id", F.struct("_o", "_id")).alias("kept"), F.array_sort(F.collect_list("_id")).alias("occurrences")).select("kept", "occurrences")


def inventory(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, content_sha, revision: the sha256 of each file's content, and of its key and content together."""
    sha = F.sha2(F.col(content), 256)
    return files.select(key, sha.alias("content_sha"), F.sha2(F.concat_ws(":", F.col(key).cast("string"), sha), 256).alias("revision"))


def staleness(now: DataFrame, then: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """key, reasons, stale: the hashes that differ between two states of each key, `missing` where one side lacks it."""
    old = then.select(key, *(F.col(h).alias("_" + h) for h in hashes), F.lit(True).alias("_t"))
    both = now.withColumn("_n", F.lit(True)).join(old, key, "full")
    lost = F.col("_t").isNull() | F.col("_n").isNull()
    changed = F.array_compact(F.array(*(F.when(~F.col(h).eqNullSafe(F.col("_" + h)), F.lit(h + "_changed")) for h in hashes)))
    reasons = F.when(lost, F.array(F.lit("missing"))).otherwise(changed)
    return both.select(key, reasons.alias("reasons"), (F.size(reasons) > 0).alias("stale"))


def key_kept(rows: DataFrame, key: list[str], risks: Column | None = None) -> DataFrame:
    """One row: rows, keys, verdict on whether a key still tells the rows apart: proven if no row shares or lacks it; with
    risks in the definition (a union, grouping, outer join) supported_partial; otherwise unproven; no rows: not_evaluable."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    by_key = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~whole).alias("lost"))
    n = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))
    risky = F.lit(False) if risks is None else risks
    verdict = F.when(F.col("rows") == 0, "not_evaluable").when((F.col("rows") != F.col("keys")) | (F.col("lost") > 0), "unproven").when(risky, "supported_partial").otherwise("proven")
    return n.select("rows", "keys", verdict.alias("verdict"))


def upserted_links(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, confidence, use_count, source: links with new sightings added: the highest confidence, one use more for each,
    and the source `seed` for good once it is one."""
    both = old.select(*key, "confidence", "use_count", "source").unionByName(new.select(*key, "confidence", F.lit(1).cast("long").alias("use_count"), "source"))
    return both.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.sum("use_count").alias("use_count"), F.when(F.bool_or(F.col("source") == "seed"), "seed").otherwise(F.max("source")).alias("source"))


def paired_files(left: DataFrame, right: DataFrame, name: str = "name", most: int = 2) -> DataFrame:
    """left_name, right_name, suggested, outcome for each file of left, and for each of right that none pairs with.

    Names are compared without folder and ending, folded in case. One file of right is exact or, if only the case differs,
    case_insensitive_exact; several are ambiguous. Without one, the right name within most letters' edits that is nearest (ties: the
    first) is only suggested: requires_confirmation; else missing. What stays of right is an orphan.
    """
    base = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    own = left.select(F.col(name).alias("left_name"), base.alias("base"), F.lower(base).alias("key"))
    other = right.select(F.col(name).alias("other"), base.alias("other_base"), F.lower(base).alias("key"))
    by_key = other.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("other", "other_base")).alias("o"))
    met = own.join(by_key, "key", "left")
    single = F.when(F.col("n") == 1, F.when(F.col("o.other_base") == F.col("base"), "exact").otherwise("case_insensitive_exact")).when(F.col("n") > 1, "ambiguous")
    lost = met.where("n is null").select(F.col("key").alias("name")).distinct()
    near = suggestions(lost, by_key.select(F.col("key").alias("name")), most).groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("s"))
    near = near.join(by_key.select(F.col("key").alias("_k"), F.col("o.other").alias("suggested")), F.col("s.suggestion") == F.col("_k")).select(F.col("name").alias("key"), "suggested")
    pairs = met.join(near, "key", "left").select("left_name", F.when(F.col("n") == 1, F.col("o.other")).alias("right_name"), "suggested", F.coalesce(single, F.when(F.col("suggested").isNotNull(), "requires_confirmation").otherwise("missing")).alias("outcome"))
    none = F.lit(None).cast("string")
    orphans = other.join(own.select("key").distinct(), "key", "left_anti").select(none.alias("left_name"), F.col("other").alias("right_name"), none.alias("suggested"), F.lit("orphan").alias("outcome"))
    return pairs.unionByName(orphans)


def current_state(ledger: DataFrame, key: str, decision: str, *order: str) -> DataFrame:
    """The last decision of each key and the number of its events."""
    return ledger.groupBy(key).agg(F.max_by(decision, F.struct(*order)).alias("state"), F.count("*").alias("events"))


def chained(ledger: DataFrame, key: str, payload: Column, *order: str) -> DataFrame:
    """event_sha and previous_sha of each event of a key in order; the first has no previous one."""
    by = Window.partitionBy(key).orderBy(*order)
    out = ledger.withColumn("event_sha", F.sha2(payload, 256))
    return out.withColumn("previous_sha", F.lag("event_sha").over(by)).withColumn("seq", F.row_number().over(by))


def broken_links(ledger: DataFrame, key: str) -> DataFrame:
    """Events whose previous_sha isn't the sha of the event before them, or whose seq doesn't follow it."""
    by = Window.partitionBy(key).orderBy("seq")
    prior, at = F.lag("event_sha").over(by), F.lag("seq").over(by)
    return ledger.withColumns({"_p": prior, "_s": at}).where(~F.col("previous_sha").eqNullSafe(F.col("_p")) | (F.col("seq") != F.coalesce(F.col("_s"), F.lit(0)) + 1)).drop("_p", "_s")


def scored_intents(text: Column, signals: dict[str, list[tuple[str, float]]], least: float, margin: float) -> Column:
    """The intent whose patterns weigh most; unknown below least or if the next is within margin."""
    scores = F.array_sort(F.array(*(F.struct((-sum((F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in rules), F.lit(0.0))).alias("s"), F.lit(name).alias("name")) for name, rules in signals.items())))
    best, next_ = scores[0], scores[1]
    return F.when((-best["s"] < least) | (next_["s"] - best["s"] <= margin), "unknown").otherwise(best["name"])


#: Sounds that say nothing, and the word that alone tells of a technical problem (fixed values).
FILLER, MICROPHONE = r"(?i)^(hm+|eee+|yyy+)\.?$", "(?i)mikrofon"


def noise(text: Column, matter: list[str], patterns: list[tuple[str, str]], least: int = 4) -> Column:
    """The kind of noise of a segment: uncertain if it is shorter than least, content if a word of the matter stands in it
    whatever else does, else that of the first pattern found, repeated_phrase for a filler, audio_problem for a microphone,
    else content. Patterns are case-blind. Uncertain segments are kept, as content is."""
    t = F.trim(text)
    out = F.when(t.rlike(FILLER), "repeated_phrase").when(t.rlike(MICROPHONE), "audio_problem").otherwise("content")
    for name, pattern in reversed(patterns):
        out = F.when(t.rlike(f"(?iu){pattern}"), name).otherwise(out)
    for word in matter:
        out = F.when(t.rlike(f"(?iu){word}"), "content").otherwise(out)
    return F.when(F.length(t) < least, "uncertain").otherwise(out)


def without_noise(segments: DataFrame, kind: Column) -> DataFrame:
    """The segments that are content or uncertain; what noise() calls anything else takes no part in topics."""
    return segments.where(kind.isin("content", "uncertain"))


def tagged(links: DataFrame, tags: DataFrame, pattern: str, key: str = "tag") -> DataFrame:
    """The distinct links whose tag (tag_id, tag) is like a pattern; the tags are filtered before they meet the links."""
    wanted = tags.where(F.col(key).like(pattern)).select("tag_id").distinct()
    return links.join(wanted, "tag_id", "left_semi").distinct()
