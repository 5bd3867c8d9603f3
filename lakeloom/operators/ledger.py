"""A decision ledger: ids from content, a chain that is checked by joins, and a fold that takes only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx

#: Kinds of events that leave records as they are (fixed values).
WITHOUT_RECORDS = ("defer", "request_more_evidence", "reject", "close_gap_as_no_evidence")
_HALF = 1 << 64


def event_id(content: dict[str, Column]) -> Column:
    """The id of an event: a digest of its content, whatever the order of its fields; the same content has the same id."""
    return F.concat(F.lit("evt:"), F.sha2(fx.stable_json(content), 256))


def chain_faults(ledger: DataFrame, payload: Column, head: DataFrame | None = None) -> DataFrame:
    """seq, fault for each event (seq, event_sha, previous_sha) that breaks the chain: content if its sha isn't that of its
    payload, repeated if its number comes again, gap if the number before it is missing, link if its previous sha isn't that
    of the event before. head: seq, event_sha of the last event that was found right, if any; the first event of a chain without
    a head has number 1 and no previous sha.

    Events meet the one before them in an equi-join by number, so a long chain is no single task.
    """
    known = ledger.select("seq", "event_sha")
    if head is not None:
        known = known.unionByName(head.select("seq", "event_sha"))
    prior = known.groupBy((F.col("seq") + 1).alias("seq")).agg(F.min("event_sha").alias("prior"))
    times = known.groupBy("seq").agg(F.count("*").alias("times"))
    rows = ledger.select("seq", "event_sha", "previous_sha", F.sha2(payload, 256).alias("own")).join(prior, "seq", "left").join(times, "seq")
    first = F.lit(head is None) & (F.col("seq") == 1)
    faults = F.array(
        F.when(F.col("event_sha") != F.col("own"), "content"),
        F.when(F.col("times") > 1, "repeated"),
        F.when(F.col("prior").isNull() & ~first, "gap"),
        F.when((F.col("prior").isNotNull() & ~F.col("previous_sha").eqNullSafe(F.col("prior"))) | (first & F.col("previous_sha").isNotNull()), "link"),
    )
    return rows.select("seq", F.explode(F.array_compact(faults)).alias("fault")).distinct()


def folded(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """record, revision, previous, made, revoked: the state of each record after events (seq, kind, record, revision), from the
    state before them, which this function gave for all earlier ones.

    An event that makes a record puts its revision in place, supersede also remembers the one before; revoke marks the
    record, without a record all. The row with a null record keeps the last revocation of all. One window by record sees
    only what is new and one row of what was; two steps give what one over all events gives.
    """
    own = events.where(~F.col("kind").isin(*WITHOUT_RECORDS))
    made = own.where("kind <> 'revoke' and record is not null").select("record", F.col("seq").cast("long").alias("seq"), "kind", "revision", F.lit(None).cast(events.schema["revision"].dataType).alias("previous"))
    gone = own.where("kind = 'revoke'").groupBy("record").agg(F.max("seq").cast("long").alias("revoked"))
    if state is not None:
        made = made.unionByName(state.where("made is not null").select("record", F.col("made").alias("seq"), F.lit("state").alias("kind"), "revision", "previous"))
        gone = gone.unionByName(state.where("revoked is not null").select("record", "revoked")).groupBy("record").agg(F.max("revoked").alias("revoked"))
    before = F.lag("revision").over(Window.partitionBy("record").orderBy("seq"))
    made = made.withColumn("previous", F.when(F.col("kind") == "supersede", before).otherwise(F.col("previous")))
    stands = made.groupBy("record").agg(F.max("seq").alias("made"), F.max_by(F.struct("revision", "previous"), "seq").alias("r"))
    both = stands.select("record", F.col("r.revision").alias("revision"), F.col("r.previous").alias("previous"), "made", F.lit(None).cast("long").alias("revoked"))
    both = both.unionByName(gone.select("record", F.lit(None).cast(made.schema["revision"].dataType).alias("revision"), F.lit(None).cast(made.schema["revision"].dataType).alias("previous"), F.lit(None).cast("long").alias("made"), "revoked"))
    return both.groupBy("record").agg(F.max("revision").alias("revision"), F.max("previous").alias("previous"), F.max("made").alias("made"), F.max("revoked").alias("revoked"))


def advanced(ledger: DataFrame, payload: Column, head: DataFrame | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The state after the events of a ledger that are newer than the head, and the new head (seq, event_sha). Older events are
    not read again; if a newer one breaks the chain, nothing is applied and ValueError names the first fault."""
    last = None if head is None else head.first()
    fresh = ledger if last is None else ledger.where(F.col("seq") > last["seq"])
    fault = chain_faults(fresh, payload, head).orderBy("seq", "fault").first()
    if fault:
        raise ValueError(f"event {fault['seq']}: {fault['fault']}")
    newest = fresh.select("seq", "event_sha") if head is None else fresh.select("seq", "event_sha").unionByName(head)
    return folded(fresh, state), newest.orderBy(F.desc("seq")).limit(1)


def view(state: DataFrame) -> DataFrame:
    """record, revision, status, previous of what a state holds: approved, or revoked after it was made."""
    everywhere = state.where("record is null").agg(F.max("revoked").alias("r"))
    rows = state.where("record is not null and made is not null")
    gone = F.greatest(F.coalesce("revoked", F.lit(-1)), F.coalesce(everywhere.scalar(), F.lit(-1))) > F.col("made")
    return rows.select("record", "revision", F.when(gone, "revoked").otherwise("approved").alias("status"), "previous")


def view_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, digest: a digest of all rows whatever their order: the halves of each row's sha256, summed by 2^64."""
    h = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda i: F.conv(h.substr(16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = rows.select(*(part(i).alias(f"p{i}") for i in range(4))).agg(F.count("*").alias("rows"), *((F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("decimal(38,0)") % F.lit(str(_HALF)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias(f"p{i}") for i in range(4)))
    return sums.select("rows", F.concat_ws("-", *(f"p{i}" for i in range(4))).alias("digest"))
