"""Queries of joins over time, periods, topics and sections, and the SQL that must give the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lakeloom.operators import temporal
from lakeloom.queries import query
from lakeloom.sources.tables import table


@query("""WITH h AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events), u AS (SELECT DISTINCT user_id FROM events UNION SELECT 1000000 + c_custkey FROM customer WHERE c_custkey < 5)
SELECT u.user_id, h.ts, h.event_type FROM u LEFT JOIN h ON u.user_id = h.user_id AND h.ts <= DATE '2024-01-10' AND (h.valid_to IS NULL OR h.valid_to >= DATE '2024-01-10')""")
def valid_on_day(spark, d):
    """Each user with the states that hold on a day, or with none."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    states = e.select("user_id", "ts", "event_type", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("valid_to"))
    users = e.select("user_id").union(table(spark, d, "customer").where("c_custkey < 5").select(F.col("c_custkey") + 1000000)).distinct()
    return temporal.valid_on(users, states, ["user_id"], "ts", "valid_to", date(2024, 1, 10)).select("user_id", "ts", "event_type")


@query("""SELECT o_orderkey, o_orderdate >= DATE '1997-05-10' AND o_orderdate < DATE '1997-06-09' AS next_30, o_orderdate >= DATE '1997-05-01' AND o_orderdate < DATE '1997-06-01' AS month, o_orderdate >= DATE '1997-05-10' AND o_orderdate < DATE '1997-05-11' AS today,
o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AS range FROM orders""")
def periods(spark, d):
    """The kinds of period as conditions, each evaluated by a day given."""
    c, day = F.col("o_orderdate"), date(1997, 5, 10)
    return table(spark, d, "orders").select("o_orderkey", temporal.in_period(c, "next_days", day, days=30).alias("next_30"), temporal.in_period(c, "current_month", day).alias("month"), temporal.in_period(c, "today", day).alias("today"), temporal.in_period(c, "date_range", day, date(1997, 1, 1), date(1997, 12, 31)).alias("range"))


@query("""WITH n AS (SELECT p_partkey, (1896 + p_partkey % 210)::INT AS y, (p_size % 14)::INT AS m, (p_partkey % 33)::INT AS d FROM part)
SELECT p_partkey, try_cast(lpad(y::VARCHAR, 4, '0') || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) IS NOT NULL AS valid, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap,
CASE WHEN m BETWEEN 1 AND 12 THEN day(last_day(make_date(y, m, 1)))::INT END AS days FROM n""")
def calendar_days(spark, d):
    """Days of the calendar, leap years and lengths of months, from bare numbers."""
    y, m, day = (F.lit(1896) + F.col("p_partkey") % 210).cast("int"), (F.col("p_size") % 14).cast("int"), (F.col("p_partkey") % 33).cast("int")
    valid, leap, days = temporal.calendar(y, m, day)
    return table(spark, d, "part").select("p_partkey", valid.alias("valid"), leap.alias("leap"), days.alias("days"))


_SEGMENTS = """seg AS (SELECT event_id, user_id, (event_id * 7 + event_id % 5 * 3 + CASE WHEN event_id % 29 = 0 THEN 9 ELSE 0 END)::DOUBLE AS a, 1.0 + value % 13 AS len, CASE WHEN event_id % 31 = 0 THEN 'Teraz ' ELSE '' END || event_type AS text FROM events)"""


def _segments(spark, d):
    k = F.col("event_id")
    a = (k * 7 + k % 5 * 3 + F.when(k % 29 == 0, 9).otherwise(0)).cast("double")
    text = F.concat(F.when(k % 31 == 0, "Teraz ").otherwise(""), "event_type")
    return table(spark, d, "events").select("event_id", "user_id", a.alias("a"), (a + 1.0 + F.col("value") % 13).alias("b"), text.alias("text"))


@query(f"""WITH {_SEGMENTS}, x AS (SELECT event_id, user_id, a, a + len AS b FROM seg), y AS (SELECT event_id AS other, user_id, a AS c, a + len AS d FROM seg WHERE event_id % 3 = 0)
SELECT event_id, other FROM x JOIN y USING (user_id) WHERE b > c AND a < d""")
def overlapping_segments(spark, d):
    """Pairs of a user's intervals that overlap, by windows."""
    rows = _segments(spark, d)
    other = rows.where("event_id % 3 = 0").select(F.col("event_id").alias("other"), "user_id", F.col("a").alias("c"), F.col("b").alias("d"))
    return temporal.interval_join(rows, other, ["user_id"], ("a", "b"), ("c", "d"), 20.0).select("event_id", "other")


@query("""WITH RECURSIVE s AS (SELECT *, event_id % 4 AS src, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS place, round(2 + event_id % 17, 1)::DOUBLE AS len FROM events),
p AS (SELECT *, sum(len + CASE WHEN event_id % 29 = 0 THEN 9 ELSE 1 END) OVER (PARTITION BY src ORDER BY place) AS b, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS cue FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY place) AS n FROM p WHERE cue = 1 OR (event_id % 13 <> 0 AND event_id % 37 <> 0)),
q AS (SELECT *, b - len AS a, coalesce((b - len) - lag(b) OVER (PARTITION BY src ORDER BY n) >= 8 OR cue = 1, true) AS opens FROM c),
w(src, n, place, topic, total) AS (SELECT src, n, place, 1, len FROM q WHERE n = 1 UNION ALL SELECT q.src, q.n, q.place, CASE WHEN q.opens OR w.total >= 120 THEN w.topic + 1 ELSE w.topic END, CASE WHEN q.opens OR w.total >= 120 THEN q.len ELSE w.total + q.len END FROM w JOIN q ON q.src = w.src AND q.n = w.n + 1)
SELECT src, topic::INT AS topic, count(*) AS segments, min(place) AS first_n FROM w GROUP BY ALL""")
def transcript_topics(spark, d):
    """Topics of a transcript without its noise: after silence, with a cue, or when they have lasted long."""
    from pyspark.sql import Window

    from lakeloom.operators import curation

    k, by = F.col("event_id"), Window.partitionBy("src").orderBy("event_id")
    said = F.when(k % 31 == 0, " Teraz o czym innym").when(k % 13 == 0, "Hmmm.").when(k % 37 == 0, "czy mikrofon działa").when(k % 5 == 0, "mikrofon i wniosek").otherwise("dalej")
    rows = table(spark, d, "events").select("event_id", (k % 4).alias("src"), F.round(F.lit(2) + k % 17, 1).cast("double").alias("len"), said.alias("text"))
    rows = rows.withColumns({"n": F.row_number().over(by), "b": F.sum(F.col("len") + F.when(k % 29 == 0, 9).otherwise(1)).over(by)}).withColumn("a", F.col("b") - F.col("len"))
    found = temporal.topics(curation.without_noise(rows, curation.noise(F.col("text"), ["wniosek", "czym innym"], [])), "src", "a", "b", "text")
    return found.groupBy("src", "topic").agg(F.count("*").alias("segments"), F.min("n").cast("long").alias("first_n"))


@query(f"""WITH {_SEGMENTS}, x AS (SELECT user_id, a, a + len AS b, trim(text) AS t FROM seg), u AS (SELECT user_id, max(b) AS duration FROM x GROUP BY 1), w AS (SELECT *, unnest(range(greatest(floor(a / 600), 0)::BIGINT, greatest(ceil(b / 600) - 1, 0)::BIGINT + 1)) AS win FROM x WHERE b > a AND t <> '')
SELECT user_id, win AS "window", (win * 600)::DOUBLE AS begins, least(win * 600 + 600, any_value(duration))::DOUBLE AS ends, min(a) AS first, max(b) AS last, md5(string_agg(t, ' ' ORDER BY a, b, t)) AS digest FROM w JOIN u USING (user_id) GROUP BY user_id, win""")
def window_chunks(spark, d):
    """Texts of windows of time that follow each other, the last up to the end."""
    return temporal.window_chunks(_segments(spark, d), "user_id", "a", "b", "text", 600.0).select("user_id", "window", F.col("begins").cast("double").alias("begins"), F.col("ends").cast("double").alias("ends"), "first", "last", F.md5("text").alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT *, length(line) < 60 AND regexp_matches(line, '[a-z]') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, section::INT AS section, count(*) AS lines, min(pos)::INT AS first_line, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL""")
def document_sections(spark, d):
    """Sections of documents: a preamble, then one from each heading, here a short line, to the next."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    head = (F.length("line") < 60) & F.col("line").rlike("[a-z]")
    found = temporal.sections(lines, "doc_id", "at", head)
    return found.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.min("at").alias("first_line"), F.sum(F.length("line")).alias("chars")).withColumn("section", F.col("section").cast("int"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR")
def unexpired_events(spark, d):
    """Rows that aren't past their end and not stale."""
    from datetime import datetime

    rows = table(spark, d, "events").withColumn("expires", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return temporal.unexpired(rows, "expires", datetime(2024, 1, 20), "ts", 72).select("event_id")


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 40 THEN 'uncertain' WHEN regexp_matches(lower(text), 'tion') THEN 'content' WHEN regexp_matches(lower(text), 'eau') THEN 'audio_problem' WHEN regexp_matches(lower(text), 'ung') THEN 'break_announcement' ELSE 'content' END AS noise FROM conversations""")
def noise_kinds(spark, d):
    """Kinds of noise among segments: very short ones are uncertain, words of the matter override, then patterns in order."""
    from lakeloom.operators import curation

    kind = curation.noise(F.col("text"), ["tion"], [("audio_problem", "eau"), ("break_announcement", "ung")], 40)
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("noise"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """Events of each kind in each day, by the operator that streams use."""
    from lakeloom.streaming.ledger import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 12")
def newest_orders(spark, d):
    """The newest rows by the date column that they have."""
    return temporal.newest_first(table(spark, d, "orders"), ("modified", "created"), "o_orderkey").select("o_orderkey", "o_orderdate").limit(12)
