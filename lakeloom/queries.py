"""One query for each operator, over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators import curation, graph, retrieval, temporal, traversal
from lakeloom.plans.request import Filter, Relation, Request
from lakeloom.sources.tables import html_text, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MONEY = "decimal(18,2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey, c_name, n_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500""")
def report_open_orders(spark, d):
    """A report: inner and left joins, existence at the report's grain, a half-open period, order and the fixed row cap."""
    returned = Relation(table(spark, d, "lineitem"), (("o_orderkey", "l_orderkey"),), "exists", (Filter("l_returnflag", "=", "R"),))
    customer = Relation(table(spark, d, "customer"), (("o_custkey", "c_custkey"),))
    nation = Relation(table(spark, d, "nation"), (("c_nationkey", "n_nationkey"),), "left")
    period = (Filter("o_orderstatus", "=", "O"), Filter("o_orderdate", ">=", datetime(1996, 1, 1)), Filter("o_orderdate", "<", datetime(1998, 1, 1)))
    fields = ("o_orderkey", "c_name", "n_name", "o_orderdate", "o_totalprice")
    return Request(fields, period, relations=(returned, customer, nation), order_by=(("o_orderdate", True), ("o_orderkey", False)), limit=500).answer(table(spark, d, "orders"))


@query("""SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE (p_size <= 10 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#1', 'Brand#2')) OR (p_retailprice IS NULL OR p_retailprice <= 950) OR upper(p_name) LIKE 'PART 1%'""")
def filter_groups(spark, d):
    """Groups of conditions: any group, all within one; IN, nullable comparison, case-blind prefix."""
    groups = ((Filter("p_size", "<=", 10), Filter("p_brand", "in", ("Brand#12", "Brand#23", "Brand#1", "Brand#2"))), (Filter("p_retailprice", "or_null_le", 950.0),), (Filter("_upper", "starts_with", "PART 1"),))
    return Request(("p_partkey", "p_name", "p_brand", "p_size"), any_of=groups).answer(table(spark, d, "part").withColumn("_upper", F.upper("p_name")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-01' AND o_orderpriority IS NOT NULL")
def filter_date_range(spark, d):
    """A range of days, both included."""
    return Request(("o_orderkey", "o_orderdate"), (Filter("o_orderdate", "between_dates", (date(1997, 3, 1), date(1997, 3, 31))), Filter("o_orderpriority", "is_not_null"))).answer(table(spark, d, "orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def customers_without_large_orders(spark, d):
    """Absence as an anti join."""
    return Request(("c_custkey", "c_name"), relations=(Relation(table(spark, d, "orders"), (("c_custkey", "o_custkey"),), "absent", (Filter("o_totalprice", ">", 100000),)),)).answer(table(spark, d, "customer"))


@query("""SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%'""")
def left_join_with_condition(spark, d):
    """A left join whose extra condition belongs to the joined side."""
    return Request(("c_custkey", "c_mktsegment", "o_orderkey"), relations=(Relation(table(spark, d, "orders"), (("c_custkey", "o_custkey"),), "left", (Filter("o_orderpriority", "like", "1%"),)),)).answer(table(spark, d, "customer"))


@query("""SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice::DECIMAL(18,2))::DOUBLE, 4) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) >= 5""")
def aggregates_having(spark, d):
    """count, sum, avg, min, max by group and a condition on the groups."""
    rows = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast(MONEY))
    joins = (Relation(table(spark, d, "customer"), (("o_custkey", "c_custkey"),)), Relation(table(spark, d, "nation"), (("c_nationkey", "n_nationkey"),)))
    wanted = (("count", "*", "orders"), ("sum", "price", "total"), ("min", "o_totalprice", "least"), ("max", "o_totalprice", "most"), ("avg", "price", "mean"))
    out = Request(relations=joins, group_by=("c_mktsegment", "n_name"), aggregates=wanted, having=(Filter("orders", ">=", 5),)).answer(rows)
    return out.withColumn("mean", F.round(F.col("mean").cast("double"), 4)).withColumn("total", F.round(F.col("total").cast("double"), 2))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return Request(("p_brand", "p_type"), distinct=True).answer(table(spark, d, "part"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def page_of_orders(spark, d):
    """The third page of 25."""
    return Request(("o_orderkey", "o_totalprice"), order_by=(("o_totalprice", True), ("o_orderkey", False)), offset=50, limit=25).answer(table(spark, d, "orders"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def newest_events(spark, d):
    return Request(("event_id", "ts", "event_type"), order_by=(("ts", True), ("event_id", True)), limit=10).answer(table(spark, d, "events"))


_VALID = "WITH v AS (SELECT user_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"


def _history(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type").withColumn("valid_to", F.lead("ts").over(order))


@query(_VALID + " SELECT user_id, event_type, ts FROM v WHERE ts <= DATE '2024-01-15' AND (valid_to IS NULL OR valid_to >= DATE '2024-01-15')")
def state_as_of(spark, d):
    """What held for each user on a day."""
    return Request(("user_id", "event_type", "ts"), valid=("ts", "valid_to", date(2024, 1, 15))).answer(_history(spark, d))


@query(_VALID + " SELECT user_id, event_type, ts, valid_to FROM v")
def state_history(spark, d):
    """Every state with the time until which it held."""
    return _history(spark, d).select("user_id", "event_type", "ts", "valid_to")


@query("""WITH p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL),
e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT e.*, p.v AS bv, p.ts AS bt FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts),
a AS (SELECT b.*, p.v AS av, p.ts AS a_t FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.ts < p.ts)
SELECT user_id, ts, event_id, bv AS before, av AS after, CASE WHEN a_t IS NULL OR ts - bt <= a_t - ts THEN bv ELSE av END AS nearest FROM a""")
def nearest_purchase(spark, d):
    """The purchase before, after and nearest to each error of a user."""
    e = table(spark, d, "events")
    return temporal.nearest_before_after(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value")


@query("""SELECT w AS week, count(*) AS running FROM (SELECT unnest(range(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 7,
  (date_diff('day', DATE '1970-01-01', (o_orderdate + INTERVAL 30 DAY - INTERVAL 1 MICROSECOND)::DATE) // 7) + 1)) AS w FROM orders) GROUP BY w""")
def orders_running_by_week(spark, d):
    """Orders that take 30 days, counted in each week that they overlap."""
    rows = table(spark, d, "orders").select("o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("done"))
    return temporal.overlapping(rows, "o_orderdate", "done", 7, "week").groupBy("week").agg(F.count("*").alias("running"))


@query("""WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o)
SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def user_sessions(spark, d):
    """Runs of a user's events without a gap of over twelve hours."""
    s = temporal.sessions(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", F.lit(12 * 3_600_000_000), "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH n AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events),
g AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS p FROM n)
SELECT user_id, unnest(range(p + 1, day)) AS missing FROM g WHERE day - p > 1""")
def missing_days(spark, d):
    """Days without events between a user's days with some."""
    rows = table(spark, d, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day"))
    return temporal.missing_numbers(rows, "user_id", "day")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark, d):
    """Each customer's last order, aggregated before the shuffle."""
    return temporal.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, n AS place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 2 AND n <= 4")
def rows_of_page(spark, d):
    """Numbered rows of each customer, those of one page."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", n.alias("place")).where("place > 2 AND place <= 4")


@query("""SELECT count(*) AS cells, count(*) FILTER (WHERE props IS NULL) AS nulls, count(*) FILTER (WHERE value IS NOT NULL AND isfinite(value)) AS numbers,
count(*) FILTER (WHERE regexp_matches(event_type, '^[=+@-]')) AS formulas, count(DISTINCT event_type) AS kinds FROM events""")
def cell_statistics(spark, d):
    """Nulls, finite numbers and formula-like cells of a result, in one pass."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return table(spark, d, "events").agg(F.count("*").alias("cells"), F.count_if(F.col("props").isNull()).alias("nulls"), F.count_if(ok).alias("numbers"), F.count_if(fx.formula_lead(F.col("event_type"))).alias("formulas"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT event_type, count(*) AS events, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS share FROM events GROUP BY 1")
def type_shares(spark, d):
    """Counts by key and their share of all, rounded."""
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"))
    return n.withColumn("share", F.round(100.0 * F.col("events") / F.sum("events").over(Window.partitionBy()), 2))


@query("SELECT event_type, k, count(*) AS events, list_aggregate(list_sort(list(DISTINCT user_id % 7)), 'string_agg', ',') AS groups FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) GROUP BY 1, 2")
def json_properties(spark, d):
    """A field of JSON text as a column; distinct members collected in order."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").withColumn("k", k).groupBy("event_type", "k").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set(F.col("user_id") % 7)), ",").alias("groups"))


@query("""SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""")
def set_operations(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nationkey"))
    return c.intersect(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey")).exceptAll(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query("""SELECT coalesce(o.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' WHEN o.v IS NOT DISTINCT FROM l.v THEN 'identical' ELSE 'different' END AS outcome
FROM (SELECT o_orderkey AS k, round(o_totalprice)::BIGINT % 3 AS v FROM orders) o FULL JOIN (SELECT l_orderkey AS k, count(*) % 3 AS v FROM lineitem GROUP BY 1) l ON o.k = l.k""")
def compare_sources(spark, d):
    """Two sources by key: identical, different, or on one side only."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.round("o_totalprice").cast("long") % 3).alias("v"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count("*") % 3).alias("v"))
    return curation.compare(o, n, "k", "v")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, (date_trunc('month', o_orderdate) + INTERVAL 2 MONTH)::DATE::VARCHAR AS later,
last_day(o_orderdate::DATE)::VARCHAR AS month_end, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') + 1 AS span, date_sub('year', o_orderdate::DATE, DATE '2002-01-01')::INT AS years,
(o_orderkey // 3600)::VARCHAR || ':' || lpad((o_orderkey // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS clock FROM orders""")
def date_functions(spark, d):
    o = F.to_date("o_orderdate")
    end = F.lit(date(2002, 1, 1))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(o, "yyyy-MM-dd").alias("day"), F.trunc(o, "MM").cast("string").alias("month"), F.add_months(F.trunc(o, "MM"), 2).cast("string").alias("later"), F.last_day(o).cast("string").alias("month_end"), (F.datediff(end, o) + 1).cast("long").alias("span"), fx.years_between(o, end).alias("years"), fx.clock(F.col("o_orderkey")).alias("clock"))


@query("""WITH h AS (SELECT doc_id, sha256(source || ':' || doc_id) AS h, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || format('{:02x}', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id,
CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 297) || ' … ' || right(t, 100) END AS excerpt, ceil(length(text) / 3.5)::BIGINT AS tokens,
lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS plain FROM h""")
def text_functions(spark, d):
    plain = F.lower(F.trim(F.regexp_replace("text", r"[^A-Za-z0-9]+", " ")))
    return table(spark, d, "documents").select("doc_id", fx.point_id(F.col("source"), F.col("doc_id")).alias("point_id"), fx.excerpt(F.col("text"), 400).alias("excerpt"), F.ceil(F.length("text") / 3.5).alias("tokens"), plain.alias("plain"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS words FROM part)
SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(words, lambda x: {'n': -length(x), 'w': x})), lambda s: s.w), ' ') AS terms, len(words)::INT AS n FROM w""")
def search_terms(spark, d):
    t = fx.terms(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(t, " ").alias("terms"), F.size(t).alias("n"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, i, regexp_replace(substr(t, (i * 1800 + 1)::BIGINT, 2000), '^\\s+|\\s+$', '', 'g') AS chunk FROM (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 2000) / 1800.0), 0)::BIGINT + 1)) AS i FROM t WHERE t <> ''))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, length(chunk)::INT AS chars, md5(chunk) AS digest FROM c WHERE chunk <> ''""")
def document_chunks(spark, d):
    """Overlapping chunks of whole texts."""
    return retrieval.chunked(table(spark, d, "documents")).select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label IN (1, 3, 5) ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20""")
def cosine_search(spark, d):
    """Exact cosine search for one vector with a filter on the payload."""
    vectors = table(spark, d, "embeddings")
    q = vectors.where("vec_id = 7").select("embedding").first()
    return retrieval.search(vectors, q[0] if q else [], 20, F.col("label").isin(1, 3, 5)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT doc_id, source, 0.18 / 3 * ((contains(strip_accents(lower(text)), 'theast') OR contains(strip_accents(lower(text)), 'theas') OR contains(strip_accents(lower(text)), 'thea'))::INT + (contains(strip_accents(lower(text)), 'tion'))::INT
 + (contains(strip_accents(lower(text)), 'ingea') OR contains(strip_accents(lower(text)), 'inge'))::INT) AS score FROM documents)
SELECT source, doc_id, round(max(score), 6)::DOUBLE AS score FROM s WHERE score >= 0.1 GROUP BY ALL ORDER BY max(score) DESC, source, doc_id LIMIT 50""")
def lexical_hits(spark, d):
    """Boosts by words and their stems, a threshold on the boosted score, the best of each key, the best of all."""
    rows = table(spark, d, "documents").select("source", "doc_id", retrieval.word_boost(F.col("text"), ["theast", "tion", "ingea"]).alias("score"))
    return retrieval.merge_hits(rows, ["source", "doc_id"], 0.1, 50).withColumn("score", F.round("score", 6))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies, count(*) - 1 AS extra FROM documents GROUP BY lang, text")
def exact_duplicates(spark, d):
    """Groups of equal texts within a language."""
    return curation.exact_groups(table(spark, d, "documents"), [F.col("lang"), F.col("text")], "doc_id")


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre)\\b[^>]*>', chr(8232), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM s),
e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), chr(8232)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM e)
SELECT page_id, length(t)::INT AS chars, md5(t) AS digest FROM l""")
def page_text(spark, d):
    """Text of raw pages."""
    t = html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


def _parts(spark, d):
    """A part leads to the parts whose keys are its own plus one, two or three times its size."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("src"), F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.col("p_partkey") + k * F.col("p_size"))).alias("dst"))


_EDGES = "edges AS (SELECT p_partkey AS src, unnest([p_partkey + p_size, p_partkey + 2 * p_size, p_partkey + 3 * p_size]) AS dst FROM part)"


@query(f"WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def reachable_parts(spark, d):
    """Parts that one leads to in at most four steps, with the fewest."""
    return graph.reach(_parts(spark, d), spark.range(1, 2).withColumnRenamed("id", "node"), 4)


@query(f"WITH RECURSIVE {_EDGES}, r(node, depth) AS (SELECT 200::BIGINT, 0 UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def dependent_parts(spark, d):
    """Parts that lead to one in at most three steps."""
    return graph.reach(_parts(spark, d), spark.range(200, 201).withColumnRenamed("id", "node"), 3, reverse=True)


_WALKS = f"""WITH RECURSIVE {_EDGES}, roots(root) AS (SELECT p_partkey FROM part), x AS (SELECT DISTINCT src, dst FROM edges), r(root, node, depth, path) AS (SELECT root, root, 0, [root] FROM roots UNION ALL SELECT root, dst, depth + 1, list_append(path, dst) FROM r JOIN x ON src = node WHERE depth < 4 AND (depth = 0 OR (node <> root AND NOT list_contains(path, dst))))"""


@query(f"""{_WALKS}, m AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS k FROM r WHERE depth > 0), cut AS (SELECT *, max(k) OVER (PARTITION BY root) > 60 AS truncated FROM m),
t AS (SELECT *, min(depth) OVER (PARTITION BY root, node) AS least, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS n FROM cut WHERE k <= 60 AND node <> root)
SELECT root, node, depth::INT AS depth, array_to_string(path, '>') AS path, truncated FROM t WHERE depth = least AND n <= 3 AND least > 1""")
def dependency_paths(spark, d):
    """What every part depends on through others: at most three ways of the least depth, within sixty walks of a part."""
    found = traversal.dependency_paths(_parts(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")), 4, budget=60)
    return found.withColumn("path", F.array_join("path", ">"))


@query(f"""{_WALKS}, t AS (SELECT *, min(depth) OVER (PARTITION BY root, node) AS least, row_number() OVER (PARTITION BY root, node ORDER BY depth, path) AS n FROM r WHERE depth > 0 AND node <> root)
SELECT root, node, depth::INT AS depth, array_to_string(path, '>') AS path FROM t WHERE depth = least AND n <= 3 AND least > 1""")
def shortest_paths(spark, d):
    """The same without a budget."""
    found = traversal.dependency_paths(_parts(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")), 4, budget=None)
    return found.drop("truncated").withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {_EDGES}, e AS (SELECT src, CASE WHEN src % 50 = 0 THEN src ELSE dst END AS dst FROM edges), n AS (SELECT p_partkey AS node, p_partkey % 97 AS place FROM part)
SELECT DISTINCT src, dst, 'self' AS fault FROM e WHERE src = dst UNION ALL SELECT DISTINCT src, dst, 'missing' FROM e WHERE dst NOT IN (SELECT node FROM n)
UNION ALL SELECT src, dst, 'repeated' FROM e GROUP BY src, dst HAVING count(*) > 1 UNION ALL SELECT DISTINCT src, dst, 'forward' FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE b.place > a.place""")
def edge_faults(spark, d):
    """Edges to parts that aren't there, to themselves, twice, or to a part that comes later in an order."""
    edges = _parts(spark, d).withColumn("dst", F.when(F.col("src") % 50 == 0, F.col("src")).otherwise(F.col("dst")))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 97).alias("place"))
    return graph.edge_faults(edges, nodes, "place")


@query("SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)")
def supplier_components(spark, d):
    """Connected components of suppliers, each linked with the next of its nation."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    links = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.lead("s_suppkey").over(order).alias("dst")).where("dst is not null")
    return graph.components(links)


@query("""SELECT c_custkey, greatest(0, CASE WHEN c_acctbal < 0 THEN 90 ELSE 0 END, CASE WHEN c_acctbal > 9000 THEN 70 ELSE 0 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 40 ELSE 0 END)::INT AS priority,
array_to_string(list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, CASE WHEN c_acctbal > 9000 THEN 'large' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM customer""")
def review_priorities(spark, d):
    """The strongest rule that holds decides; all that hold are named."""
    score, names = curation.priority([("overdrawn", F.col("c_acctbal") < 0, 90), ("large", F.col("c_acctbal") > 9000, 70), ("building", F.col("c_mktsegment") == "BUILDING", 40)])
    return table(spark, d, "customer").select("c_custkey", score.alias("priority"), names.alias("reasons"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def ledger_state(spark, d):
    """The ledger folded into the current state of each subject."""
    return curation.current_state(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT event_id, user_id, sha256(event_id || '|' || event_type) AS event_sha, lag(sha256(event_id || '|' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_sha,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq FROM events""")
def ledger_chain(spark, d):
    """Each event's hash and that of the one before it."""
    return curation.chained(table(spark, d, "events"), "user_id", F.concat_ws("|", "event_id", "event_type"), "ts", "event_id").select("event_id", "user_id", "event_sha", "previous_sha", "seq")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM conversations""")
def carried_request(spark, d):
    """What the user said last before each turn."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.md5("text")), ignorenulls=True).over(before).alias("carried"))


@query("""WITH s AS (SELECT conv_id, turn, (2 * regexp_matches(text, 'tion')::INT + regexp_matches(text, 'the')::INT)::DOUBLE AS a, (2 * regexp_matches(text, 'eau')::INT + regexp_matches(text, 'ment')::INT)::DOUBLE AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(a, b) < 1 OR abs(a - b) <= 1 THEN 'unknown' WHEN a > b THEN 'english' ELSE 'french' END AS intent FROM s""")
def scored_intents(spark, d):
    """Patterns weigh for intents; too little or too close is unknown."""
    signals = {"english": [("tion", 2.0), ("the", 1.0)], "french": [("eau", 2.0), ("ment", 1.0)]}
    return table(spark, d, "conversations").select("conv_id", "turn", curation.scored_intents(F.col("text"), signals, 1, 1).alias("intent"))
