"""Queries of graphs of nodes, names and schemas, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators import graph, lookup, traversal
from lakeloom.queries import query
from lakeloom.queries_profile import NAMED, PROFILE, named, profile
from lakeloom.sources.tables import table

#: Parts as nodes in rings of twelve; some lead across their ring too, some of every other ring to the next one.
_E = """p AS (SELECT p_partkey AS p, p_size AS s, p_brand, p_partkey - (p_partkey - 1) % 12 AS b, (p_partkey - 1) % 12 AS i FROM part),
w AS (SELECT p AS src, b + (i + 1) % 12 AS dst, s, p_brand FROM p UNION ALL SELECT p, b + (i * 7 + s) % 12, s + 1, p_brand FROM p WHERE s % 5 = 0 UNION ALL SELECT p, p + 12, s + 2, p_brand FROM p WHERE s % 7 = 0 AND (p // 12) % 2 = 0),
e AS (SELECT src, dst, CASE s % 3 WHEN 0 THEN 'reads' WHEN 1 THEN 'calls' ELSE 'shows' END AS type, p_brand AS source, s AS p_size FROM w)"""


def _edges(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    i = (p - 1) % 12
    to = lambda dst, size: F.struct(dst.cast("long").alias("dst"), size.cast("int").alias("p_size"))
    ends = F.array(to(p - i + (i + 1) % 12, s), F.when(s % 5 == 0, to(p - i + (i * 7 + s) % 12, s + 1)), F.when((s % 7 == 0) & (F.floor(p / 12) % 2 == 0), to(p + 12, s + 2)))
    rows = table(spark, d, "part").select(p.alias("src"), F.col("p_brand").alias("source"), F.inline(F.array_compact(ends)))
    kind = F.when(F.col("p_size") % 3 == 0, "reads").when(F.col("p_size") % 3 == 1, "calls").otherwise("shows")
    return rows.select("src", "dst", kind.alias("type"), "source", "p_size")


@query(f"""WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e WHERE type <> 'shows' UNION SELECT dst, src FROM e WHERE type <> 'shows'), r(node, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN b ON src = node WHERE depth < 4),
m AS (SELECT node, min(depth)::INT AS depth FROM r GROUP BY node ORDER BY depth, node LIMIT 20) SELECT node, depth, (SELECT count(*) FROM m) >= 20 AS truncated FROM m""")
def evidence_subgraph(spark, d):
    """What edges of two types lead to, both ways, the nearest twenty."""
    return graph.subgraph(_edges(spark, d), spark.range(7, 8).withColumnRenamed("id", "node"), 4, 20, ("reads", "calls"))


@query(f"""WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), r(node, depth, path) AS (SELECT 3::BIGINT, 0, [3::BIGINT] UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM r JOIN b ON src = node WHERE depth < 9 AND NOT list_contains(path, dst))
SELECT depth::INT AS depth, array_to_string(path, '>') AS path FROM r WHERE node = 9 ORDER BY r.depth, r.path LIMIT 1""")
def undirected_path(spark, d):
    """One shortest way between two nodes, along edges either way."""
    return graph.shortest_path(_edges(spark, d), 3, 9, 9).select("depth", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_E}, x AS (SELECT DISTINCT src, dst FROM e WHERE (src - 1) // 12 = (dst - 1) // 12), r(root, node, depth, path) AS (SELECT DISTINCT src, src, 0, [src] FROM x UNION ALL SELECT root, dst, depth + 1, list_append(path, dst) FROM r JOIN x ON src = node WHERE (depth = 0 OR node <> root) AND dst >= root AND (dst = root OR NOT list_contains(path, dst)))
SELECT array_to_string(path, '>') AS cycle, depth::INT AS length FROM r WHERE depth > 0 AND node = root ORDER BY r.depth, r.path""")
def all_cycles(spark, d):
    """Simple cycles of any length, each once. (In the SQL, edges to later rings can't be on one.)"""
    return traversal.cycles(_edges(spark, d)).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query(f"""WITH RECURSIVE {_E}, x AS (SELECT DISTINCT src, dst FROM e WHERE (src - 1) // 12 = (dst - 1) // 12), r(root, node) AS (SELECT src, dst FROM x UNION SELECT root, dst FROM r JOIN x ON src = node),
m AS (SELECT a.root, a.node FROM r a JOIN r b ON a.root = b.node AND a.node = b.root) SELECT root AS node, min(node) AS component FROM m GROUP BY root HAVING count(*) > 1""")
def strong_components(spark, d):
    """Nodes that lead to each other, by the least of them."""
    return traversal.strong_components(_edges(spark, d))


@query("""WITH n AS (SELECT p_partkey::VARCHAR AS node, p_name AS name, p_name || '/' || p_brand AS canonical FROM part), a AS (SELECT p_partkey::VARCHAR AS node, p_brand || ' ' || p_partkey AS alias FROM part),
q AS (SELECT '17' AS question UNION ALL SELECT 'SMALL  ring' UNION ALL SELECT p_brand || ' ' || p_partkey FROM part WHERE p_partkey = 5 UNION ALL SELECT 'nothing' UNION ALL (SELECT canonical FROM (SELECT canonical, count(*) AS k FROM n GROUP BY 1) WHERE k = 1 ORDER BY 1 LIMIT 3)),
h AS (SELECT question, node, 1 AS rank FROM q JOIN n ON question = node UNION ALL SELECT question, node, 4 FROM q JOIN n ON question = name OR question = canonical UNION ALL
  SELECT question, node, 9 FROM q JOIN n ON lower(regexp_replace(question, '\\s+', ' ', 'g')) = lower(name) UNION ALL SELECT question, node, 10 FROM q JOIN a ON lower(question) = lower(alias)),
b AS (SELECT question, node, min(rank) AS rank FROM h GROUP BY ALL), t AS (SELECT question, min(rank) AS best, count(*) AS n FROM b GROUP BY question), u AS (SELECT t.*, (SELECT count(*) FROM b WHERE b.question = t.question AND rank = best) AS ties, (SELECT min(node) FROM b WHERE b.question = t.question AND rank = best) AS node FROM t)
SELECT question, CASE WHEN best IS NULL THEN 'unresolved' WHEN ties = 1 AND best <= 8 THEN 'resolved' WHEN n = 1 THEN 'unresolved' ELSE 'ambiguous' END AS status, CASE WHEN ties = 1 AND best <= 8 THEN node END AS node, best::INT AS rank FROM q LEFT JOIN u USING (question)""")
def resolved_names(spark, d):
    """Which node a question names: by id, exact name, folded name or alias; ties are ambiguous, weak ranks don't resolve."""
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.concat_ws("/", "p_name", "p_brand").alias("canonical"))
    names = p.select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")).alias("alias"))
    asked = spark.createDataFrame([("17",), ("SMALL  ring",), ("nothing",)], "question string").unionByName(names.where("node = 5").select(F.col("alias").alias("question")))
    single = nodes.groupBy("canonical").count().where("count = 1").orderBy("canonical").limit(3).select(F.col("canonical").alias("question"))
    return graph.resolved_names(asked.unionByName(single), nodes, names, typed=True)


@query("""WITH s AS (SELECT p_brand AS k, p_partkey AS v, p_size + p_partkey % 3 AS s FROM part), t AS (SELECT k, max(s) AS top FROM s GROUP BY k), l AS (SELECT s.k, t.top, list(v ORDER BY s DESC, v) AS vs FROM s JOIN t ON s.k = t.k WHERE s >= top - 2 GROUP BY ALL)
SELECT k, vs[1] AS best, top, array_to_string(vs[2:], ',') AS rivals FROM l""")
def within_margin(spark, d):
    """The best of each brand and those too near to it."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("v"), (F.col("p_size") + F.col("p_partkey") % 3).alias("s"))
    return graph.within_margin(rows, "k", "v", "s", 2).withColumn("rivals", F.array_join("rivals", ","))


@query("""WITH n AS (SELECT p_partkey % 300 AS id, p_partkey AS seq, CASE p_size % 4 WHEN 0 THEN 'action_control' ELSE 'ui_control' END AS type, p_name AS name, p_brand AS stage, CASE p_size % 9 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'exact' WHEN 2 THEN 'probable' ELSE 'unresolved' END AS confidence, p_type AS ev FROM part)
SELECT id, CASE WHEN arg_min(type, seq) = 'ui_control' AND bool_or(type = 'action_control') THEN 'action_control' ELSE arg_min(type, seq) END AS type, arg_min(name, seq) AS name,
CASE WHEN bool_or(confidence = 'conflicting') THEN 'conflicting' ELSE coalesce(arg_min(confidence, seq) FILTER (WHERE confidence <> 'unresolved'), 'unresolved') END AS confidence,
array_to_string(list_sort(list_distinct(list(stage))), ',') AS stages, array_to_string(list_sort(list_distinct(list(ev))), ',') AS evidence FROM n GROUP BY id""")
def merged_nodes(spark, d):
    """Sightings of a node as one, with all stages and evidence."""
    conf = F.when(F.col("p_size") % 9 == 0, "conflicting").when(F.col("p_size") % 9 == 1, "exact").when(F.col("p_size") % 9 == 2, "probable").otherwise("unresolved")
    rows = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("id"), F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 4 == 0, "action_control").otherwise("ui_control").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("stage"), conf.alias("confidence"), F.array("p_type").alias("evidence"))
    return graph.merged_nodes(rows).withColumns({"stages": F.array_join("stages", ","), "evidence": F.array_join("evidence", ",")})


@query(f"""WITH {_E}, f AS (SELECT src % 40 AS src, dst % 20 AS dst, type, source, CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'probable' WHEN 2 THEN 'conflicting' ELSE 'unresolved' END AS confidence, CASE p_size % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS r FROM e)
SELECT sha256(type || '|' || src || '|' || dst) AS edge_id, arg_max(confidence, r) AS confidence, count(*) AS copies, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM f GROUP BY type, src, dst""")
def canonical_edges(spark, d):
    """Edges of the same type and ends as one, the surest confidence first."""
    conf = F.when(F.col("p_size") % 4 == 0, "exact").when(F.col("p_size") % 4 == 1, "probable").when(F.col("p_size") % 4 == 2, "conflicting").otherwise("unresolved")
    rows = _edges(spark, d).select((F.col("src") % 40).alias("src"), (F.col("dst") % 20).alias("dst"), "type", "source", conf.alias("confidence"))
    return graph.canonical_edges(rows).select("edge_id", "confidence", "copies", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {PROFILE}, {NAMED}, known AS (SELECT f.t AS from_table, g.t AS to_table, f.c AS from_column, g.c AS to_column, 'fk' AS edge_type, 1.0::DOUBLE AS confidence, 'constraint' AS source FROM named f JOIN named g ON f.c = g.c AND g.is_pk AND NOT f.is_pk AND f.t <> g.t WHERE f.c <> 'ORDER_ID'),
rules AS (SELECT l.t AS from_table, k.t AS to_table, k.c AS from_column, k.c AS to_column, 1 AS r FROM (SELECT DISTINCT t FROM named WHERE starts_with(t, 'L_')) l JOIN named k ON k.is_pk AND k.t IN ('T_' || l.t[3:], 'T_PRAC', 'T_PRACOWNICY')
  UNION ALL SELECT s.t, l.t, 'BADANIE_ID', 'BADANIE_ID', 2 FROM (SELECT DISTINCT t FROM named WHERE starts_with(t, 'SL_')) s JOIN (SELECT DISTINCT t FROM named) l ON l.t = 'L_' || s.t[4:]
  UNION ALL SELECT a.t, b.t, a.c, a.c, 3 FROM named a JOIN named b ON a.is_pk AND b.is_pk AND a.c = b.c AND ends_with(a.c, '_ID') AND b.t IN ('T_' || a.c[:-4], 'T_' || a.c[:-4] || 'OWNICY', 'T_' || a.c[:-4] || 'OWNIK') WHERE a.t <> b.t),
u AS (SELECT from_table, to_table, from_column, to_column, min(r) AS r FROM rules ANTI JOIN known USING (from_table, to_table, from_column, to_column) GROUP BY ALL)
SELECT * FROM known UNION ALL SELECT from_table, to_table, from_column, to_column, 'inferred', CASE r WHEN 1 THEN 0.7 WHEN 2 THEN 0.65 ELSE 0.75 END, CASE r WHEN 1 THEN 'naming_L_table' WHEN 2 THEN 'naming_SL_table' ELSE 'column_id_pattern' END FROM u""")
def schema_edges(spark, d):
    """A schema's edges: keys that other columns are named after, then those that names suggest and keys don't already give."""
    from lakeloom.sources.cuts import cut

    columns = cut(named(spark, d))
    tables = columns.select("table").distinct()
    own = columns.where("not is_pk and column <> 'ORDER_ID'").select(F.col("table").alias("from_table"), F.col("column").alias("from_column"))
    foreign = own.join(columns.where("is_pk").select(F.col("table").alias("to_table"), F.col("column").alias("to_column")), F.col("from_column") == F.col("to_column")).where("from_table <> to_table")
    lost = foreign.select("from_table", F.lit("NOPE").alias("from_column"), "to_table", "to_column")  # a column that no table has
    known = graph.schema_graph(tables, columns, foreign.unionByName(lost))
    return known.unionByName(graph.inferred_edges(tables, columns, known))


@query(f"""WITH {_E}, old AS (SELECT src % 10 AS start, dst % 5 AS goal, type AS path, count(*) AS use_count, max(p_size) AS last_used FROM e WHERE p_size < 25 GROUP BY ALL), new AS (SELECT src % 10 AS start, dst % 5 AS goal, type AS path, count(*) AS use_count, max(p_size) AS last_used FROM e WHERE p_size >= 25 GROUP BY ALL),
m AS (SELECT start, goal, path, sum(use_count)::BIGINT AS use_count, max(last_used) AS last_used FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY use_count DESC, last_used DESC, path DESC) = 1 AS best FROM m""")
def used_paths(spark, d):
    """A cache of ways with their uses added up; the most used one is the best."""
    rows = _edges(spark, d).select((F.col("src") % 10).alias("start"), (F.col("dst") % 5).alias("goal"), F.col("type").alias("path"), F.col("p_size").alias("used_at"))
    old = rows.where("used_at < 25").groupBy("start", "goal", "path").agg(F.count("*").alias("use_count"), F.max("used_at").alias("last_used"))
    return graph.used_paths(old, rows.where("used_at >= 25"))


@query(f"""WITH {PROFILE}, c AS (SELECT tab, CASE col WHEN 'o_orderdate' THEN 'o_date_from' WHEN 'l_shipdate' THEN 'l_date_to' WHEN 'l_linestatus' THEN 'l_is_current' ELSE col END AS name, nulls = 0 AND n > kinds AND regexp_matches(col, 'key$|date$') AS used FROM profile),
r AS (SELECT *, CASE WHEN regexp_matches(name, 'date_from$') THEN 'valid_from' WHEN regexp_matches(name, 'date_to$') THEN 'valid_to' WHEN regexp_matches(name, 'is_current$') THEN 'current_flag' WHEN regexp_matches(name, '(_id|key)$') THEN 'reference' WHEN regexp_matches(name, '_name$') THEN 'dictionary_name' END AS role FROM c)
SELECT tab AS "table", name AS "column", role, CASE WHEN used THEN 'strong' ELSE 'name_only' END AS strength FROM r WHERE role IS NOT NULL""")
def column_roles(spark, d):
    """Roles that names suggest, strong where a column's values repeat without gaps as joins have them."""
    c = F.col("col")
    name = F.when(c == "o_orderdate", "o_date_from").when(c == "l_shipdate", "l_date_to").when(c == "l_linestatus", "l_is_current").otherwise(c)
    rows = profile(spark, d).select(F.col("tab").alias("table"), name.alias("column"), ((F.col("nulls") == 0) & (F.col("n") > F.col("kinds")) & c.rlike("key$|date$")).alias("used"))
    return graph.column_roles(rows.select("table", "column"), rows.where("used").select("table", "column"))


@query(f"""WITH {_E}, x AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE type = 'reads'), y AS (SELECT DISTINCT src AS b, dst AS c FROM e WHERE type = 'calls') SELECT a, b, c FROM x JOIN y USING (b)""")
def typed_trace(spark, d):
    """Chains of an edge of one type and one of another: what is reached over the first by the second."""
    return graph.trace(_edges(spark, d), ["reads", "calls"]).toDF("a", "b", "c")


#: Objects with two columns each, keys between neighbours, joins and mappings that name columns; a pair of objects for each part.
_OBJECTS = """s AS (SELECT p_partkey AS p, p_size AS z FROM part), e(edge_id, src, dst, type, lc, rc) AS (SELECT 'h1.' || p, 'o' || p, 'c' || p || '.1', 'HAS_COLUMN', NULL, NULL FROM s UNION ALL SELECT 'h2.' || p, 'o' || p, 'c' || p || '.2', 'HAS_COLUMN', NULL, NULL FROM s
UNION ALL SELECT 'k' || p, 'c' || p || '.1', 'c' || (p + 1) || '.2', CASE WHEN z % 4 = 0 THEN 'REFERENCES' ELSE 'FOREIGN_KEY_TO' END, NULL, NULL FROM s WHERE z % 2 = 0 UNION ALL SELECT 'b' || p, 'c' || (p + 1) || '.1', 'c' || p || '.2', 'FOREIGN_KEY_TO', NULL, NULL FROM s WHERE z % 9 = 0
UNION ALL SELECT 'j' || p, 'o' || p, 'o' || (p + 2), 'JOINS_TO', 'c' || p || '.2', 'c' || (p + 2) || '.1' FROM s WHERE z % 3 = 0 UNION ALL SELECT 'm' || p, 'o' || p, 'c' || (p + 3) || '.1', 'MAPS_TO_ORACLE_COLUMN', 'c' || p || '.2', 'c' || (p + 3) || '.1' FROM s WHERE z % 5 = 0
UNION ALL SELECT 'k2.' || p, 'c' || p || '.1', 'c' || (p + 1) || '.2', 'FOREIGN_KEY_TO', NULL, NULL FROM s WHERE z % 8 = 0 UNION ALL SELECT 'x' || p, 'o' || p, 'o' || (p + 1), 'MENTIONS', 'c' || p || '.1', 'c' || (p + 1) || '.1' FROM s)"""


def _objects(spark, d):
    p, z = F.col("p_partkey"), F.col("p_size")
    col = lambda k, n: F.concat(F.lit("c"), (p + k).cast("string"), F.lit(f".{n}"))
    obj = lambda k: F.concat(F.lit("o"), (p + k).cast("string"))
    none = F.lit(None).cast("string")

    def edge(name, src, dst, kind, left=none, right=none):
        return F.struct(F.concat(F.lit(name), p.cast("string")).alias("edge_id"), src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), left.alias("left_column"), right.alias("right_column"))

    made = [edge("h1.", obj(0), col(0, 1), "HAS_COLUMN"), edge("h2.", obj(0), col(0, 2), "HAS_COLUMN"), F.when(z % 2 == 0, edge("k", col(0, 1), col(1, 2), F.when(z % 4 == 0, "REFERENCES").otherwise("FOREIGN_KEY_TO"))), F.when(z % 9 == 0, edge("b", col(1, 1), col(0, 2), "FOREIGN_KEY_TO")), F.when(z % 3 == 0, edge("j", obj(0), obj(2), "JOINS_TO", col(0, 2), col(2, 1))),
            F.when(z % 5 == 0, edge("m", obj(0), col(3, 1), "MAPS_TO_ORACLE_COLUMN", col(0, 2), col(3, 1))), F.when(z % 8 == 0, edge("k2.", col(0, 1), col(1, 2), "FOREIGN_KEY_TO")), edge("x", obj(0), obj(1), "MENTIONS", col(0, 1), col(1, 1))]
    parts = table(spark, d, "part")
    return parts.select(F.inline(F.array_compact(F.array(*made)))), parts.select(obj(0).alias("left_id"), F.concat(F.lit("o"), (p + p % 3 + 1).cast("string")).alias("right_id"))


_AROUND = f"""WITH RECURSIVE {_OBJECTS}, a AS (SELECT * FROM e WHERE type <> 'MENTIONS'), q AS (SELECT 'o' || p AS l, 'o' || (p + p % 3 + 1) AS r FROM s), t AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a),
g(l, r, node, depth) AS (SELECT l, r, unnest([l, r]), 0 FROM q UNION SELECT l, r, dst, depth + 1 FROM g JOIN t ON src = node WHERE depth < 4), n AS (SELECT l, r, node, min(depth) AS depth FROM g GROUP BY l, r, node),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY depth, node) AS k FROM n)"""


@query(f"""{_AROUND}, u AS (SELECT * FROM ranked WHERE k <= 400), w AS (SELECT f.l, f.r, a.* FROM u f JOIN a ON a.src = f.node JOIN u h ON h.l = f.l AND h.r = f.r AND h.node = a.dst WHERE least(f.depth, h.depth) < 4),
lc AS (SELECT l, r, dst AS c FROM w WHERE type = 'HAS_COLUMN' AND src = l), rc AS (SELECT l, r, dst AS c FROM w WHERE type = 'HAS_COLUMN' AND src = r),
m AS (SELECT l, r, edge_id, 'foreign_key' AS evidence, src AS x, dst AS y FROM w WHERE type IN ('FOREIGN_KEY_TO', 'REFERENCES') UNION ALL SELECT l, r, edge_id, 'foreign_key', dst, src FROM w WHERE type IN ('FOREIGN_KEY_TO', 'REFERENCES')
  UNION ALL SELECT l, r, edge_id, CASE type WHEN 'JOINS_TO' THEN 'reconstructed_sql_join' ELSE 'canonical_graph_path' END, lc, rc FROM w WHERE lc IS NOT NULL)
SELECT m.l AS left_id, m.r AS right_id, x AS left_column, y AS right_column, evidence, min(edge_id) AS edge_id FROM m JOIN lc ON lc.l = m.l AND lc.r = m.r AND lc.c = x JOIN rc ON rc.l = m.l AND rc.r = m.r AND rc.c = y GROUP BY ALL""")
def join_evidence(spark, d):
    """How the columns of each pair of objects can be joined: keys, joins of SQL, other edges that name them."""
    return traversal.join_evidence(*_objects(spark, d))


@query(f"""{_AROUND} SELECT l AS left_id, r AS right_id, count(*) AS nodes, max(depth)::INT AS depth, sha256(string_agg(node, ',' ORDER BY depth, node)) AS digest FROM ranked WHERE k <= 15 GROUP BY l, r""")
def pair_surroundings(spark, d):
    """The fifteen nearest nodes around each pair of objects."""
    near = traversal.around_pairs(*_objects(spark, d), most=15)
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda s: s["node"]), ",")
    return near.groupBy("left_id", "right_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), F.sha2(order, 256).alias("digest"))


_NAMED = """e AS (SELECT p_partkey AS k, p_brand AS so, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE ' ' END AS ow, CASE WHEN p_size % 2 = 0 THEN '"' || p_name || '" ' ELSE p_name END AS nm FROM part),
q AS (SELECT k, upper(CASE WHEN ow IS NULL OR trim(ow) = '' THEN so ELSE ow END) AS oo, upper(trim(replace(nm, '"', ''))) AS n FROM e)"""


def _named(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('" '))).otherwise(F.col("p_name"))
    return p, p.select(k.alias("k"), F.col("p_brand").alias("source_owner"), F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 2, " ").alias("owner"), name.alias("name"))


@query(f"""WITH {_NAMED}, i AS (SELECT upper(o) AS o, upper(p_name) AS n, max(CASE t WHEN 'VIEW' THEN '2VIEW' WHEN 'TABLE' THEN '1TABLE' ELSE '0' || t END) AS t FROM (SELECT p_type AS o, p_name, CASE p_size % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'TABLE' WHEN 2 THEN 'SYNONYM' ELSE 'PACKAGE' END AS t FROM part WHERE p_size < 20 UNION ALL SELECT p_brand, p_name, 'SYNONYM' FROM part WHERE p_size < 5) GROUP BY 1, 2),
s AS (SELECT upper(o) AS o, upper(p_name) AS n, min({{'o': upper(t), 'n': upper(p_name)}}) AS t FROM (SELECT p_brand AS o, p_name, p_type AS t FROM part WHERE p_size < 15 UNION ALL SELECT p_type, p_name, p_brand FROM part WHERE p_size < 9) GROUP BY 1, 2),
j AS (SELECT k, oo, q.n, i.t[2:] AS t, CASE WHEN i.t[2:] = 'SYNONYM' THEN s.t END AS far FROM q LEFT JOIN i ON i.o = oo AND i.n = q.n LEFT JOIN s ON s.o = oo AND s.n = q.n)
SELECT k, oo AS object_owner, j.n AS object_name, coalesce(j.t, 'unresolved_object') AS object_type, CASE WHEN j.t IS NULL THEN 'unresolved' ELSE 'exact_from_source' END AS confidence, far.o AS target_owner, far.n AS target_name, CASE WHEN far IS NOT NULL THEN coalesce(i.t[2:], 'TABLE') END AS target_type FROM j LEFT JOIN i ON i.o = far.o AND i.n = far.n""")
def resolved_endpoints(spark, d):
    """What the names that edges lead to stand for in an inventory of objects and synonyms."""
    p, edges = _named(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("VIEW", "TABLE", "SYNONYM", "PACKAGE"))), F.col("p_size") % 4 + 1)
    has = p.where("p_size < 20").select(F.col("p_type").alias("owner"), F.col("p_name").alias("name"), kind.alias("type")).unionByName(p.where("p_size < 5").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.lit("SYNONYM").alias("type")))
    far = lambda own, to, most: p.where(F.col("p_size") < most).select(F.col(own).alias("owner"), F.col("p_name").alias("name"), F.col(to).alias("target_owner"), F.col("p_name").alias("target_name"))
    return graph.endpoints(edges, has, far("p_brand", "p_type", 15).unionByName(far("p_type", "p_brand", 9))).drop("source_owner", "owner", "name")


@query(f"""WITH {_NAMED} SELECT k, oo AS object_owner, n AS object_name, 'TABLE' AS object_type, 'strong_static_inference' AS confidence FROM q""")
def inferred_endpoints(spark, d):
    """The same against an inventory without objects."""
    p, edges = _named(spark, d)
    none = p.where("p_size < 0")
    out = graph.endpoints(edges, none.select(F.col("p_type").alias("owner"), F.col("p_name").alias("name"), F.lit("VIEW").alias("type")), none.select(*(F.col("p_name").alias(c) for c in ("owner", "name", "target_owner", "target_name"))))
    return out.select("k", "object_owner", "object_name", "object_type", "confidence")


_FORMS = "forms AS (SELECT p_partkey::VARCHAR AS node, md5(p_partkey::VARCHAR) AS guid, 'Łąka ' || p_name || ' ' || p_size AS name, 'App.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '') || p_partkey AS canonical FROM part)"


def _forms(spark, d):
    k = F.col("p_partkey").cast("string")
    canonical = F.concat(F.lit("App."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("")), k)
    return table(spark, d, "part").select(k.alias("node"), F.md5(k).alias("guid"), F.concat(F.lit("Łąka "), "p_name", F.lit(" "), F.col("p_size").cast("string")).alias("name"), canonical.alias("canonical"))


@query(f"""WITH {_FORMS}, q AS (SELECT p_partkey AS question, CASE WHEN p_partkey % 5 < 2 THEN md5(p_partkey::VARCHAR) END AS g, CASE p_partkey % 5 WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '') || p_partkey ELSE 'other' END WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'App.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '') || p_partkey ELSE replace(p_name, ' ', '') || p_partkey END END AS t,
  CASE p_partkey % 5 WHEN 3 THEN 'ŁĄKA ' || upper(p_name) || ' ' || p_size WHEN 4 THEN CASE p_size % 4 WHEN 0 THEN p_name[1:2] WHEN 1 THEN (p_size::VARCHAR)[1:1] ELSE p_name[3:7] END END AS f FROM part),
n AS (SELECT *, translate(lower(name), '{{marked}}', '{{plain}}') AS term FROM forms), fr AS (SELECT question, f, translate(lower(regexp_replace(trim(f), '\\s+', ' ', 'g')), '{{marked}}', '{{plain}}') AS ft FROM q WHERE f IS NOT NULL),
h AS (SELECT question, node, 2 AS rank FROM q JOIN forms ON guid = g WHERE t IS NULL OR canonical = t OR name = t OR ends_with(canonical, t) UNION ALL SELECT question, node, CASE WHEN canonical = t THEN 4 ELSE 9 END FROM q JOIN forms ON ends_with(canonical, t) WHERE g IS NULL AND t IS NOT NULL
  UNION ALL SELECT question, node, 9 FROM (SELECT question, node, row_number() OVER (PARTITION BY question ORDER BY node) AS k FROM fr JOIN n ON contains(name, f) OR contains(canonical, f) OR (ft <> '' AND contains(term, ft))) WHERE k <= 30),
b AS (SELECT question, node, min(rank) AS rank FROM h GROUP BY ALL), m AS (SELECT question, min(rank) AS best, count(*) AS n FROM b GROUP BY 1), u AS (SELECT m.question, best, m.n, count(*) AS ties, min(node) AS node FROM m JOIN b ON b.question = m.question AND b.rank = best GROUP BY ALL)
SELECT question, CASE WHEN best IS NULL THEN 'unresolved' WHEN ties = 1 AND best <= 8 THEN 'resolved' WHEN n = 1 THEN 'unresolved' ELSE 'ambiguous' END AS status, CASE WHEN ties = 1 AND best <= 8 THEN node END AS node, best::INT AS rank FROM q LEFT JOIN u USING (question)""".replace("{marked}", fx.MARKED).replace("{plain}", fx.PLAIN))
def resolved_forms(spark, d):
    """Forms by GUID, type, end of a type, and fragments of their names."""
    p, k, z = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    short = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), k.cast("string"))
    guid = F.when(k % 5 < 2, F.concat(F.lit("{"), F.upper(F.md5(k.cast("string"))), F.lit("}")))
    kind = F.when(k % 5 == 1, F.when(z % 2 == 0, short).otherwise("other")).when(k % 5 == 2, F.when(z % 3 == 0, F.concat(F.lit("App."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), short)).otherwise(short))
    piece = F.when(k % 5 == 3, F.concat(F.lit("ŁĄKA "), F.upper("p_name"), F.lit(" "), z.cast("string"))).when(k % 5 == 4, F.when(z % 4 == 0, F.substring("p_name", 1, 2)).when(z % 4 == 1, F.substring(z.cast("string"), 1, 1)).otherwise(F.substring("p_name", 3, 5)))
    return lookup.resolved_forms(p.select(k.alias("question"), guid.alias("guid"), kind.alias("full_type"), piece.alias("fragment")), _forms(spark, d))


@query("""WITH o AS (SELECT p_partkey::VARCHAR AS node, p_brand AS owner, p_type AS k, upper(p_name) AS n FROM part), q AS (SELECT p_partkey AS question, CASE WHEN p_size % 4 = 0 THEN lower(p_brand) ELSE p_brand END AS qo, p_type AS qk, CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN p_name ELSE p_name || 'x' END AS qn FROM part),
h AS (SELECT question, node, CASE WHEN qo = owner AND qk = k AND (qn = n OR lower(qn) = lower(n)) THEN 0 ELSE 1 END AS way FROM q JOIN o ON upper(qo) = upper(owner) AND qk = k AND upper(qn) = upper(n)), b AS (SELECT question, min(way) AS way FROM h GROUP BY 1), u AS (SELECT question, count(DISTINCT node) AS n, min(node) AS node FROM h JOIN b USING (question, way) GROUP BY 1)
SELECT question, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN node END AS node, CASE WHEN n IS NOT NULL THEN 3 END AS rank FROM q LEFT JOIN u USING (question)""")
def resolved_objects(spark, d):
    """Objects by their identity: owner, type and name."""
    p, k, z = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    name = F.when(z % 3 == 0, F.upper("p_name")).when(z % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("x")))
    asked = p.select(k.alias("question"), F.when(z % 4 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("owner"), F.col("p_type").alias("object_type"), name.alias("name"))
    return lookup.resolved_objects(asked, p.select(k.alias("node"), F.col("p_brand").alias("owner"), F.col("p_type").alias("object_type"), F.upper("p_name").alias("name"), F.upper("p_name").alias("canonical")))
