"""Bounded walks, components and checks over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.sources.cuts import cut, drop_cut


#: Steps up to which a walk is one plan; each level's shuffle serves the next level and the answer.
ONE_PLAN = 4


def reach(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """node, depth: what can be reached from roots (node) in at most depth steps, with the fewest steps. Roots have 0.

    Short walks are one plan without files; deep ones write each level and walk on from nodes not seen before.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    first = roots.select("node").distinct().withColumn("depth", F.lit(0))
    if depth <= ONE_PLAN:
        found = front = first
        for d in range(1, depth + 1):
            front = front.join(step, "node").select(F.col("next").alias("node")).distinct().withColumn("depth", F.lit(d))
            found = found.unionByName(front)
        return found.groupBy("node").agg(F.min("depth").alias("depth"))
    seen = front = cut(first)
    for d in range(1, depth + 1):
        new = front.join(step, "node").select(F.col("next").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start, goal, depth: int = 10) -> DataFrame:
    """depth, path: one shortest way from start to goal along edges in either direction, the least by its nodes; no row if
    there is none within depth. Each round keeps the least way to each node reached anew."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    kind = edges.schema["src"].dataType
    front = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    if start == goal:
        return front.select(F.lit(0).alias("depth"), "path")
    seen = cut(front.select("node"))
    for d in range(1, depth + 1):
        new = front.join(both, front["node"] == both["src"]).groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).withColumnRenamed("dst", "node")
        front = cut(new.join(seen, "node", "left_anti"))
        if front.where(F.col("node") == F.lit(goal)).limit(1).count():
            return front.where(F.col("node") == F.lit(goal)).select(F.lit(d).alias("depth"), "path")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
    return front.limit(0).select(F.lit(0).alias("depth"), "path")


def subgraph(edges: DataFrame, roots: DataFrame, depth: int = 6, most: int = 500, types: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """node, depth, truncated: what evidence edges (src, dst, type) of the given types lead to, the nearest first (ties: by
    node), at most so many nodes; truncated says whether as many or more were there. roots: node."""
    kept = edges if types is None else edges.where(F.col("type").isin(*types))
    out, back = kept.select("src", "dst"), kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    used = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    found = reach(used, roots, depth)
    first = found.orderBy("depth", "node").limit(most)
    return first.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= most)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each node's component, by alternating large-star and small-star steps.

    A step groups a node's neighbours with partial sums and joins them to their least one, so a node with very many
    neighbours is a skewed join key that Spark can split, and no group is held in one task.
    """
    links = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut(large.join(low, "u").select(F.inline(ends)).where("u <> v").distinct())
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        drop_cut(links)
        links = after
        if now == before:
            leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def edge_faults(edges: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """src, dst, fault: self references, targets that nodes (node) lacks, edges that come more than once and, with order,
    a column of nodes, forward references to nodes that come later."""
    own = edges.where("src = dst").select("src", "dst", F.lit("self").alias("fault")).distinct()
    lost = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", F.lit("missing").alias("fault")).distinct()
    twice = edges.groupBy("src", "dst").count().where("count > 1").select("src", "dst", F.lit("repeated").alias("fault"))
    out = own.unionByName(lost).unionByName(twice)
    if order is None:
        return out
    place = lambda n, p: nodes.select(F.col("node").alias(n), F.col(order).alias(p))
    forward = edges.join(place("src", "_a"), "src").join(place("dst", "_b"), "dst").where("_b > _a")
    return out.unionByName(forward.select("src", "dst", F.lit("forward").alias("fault")).distinct())


def resolved_names(asked: DataFrame, nodes: DataFrame, names: DataFrame, typed: bool = False, most: int = 8) -> DataFrame:
    """question, status, node, rank for each question: the node it names. nodes: node, name, canonical; names: node, alias.

    Ranks: 1 the node's own id; 4 (typed) or 9 its exact name; 9 its folded name; 10 an alias. A node counts with its best
    rank. Resolved if one node alone has the best rank and that is at most most; ambiguous if several nodes are found but
    that fails; unresolved otherwise.
    """
    q = asked.select("question", fx.graph_term(F.col("question")).alias("_q"))
    named = nodes.select(F.col("node").cast("string").alias("node"), "name", "canonical")
    by = lambda rows, key, rank: rows.select(F.col("node").cast("string").alias("node"), key.alias("_k"), F.lit(rank).alias("rank"))
    exact = by(named, F.col("node"), 1).unionByName(by(named, F.col("name"), 4 if typed else 9)).unionByName(by(named, F.col("canonical"), 4 if typed else 9))
    folded = by(named, fx.graph_term(F.col("name")), 9).unionByName(by(names, fx.graph_term(F.col("alias")), 10))
    hits = q.join(exact, q["question"] == exact["_k"]).select("question", "node", "rank").unionByName(q.join(folded, q["_q"] == folded["_k"]).select("question", "node", "rank"))
    best = hits.groupBy("question", "node").agg(F.min("rank").alias("rank"))
    return asked.select("question").distinct().join(unique_best(best, "question", "node", "rank", most), "question", "left").withColumn("status", F.coalesce("status", F.lit("unresolved"))).select("question", "status", "node", "rank")


def unique_best(candidates: DataFrame, key: str, value: str, rank: str, most: int) -> DataFrame:
    """key, status, value, rank: resolved with the value of the best (least) rank if no other one shares it and it is at
    most most; unresolved for a single worse one, otherwise ambiguous without a value. Aggregated before the shuffle."""
    best = candidates.groupBy(key, rank).agg(F.count("*").alias("n"), F.min(value).alias("v"))
    best = best.groupBy(key).agg(F.min_by(F.struct("n", "v", rank), rank).alias("b"), F.sum("n").alias("all"))
    ok = (F.col("b.n") == 1) & (F.col(f"b.{rank}") <= most)
    status = F.when(ok, "resolved").when(F.col("all") == 1, "unresolved").otherwise("ambiguous")
    return best.select(key, status.alias("status"), F.when(ok, F.col("b.v")).alias(value), F.col(f"b.{rank}").alias(rank))


def within_margin(candidates: DataFrame, key: str, value: str, score: str, margin: float = 5) -> DataFrame:
    """key, best, top, rivals: the value of the highest score (ties: the least) and the others within margin of it, in
    order; with rivals the answer is ambiguous."""
    top = candidates.groupBy(key).agg(F.max(score).alias("top"))
    near = candidates.join(top, key).where(F.col(score) >= F.col("top") - margin)
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))))
    ranked = near.groupBy(key).agg(F.first("top").alias("top"), order.alias("all"))
    names = F.transform("all", lambda x: x["v"])
    return ranked.select(key, names[0].alias("best"), "top", F.slice(names, 2, F.size(names)).alias("rivals"))


#: How sure each kind of evidence is (fixed values).
CONFIDENCE = {"exact": 4, "probable": 3, "conflicting": 2, "unresolved": 1}


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row of each id (id, type, name, stage, confidence, evidence, seq): the first type and name by seq, all stages and
    evidence. A confidence that was unresolved gives way to a later known one, conflicting always stays; a ui_control that
    is an action_control anywhere is one."""
    first = lambda c: F.min_by(c, "seq")
    known = F.min_by(F.when(F.col("confidence") != "unresolved", F.col("confidence")), F.when(F.col("confidence") != "unresolved", F.col("seq")))
    out = nodes.groupBy("id").agg(first("type").alias("type"), first("name").alias("name"), known.alias("known"), F.bool_or(F.col("confidence") == "conflicting").alias("odd"), F.bool_or(F.col("type") == "action_control").alias("acts"), F.array_sort(F.collect_set("stage")).alias("stages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    kind = F.when((F.col("type") == "ui_control") & F.col("acts"), "action_control").otherwise(F.col("type"))
    sure = F.when(F.col("odd"), "conflicting").otherwise(F.coalesce("known", F.lit("unresolved")))
    return out.select("id", kind.alias("type"), "name", sure.alias("confidence"), "stages", "evidence")


def canonical_edges(edges: DataFrame, rank: dict[str, int] | None = None) -> DataFrame:
    """edge_id, type, src, dst, confidence, copies, sources: edges of the same type and ends are one, named by the sha256
    of these; the surest confidence stays."""
    levels = rank or CONFIDENCE
    sure = F.coalesce(F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))[F.col("confidence")], F.lit(0))
    out = edges.groupBy("type", "src", "dst").agg(F.max_by("confidence", F.struct(sure.alias("r"), F.col("confidence").alias("c"))).alias("confidence"), F.count("*").alias("copies"), F.array_sort(F.collect_set("source")).alias("sources"))
    key = F.sha2(F.concat_ws("|", "type", F.col("src").cast("string"), F.col("dst").cast("string")), 256)
    return out.select(key.alias("edge_id"), "type", "src", "dst", "confidence", "copies", "sources")


def schema_graph(tables: DataFrame, columns: DataFrame, foreign: DataFrame) -> DataFrame:
    """from_table, to_table, from_column, to_column, edge_type, confidence, source of foreign keys between known tables and
    columns, each once. tables: table; columns: table, column, is_pk; foreign: from_table, from_column, to_table, to_column."""
    known = columns.join(tables, "table", "left_semi")
    side = lambda p: known.select(F.col("table").alias(f"{p}_table"), F.col("column").alias(f"{p}_column"))
    found = foreign.join(side("from"), ["from_table", "from_column"], "left_semi").join(side("to"), ["to_table", "to_column"], "left_semi")
    return found.select("from_table", "to_table", "from_column", "to_column").distinct().withColumns({"edge_type": F.lit("fk"), "confidence": F.lit(1.0), "source": F.lit("constraint")})


def inferred_edges(tables: DataFrame, columns: DataFrame, known: DataFrame) -> DataFrame:
    """Edges as those of schema_graph() that names alone suggest and known lacks: L_X to T_X (and T_PRAC, T_PRACOWNICY) by
    the target's keys, SL_X to L_X, and a key Y_ID to the table T_Y (T_YOWNICY, T_YOWNIK) that has it as a key too. The
    first rule of an edge gives its confidence."""
    keys = columns.where("is_pk").select("table", F.col("column").alias("pk"))
    up, ends = F.upper(F.col("table")), ["from_table", "to_table", "from_column", "to_column"]
    targets = keys.select(F.col("table").alias("to_table"), F.upper("table").alias("_n"), "pk")
    stem = lambda k: F.substring(up, k, F.length(up))
    ask = lambda rows, names: rows.withColumn("_n", F.explode(F.array(*names)))
    l = ask(tables.where(up.startswith("L_")).select(F.col("table").alias("from_table"), stem(3).alias("_s")), [F.concat(F.lit("T_"), "_s"), F.lit("T_PRAC"), F.lit("T_PRACOWNICY")])
    one = l.join(targets, "_n").select("from_table", "to_table", F.col("pk").alias("from_column"), F.col("pk").alias("to_column"), F.lit(1).alias("_r"))
    sl = tables.where(up.startswith("SL_")).select(F.col("table").alias("from_table"), F.concat(F.lit("L_"), stem(4)).alias("_n"))
    two = sl.join(tables.select(F.col("table").alias("to_table"), F.upper("table").alias("_n")), "_n").select("from_table", "to_table", F.lit("BADANIE_ID").alias("from_column"), F.lit("BADANIE_ID").alias("to_column"), F.lit(2).alias("_r"))
    y = F.upper(F.regexp_extract("pk", "(?i)^(.+)_ID$", 1))
    own = ask(keys.select(F.col("table").alias("from_table"), "pk", y.alias("_s")).where("_s <> ''"), [F.concat(F.lit("T_"), "_s"), F.concat(F.lit("T_"), F.col("_s"), F.lit("OWNICY")), F.concat(F.lit("T_"), F.col("_s"), F.lit("OWNIK"))])
    three = own.join(targets, ["_n", "pk"]).select("from_table", "to_table", F.col("pk").alias("from_column"), F.col("pk").alias("to_column"), F.lit(3).alias("_r"))
    found = one.unionByName(two).unionByName(three).where("from_table <> to_table or _r = 2")
    found = found.withColumns({"_f": F.upper("from_column"), "_t": F.upper("to_column")}).groupBy("from_table", "to_table", "_f", "_t").agg(F.min_by(F.struct("from_column", "to_column", "_r"), "_r").alias("e"))
    seen = known.select("from_table", "to_table", F.upper("from_column").alias("_f"), F.upper("to_column").alias("_t")).distinct()
    found = found.join(seen, ["from_table", "to_table", "_f", "_t"], "left_anti").select("from_table", "to_table", "e.*")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("_r"))
    return found.select(*ends, F.lit("inferred").alias("edge_type"), pick(0.7, 0.65, 0.75).alias("confidence"), pick("naming_L_table", "naming_SL_table", "column_id_pattern").alias("source"))


def used_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """start, goal, path, use_count, last_used: a cache of ways with uses added; the one used most of each start and goal
    (ties: the latest) has best true. new: start, goal, path, used_at."""
    fresh = new.groupBy("start", "goal", "path").agg(F.count("*").alias("use_count"), F.max("used_at").alias("last_used"))
    all_ = old.select("start", "goal", "path", "use_count", "last_used").unionByName(fresh).groupBy("start", "goal", "path").agg(F.sum("use_count").alias("use_count"), F.max("last_used").alias("last_used"))
    best = all_.groupBy("start", "goal").agg(F.max_by("path", F.struct("use_count", "last_used", "path")).alias("_b"))
    return all_.join(best, ["start", "goal"]).withColumn("best", F.col("path") == F.col("_b")).drop("_b")


def column_roles(columns: DataFrame, joined: DataFrame) -> DataFrame:
    """table, column, role, strength: roles that a column's name suggests; strong only if evidence backs it, else name_only.
    columns: table, column; joined: table, column of columns that joins or filters use."""
    n = F.lower(F.col("column"))
    role = (
        F.when(n.rlike(r"(^|_)(data_?od|valid_?from|date_?from|start_?date)$"), "valid_from")
        .when(n.rlike(r"(^|_)(data_?do|valid_?to|date_?to|end_?date)$"), "valid_to")
        .when(n.rlike(r"(^|_)(aktualny|is_?current|current_?flag|active)$"), "current_flag")
        .when(n.rlike(r"(_id|key)$"), "reference")
        .when(n.rlike(r"(^|_)(nazwa|name|label)$"), "dictionary_name")
    )
    used = joined.select("table", "column").distinct().withColumn("_u", F.lit(True))
    out = columns.withColumn("role", role).where("role is not null").join(used, ["table", "column"], "left")
    return out.select("table", "column", "role", F.when(F.col("_u"), "strong").otherwise("name_only").alias("strength"))


def trace(edges: DataFrame, types: list[str], reverse: bool = False) -> DataFrame:
    """n0, n1, ...: the nodes of each chain whose edges have these types in this order; from targets to sources if reverse."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    out = None
    for i, kind in enumerate(types):
        hop = edges.where(F.col("type") == kind).select(F.col(a).alias(f"n{i}"), F.col(b).alias(f"n{i + 1}")).distinct()
        out = hop if out is None else out.join(hop, f"n{i}")
    return out.select(*(f"n{i}" for i in range(len(types) + 1)))


def endpoints(edges: DataFrame, inventory: DataFrame, synonyms: DataFrame) -> DataFrame:
    """edges (source_owner, owner, name and any others) with object_owner, object_name, object_type, confidence and the target
    (target_owner, target_name, target_type) of a synonym.

    Names lose quotes and spaces and are upper case. A name without an owner belongs to the source's. inventory (owner, name,
    type): of several types of an object VIEW goes before TABLE before the rest. synonyms: owner, name, target_owner,
    target_name; a target that the inventory lacks counts as a TABLE. Against an empty inventory everything is a TABLE, but
    only by inference; what a filled one lacks is unresolved_object.
    """
    plain = lambda c: F.upper(F.trim(F.regexp_replace(c, "[\"']", "")))
    rank = F.when(F.col("type") == "VIEW", 2).when(F.col("type") == "TABLE", 1).otherwise(0)
    known = inventory.groupBy(plain("owner").alias("object_owner"), plain("name").alias("object_name")).agg(F.max_by("type", F.struct(rank.alias("r"), F.col("type"))).alias("found_type"))
    ends = synonyms.groupBy(plain("owner").alias("object_owner"), plain("name").alias("object_name")).agg(F.min(F.struct(plain("target_owner").alias("o"), plain("target_name").alias("n"))).alias("target"))
    targets = known.select(F.col("object_owner").alias("target_owner"), F.col("object_name").alias("target_name"), F.col("found_type").alias("far_type"))
    asked = edges.withColumns({"object_owner": plain(F.coalesce(F.when(F.trim("owner") != "", F.col("owner")), F.col("source_owner"))), "object_name": plain("name")})
    key = ["object_owner", "object_name"]
    out = asked.join(known, key, "left").join(ends, key, "left")
    out = out.withColumns({c: F.when(F.col("found_type") == "SYNONYM", F.col(f"target.{k}")) for c, k in (("target_owner", "o"), ("target_name", "n"))}).join(targets, ["target_owner", "target_name"], "left")
    empty = F.lit(inventory.isEmpty())
    kind = F.when(empty, "TABLE").otherwise(F.coalesce("found_type", F.lit("unresolved_object")))
    sure = F.when(empty, "strong_static_inference").when(F.col("found_type").isNull(), "unresolved").otherwise("exact_from_source")
    far = F.when(F.col("target_owner").isNotNull(), F.coalesce("far_type", F.lit("TABLE")))
    return out.select(*edges.columns, *key, kind.alias("object_type"), sure.alias("confidence"), "target_owner", "target_name", far.alias("target_type"))
