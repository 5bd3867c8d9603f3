"""Walks over edge tables that keep what a question needs and no more: shortest paths, strong components, cycles and the
evidence around two nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.cuts import cut, drop_cut

# Tables that were cut are judged by their files, which are far smaller than their rows: without the merge hints whole tables
# of nodes go through the driver to every task.

#: Walks that one task sorts, of some 200 bytes each.
_ROWS_OF_A_TASK = 500_000


def dependency_paths(edges: DataFrame, roots: DataFrame, depth: int, most_per_target: int = 3, budget: int | None = 500) -> DataFrame:
    """root, node, depth, path, truncated: what each root (node) depends on only through others, with its least depth and at
    most most_per_target paths of that depth, the first ones in order. What a root leads to directly is left out, and so is
    the root.

    With a budget, walks of a root are taken level by level and in order, so many at most, longer ways included, as all count;
    truncated says that there were more. Without one, a level keeps nodes that are reached there first, each with its least
    most_per_target paths: every beginning of a shortest path is a shortest path, so nothing that counts is lost.
    Edges that repeat count once; a node on the walk isn't entered again.
    """
    step = edges.select("src", F.col("dst").alias("next")).distinct()
    front = roots.select(F.col("node").alias("root"), "node", F.array("node").alias("path"), F.lit(0).cast("long").alias("used")).distinct()
    by_root, by_target = Window.partitionBy("root"), Window.partitionBy("root", "node").orderBy("path")
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):
        on = front.join(step, front["node"] == step["src"])
        on = on.where((F.lit(d) == 1) | ~F.array_contains("path", F.col("next"))).select("root", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), "used")
        if budget is not None:
            on = on.withColumn("n", F.row_number().over(by_root.orderBy("path"))).where(F.col("n") <= budget + 1)
            on = on.where(F.col("n") + F.col("used") <= budget + 1).withColumn("past", F.col("n") + F.col("used") > budget)
            on = on.withColumn("used", F.col("used") + F.count_if(~F.col("past")).over(by_root)).drop("n")
        else:
            for known in levels:
                on = on.join(known.select("root", "node").distinct(), ["root", "node"], "left_anti")
            on = on.withColumn("n", F.row_number().over(by_target)).where(F.col("n") <= most_per_target).drop("n").withColumn("past", F.lit(False))
        level = on.withColumn("depth", F.lit(d))
        if budget is None and d == depth:  # nothing walks on from here, and each level is final
            levels.append(level)
            break
        level = cut(level)
        levels.append(level)
        front = level.where(~F.col("past") & (F.col("node") != F.col("root"))).select("root", "node", "path", "used")
        if front.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    if budget is None:
        return found.where((F.col("depth") > 1) & (F.col("node") != F.col("root"))).select("root", "node", "depth", "path", F.col("past").alias("truncated"))
    # the more rows, the more tasks, so that one sorts no more of them; one sort by root, node serves all windows
    parts = found.count() // _ROWS_OF_A_TASK
    many = parts > int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "root") if many else found.repartition("root")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("root", "node").orderBy("past", "depth", "path"))).withColumn("least", F.min(F.when(~F.col("past"), F.col("depth"))).over(Window.partitionBy("root", "node")))
    # (n in it keeps this window above the others: below them it would sort the rows once more)
    found = found.withColumn("truncated", F.max(F.col("past") & (F.col("n") > 0)).over(by_root)).where(~F.col("past") & (F.col("node") != F.col("root")))
    return found.where((F.col("depth") == F.col("least")) & (F.col("n") <= most_per_target) & (F.col("least") > 1)).select("root", "node", "depth", "path", "truncated")


def _settled(rows: DataFrame, step) -> DataFrame:
    """Apply step to a table until it marks no row as changed: each round is written, the one before is deleted."""
    while True:
        after = cut(step(rows))
        drop_cut(rows)
        rows = after.drop("changed")
        if after.where("changed").isEmpty():
            return rows


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the nodes that lie on cycles of several nodes, with the smallest node of their strong component.

    Nodes without an edge in or without one out are trimmed. Every node that is left takes two colours: the smallest node that
    leads to it and the smallest that it leads to. Where both are one node, that node leads there and back, so this is its
    component; all other components lie within pairs of colours, and only edges within these stay for the next turn. Labels
    jump along labels, so they settle in about the logarithm of the longest way; a turn ends when none changes.
    """
    left, found = cut(edges.where("src <> dst").select("src", "dst").distinct()), None

    def trim(rows: DataFrame) -> DataFrame:
        ends = rows.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(rows.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        lost = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in")).where("out = 0 or in = 0").select("node")
        return rows.join(lost.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(lost.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti").select("src", "dst")

    while True:
        step = cut(trim(left))
        drop_cut(left)
        if step.isEmpty():
            break
        ask = lambda rows, a, b, down: rows.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(down).alias("down"))
        both = ask(step, "src", "dst", True).unionByName(ask(step, "dst", "src", False))

        def spread(labels: DataFrame) -> DataFrame:
            """A node asks its neighbours for theirs and its labels too: what leads to a node that leads here does so as well.
            All are asked in one join."""
            asked = both
            for label, down in (("above", True), ("first", True), ("below", False), ("last", False)):
                asked = asked.unionByName(ask(labels.where(F.col(label) != F.col("node")), label, "node", down))
            sent = asked.join(labels.hint("merge"), asked["a"] == labels["node"]).select(F.col("b").alias("node"), *(F.when(F.col("down"), F.col(c)).alias(c) for c in ("above", "first")), *(F.when(~F.col("down"), F.col(c)).alias(c) for c in ("below", "last")))
            old = labels.select("node", "above", "below", "first", "last", F.col("above").alias("a0"), F.col("below").alias("b0"))
            now = sent.unionByName(old, allowMissingColumns=True).groupBy("node").agg(*(F.min(c).alias(c) for c in ("above", "below")), *(F.max(c).alias(c) for c in ("first", "last", "a0", "b0")))
            return now.select("node", "above", "below", "first", "last", ((F.col("above") != F.col("a0")) | (F.col("below") != F.col("b0"))).alias("changed"))

        # first and last, the largest node that leads to a node and that it leads to, as far as known, only help to jump where
        # nodes rise along a way
        near = both.groupBy(F.col("b").alias("node")).agg(*(f(F.when(F.col("down") == down, F.col("a"))).alias(c) for c, f, down in (("above", F.min, True), ("below", F.min, False), ("first", F.max, True), ("last", F.max, False))))
        labels = _settled(cut(near.select("node", F.least("node", "above").alias("above"), F.least("node", "below").alias("below"), F.greatest("node", "first").alias("first"), F.greatest("node", "last").alias("last"))), spread)
        members = cut(labels.where("above = below").select("node", F.col("above").alias("component")))
        found = members if found is None else found.unionByName(members)
        open_ = labels.where("above <> below")
        of = lambda end: open_.select(F.col("node").alias(end), F.struct("above", "below").alias(f"{end}_of"))
        left = cut(step.join(of("src").hint("merge"), "src").join(of("dst").hint("merge"), "dst").where("src_of = dst_of").select("src", "dst"))
        drop_cut(step)
        drop_cut(labels)
    if found is None:
        return step.select(F.col("src").alias("node"), F.col("src").alias("component"))
    several = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(several.hint("merge"), "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """cycle, length: all simple cycles of any length, each once, from its smallest node, the shortest first (ties: by nodes).
    Walks stay inside strong components and above the node that they began with and begin only where an edge from a later node
    comes in. With most, only that many are asked for, and walks end as soon as a length is whole and so many are found."""
    alone = cut(edges.where("src = dst").select(F.array("src", "dst").alias("cycle"), F.lit(1).alias("length")).distinct())
    inside = cut(strong_components(edges))
    of = lambda end: inside.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")).hint("merge")
    step = cut(edges.where("src <> dst").select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("src_in = dst_in").select("src", "dst"))
    first = step.where("src > dst").select(F.col("dst").alias("src")).distinct()
    front, found, n, d = first.select(F.col("src").alias("first"), F.array("src").alias("path"), "src"), alone, alone.count(), 1
    while most is None or n < most:
        on = cut(front.join(step.hint("merge"), "src").where(F.col("dst") >= F.col("first")).select("first", "path", "dst"))
        closed = on.where("dst = first").select(F.concat("path", F.array("dst")).alias("cycle"), F.lit(d).alias("length"))
        onward = (F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))
        more, ended = on.agg(F.count_if(onward), F.count_if(F.col("dst") == F.col("first"))).first()
        found, n, d = found.unionByName(closed), n + ended, d + 1
        front = on.where(onward).select("first", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        if not more:
            break
    found = found.orderBy("length", "cycle")
    return found if most is None or n <= most else found.limit(most)


#: Edge types along which a join's evidence is looked for, and those that are keys (fixed values).
JOIN_TYPES = ("FOREIGN_KEY_TO", "REFERENCES", "JOINS_TO", "HAS_COLUMN", "MAPS_TO_ORACLE_OBJECT", "MAPS_TO_ORACLE_COLUMN", "RESOLVES_TO_ORACLE_COLUMN", "READS_FROM")
KEY_TYPES = ("FOREIGN_KEY_TO", "REFERENCES")


def around_pairs(edges: DataFrame, pairs: DataFrame, depth: int = 4, most: int = 400, types: tuple[str, ...] = JOIN_TYPES) -> DataFrame:
    """left_id, right_id, node, depth: what edges of these types lead to, either way, from either node of each pair, the nearest
    first (ties: by node), at most most nodes for each pair."""
    used = edges.where(F.col("type").isin(*types)).select("src", "dst").distinct()
    both = used.unionByName(used.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    pair = ["left_id", "right_id"]
    seen = front = cut(pairs.select(*pair, F.explode(F.array_distinct(F.array(*pair))).alias("node")).distinct().withColumns({"depth": F.lit(0), "used": F.lit(0).cast("long")}))
    seen = front = front.withColumn("used", F.count("*").over(Window.partitionBy(*pair)))
    for d in range(1, depth + 1):
        on = front.join(both.hint("merge"), front["node"] == both["src"]).select(*pair, F.col("dst").alias("node"), "used").distinct()
        on = on.join(seen.select(*pair, "node").hint("merge"), [*pair, "node"], "left_anti")
        by_pair = Window.partitionBy(*pair)
        on = on.withColumn("n", F.row_number().over(by_pair.orderBy("node"))).where(F.col("n") <= most).where(F.col("n") + F.col("used") <= most)
        front = cut(on.select(*pair, "node", F.lit(d).alias("depth"), (F.col("used") + F.count("*").over(by_pair)).alias("used")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select(*pair, "node", "depth")


def join_evidence(edges: DataFrame, pairs: DataFrame, depth: int = 4, most: int = 400) -> DataFrame:
    """left_id, right_id, left_column, right_column, evidence, edge_id: how columns of the two objects of each pair can be
    joined, from the edges (edge_id, src, dst, type, left_column, right_column) that around_pairs() finds between its nodes.

    foreign_key: a key edge between a column of each, in either direction; reconstructed_sql_join: a JOINS_TO edge that names
    a column of each; canonical_graph_path: another edge that names them. An object's columns are those that HAS_COLUMN edges
    of the subgraph give it. The same columns with the same evidence count once, by the least edge.
    """
    pair = ["left_id", "right_id"]
    nodes = cut(around_pairs(edges, pairs, depth, most))
    allowed = edges.where(F.col("type").isin(*JOIN_TYPES))
    # an edge belongs to a pair's subgraph if both its ends do and one of them could still be walked on from
    near = nodes.select(*pair, F.col("node").alias("src"), F.col("depth").alias("from_depth"))
    far = nodes.select(*pair, F.col("node").alias("dst"), F.col("depth").alias("to_depth"))
    own = cut(allowed.join(near.hint("merge"), "src").join(far.hint("merge"), [*pair, "dst"]).where(F.least("from_depth", "to_depth") < depth).drop("from_depth", "to_depth"))
    has = own.where("type = 'HAS_COLUMN'")
    left = has.where("src = left_id").select(*pair, F.col("dst").alias("left_column")).distinct()
    right = has.where("src = right_id").select(*pair, F.col("dst").alias("right_column")).distinct()
    ends = F.array(F.struct(F.col("src").alias("left_column"), F.col("dst").alias("right_column")), F.struct(F.col("dst").alias("left_column"), F.col("src").alias("right_column")))
    keys = own.where(F.col("type").isin(*KEY_TYPES)).select(*pair, "edge_id", F.lit("foreign_key").alias("evidence"), F.inline(ends))
    kind = F.when(F.col("type") == "FOREIGN_KEY_TO", "foreign_key").when(F.col("type") == "JOINS_TO", "reconstructed_sql_join").otherwise("canonical_graph_path")
    named = own.where("left_column is not null and right_column is not null").select(*pair, "edge_id", kind.alias("evidence"), "left_column", "right_column")
    found = keys.unionByName(named).join(left.hint("merge"), [*pair, "left_column"], "left_semi").join(right.hint("merge"), [*pair, "right_column"], "left_semi")
    return found.groupBy(*pair, "left_column", "right_column", "evidence").agg(F.min("edge_id").alias("edge_id"))
