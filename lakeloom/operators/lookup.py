"""Names looked up by exact keys, GUIDs and fragments: fragments by an inverted index of letter grams, never name by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators.graph import unique_best
from lakeloom.sources.cuts import cut

#: Letters of a gram; shorter fragments are looked for by grams of their own length.
GRAM = 3
#: Ranks of candidates (fixed values), and the worst one that resolves by itself.
EXACT_ID, EXACT_GUID, IDENTITY, EXACT_TYPE, SUFFIX, FRAGMENT, RESOLVES = 1, 2, 3, 4, 9, 9, 8


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _met(fragments: DataFrame, names: DataFrame) -> DataFrame:
    """fragment, name of every distinct name that holds a fragment, letter by letter.

    Names are posted under each of their distinct grams of one to three letters that is asked for; a fragment meets those of its
    rarest gram alone, and the text itself decides. One with a gram that no name has meets none.
    """
    asked = fragments.select("fragment").where("fragment <> ''").distinct()
    length = F.least(F.length("fragment"), F.lit(GRAM))
    wanted = F.when(length == 1, _grams(F.col("fragment"), 1)).when(length == 2, _grams(F.col("fragment"), 2)).otherwise(_grams(F.col("fragment"), GRAM))
    asked = cut(asked.select("fragment", wanted.alias("g")).select("fragment", F.size("g").alias("needs"), F.explode("g").alias("gram")))
    posts = names.select("name").distinct().select("name", F.explode(F.concat(*(_grams(F.col("name"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    counts = posts.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram").groupBy("fragment", "needs").agg(F.count("*").alias("has"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("has = needs")
    return posts.join(cut(rarest.select("fragment", "gram")), "gram").where(F.col("name").contains(F.col("fragment"))).select("fragment", "name")


def holders(fragments: DataFrame, names: DataFrame) -> DataFrame:
    """fragment, id, name of every name (id, name) that holds a fragment (fragment), letter by letter. An empty fragment is in no
    name."""
    return _met(fragments, names).join(names.select("id", "name").distinct(), "name").select("fragment", "id", "name")


def first_holders(fragments: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """fragment, id of the first most ids, by id, of the names that hold a fragment: of each name, then of each fragment, only
    so many go on."""
    first = lambda rows, key: rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("_k") <= most).drop("_k")
    ids = first(names.select("id", "name").distinct(), "name")
    return first(_met(fragments, names).join(ids, "name").select("fragment", "id").distinct(), "fragment")


def enders(fragments: DataFrame, names: DataFrame) -> DataFrame:
    """fragment, id, name of every name (id, name) that ends with a fragment: names meet fragments by the ends that they have."""
    asked = fragments.select("fragment").where("fragment <> ''").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.length("name")))
    ends = names.select("id", "name").distinct().where("name <> ''").select("id", "name", F.explode(ends).alias("fragment"))
    return asked.join(ends, "fragment").select("fragment", "id", "name")


def guid_key(c: Column) -> Column:
    """A GUID without braces, in lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "[{}()]", ""))


def resolved_forms(asked: DataFrame, forms: DataFrame, most: int = 30) -> DataFrame:
    """question, status, node, rank for each question (question, guid, full_type, fragment; what is null isn't asked): the form it
    names. forms: node, guid, name, canonical.

    A GUID, and if it is given a type that is the form's or ends its canonical name, gives rank 2. A type alone: 4 for the
    canonical name, 9 for its end. A fragment of the name, as it stands or folded, or of the canonical name: 9, the first most
    forms by node. Only a best candidate of rank 8 or better, alone at its rank, resolves; others are ambiguous, a single
    worse one is unresolved.
    """
    q = asked.select("question", guid_key(F.col("guid")).alias("g"), F.col("full_type").alias("t"), F.col("fragment").alias("f"))
    own = forms.select(F.col("node").cast("string").alias("node"), guid_key(F.col("guid")).alias("g"), "name", "canonical")
    by_guid = q.where("g is not null").join(own, "g").where(F.col("t").isNull() | (F.col("canonical") == F.col("t")) | (F.col("name") == F.col("t")) | F.col("canonical").endswith(F.col("t"))).select("question", "node", F.lit(EXACT_GUID).alias("rank"))
    typed = q.where("g is null and t is not null").select("question", F.col("t").alias("fragment"))
    ends = enders(typed, own.select(F.col("node").alias("id"), F.col("canonical").alias("name")))
    by_type = typed.join(ends, "fragment").select("question", F.col("id").alias("node"), F.when(F.col("name") == F.col("fragment"), EXACT_TYPE).otherwise(SUFFIX).alias("rank"))
    plain, folded = q.where("g is null and t is null and f is not null").select("question", F.col("f").alias("fragment")), F.col("fragment")
    names = own.select(F.col("node").alias("id"), F.explode(F.array("name", "canonical")).alias("name"))
    as_is = plain.join(first_holders(plain, names, most), "fragment").select("question", F.col("id").alias("node"))
    bare = plain.select("question", fx.graph_term(folded).alias("fragment"))
    terms = own.select(F.col("node").alias("id"), fx.graph_term(F.col("name")).alias("name"))
    alike = bare.join(first_holders(bare, terms, most), "fragment").select("question", F.col("id").alias("node"))
    pieces = as_is.unionByName(alike).groupBy("question").agg(F.slice(F.array_sort(F.collect_set("node")), 1, most).alias("nodes")).select("question", F.explode("nodes").alias("node"), F.lit(FRAGMENT).alias("rank"))
    best = by_guid.unionByName(by_type).unionByName(pieces).groupBy("question", "node").agg(F.min("rank").alias("rank"))
    found = asked.select("question").distinct().join(unique_best(best, "question", "node", "rank", RESOLVES), "question", "left")
    return found.select("question", F.coalesce("status", F.lit("unresolved")).alias("status"), "node", "rank")


def resolved_objects(asked: DataFrame, objects: DataFrame) -> DataFrame:
    """question, status, node, rank for each question (question, owner, object_type, name): the object of that identity, rank 3.
    objects: node, owner, object_type, name, canonical. The identity as it stands goes before one that differs in case.

    Each way to be meant is a key; an object counts under its keys only by the least and the greatest node of each, which tell
    one node from several, so a question meets one row of a key, however many objects have it.
    """
    o = objects.select(F.col("node").cast("string").alias("node"), F.col("owner").alias("o"), F.col("object_type").alias("k"), F.col("name").alias("n"), F.col("canonical").alias("c"))
    key = lambda way, own, kind, name: F.when(name.isNotNull(), F.struct(F.lit(way).alias("way"), own.alias("o"), kind.alias("k"), name.alias("n")))
    # ways: 0 the name as it stands, 1 its term, 2 whatever its case
    keys = lambda own, kind, term, *names: F.inline(F.array_distinct(F.array_compact(F.array(key(1, own, kind, fx.graph_term(term)), *(k for n in names for k in (key(0, own, kind, n), key(2, F.upper(own), F.upper(kind), F.upper(n))))))))
    has = o.select("node", keys(F.col("o"), F.col("k"), F.col("n"), F.col("n"), F.col("c"))).groupBy("way", "o", "k", "n").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    said = asked.select("question", keys(F.col("owner"), F.col("object_type"), F.col("name"), F.col("name")))
    hits = said.join(has.hint("merge"), ["way", "o", "k", "n"]).withColumn("loose", F.col("way") == 2)
    best = hits.groupBy("question").agg(F.min("loose").alias("loose"), *(f(F.when(F.col("loose") == loose, F.col(c))).alias(f"{c}_{int(loose)}") for loose in (False, True) for f, c in ((F.min, "first"), (F.max, "last"))))
    end = lambda c: F.when(F.col("loose"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    found = best.select("question", F.explode(F.array_distinct(F.array(end("first"), end("last")))).alias("node"), F.lit(IDENTITY).alias("rank"))
    # a table's files are far smaller than its rows, so a side that looks small would be sent to every task
    out = asked.select("question").distinct().join(unique_best(found, "question", "node", "rank", RESOLVES).hint("merge"), "question", "left")
    return out.select("question", F.coalesce("status", F.lit("unresolved")).alias("status"), "node", "rank")
