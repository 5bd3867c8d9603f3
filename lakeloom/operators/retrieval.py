"""Chunks, exact cosine search with filters, and lexical boosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakeloom.functions import text as fx
from lakeloom.sources.cuts import cut

#: Characters of a chunk and of what it shares with the next; most that words can add to a score (fixed values).
SIZE, SHARED, BOOST = 2000, 200, 0.18


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, shared: int = SHARED) -> DataFrame:
    """id, chunk_index, chunk: overlapping pieces of every text. CRLF becomes LF and the whole text is trimmed first; pieces
    are trimmed too, blank ones left out, and the others numbered without gaps."""
    step = max(size - shared, 1)
    rows = docs.select(F.col(id_col), fx.trimmed(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))).alias("_t")).where("_t <> ''")
    n = F.length("_t")
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    parts = F.filter(F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: fx.trimmed(F.col("_t").substr(i * step + 1, F.lit(size)))), lambda x: x != "")
    return rows.select(id_col, F.posexplode(parts).alias("chunk_index", "chunk"))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two number arrays in double precision; null where one is zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest by cosine to one vector, score first; each task sends on its own k best."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*map(F.lit, map(float, query)))
    return rows.withColumn("score", cosine(F.col(vector_col), q)).orderBy(F.desc_nulls_last("score"), vectors.columns[0]).limit(k)


def _unit(v: Column) -> Column:
    """A vector over its length, in double precision; null for a null, zero or non-finite one."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(d, lambda x: x / n)))[0]


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _rows(vectors):
    """The vectors of an Arrow column over their lengths, in double precision, added up as _unit() does."""
    import numpy as np

    v = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return v / np.sqrt(np.cumsum(v * v, axis=1)[:, -1])[:, None]


def _allowed(points, filters: list[str], sets: tuple):
    """Which points have an allowed value for every filter; None allows any, null and NaN are no values."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    good = np.ones(len(points), dtype=bool)
    for f, values in zip(filters, sets):
        if values is not None:
            known = pa.array(sorted(values), type=points.schema.field(f).type)
            good &= pc.is_in(points[f], value_set=known).combine_chunks().to_numpy(zero_copy_only=False)
    return good


def _best_pairs(asked, points, k: int, filters: list[str]):
    """query_id, id, score: for each query of a block the k best points of a cell, among the lists that it asks for and what its
    filters allow (ties: the smaller id). Products of matrices in single precision, with their error bound, say which may be; their
    scores are added up component by component, so that equal vectors score alike anywhere. Tiles are of bounded size."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    none = pa.table({"query_id": asked["query_id"][:0], "id": points["id"][:0], "score": pa.array([], pa.float64())})
    if not len(asked) or not len(points):
        return none
    points = points.take(pc.sort_indices(points["id"]))  # from here on a place stands for an id
    y = _rows(points["v"])
    same = np.unique(y.view(np.dtype((np.void, y.strides[0]))).ravel(), return_inverse=True)[1]
    if same.max() + 1 < len(y):  # copies score alike: of those that filters can't tell apart the k first are enough
        codes = {f: points[f].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for f in filters}
        first = pd.DataFrame({"same": same, **codes}).groupby(["same", *filters]).cumcount().to_numpy() < k
        points, y = points.filter(pa.array(first)), y[first]
    x, lists = _rows(asked["q"]), points["list"].to_numpy()
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    slack = (x.shape[1] + 16) * 6e-8  # of a product of unit vectors in single precision
    given = asked["floor"].to_numpy().astype(float)
    given = np.where(np.isnan(given), -np.inf, given)
    sets = zip(*([None if v is None else frozenset(a for a in v if a is not None and a == a) for v in asked[f"_{f}"].to_pylist()] for f in filters), asked["lists"].to_pylist())
    alike: dict = {}
    for i, (*allowed, held) in enumerate(sets):
        alike.setdefault((tuple(allowed), tuple(sorted(held))), []).append(i)
    found = []
    for (allowed, held), members in alike.items():
        cols = np.flatnonzero(_allowed(points, filters, allowed) & np.isin(lists, held))
        for at in range(0, len(members), 1024):
            rows = np.array(members[at : at + 1024])
            floor, i, j, score = given[rows], np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for to in range(0, len(cols), 4096):
                tile = cols[to : to + 4096]
                near, least = x4[rows] @ y4[tile].T, floor.copy()
                open_ = np.flatnonzero(np.isneginf(floor))
                if len(open_) and len(tile) > k:
                    least[open_] = np.partition(near[open_], len(tile) - k, axis=1)[:, len(tile) - k] - slack
                a, b = np.nonzero(near >= (least - slack).astype(np.float32)[:, None])
                b = tile[b]
                exact = [np.cumsum(x[rows[a[n : n + 65536]]] * y[b[n : n + 65536]], axis=1)[:, -1] for n in range(0, len(a), 65536)]
                i, j, score = np.concatenate([i, a]), np.concatenate([j, b]), np.concatenate([score, *exact])
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                starts = np.searchsorted(i, i)
                best = np.arange(len(i)) - starts < k
                i, j, score = i[best], j[best], score[best]
                last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                floor[i[last]] = np.maximum(floor[i[last]], score[last])
            found.append((rows[i], j, score))
    i, j, score = (np.concatenate(c) for c in zip(*found))
    return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "id": points["id"].take(pa.array(j)), "score": pa.array(score)})


def search_many(queries: DataFrame, points: DataFrame, k: int, filters: list[str], most_lists: int = 64, list_rows: int = 65536) -> DataFrame:
    """query_id, rank, id, score: for each query (query_id, vector, and for each filter an array of allowed values or null for any)
    its k nearest points (id, vector, and the filters' columns) by cosine among those that its filters allow; ties: the smaller
    id. Null, zero, non-finite and differently long vectors take no part.

    Points are filed under the nearest of at most most_lists centres, which are points of least hash; lists go to cells, and queries to
    blocks, of at most list_rows rows. A query first reads its own centre's list; its k-th best there is a floor. By the angles
    between query, centre and the list's farthest member, no member of a list can be nearer than a bound; only lists whose bound
    reaches the floor are read. So results are exact, and how much is skipped depends on how the points cluster. A query goes
    once to each cell with a list that it asks for, and a cell once to each block: a dozen times, until list_rows asks for more.
    """
    spark = points.sparkSession
    p = points.select("id", F.col("vector").alias("v"), _unit(F.col("vector")).alias("unit"), *filters).where("unit is not null")
    shape = p.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).limit(0)
    p = p.where(F.size("v") == shape["dim"])
    n_lists = max(1, min(most_lists, shape["n"] // 32))
    centres = [r["unit"] for r in p.orderBy(F.xxhash64("id", "unit"), "id").limit(n_lists).select("unit").collect()]  # most_lists vectors
    known = F.array(*(F.struct(F.lit(i).alias("list"), F.array(*map(F.lit, c)).alias("c")) for i, c in enumerate(centres)))
    angle = lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    near = lambda v: F.transform(known, lambda c: F.struct(angle(_dot(v, c["c"])).alias("angle"), c["list"].alias("list")))
    filed = cut(p.withColumn("near", F.array_min(near(F.col("unit")))).select("id", "v", *filters, F.col("near.list").alias("list"), F.col("near.angle").alias("angle")))
    q = queries.select("query_id", F.col("vector").alias("q"), _unit(F.col("vector")).alias("unit"), *(F.col(f).alias(f"_{f}") for f in filters)).where(F.size("unit") == shape["dim"])
    q = cut(q.withColumn("far", near(F.col("unit"))).withColumn("own", F.array_min("far")["list"]).drop("unit"))
    block_rows = lambda n: min(list_rows, max(2048, -(-n // 12)))
    radius, placed, held, room = [None] * n_lists, [], [], 0.0
    for r in filed.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).orderBy("list").collect():  # most_lists rows
        radius[r["list"]], parts = r["radius"], -(-r["n"] // block_rows(shape["n"]))
        for part in range(parts):
            if r["n"] / parts > room:
                held.append((len(held), []))
                room = block_rows(shape["n"])
            room -= r["n"] / parts
            held[-1][1].append(r["list"])
            placed.append((r["list"], part, parts, len(held) - 1))
    placed, held = spark.createDataFrame(placed, "list int, part long, parts long, cell int"), spark.createDataFrame([(c, sorted(set(ls))) for c, ls in held], "cell int, held array<int>")
    filed = filed.drop("angle").join(F.broadcast(placed), "list").where(F.pmod(F.xxhash64("id"), F.col("parts")) == F.col("part")).drop("part", "parts")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    nearest = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    pairs = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("id", filed.schema["id"].dataType), StructField("score", DoubleType())])
    of_block = block_rows(q.count())

    def read(asked: DataFrame) -> DataFrame:
        """asked: query_id, q, filters, floor, lists; of each cell the k best of the lists that a query asks for, not under its floor."""
        left = asked.join(F.broadcast(held), F.arrays_overlap("lists", "held")).withColumn("lists", F.array_intersect("lists", "held")).drop("held")
        blocks = left.groupBy("cell").agg(F.ceil(F.count("*") / of_block).cast("int").alias("blocks"))  # a row for each cell
        left = left.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
        right = filed.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(lambda x, y: _best_pairs(x, y, k, filters), pairs)

    columns = ["query_id", "q", *(f"_{f}" for f in filters)]
    first = cut(nearest(read(q.select(*columns, F.lit(None).cast("double").alias("floor"), F.array("own").alias("lists")))).drop("rank"))
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    bound = lambda x: F.cos(F.greatest(F.lit(0.0), x["angle"] - F.array(*map(F.lit, radius))[x["list"]])) + 1e-9
    wanted = F.filter("far", lambda x: (x["list"] != F.col("own")) & (F.col("floor").isNull() | (bound(x) >= F.col("floor"))))["list"]
    other = cut(q.join(floor, "query_id", "left").select(*columns, "floor", wanted.alias("lists")).where(F.size("lists") > 0))
    return nearest(first.unionByName(read(other))).select("query_id", "rank", "id", "score")


def word_boost(text: Column, words: list[str], most: float = BOOST) -> Column:
    """most times the share of words of which a stem stands in the text. The text is folded once: one pattern of all stems
    finds those that stand in it."""
    words = [w for w in words if w]
    if not words:
        return F.lit(0.0)
    shortest = [w[: len(w) - (2 if len(w) >= 6 else 1 if len(w) >= 5 else 0)] for w in words]  # its longer forms hold it
    hits = F.transform(F.array(fx.folded(text)), lambda t: F.size(F.filter(F.array(*map(F.lit, shortest)), lambda s: t.contains(s))))
    return F.coalesce(hits[0], F.lit(0)) * (most / len(words))


#: Additions to a hit's score (fixed values): what the folded question must say, the phrases of the chunk, the amount.
#: Rules of a list exclude each other, the first that holds counts.
DEFINITION = [
    (r"dodatkow", ("urlopy dodatkowe", "nastepujacych cech"), 0.24),
    (r"\b(ktory|ktora|ktore|jaki|jaka|jakie|co to|czym jest|jakie sa|jak rozumiec)\b", ("nastepujacych cech", "rodzaje nieobecnosci"), 0.12),
]
FIELD = [(r"\b(kolumn|formularz|etykiet|pole|staz|wyksztalc|czego sluzy|do czego)\b", ("pole ui w teta",), 0.26)]
SECTION = [
    (r"zwolni", ("zwolnienie pracownika",), 0.38),
    (r"zwolni", ("zwolnic tylko i wylacznie",), 0.38),
    (r"zwolni", ("zwolnic tylko i wylaczenie",), 0.38),
    (r"zwolni", ("zwolnij pracownika",), 0.38),
    (r"(?s)(?=.*jak)(?=.*(przyj|zatrudn))", ("przyjecie pracownika", "kartoteki pracownik"), 0.38),
]


def rule_boost(text: Column, question: str, rules: list[tuple[str, tuple[str, ...], float]]) -> Column:
    """The amount of the first rule whose pattern the question has and whose phrases all stand in the text; else 0."""
    asked = question.lower().translate(str.maketrans(fx.MARKED, fx.PLAIN))
    fitting = [(phrases, amount) for pattern, phrases, amount in rules if re.search(pattern, asked)]
    if not fitting:
        return F.lit(0.0)

    def judged(t: Column) -> Column:
        out = F.lit(0.0)
        for phrases, amount in reversed(fitting):
            every = F.lit(True)
            for p in phrases:
                every = every & t.contains(p)
            out = F.when(every, amount).otherwise(out)
        return out

    return F.coalesce(F.transform(F.array(fx.folded(text)), judged)[0], F.lit(0.0))


def reranked(hits: DataFrame, question: str, words: list[str], rules: tuple = (DEFINITION, FIELD, SECTION), text_col: str = "text") -> DataFrame:
    """hits with what words and rules add to their scores. rules: lists as those of rule_boost, each adds its own."""
    added = sum((rule_boost(F.col(text_col), question, r) for r in rules), word_boost(F.col(text_col), words))
    return hits.withColumn("score", F.col("score") + added)


def embedded_text(summary: Column, text: Column) -> Column:
    """What is embedded of a chunk: its summary, a blank line and its text; the text alone without a summary."""
    s = fx.trimmed(F.coalesce(summary, F.lit("")))
    return F.when(s != "", F.concat(s, F.lit("\n\n"), fx.trimmed(text))).otherwise(fx.trimmed(text))


def context(hits: DataFrame, key: list[str], words: list[str], first: int = 1400, others: int = 650) -> DataFrame:
    """rank, key, passage: hits by score, the best one cut to first characters, the others to fewer, around the words. For
    the few hits of one question, after merge_hits."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), *key))
    cut = F.when(F.col("rank") == 1, fx.centred(F.col("text"), first, words)).otherwise(fx.centred(F.col("text"), others, words))
    return hits.withColumn("rank", rank).select("rank", *key, cut.alias("passage"))


#: Kinds of knowledge, the best first; each is worth 100 less than the one before (fixed values).
BUCKETS = ("approved_canonical_exact_subject", "approved_canonical_lexical_alias", "authorized_client_exact", "verified_public_authority_exact", "source_backed_direct", "source_backed_partial", "insufficient")


def allowed(user: dict | None, columns: dict[str, str] | None = None) -> Column:
    """Whether a user (tenant, roles, permissions) may see a row: rows that no client owns always; a client's only with
    its tenant, one of its roles and permissions, where it names some, and within its audience."""
    name = {c: c for c in ("ownership", "tenant", "roles", "permissions", "audience")} | (columns or {})
    c = lambda n: F.col(name[n])
    if user is None:
        return ~c("ownership").eqNullSafe("client")
    own = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    roles, rights = user.get("roles", ()), user.get("permissions", ())
    none = F.array().cast("array<string>")
    named = lambda n, values: (F.size(F.coalesce(c(n), none)) == 0) | F.coalesce(F.arrays_overlap(c(n), own(values)), F.lit(False))
    audience = (
        F.when(c("audience") == "all_client_users", True)
        .when(c("audience") == "hr_only", bool({"hr", "hr_only"} & set(roles)))
        .when(c("audience") == "payroll_only", bool({"payroll", "payroll_only"} & set(roles)))
        .when(c("audience") == "administrators", bool({"admin", "administrators"} & set(roles)))
        .when(c("audience") == "named_roles", F.coalesce(F.arrays_overlap(c("roles"), own(roles)), F.lit(False)))
        .otherwise(False)
    )
    inside = F.coalesce(c("tenant") == user["tenant"], F.lit(False)) & named("roles", roles) & named("permissions", rights) & audience
    return ~c("ownership").eqNullSafe("client") | inside


def searchable(c: Column) -> Column:
    """Lower case without marks; everything but letters a-z and digits is one space."""
    return F.trim(F.regexp_replace(fx.folded(c), r"[^a-z0-9]+", " "))


def lexical_search(units: DataFrame, question: str, user: dict | None = None, scope: dict[str, str] | None = None, k: int | None = None) -> DataFrame:
    """unit_id, bucket, score of the units (unit_id, subject, text, mode, ownership and what allowed() reads) that share
    words with a question, by score and id.

    A unit of a scope column's array other than asked for is left out (an empty one fits all). Overlap: each word of the
    unit that the question has, 2 for the question's first two words together, 1 for each of its words of four letters
    whose beginning stands in the unit. The bucket gives 1000, 900 ..., an exact subject 50 more.
    """
    rows = units.where(allowed(user))
    for column, wanted in (scope or {}).items():
        rows = rows.where((F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) == 0) | F.array_contains(column, wanted))
    asked = " ".join(re.sub(r"[^a-z0-9]+", " ", question.lower().translate(str.maketrans(fx.MARKED, fx.PLAIN))).split())
    words = sorted(set(asked.split()))
    rows = rows.withColumns({"_t": searchable(F.concat_ws(" ", "subject", "text")), "_s": searchable(F.col("subject"))})
    begin, head = " ".join(asked.split()[:2]), " ".join(asked.split()[:3])
    shared = F.size(F.filter(F.split("_t", " "), lambda w: w.isin(*words))) if words else F.lit(0)
    stems = [w[: max(4, len(w) - 1)] for w in words if len(w) >= 4]
    overlap = shared + (F.when(F.col("_t").contains(begin), 2).otherwise(0) if begin else F.lit(0)) + F.size(F.filter(F.array(*map(F.lit, stems)).cast("array<string>"), lambda s: F.col("_t").contains(s)))
    exact = (F.col("_s") != "") & (F.lit(asked).contains(F.col("_s")) | F.col("_s").contains(head))
    rows = rows.withColumns({"_o": overlap, "_e": exact}).where("_o > 0 or _e")
    bucket = (
        F.when(F.col("mode") == "approved_canonical", F.when(F.col("_e") | (F.col("_o") >= 8), BUCKETS[0]).otherwise(BUCKETS[1]))
        .when(F.col("ownership") == "client", BUCKETS[2])
        .when(F.col("ownership") == "public_authority", BUCKETS[3])
        .when(F.col("mode") == "source_backed_direct", BUCKETS[4])
        .when(F.col("mode") == "source_backed_partial", BUCKETS[5])
        .otherwise(BUCKETS[6])
    )
    worth = F.lit(1000) - 100 * (F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int") - 1)
    out = rows.withColumn("bucket", bucket).select("unit_id", "bucket", (worth + F.col("_o") + F.when(F.col("_e"), 50).otherwise(0)).alias("score"))
    out = out.orderBy(F.desc("score"), "unit_id")
    return out if k is None else out.limit(k)


def merge_hits(hits: DataFrame, key: list[str], least: float, k: int) -> DataFrame:
    """Hits of at least that score, the best of each key, the k best of all."""
    best = hits.where(F.col("score") >= least).groupBy(*key).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), *key).limit(k)


def payload(must: dict[str, object], columns: dict[str, str]) -> Column:
    """Conditions on a row's payload, all of which must hold: a value is equal to the column's, a list holds it; of an array
    column a member is. columns: the names and types of the row's columns; others are refused."""
    out = F.lit(True)
    for name, wanted in must.items():
        if name not in columns:
            raise ValueError(f"unknown column {name}")
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        held = F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if columns[name].startswith("array") else F.col(name).isin(*values)
        out = out & F.coalesce(held, F.lit(False))
    return out
