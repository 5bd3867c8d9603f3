"""Queries of text, cell and retrieval expressions, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.functions.unicode import nfkc
from lakeloom.queries import query
from lakeloom.queries_profile import PROFILE, profile
from lakeloom.sources.tables import table

#: A text with Polish letters, quotes and dashes around a part's name, for what plain data lack.
_MIXED = "'  „Ćma–' || upper(p_name) || '; (Łoś) nr. ' || p_size || '!? '"


def _mixed(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("  „Ćma–"), F.upper("p_name"), F.lit("; (Łoś) nr. "), F.col("p_size").cast("string"), F.lit("!? ")).alias("t"))


_FOLD = "translate({}, 'ąćęłńóśźż', 'acelnoszz')"


@query(f"""SELECT p_partkey, 'ćma ' || lower(p_name) || ' łoś nr ' || p_size AS words, '"ćma-' || lower(p_name) || '; (łoś) nr ' || p_size AS spoken, 'CMA ' || upper(p_name) || ' OS NR ' || p_size AS title,
'„cma–' || lower(p_name) || '; (los) nr. ' || p_size || '!?' AS graph_term, 'cma ' || lower(p_name) || ' los nr ' || p_size AS searchable FROM part""")
def text_keys(spark, d):
    """One text as the different comparisons see it."""
    from lakeloom.operators import retrieval

    t = F.col("t")
    return _mixed(spark, d).select("p_partkey", fx.normal_words(t).alias("words"), fx.spoken(t).alias("spoken"), fx.title_key(t).alias("title"), fx.graph_term(t).alias("graph_term"), retrieval.searchable(t).alias("searchable"))


@query("SELECT p_partkey, 'fi ' || p_name || ' 21⁄2 ÅK é x̂ (1) カ̇ ' || p_size AS text FROM part")
def compatible_texts(spark, d):
    """Texts in compatibility form: ligatures, fractions, wide and circled signs, marks."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    text = F.concat(F.lit("ﬁ "), wide, F.lit(" 2½ A\u030a\u212a e\u0301 x\u0302 ⑴ ｶ\u0307 "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", nfkc(text).alias("text"))


@query("""WITH g AS (SELECT p_partkey, md5(p_name) AS h FROM part) SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS guid FROM g""")
def guid_keys(spark, d):
    """GUIDs in braces and capitals, as names of a graph."""
    h = F.upper(F.md5("p_name"))
    cut = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    return table(spark, d, "part").select("p_partkey", fx.graph_term(F.concat(F.lit(" {"), cut, F.lit("} "))).alias("guid"))


@query("""WITH w AS (SELECT p_partkey, list_transform(string_split(p_name || ' pracownikach', ' '), lambda w: CASE WHEN length(w) < 2 THEN '' ELSE w END) AS ws FROM part),
s AS (SELECT p_partkey, list_transform(ws, lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 'ow') THEN left(w, -2) WHEN length(w) > 5 AND ends_with(w, 'ach') THEN left(w, -3) WHEN length(w) > 5 AND ends_with(w, 'ami') THEN left(w, -3) WHEN length(w) > 4 AND ends_with(w, 'om') THEN left(w, -2)
WHEN length(w) > 4 AND ends_with(w, 'em') THEN left(w, -2) WHEN length(w) > 4 AND ends_with(w, 'ie') THEN left(w, -2) WHEN length(w) > 3 AND regexp_matches(w, '[yaeiu]$') THEN left(w, -1) ELSE w END) AS ws FROM w)
SELECT p_partkey, array_to_string(list_filter(ws, lambda w: length(w) >= 3 AND w <> 'red'), ' ') AS tags FROM s""")
def query_tags(spark, d):
    """Words of names as tags, without endings and stop words; an inflected word meets its alias."""
    words = F.concat_ws(" ", "p_name", F.lit("pracownikach"))
    return table(spark, d, "part").select("p_partkey", F.array_join(fx.tags(words, ("red",)), " ").alias("tags"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS b, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3) AS parts FROM part), q AS (SELECT *, unnest(['red', 'red widget', 'small nut bolt', 'qq']) AS a FROM p)
SELECT p_partkey, a AS label, (CASE WHEN a = b THEN 100 WHEN contains(b, a) OR contains(a, b) THEN 6 ELSE 3 * len(list_filter(list_filter(string_split(a, ' '), lambda w: length(w) >= 3), lambda w: len(list_filter(parts, lambda p: contains(p, w) OR contains(w, p))) > 0)) END
+ CASE WHEN contains('about ' || b, a) THEN 8 ELSE 0 END)::INT AS score FROM q""")
def label_scores(spark, d):
    """How well labels name columns."""
    rows = table(spark, d, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("c"), F.concat(F.lit("About "), F.col("p_name")).alias("comment"), F.explode(F.array(*map(F.lit, ("red", "red widget", "small nut bolt", "qq")))).alias("label"))
    return rows.select("p_partkey", "label", fx.label_score(F.col("label"), F.col("c"), F.col("comment")).alias("score"))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS x, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations),
i AS (SELECT conv_id, turn, y, unnest(x) AS w, unnest(range(len(x))) AS i FROM t WHERE y IS NOT NULL), j AS (SELECT conv_id, turn, unnest(y) AS w, unnest(range(len(y))) AS j FROM t WHERE y IS NOT NULL),
m AS (SELECT DISTINCT conv_id, turn, i, j FROM i JOIN j USING (conv_id, turn, w)), g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS island FROM m),
r AS (SELECT conv_id, turn, count(*) AS run, min(i) AS x_at, min(j) AS y_at FROM g GROUP BY conv_id, turn, i - j, island), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY run DESC, x_at, y_at) AS k FROM r)
SELECT t.conv_id, t.turn, coalesce(run, 0)::INT AS run, x_at::INT AS x_at, y_at::INT AS y_at FROM t LEFT JOIN b ON t.conv_id = b.conv_id AND t.turn = b.turn AND k = 1 WHERE t.y IS NOT NULL""")
def common_runs(spark, d):
    """The longest run of words that a turn shares with the next one, and where it stands in both."""
    from pyspark.sql import Window

    words = F.split("text", " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", words.alias("x"), F.lead(words).over(Window.partitionBy("conv_id").orderBy("turn")).alias("y"))
    found = rows.where("y is not null").select("conv_id", "turn", fx.longest_run(F.col("x"), F.col("y")).alias("r"))
    return found.select("conv_id", "turn", F.col("r.length").alias("run"), "r.x_at", "r.y_at")


@query(r"""WITH p AS (SELECT p_partkey, lower(p_name) AS t, string_split(lower(p_name), ' ') AS k FROM part) SELECT p_partkey, t = 'red widget' AS exact, contains(t, 'ed w') AS contained, regexp_matches(t, 'e.*t') AS ordered,
list_contains(k, 'red') AND list_contains(k, 'bolt') AS required, len(list_filter(k, lambda x: starts_with(x, 'wid'))) > 0 AS prefixed, CASE WHEN regexp_matches(t, 'red|blue') THEN 'colour' WHEN regexp_matches(t, 'small|large') THEN 'size' ELSE 'other' END AS rule FROM p""")
def lexicon_modes(spark, d):
    """The modes of a lexicon, and rules of which the first that holds names the text."""
    t = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ?!"))
    modes = (("exact", "exact_phrase", "red widget"), ("contained", "contains_phrase", "ed w"), ("ordered", "ordered_terms", ["e", "t"]), ("required", "required_terms", ["red", "bolt"]), ("prefixed", "token_prefixes", ["wid"]))
    return table(spark, d, "part").select("p_partkey", *(fx.lexicon_match(t, m, w).alias(n) for n, m, w in modes), fx.first_rule(F.lower("p_name"), [("colour", "red|blue"), ("size", "small|large")], "other").alias("rule"))


@query("""SELECT p_partkey, '00' || (p_size % 7) || ',' || (p_partkey % 11 + 7) AS codes, 'foo' AS unknown FROM part""")
def formula_references(spark, d):
    """What pay formulas refer to and call."""
    formula = F.concat(F.lit("CASE WHEN M0_00"), (F.col("p_size") % 7).cast("string"), F.lit(" > 0 THEN round(s( '"), (F.col("p_partkey") % 11 + 7).cast("string"), F.lit("')) ELSE foo(m0_00"), (F.col("p_size") % 7).cast("string"), F.lit(") END"))
    codes, unknown = fx.formula_codes(formula, ("round", "s"))
    return table(spark, d, "part").select("p_partkey", F.array_join(codes, ",").alias("codes"), F.array_join(unknown, ",").alias("unknown"))


@query("""SELECT c_custkey, upper(c_mktsegment) = 'BUILDING' AS blind, c_custkey % 3 = 0 AS digits, c_mktsegment IN ('BUILDING') AND c_custkey % 2 = 0 AS both FROM customer""")
def equal_texts(spark, d):
    """Case-blind equality, digits as they stand, and two names in either order."""
    seg, other = F.initcap("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "Anna").otherwise("Ewa")
    return table(spark, d, "customer").select("c_custkey", fx.equal_text(seg, "building").alias("blind"), fx.equal_text(F.when(F.col("c_custkey") % 3 == 0, "12").otherwise("0012"), "12").alias("digits"), fx.either_order(other, seg, "BUILDING", "anna").alias("both"))


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(p_name || ' ring bolt', ' '), lambda w: w NOT IN ('red', 'small')) AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""")
def loose_words(spark, d):
    """Words of a question that may be values."""
    w = fx.loose_words(F.concat(F.upper("p_name"), F.lit(", x! Ring, bólt")), ("red", "small"))
    return table(spark, d, "part").select("p_partkey", F.array_join(w, " ").alias("words"))


@query("""SELECT p_partkey, 'part ' || p_partkey || ': ' || p_name || ' (' || p_brand || ')' AS label FROM part""")
def filled_templates(spark, d):
    """A template filled from columns."""
    return table(spark, d, "part").select("p_partkey", fx.filled("part {p_partkey}: {p_name} ({p_brand})", ["p_partkey", "p_name", "p_brand"]).alias("label"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_size - 20)::VARCHAR || '.5' WHEN 1 THEN 'x' WHEN 2 THEN ' ' WHEN 3 THEN '2024-02-' || lpad((p_size % 32)::VARCHAR, 2, '0') WHEN 4 THEN CASE WHEN p_size % 3 = 0 THEN 'Infinity' END END AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN raw::DOUBLE END AS number, CASE WHEN raw IS NULL OR p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 4 THEN 'non_finite_number' ELSE 'unparsable_number_value' END AS number_fault,
CASE WHEN p_partkey % 5 = 3 THEN try_cast(raw AS DATE)::VARCHAR END AS date, CASE WHEN raw IS NULL THEN NULL WHEN p_partkey % 5 <> 3 OR try_cast(raw AS DATE) IS NULL THEN 'unparsable_date_value' END AS date_fault FROM c""")
def cell_values(spark, d):
    """Text cells as numbers and dates, with what is wrong with them."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat((F.col("p_size") - 20).cast("string"), F.lit(".5"))).when(k == 1, "x").when(k == 2, " ").when(k == 3, F.concat(F.lit("2024-02-"), F.lpad((F.col("p_size") % 32).cast("string"), 2, "0"))).when(F.col("p_size") % 3 == 0, "Infinity")
    (n, n_fault), (t, t_fault) = fx.cell(raw, "number"), fx.cell(raw, "date")
    return table(spark, d, "part").select("p_partkey", n.alias("number"), n_fault.alias("number_fault"), t.cast("string").alias("date"), t_fault.alias("date_fault"))


@query(f"""WITH {PROFILE} SELECT tab, col, regexp_matches(upper(regexp_replace(col, 'date$', '_date')), '^DATA|_DT$|_DATE$|_DATUM$') AS is_date, nulls = 0 AND NOT is_pk AND length(trim(least_value)) > 0 AS required FROM profile""")
def column_facts(spark, d):
    """Columns that hold dates by their names, and those that always have a value without being a key."""
    rows = profile(spark, d)
    name = F.regexp_replace("col", "date$", "_date")
    required = (F.col("nulls") == 0) & ~F.col("is_pk") & (F.length(F.trim("least_value")) > 0)
    return rows.select("tab", "col", fx.is_date_name(name).alias("is_date"), required.alias("required"))


_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279)"


@query(f"""WITH t AS (SELECT doc_id, trim(text, {_BLANK}) AS t FROM documents), l AS (SELECT *, translate(lower(t), '{fx.MARKED}', '{fx.PLAIN}') AS l FROM t), p AS (SELECT *, CASE WHEN contains(l, 'theast') THEN strpos(l, 'theast') WHEN contains(l, 'theas') THEN strpos(l, 'theas') WHEN contains(l, 'thea') THEN strpos(l, 'thea') ELSE 0 END AS pos FROM l),
s AS (SELECT *, greatest(pos - 1 - 75, 0) AS start FROM p)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN pos > 0 THEN CASE WHEN start > 0 THEN '…' ELSE '' END || substr(t, start + 1, 300) || CASE WHEN start + 300 < length(t) THEN '…' ELSE '' END ELSE substr(t, 1, 222) || ' … ' || right(t, 75) END AS passage FROM s""")
def centred_passages(spark, d):
    """Passages around a word or its stem, marks aside."""
    return table(spark, d, "documents").select("doc_id", fx.centred(F.col("text"), 300, ["theast"]).alias("passage"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'RIN') OR contains(upper(p_brand || '.' || p_type), '#12.ECO')")
def table_search(spark, d):
    """Names that hold a text, case-blind, alone or after their owner's."""
    from lakeloom.plans.request import Filter, Request

    rows = table(spark, d, "part").withColumn("full", F.concat_ws(".", "p_brand", "p_type"))
    return Request(("p_partkey", "p_name"), any_of=((Filter("p_name", "contains", "rin"),), (Filter("full", "contains", "#12.eco"),))).answer(rows)


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN (SELECT o_orderkey, o_orderkey % 7 + 1 AS line, o_orderpriority FROM orders) ON o_orderkey = l_orderkey AND line = l_linenumber")
def two_key_join(spark, d):
    """An inner join on two columns."""
    from lakeloom.plans.request import Relation, Request

    other = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("line"), "o_orderpriority")
    return Request(("l_orderkey", "l_linenumber", "o_orderpriority"), relations=(Relation(other, (("l_orderkey", "o_orderkey"), ("l_linenumber", "line"))),)).answer(table(spark, d, "lineitem"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_brand || ' red ring'), ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE, 6) AS overlap FROM w""")
def word_overlaps(spark, d):
    """Shared words over the larger set."""
    a, b = F.split("p_name", " "), F.split(F.lower(F.concat("p_brand", F.lit(" red ring"))), " ")
    return table(spark, d, "part").select("p_partkey", F.round(fx.overlap(a, b), 6).alias("overlap"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ',"size":' || p_size || '}') AS fingerprint FROM part""")
def stable_fingerprints(spark, d):
    """Fingerprints of records whatever the order of their fields."""
    fields = {"size": F.col("p_size"), "name": F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), "brand": F.col("p_brand")}
    return table(spark, d, "part").select("p_partkey", F.sha2(fx.stable_json(fields), 256).alias("fingerprint"))


@query("""SELECT p_partkey, sha256('{"list":[{"a":"' || p_type || '","b":null},' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '{"a":"x","b":' || p_size || '}' END || '],"made":{"deep":{"k":1,"n":"' || p_brand || '"},"size":' || p_size || '}}') AS fingerprint FROM part""")
def nested_fingerprints(spark, d):
    """Fingerprints of nested records whatever the order of fields at any depth."""
    s, n = F.struct, F.lit(None)
    two = F.when(F.col("p_partkey") % 3 != 0, s(F.col("p_size").alias("b"), F.lit("x").alias("a")))
    made = s(F.col("p_size").alias("size"), s(F.col("p_brand").alias("n"), F.lit(1).alias("k")).alias("deep"))
    rows = table(spark, d, "part").select("p_partkey", made.alias("made"), F.array(s(n.cast("int").alias("b"), F.col("p_type").alias("a")), two).alias("list"))
    return rows.select("p_partkey", F.sha2(fx.stable_row(rows, "made", "list"), 256).alias("fingerprint"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'widge') THEN 'Blok: ' || p_name || chr(10) || 'next ' || p_partkey END AS passage FROM part""")
def headed_passages(spark, d):
    """The passage under a heading that names a word."""
    text = F.concat(F.lit("intro\nBlok: "), F.col("p_name"), F.lit("\nnext "), F.col("p_partkey").cast("string"), F.lit("\nrest"))
    return table(spark, d, "part").select("p_partkey", fx.headed_passage(text, ["widgets", "red"]).alias("passage"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Urlop ma nastepujacych cech brak, lecz następujących cech: ' || p_name || ', ' || p_size || '.' WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN left('Wolno to tylko i wyłącznie komu' || p_brand || chr(10) || 'i dalej. ' || repeat('x', 1500), 1200) WHEN contains(p_name, 'widge') THEN 'Blok: ' || p_name || chr(10) || 'next' END AS excerpt FROM part""")
def knowledge_excerpts(spark, d):
    """The fragment of a text that answers best: a list of features, a duty, a headed passage."""
    z, name = F.col("p_size"), F.col("p_name")
    first = F.when(z % 3 == 0, F.concat(F.lit("Wstęp.\nUrlop ma nastepujacych cech brak, lecz następujących cech: "), name, F.lit(", "), z.cast("string"), F.lit(". Koniec.\n"))).when((z % 3 == 1) & (z % 2 == 0), F.concat(F.lit("Wstęp.\nWolno to tylko i wyłącznie komu"), "p_brand", F.lit("\ni dalej. "), F.repeat(F.lit("x"), F.lit(1500)))).otherwise("")
    text = F.concat(F.lit(" "), first, F.lit("\nBlok: "), name, F.lit("\nnext\nrest "))
    return table(spark, d, "part").select("p_partkey", fx.knowledge_excerpt(text, ["widgets"]).alias("excerpt"))
