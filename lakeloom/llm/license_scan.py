"""Licence notices by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a document's words is joined by its hash to the places where templates have it; the words
themselves confirm each hit. A hit votes for the diagonal (place in the document less place in the template), votes are
summed by document, template and diagonal, neighbouring diagonals merge, and what they cover of the template and of the
span decides. A short phrase is a template that must stand whole, on one diagonal.

The grams of the templates are the joined side that is small; it is broadcast if its measured size allows that. Texts are
read once and stay where they are: only hits and one row for each document are shuffled, by document, so neither a frequent
phrase nor a frequent text gathers anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import maybe_broadcast, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words (fixed value of the contract): ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram (a shorter template is one gram); how far apart diagonals still merge; shares that confirm a span.
GRAM, BAND, LEAST, DENSE = 3, 3, 0.8, 0.5

#: Phrases that name a licence (fixed values of the contract).
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Sentences by which well-known licences are announced (their public wording, as words).
NOTICES = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), "")


def _gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(k)))


def _template_grams(templates: DataFrame, gram: int) -> DataFrame:
    """tid, label, whole, length, k, tpos, gram, h for every gram of the distinct templates that have words."""
    t = templates.select("label", F.coalesce("whole", F.lit(False)).alias("whole"), words_of(F.col("text")).alias("w")).where("label is not null and size(w) > 0").distinct()
    t = t.withColumns({"tid": F.xxhash64("label", "whole", "w"), "length": F.size("w"), "k": F.least(F.size("w"), F.lit(gram))})
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("k"))).alias("tpos"))
    h = F.lit(None).cast("long")
    for k in range(1, gram + 1):
        h = F.when(F.col("k") == k, _gram_hash(F.col("w"), F.col("tpos"), k)).otherwise(h)
    return t.select("tid", "label", "whole", "length", "k", "tpos", F.array_join(F.slice("w", F.col("tpos") + 1, F.col("k")), " ").alias("gram"), h.alias("h"))


def scan_licenses(docs: DataFrame, templates: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), gram: int = GRAM, band: int = BAND, least: float = LEAST, dense: float = DENSE) -> DataFrame:
    """For each row of docs: row (a struct of the keep columns), n_words and spans, an array of (start, end, label, whole, share)
    in order, start and end counted in words from 0, end excluded; and best, the largest share of any template's words found.

    templates has label, text and whole. A whole template's words must stand consecutively: each place is a span of share 1.
    Of another one, diagonals at most band apart merge, and the span that they cover counts if it holds at least `least` of the
    template's words and they make up at least `dense` of it. A template shorter than gram words is one gram.
    Null and empty texts have no words and no spans; texts of any length are read whole; rows that repeat stay as often as they
    come; templates that repeat count once, without words or label not at all; other columns are ignored, whatever their names;
    an empty table gives an empty result, no templates give no spans.
    """
    grams = _template_grams(templates, gram)
    n, widest, sizes = grams.agg(F.count("*"), F.coalesce(F.max(F.length("gram")), F.lit(0)), F.sort_array(F.collect_set("k"))).first()
    one_each = docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("tid"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("whole"), F.lit(0).alias("length"), F.lit(0).alias("k"), F.lit(0).alias("tpos"), F.lit("").alias("gram"), F.lit(0).cast("long").alias("h"))
    grams = maybe_broadcast(grams.unionByName(one_each), n + 1, 128 + 4 * widest)

    # one place more than there are words: it meets the row of no template, so every document keeps a row
    rows = docs.select(F.struct(*keep).alias("row"), words_of(F.col(text_col).cast("string")).alias("words")).withColumns({"id": F.monotonically_increasing_id(), "n_words": F.size("words")})
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("dpos"))
    hashes = F.array(*(_gram_hash(F.col("words"), F.col("dpos"), k) for k in sizes)) if sizes else F.array().cast("array<bigint>")
    places = places.select("*", F.explode(F.when(F.col("dpos") < F.col("n_words"), hashes).otherwise(F.array(F.lit(0).cast("long")))).alias("dh"))
    same = (F.col("dh") == F.col("h")) & (F.col("dpos") + F.col("k") <= F.col("n_words")) & (F.array_join(F.slice("words", F.col("dpos") + 1, F.col("k")), " ") == F.col("gram")) & ((F.col("dpos") < F.col("n_words")) != F.col("tid").isNull())
    first = F.col("tid").isNull()
    hits = places.join(grams, same).select("id", F.when(first, F.col("row")).alias("row"), F.when(first, F.col("n_words")).alias("n_words"), "tid", "label", "whole", "length", "k", "tpos", (F.col("dpos") - F.col("tpos")).alias("diagonal"))

    # votes of each diagonal; what stands on neighbouring ones is one span
    hits = hits.repartition("id")
    what = ["id", "tid", "label", "whole", "length", "k"]
    votes = hits.groupBy(*what, F.when(first, 0).otherwise(F.col("diagonal")).alias("diagonal")).agg(F.array_sort(F.collect_set("tpos")).alias("at"), F.first("row", ignorenulls=True).alias("row"), F.first("n_words", ignorenulls=True).alias("n_words"))
    by_diagonal = Window.partitionBy("id", "tid").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.when(F.col("whole"), 0).otherwise(band), F.lit(True))
    runs = votes.withColumn("run", F.sum(gap.cast("int")).over(by_diagonal))
    covered = lambda a, k: F.array_distinct(F.flatten(F.transform(a, lambda t: F.sequence(t, t + k - 1))))
    on_page = F.transform("at", lambda t: t + F.col("diagonal"))
    spans = runs.groupBy(*what, "run").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list(on_page)).alias("on_page"), F.first("row", ignorenulls=True).alias("row"), F.first("n_words", ignorenulls=True).alias("n_words"))
    spans = spans.withColumns({"start": F.array_min("on_page"), "end": F.array_max("on_page") + F.col("k"), "share": F.when(F.col("length") > 0, F.size(covered(F.col("at"), F.col("k"))) / F.col("length")), "density": F.size(covered(F.col("on_page"), F.col("k")))})
    fits = F.col("tid").isNotNull() & F.when(F.col("whole"), F.col("share") == 1).otherwise((F.col("share") >= least) & (F.col("density") >= dense * (F.col("end") - F.col("start"))))
    span = F.struct("start", "end", "label", "whole", "share")
    best = F.max(F.when(fits | ~F.col("whole"), F.col("share")))
    return spans.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.first("n_words", ignorenulls=True).alias("n_words"), F.array_sort(F.collect_list(F.when(fits, span))).alias("spans"), F.coalesce(best, F.lit(0.0)).alias("best")).drop("id")


def known_licenses(spark: SparkSession) -> DataFrame:
    """The phrases, which must stand whole, and the notices."""
    values = [f"('{n}', '{t}', {str(whole).lower()})" for some, whole in ((PHRASES, True), (NOTICES, False)) for n, t in some]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(label, text, whole)")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document; score: the largest share of a template's words that stands together."""
    found = scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))
    base = F.filter("spans", lambda s: s["whole"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.col("best").alias("score"))


_TEMPLATES = ", ".join(f"({i}, '{n}', '{t}', {str(whole).lower()})" for i, (n, t, whole) in enumerate([(n, t, True) for n, t in PHRASES] + [(n, t, False) for n, t in NOTICES]))
ORACLE_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT *, string_split(text, ' ') AS tw, least({GRAM}, len(string_split(text, ' '))) AS k FROM (VALUES {_TEMPLATES}) v(tid, label, text, whole)),
tg AS (SELECT *, array_to_string(tw[tpos + 1 : tpos + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS tpos FROM t)),
dg AS (SELECT rn, dpos, w, kk FROM (SELECT rn, w, unnest(range(0, len(w))) AS dpos FROM docs), (VALUES (2), ({GRAM})) s(kk)),
hits AS (SELECT rn, tid, label, whole, len(tw) AS length, k, tpos, dpos, dpos - tpos AS diagonal FROM (SELECT rn, dpos, kk, array_to_string(w[dpos + 1 : dpos + kk], ' ') AS gram FROM dg WHERE dpos + kk <= len(w)) d JOIN tg ON d.gram = tg.gram AND d.kk = tg.k),
gaps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rn, tid ORDER BY diagonal, tpos) <= CASE WHEN whole THEN 0 ELSE {BAND} END THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rn, tid ORDER BY diagonal, tpos) AS run FROM gaps),
spans AS (SELECT rn, tid, label, whole, min(dpos) AS s, max(dpos) + any_value(k) AS e, len(list_distinct(flatten(list(range(tpos, tpos + k))))) / any_value(length)::DOUBLE AS share, len(list_distinct(flatten(list(range(dpos, dpos + k))))) AS filled FROM runs GROUP BY rn, tid, label, whole, run),
fit AS (SELECT *, CASE WHEN whole THEN share = 1 ELSE share >= {LEAST} AND filled >= {DENSE} * (e - s) END AS fits FROM spans),
summed AS (SELECT rn, count(*) FILTER (fits AND whole) AS n_base, min(s) FILTER (fits AND whole) AS first_word, max(s) FILTER (fits AND whole) AS last_word,
  list_sort(list_distinct(list(label) FILTER (fits AND whole))) AS b, list_sort(list_distinct(list(label) FILTER (fits))) AS l, max(share) FILTER (fits OR NOT whole) AS score FROM fit GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (rn)
"""
