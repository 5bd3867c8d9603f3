"""Runs of words that texts share, with their places: by grams that meet in an equi-join, never text by text."""

from __future__ import annotations

from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as fx

#: Words too common, or names too short, to tell texts apart (fixed values).
COMMON = ("i", "w", "z", "na", "do", "o", "a", "to", "jest", "są", "sa", "jak", "jakie", "czym", "co", "oraz", "dla", "nie", "się", "sie", "od", "po", "za", "czy", "the", "of", "and")
SHORT_NAMES = ("teta", "hr", "edu", "me", "ksef", "ppk", "rcp", "xml", "gus")
#: Signs that open and close a quotation, and the least length of one (fixed values).
QUOTED = r'[„""«»]([^„""«»]{16,})[”“"»]'


def significant(text: Column, least: int = 4, names: bool = False) -> Column:
    """The words of a text that tell it apart: without marks, of at least so many letters, in order, without common ones and,
    unless names are wanted, short names."""
    # without marks only ł is left of the Polish letters; single signs are looked up at once, ranges are asked one after another
    words = F.split(fx.unmarked(F.lower(text)), f"[^{ascii_lowercase}{digits}ł]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*COMMON, *(() if names else SHORT_NAMES)))


def _hashes(words: str, n: int, row=lambda at, gram: gram) -> Column:
    """row(place, hash) of every n neighbours among a column's words; null with fewer."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: row(i, F.xxhash64(*(F.get(words, i + k) for k in range(n)))))
    return F.when(F.size(words) >= n, grams)


def _grams(rows: DataFrame, key: str, words: str, n: int, at: str) -> DataFrame:
    # a filter on words would be pushed to where they are made and make them twice
    return rows.select(key, F.posexplode(_hashes(words, n)).alias(at, "gram"))


def _islands(met: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """keys, left_at, right_at, length of the runs that places (left_at, right_at) on one difference make; length counts on from
    a place's own words."""
    met = met.distinct().withColumn("apart", F.col("left_at") - F.col("right_at"))
    on_diagonal = Window.partitionBy(*keys, "apart").orderBy("left_at")
    met = met.withColumn("island", F.col("left_at") - F.row_number().over(on_diagonal))
    runs = met.groupBy(*keys, "apart", "island").agg(F.min("left_at").alias("left_at"), F.min("right_at").alias("right_at"), (F.count("*") + length - 1).cast("int").alias("length"))
    return runs.drop("apart", "island")


def shared_runs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int) -> DataFrame:
    """left_key, right_key, left_at, right_at, length: every longest run of at least `least` words that a text of left
    (left_key, words) shares with one of right (right_key, words), and where it begins in both, counted from 0.

    Grams of least words meet by their hash; a run is an island of meetings on one difference of places. Only places that meet
    are shuffled further, by pair and difference, so a text that many share is as many groups as there are pairs.
    """
    met = _grams(left, left_key, "words", least, "left_at").join(_grams(right, right_key, "words", least, "right_at"), "gram").select(left_key, right_key, "left_at", "right_at")
    return _islands(met, [left_key, right_key], F.lit(least))


def verbatim_runs(answers: DataFrame, claims: DataFrame, least: int = 10) -> DataFrame:
    """answer_id, claim_id, answer_at, claim_at, length: runs of at least `least` significant words that an answer (answer_id,
    text) has from a claim (claim_id, text), by their place among its significant words."""
    of = lambda rows, key: rows.select(key, significant(F.col("text")).alias("words"))
    found = shared_runs(of(answers, "answer_id"), of(claims, "claim_id"), "answer_id", "claim_id", least)
    return found.select("answer_id", "claim_id", F.col("left_at").alias("answer_at"), F.col("right_at").alias("claim_at"), "length")


def quoted_claims(answers: DataFrame, claims: DataFrame, least: int = 6, least_chars: int = 24) -> DataFrame:
    """answer_id, claim_id, quote, claim_at, length: quotations in an answer (answer_id, text) that share a run of at least
    `least` significant words with a claim (claim_id, text; at least least_chars characters, list signs aside), or that stand
    in it as they are. quote counts an answer's quotations from 0; claim_at and length tell the longest run, the first of it; a
    quotation of fewer significant words is one run if the claim has all of them in a row and the text itself."""
    core = F.trim(F.regexp_replace("text", r"^[-–•\s]+", ""))
    known = claims.select("claim_id", core.alias("core")).where(F.length("core") >= least_chars).withColumn("words", significant(F.col("core")))
    said = answers.select("answer_id", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(QUOTED), 1)).alias("quote", "said"))
    said = said.select("answer_id", "quote", F.trim("said").alias("said"), significant(F.trim("said")).alias("words")).withColumn("q", F.struct("answer_id", "quote"))
    # a quotation's grams are of `least` words or, if it has fewer, of all: one pass over the answers serves both
    # what a generator's rows need of the words is made inside it, or all words would go along with each
    row = lambda n, few, at, gram: F.struct(n.alias("n"), few.cast("string").alias("few"), at.cast("int").alias("left_at"), gram.alias("gram"))
    n = F.size("words")
    whole = F.when(n > 0, F.array(row(n, F.col("said"), F.lit(0), F.xxhash64("words"))))
    asked = said.select("q", F.inline(F.coalesce(_hashes("words", least, lambda at, gram: row(F.lit(least), F.lit(None), at, gram)), whole)))
    places = [F.coalesce(_hashes("words", n, lambda at, gram, n=n: F.struct(F.lit(n).alias("n"), at.alias("right_at"), gram.alias("gram"))), F.array()) for n in range(1, least + 1)]
    met = asked.join(known.select("claim_id", F.inline(F.flatten(F.array(*places)))), ["n", "gram"]).select("q", "claim_id", "n", "few", "left_at", "right_at")
    met = met.join(known.select("claim_id", "core"), "claim_id").where(F.col("few").isNull() | F.col("core").contains(F.col("few"))).drop("core", "few")
    found = _islands(met, ["q", "claim_id", "n"], F.col("n")).select("q", "claim_id", F.col("right_at").alias("claim_at"), "length")
    best = found.groupBy("q", "claim_id").agg(F.max(F.struct("length", (-F.col("claim_at")).alias("at"))).alias("b"))
    return best.select("q.answer_id", "claim_id", "q.quote", (-F.col("b.at")).alias("claim_at"), F.col("b.length").cast("int").alias("length"))
