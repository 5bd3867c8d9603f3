"""Text and date expressions, all evaluated inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lakeloom.functions.unicode import nfkc



def _marked_letters() -> dict[str, str]:
    """Lower-case Latin letters that Unicode takes apart into an ASCII letter and marks, with that letter."""
    apart = {c: unicodedata.normalize("NFD", c)[0] for c in (chr(n).lower() for n in range(0xC0, 0x250)) if len(c) == 1 and len(c.upper()) == 1}
    return {c: base for c, base in apart.items() if base != c and base.isascii() and base.isalpha()}


#: Letters with marks and those without, as translate takes them; an ł isn't a marked letter, but folded like one.
_LETTERS = _marked_letters()
MARKS, BARE = "".join(_LETTERS), "".join(_LETTERS.values())
MARKED, PLAIN = MARKS + "ł", BARE + "l"


def folded(c: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def terms(c: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of at least so many letters, longest first, then by name."""
    words = F.filter(F.split(folded(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    words = F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)).cast("array<string>"))
    keyed = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(keyed, lambda s: s["w"])


def stems(word: Column) -> Column:
    """A word and what is left without its last letter (from 5 letters) and its last two (from 6)."""
    n = F.length(word)
    return F.filter(F.array(word, F.when(n >= 5, word.substr(F.lit(1), n - 1)), F.when(n >= 6, word.substr(F.lit(1), n - 2))), lambda s: s.isNotNull())


def overlap(x: Column, y: Column) -> Column:
    """Shared members over the size of the larger set; 0 if one is empty."""
    most = F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(most, F.lit(0)), F.lit(0.0))


def clock(seconds: Column) -> Column:
    """h:mm:ss of a number of seconds, negative ones as 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def years_between(start: Column, end: Column) -> Column:
    return F.floor(F.months_between(end, start) / 12).cast("int")


def point_id(source: Column, index: Column) -> Column:
    """A UUID of version 4's shape from the sha256 of `source:index`: 8-4-4-4-12 hex digits, the 13th a 4, the two at 17
    with the variant's bits."""
    h = F.sha2(F.concat(source, F.lit(":"), index.cast("string")), 256)
    variant = F.conv(h.substr(17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("4"), h.substr(14, 3)), F.concat(F.lower(F.lpad(F.hex(variant), 2, "0")), h.substr(19, 2)), h.substr(21, 12))


def formula_lead(c: Column) -> Column:
    """Whether a spreadsheet would take the cell for a formula."""
    return c.rlike(r"^[=+\-@]")


#: What stands between the kept ends of a cut text (fixed value).
GAP = " … "


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit("\t\n\x0b\f\r \u00a0\ufeff"))


def excerpt(c: Column, limit: int) -> Column:
    """A trimmed text of at most limit characters: three quarters of what GAP leaves from the head, the rest from the tail."""
    t = trimmed(c)
    if limit <= len(GAP) + 2:
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(t.substr(1, limit - 1), F.lit("…")))
    head = (limit - len(GAP)) * 3 // 4
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(t.substr(1, head), F.lit(GAP), F.right(t, F.lit(limit - len(GAP) - head))))


def centred(c: Column, limit: int, words: list[str]) -> Column:
    """At most limit characters around the first word (the longest first) of which a stem stands in the text, a quarter
    of them before it; … marks cut ends. Without such a word, excerpt."""
    t = trimmed(c)
    plain = folded(t)
    out = excerpt(t, limit)
    for w in sorted(words, key=len):  # the outermost condition is the longest word's longest form
        for f in reversed([w[: len(w) - k] for k in range(3 if len(w) >= 6 else 2 if len(w) >= 5 else 1)]):
            at = F.instr(plain, F.lit(f))
            start = F.greatest(at - 1 - limit // 4, F.lit(0))
            cut = F.concat(F.when(start > 0, "…").otherwise(""), t.substr(start + 1, F.lit(limit)), F.when(start + limit < F.length(t), "…").otherwise(""))
            out = F.when(at > 0, cut).otherwise(out)
    return F.when(F.length(t) <= limit, t).otherwise(out)


def like_prefix(c: Column, prefix: str) -> Column:
    """Case-blind match of a literal prefix; %, _ and the escape sign stand for themselves."""
    return F.upper(c).startswith(prefix.upper())


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_words(c: Column) -> Column:
    """Lower case, quotes out, punctuation as spaces, white space collapsed."""
    return spaced(F.regexp_replace(F.regexp_replace(F.lower(c), "[„”\"']", ""), r"[.,;:!?\-–—()\[\]{}]", " "))


def normal_words(c: Column) -> Column:
    """plain_words() of a text in compatibility form, for columns that are normalised once."""
    return plain_words(nfkc(c))


def spoken(c: Column) -> Column:
    """A question as lexicons compare it: lower case, one kind of quotes and dashes, `nr` for numer and nr., no final sign."""
    t = F.translate(F.lower(c), "„”«»–—−", '""""---')
    for pattern, by in ((r"\bnr\.", "nr"), (r"\bnumer\b", "nr"), (r"\bew\.", "ew")):
        t = F.regexp_replace(spaced(t), pattern, by)
    return F.trim(F.regexp_replace(t, r"[!?.,;:]+$", ""))


def title_key(c: Column) -> Column:
    """Upper case without marks; everything but letters and digits is one space. (An ł isn't a marked l: it's a space.)"""
    t = F.translate(F.upper(c), MARKS.upper(), BARE.upper())
    return F.trim(F.regexp_replace(t, r"[^A-Z0-9]+", " "))


def graph_term(c: Column) -> Column:
    """A name as the graph's index has it: trimmed, spaces collapsed, lower case, a GUID without its braces, marks off."""
    t = F.lower(spaced(c))
    guid = t.rlike(r"^[{(]?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[)}]?$")
    return F.translate(F.when(guid, F.regexp_replace(t, r"[{}()]", "")).otherwise(t), MARKED, PLAIN)


#: Endings that a tag loses, the first that fits, and tags that stand for others (fixed values).
ENDINGS = ("ow", "ów", "ach", "ami", "om", "em", "ie", "y", "a", "e", "i", "u")
ALIASES = {"pracownic": "pracownik", "pracownikow": "pracownik", "pracownikach": "pracownik", "pracownikami": "pracownik"}


def tag(c: Column) -> Column:
    """A word as a tag: folded, without signs and its ending, by its alias; empty if under two letters."""
    bare = F.regexp_replace(F.translate(F.lower(F.trim(c)), MARKS, BARE), "[^a-z0-9_ł]", "")

    def ended(t: Column) -> Column:
        out = t
        for e in reversed(ENDINGS):
            out = F.when((F.length(t) > len(e) + 2) & t.endswith(e), t.substr(F.lit(1), F.length(t) - len(e))).otherwise(out)
        return F.when(F.length(t) < 2, "").otherwise(out)

    def named(t: Column) -> Column:
        out = t
        for known, other in ALIASES.items():
            out = F.when(t == known, other).otherwise(out)
        return out

    # each step is the one element of an array, so that the next one reads it and doesn't compute it anew
    return F.transform(F.transform(F.array(bare), ended), named)[0]


def tags(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tags of at least three letters, in order, without stop words."""
    words = F.transform(F.split(F.translate(F.lower(c), MARKS, BARE), "[^a-z0-9_ł]+"), tag)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def label_score(label: Column, column: Column, comment: Column | None = None) -> Column:
    """How well a label names a column: 100 if equal, 6 if one holds the other, else 3 for each of its words (three letters
    at least) that a word of the name holds or is held by; 8 more if the column's comment holds the label. Under 5 no match."""
    a, b = F.trim(folded(label)), F.trim(folded(F.replace(column, F.lit("_"), F.lit(" "))))
    parts = F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    words = F.filter(F.split(a, r"\s+"), lambda w: F.length(w) >= 3)
    shared = F.size(F.filter(words, lambda w: F.exists(parts, lambda p: p.contains(w) | w.contains(p))))
    score = F.when((a == "") | (b == ""), 0).when(a == b, 100).when(b.contains(a) | a.contains(b), 6).otherwise(3 * shared)
    return score if comment is None else score + F.when((a != "") & F.coalesce(folded(comment).contains(a), F.lit(False)), 8).otherwise(0)


def unmarked(c: Column) -> Column:
    """A text without marks on Latin letters; an ł isn't a marked letter."""
    return F.translate(c, MARKS, BARE)


def _grams_of(h: Column, by: Column) -> Column:
    """Hashes of grams longer by some words than those that h has, no longer than twice as long: of a gram's first and last part."""
    longer = F.transform(F.sequence(F.lit(1), F.size(h) - by), lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i - 1 + by)))
    return F.when(by == 0, h).when(F.size(h) > by, longer).otherwise(F.array().cast("array<bigint>"))


def longest_run(x: Column, y: Column) -> Column:
    """length, x_at, y_at of the longest run of equal neighbours that two arrays share (the first in x, then in y, from 0; null
    without one).

    The length of shared grams is doubled as long as there are any, then halved in on: grams of twice a length are pairs of
    grams, so each round is one pass over the words, and about twice the logarithm of the run are made.
    """
    hashes = lambda a: F.transform(a, lambda w: F.xxhash64(w))
    rounds = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int")))

    def state(hx: Column, hy: Column, size: Column, more: Column) -> Column:
        return F.struct(hx.alias("x"), hy.alias("y"), size.alias("size"), more.alias("more"))

    def doubled(s: Column, _: Column) -> Column:
        wx, wy = _grams_of(s["x"], s["size"]), _grams_of(s["y"], s["size"])
        return F.when(~s["more"], s).when(F.arrays_overlap(wx, wy), state(wx, wy, s["size"] * 2, F.lit(True))).otherwise(state(s["x"], s["y"], s["size"], F.lit(False)))

    first = state(hashes(x), hashes(y), F.lit(1), F.lit(True))
    top = F.aggregate(rounds(F.least(F.size(x), F.size(y))), first, doubled)

    def narrowed(s: Column) -> Column:
        def step(b: Column, _: Column) -> Column:
            half = F.floor((b["low"] + b["high"]) / 2).cast("int")
            shared = F.arrays_overlap(_grams_of(s["x"], half), _grams_of(s["y"], half))
            return F.when(b["high"] - b["low"] <= 1, b).when(shared, F.struct(half.alias("low"), b["high"].alias("high"))).otherwise(F.struct(b["low"].alias("low"), half.alias("high")))

        return F.aggregate(rounds(s["size"]), F.struct(F.lit(0).alias("low"), s["size"].alias("high")), step)["low"]

    def placed(s: Column) -> Column:
        gx, gy = _grams_of(s["x"], s["by"]), _grams_of(s["y"], s["by"])
        hit = F.get(F.array_intersect(gx, gy), F.lit(0))
        return F.struct((s["size"] + s["by"]).alias("length"), (F.array_position(gx, hit) - 1).cast("int").alias("x_at"), (F.array_position(gy, hit) - 1).cast("int").alias("y_at"))

    # each step is the one element of an array, so that the next one reads it and doesn't compute it anew
    then = lambda s, f: F.transform(s, f)
    whole = then(then(F.array(top), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["size"].alias("size"), narrowed(s).alias("by"))), placed)[0]
    none = F.struct(F.lit(0).alias("length"), F.lit(None).cast("int").alias("x_at"), F.lit(None).cast("int").alias("y_at"))
    return F.when(F.arrays_overlap(x, y), whole).otherwise(none)


def in_order(c: Column, words: list[str]) -> Column:
    """Whether the words stand in the text one after the other; each is looked for behind the one before it."""
    rest = c
    for w in words:
        at = F.instr(rest, F.lit(w))
        rest = F.when(at > 0, F.substring(rest, at + len(w), F.length(rest)))
    return rest.isNotNull()


def lexicon_match(text: Column, mode: str, wanted: str | list[str]) -> Column:
    """Modes: exact_phrase, contains_phrase, ordered_terms, required_terms (whole words), token_prefixes. The text is
    compared as spoken() gives it, then without marks."""

    def fits(t: Column, w) -> Column:
        tokens = F.split(t, r"\s+")
        match mode:
            case "exact_phrase":
                return t == w
            case "contains_phrase":
                return t.contains(w)
            case "ordered_terms":
                return in_order(t, w)
            case "required_terms":
                return F.forall(F.array(*map(F.lit, w)), lambda x: F.array_contains(tokens, x))
            case "token_prefixes":
                return F.forall(F.array(*map(F.lit, w)), lambda p: F.exists(tokens, lambda k: k.startswith(p)))
        raise ValueError(f"unknown mode {mode}")

    plain = str.maketrans(MARKED, PLAIN)
    t = spoken(text)
    less = wanted.lower().translate(plain) if isinstance(wanted, str) else [w.lower().translate(plain) for w in wanted]
    whole = wanted.lower() if isinstance(wanted, str) else [w.lower() for w in wanted]
    return fits(t, whole) | fits(F.translate(t, MARKED, PLAIN), less)


def first_rule(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule (name, pattern) that is found in the text."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def formula_codes(formula: Column, known: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """What a pay formula refers to: codes of components, m0_<digits> or s('<digits>'), by number; and the names it calls
    that are neither known functions nor words of CASE."""
    found = F.concat(F.regexp_extract_all(formula, F.lit(r"(?i)m0_(\d+)"), 1), F.regexp_extract_all(formula, F.lit(r"""(?i)\bs\s*\(\s*['"]?(\d+)['"]?\s*\)"""), 1))
    codes = F.transform(F.array_sort(F.transform(F.array_distinct(found), lambda x: F.struct(x.cast("long").alias("n"), x.alias("code")))), lambda s: s["code"])
    calls = F.array_distinct(F.transform(F.regexp_extract_all(formula, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), 1), F.lower))
    ignored = ("case", "when", "then", "else", "end", *(k.lower() for k in known))
    return codes, F.array_sort(F.filter(calls, lambda x: ~x.isin(*ignored) & ~x.startswith("m0_")))


def equal_text(c: Column, value: str) -> Column:
    """Case-blind equality with a text; a value of digits alone must be equal as it stands."""
    return c == value if value.isdigit() else F.upper(c) == value.upper()


def either_order(first: Column, second: Column, a: str, b: str) -> Column:
    """Two names that may stand in either order."""
    return (equal_text(first, a) & equal_text(second, b)) | (equal_text(first, b) & equal_text(second, a))


def loose_words(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of at least two letters that may be values: no stop words, in order, distinct."""
    return F.array_distinct(F.filter(F.split(folded(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def filled(template: str, columns: list[str]) -> Column:
    """A text with {column} places; only the given columns may stand there, a null one leaves its place empty."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] not in columns:
            raise ValueError(f"unknown column {m[1]}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def is_date_name(c: Column) -> Column:
    """Whether a column's name says that it holds a date."""
    n = F.upper(F.regexp_replace(F.trim(c), '["`]', ""))
    return n.startswith("DATA") | n.rlike("_DT$|_DATE$|_DATUM$")


def cell(raw: Column, kind: str) -> tuple[Column, Column]:
    """A text cell as text, number or date, and what is wrong with it (null: nothing). Null cells stay null without fault."""
    blank = F.trim(raw) == ""
    match kind:
        case "text" | "identifier_text":
            return raw, F.lit(None).cast("string")
        case "number":
            value = F.when(~blank, raw.try_cast("double"))
            odd = F.isnan(value) | (F.abs(value) == float("inf"))
            fault = F.when(raw.isNull(), None).when(value.isNull(), "unparsable_number_value").when(odd, "non_finite_number")
            return F.when(~odd, value), fault
        case "date":
            value = raw.try_cast("date")
            return value, F.when(raw.isNotNull() & value.isNull(), "unparsable_date_value")
    raise ValueError(f"unknown kind {kind}")


def stable_json(fields: dict[str, Column]) -> Column:
    """A struct as JSON with its fields in the order of their names, nulls kept: equal values give equal text."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def in_name_order(c: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs, however deep, in the order of their names, and maps as entries by key."""
    match kind:
        case StructType():
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*(in_name_order(c.getField(f.name), f.dataType).alias(f.name) for f in fields)))
        case ArrayType():
            return F.transform(c, lambda x: in_name_order(x, kind.elementType))
        case MapType():
            return F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(e["key"].alias("key"), in_name_order(e["value"], kind.valueType).alias("value")))
    return c


def stable_row(rows: DataFrame, *columns: str) -> Column:
    """Columns of a table as JSON: fields in the order of their names at every depth, nulls kept, so that equal values give equal
    text whatever order they were declared in."""
    return stable_json({c: in_name_order(F.col(c), rows.schema[c].dataType) for c in columns})


#: Headings of blocks in a manual, by which a passage is told (fixed values).
HEADINGS = ("Zakładka", "Blok", "Formularz", "Akcja")


def headed_passage(c: Column, words: list[str], headings: tuple[str, ...] = HEADINGS, most: int = 1200) -> Column:
    """The heading line that names one of the words (five letters at least, the longest first, by its stem) with the line after
    it, cut to most characters; null if there is none."""
    out = F.lit(None).cast("string")
    for w in sorted((w for w in words if len(w) >= 5), key=len):
        stem = w[:-2] if len(w) >= 7 else w[:-1] if len(w) >= 6 else w
        found = F.regexp_extract(c, rf"(?iu)(?:{'|'.join(headings)}):[^\n]*{stem}[^\n]*(?:\n[^\n]{{0,{most}}})?", 0)
        out = F.when(found != "", trimmed(found)).otherwise(out)
    return out


#: How a list of features and a duty are told (fixed values). Both begin where their line or sentence does: a search that may
#: begin anywhere finds the same, but tries every place of a long line against all that follows.
FEATURES, DUTY = r"(?iu)(?<![^\n])[^\n]*następuj[aą]cych cech:\s*[^.\n]++(?:\.|$)", r"(?iu)(?<![^.\n])[^.\n]*\btylko i wy[łl]ączn[^.]++\."


def knowledge_excerpt(c: Column, words: list[str], most: int = 1200) -> Column:
    """What of a text answers best: a line that lists features, else what begins with a duty, cut to most characters, else the
    passage under a heading that names one of the words; null for none, and without words."""
    if not words:
        return F.lit(None).cast("string")

    def best(t: Column) -> Column:
        features, duty = F.regexp_extract(t, FEATURES, 0), F.regexp_extract(t, DUTY, 0)
        begun = F.transform(F.array(duty), lambda d: F.when(d != "", trimmed(t.substr(F.instr(t, d), F.lit(most)))))[0]
        listed = F.nullif(trimmed(features), F.lit(""))
        return F.when(t == "", None).otherwise(F.coalesce(listed, begun, headed_passage(t, words, most=most)))

    return F.transform(F.array(trimmed(c)), best)[0]
