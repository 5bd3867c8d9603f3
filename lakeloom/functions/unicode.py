"""Unicode's compatibility form NFKC of texts, by tables that are built once from Unicode's data and expressions of the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that the tables cover: the basic plane, without surrogates.
_PLANE = [n for n in range(0x10000) if not 0xD800 <= n < 0xE000]


@cache
def tables() -> tuple[str, str, str, list[str], dict[str, str]]:
    """Characters that become one other one, and these; characters that become several, and what; and pairs of a character and
    a mark that become one."""
    form = {chr(n): unicodedata.normalize("NFKC", chr(n)) for n in _PLANE}
    ones = [c for c, f in form.items() if f != c and len(f) == 1]
    several = [c for c, f in form.items() if len(f) != 1]
    apart = (unicodedata.normalize("NFD", chr(n)) for n in _PLANE)
    pairs = {unicodedata.normalize("NFC", d[:-1]) + d[-1]: unicodedata.normalize("NFC", d) for d in apart if len(d) > 1 and not 0x1100 <= ord(d[0]) < 0x1200}
    return "".join(ones), "".join(form[c] for c in ones), "".join(several), [form[c] for c in several], {k: v for k, v in pairs.items() if len(k) == 2 and len(v) == 1}


def _class(chars: str) -> str:
    """A class of a regular expression for some characters, as ranges."""
    points, ranges = sorted(map(ord, set(chars))), []
    for n in points:
        if ranges and n == ranges[-1][1] + 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def nfkc(c: Column) -> Column:
    """A text in compatibility form: characters replaced by what they stand for, and marks joined to the character right before
    them. Marks are taken in the order in which they stand; Hangul letters are not joined. Plain ASCII is left as it is."""
    ones, by, several, what, pairs = tables()
    marks = _class("".join(k[1] for k in pairs))
    each = lambda t, f: F.array_join(F.transform(F.split(t, ""), f), "")

    def expanded(t: Column) -> Column:
        at = lambda ch: F.instr(F.lit(several), ch)
        choice = F.split(F.lit("\x01".join(what)), "\x01")
        return each(t, lambda ch: F.when((ch > "\x7f") & (at(ch) > 0), F.get(choice, at(ch) - 1)).otherwise(ch))

    def joined(t: Column) -> Column:
        known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))
        first = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

        def step(s: Column, ch: Column) -> Column:
            # the table is read through, so only marks look into it, and once; no mark is plain ASCII
            one = F.when((ch > "\x7f") & ch.rlike(marks), F.try_element_at(known, F.concat(s["last"], ch)))
            met = lambda o: F.when(o.isNotNull(), F.struct(s["done"].alias("done"), o.alias("last"))).otherwise(F.struct(F.concat(s["done"], s["last"]).alias("done"), ch.alias("last")))
            return F.transform(F.array(one), met)[0]

        return F.aggregate(F.split(t, ""), first, step, lambda s: F.concat(s["done"], s["last"]))

    then = lambda t, f: F.transform(F.array(t), f)[0]
    swapped = F.translate(c, ones, by)
    wide = then(swapped, lambda t: F.when(t.rlike(_class(several)), expanded(t)).otherwise(t))
    whole = then(wide, lambda t: F.when(t.rlike(marks), joined(t)).otherwise(t))
    return F.when(c.rlike(r"[^\x00-\x7f]"), whole).otherwise(c)
