"""What questions ask for, what claims are like, and which segments of a transcript are noise: rules in order over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators import curation, runs

#: Intents of questions by patterns, the first that is found (fixed values).
INTENTS = [
    ("source_disclosure", r"sk[aą]d\s+(to\s+)?wiesz|podaj\s+(dokument|źr[oó]d|zrod|instrukcj)|poka[zż]\s+(dokument|źr[oó]d|evidence)|zignoruj\s+zasady"),
    ("comparison", r"czym\s+r[oó][zż]ni|r[oó][zż]nic[ae]|vs\.?|versus|por[oó]wn"),
    ("currentness", r"aktualn|czy\s+.+\s+obs[lł]uguje|ksef|zgodno[sś][cć]\s+z\s+aktual"),
    ("procedure", r"jak\s+(wykon|przeprowadz|przebiega|zrobic|zrobić|sterowan)|procedur"),
    ("rules_details", r"jakie\s+s[aą]\s+zasady|zasady\s+\w+|co\s+m[oó]wi\s+.+\s+o\s+|jakie\s+s[aą]\s+regu[lł]"),
    ("definition", r"czym\s+jest|co\s+to\s+jest|co\s+oznacza"),
]
#: A claim that says where rules stand, unless it states one; other shapes by patterns in order, the definition only of short
#: claims (fixed values).
POINTER = r"zasady\s+(s[aą]\s+)?okre[sś]lon[ey]|wed[lł]ug\s+zasad\s+okre[sś]lon|okre[sś]lon[eyah]\s+w\s+regulamin"
STATED = r"(premia\s+\d|%\s*premii|kwot[ay]|termin\s+wyp[lł]aty|warunkiem\s+jest)"
SHAPES = [
    ("procedural", r"krok|najpierw|nast[eę]pnie|procedur|rejestracj|akceptacj|uprawnie[nń]"),
    ("definitional", r"jest\s+|oznacza\s+|powierzchni[aą]|korzystaj[aą]c"),
    ("comparative", r"r[oó][zż]ni|w\s+odr[oó][zż]nieniu|natomiast"),
    ("currentness_claim", r"aktualn|obowi[aą]zuj[aą]c|ksef"),
    ("rules_content", r"prawo\s+do|przys[lł]uguje|zakaz|obowi[aą]zek|musi\s+|powinien"),
]
SHORT_CLAIM = 220
#: Words of the matter, which make a segment content whatever else it says, and kinds of noise by patterns (fixed values).
MATTER = ["formularz", "umow", "pracownik", r"list[y]?\s+płac", r"(?-i:\bRCP\b)", r"\bstatus\b", "składnik", "parametr", "konfigurac", "nalicz", "zatrudn", r"przejęcie|przerwa\s+w\s+zatrudnieniu", r"przerwa\s+nocna", "wpływ", "działanie", "wybrać", "utworzyć", "rejestrow"]
NOISE = [
    ("screen_share_check", r"czy widać (mój )?ekran|widzicie ekran|share screen|czy widać mój ekran"),
    ("audio_problem", r"proszę włączyć mikrofon|słychać mnie|czy mnie słychać|sprawdźcie mikrofon|nie słyszę|problemy z mikrofon"),
    ("break_announcement", r"zrobimy teraz .+przerw|dziesięć minut przerwy|wracamy za|przerwa na kawę|robimy przerwę"),
    ("training_admin", r"sprawdzanie obecności|zasady quizu|dziękuję za uwagę|dziękuję za obecność"),
    ("repeated_phrase", r"^(dziękuję[.!]?\s*){2,}$|^(ok\.?\s*){3,}$"),
]


def query_intent(question: Column) -> Column:
    """What a question asks for: the first of INTENTS that is found in it, else other. A null question is other."""
    return fx.first_rule(F.trim(F.coalesce(question, F.lit(""))), [(n, f"(?iu){p}") for n, p in INTENTS], "other")


def claim_shape(claim: Column) -> Column:
    """What a claim is like: a pointer to rules that it doesn't state, else the first of SHAPES, else other."""
    t = F.trim(F.coalesce(claim, F.lit("")))
    found = F.lit("other")
    for name, pattern in reversed(SHAPES):
        hit = t.rlike(f"(?iu){pattern}") & (F.length(t) < SHORT_CLAIM if name == "definitional" else F.lit(True))
        found = F.when(hit, name).otherwise(found)
    return F.when(t.rlike(f"(?iu){POINTER}") & ~t.rlike(f"(?iu){STATED}"), "rules_pointer").otherwise(found)


def on_topic(question: Column, claim: Column) -> Column:
    """Whether a claim shares enough significant words of a question, each as often as the question has it: two, or one if the
    question has under six."""
    asked, said = (runs.significant(c, 3, names=True) for c in (question, claim))
    shared = F.size(F.filter(asked, lambda w: F.array_contains(said, w)))
    return shared >= F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.size(asked) / 3).cast("int")))


def transcript_noise(segment: Column) -> Column:
    """The kind of noise of a transcript's segment by MATTER and NOISE; see curation.noise()."""
    return curation.noise(segment, MATTER, NOISE)
