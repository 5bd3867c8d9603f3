"""Knowledge candidates from sections of text by rules, and the gates that each kind must pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as fx

#: How a line of a list begins (fixed value).
STEP = r"^\s*(\d+[\).\]]|\-|\*)\s+"
#: Rules on single lines: kind, what the line must have, what it mustn't begin with unless it has that, and the pattern whose
#: groups are the label (fixed values).
LINE_RULES = (
    ("action", r"(?i)\b(wybierz|otwórz|dodaj|zatwierdź|oblicz|wygeneruj|zarejestruj|ustaw|utwórz)\b[:\-\s]*(?=[^\n]{3})(.{1,80})"),
    ("validation_rule", r"(?i)^(.*\b(?:nie można|musi|wymagane|dopuszczalne tylko|nie może przekraczać)\b.*)$"),
)
#: Rules that find all their matches in a text: kind, name, pattern, which groups are the label, and what stands between them
#: (fixed values).
MATCH_RULES = (
    ("state_transition", None, r"(?i)status\s+zmienia\s+się\s+na\s+([\p{L}][\w ]{2,40})", (1,)),
    ("state_transition", None, r"(?i)\bz\s+([\p{L}]\w{2,30})\s+do\s+([\p{L}]\w{2,30})", (1, 2)),
    ("technical_relation", "form_uses_object", r"(?i)formularz\s+korzysta\s+z\s+(?:obiektu\s+)?([A-Za-z][\w.]{2,60})", (1,)),
    ("technical_relation", "field_mapped_to", r"(?i)pole\s+jest\s+mapowane\s+na\s+(.{3,80})", (1,)),
    ("technical_relation", "dataset_column", r"(?i)dataset\s+zawiera\s+kolumn[ęe]\s+(.{3,60})", (1,)),
    ("technical_relation", "report_registered_in", r"(?i)raport\s+jest\s+rejestrowany\s+w\s+(.{3,60})", (1,)),
    ("technical_relation", "function_references", r"(?i)funkcja\s+odwołuje\s+się\s+do\s+(.{3,60})", (1,)),
    ("parameter", None, r"(?i)Konfiguracja parametru\s+([A-Z][A-Z0-9_]{2,})", (1,)),
    ("business_concept", None, r"(?im)^[-*]?\s*([\p{L}][\p{L} ]{2,60}?)\s+(?:oznacza|to jest|rozumie się)\s+([^\n.]{5,400})", (1,)),
)
#: Rules on whole sections: kind, label, patterns that must all be there (fixed values).
TEXT_RULES = (
    ("document_type", "Dokument faktury / e-faktura", (r"(?i)dokument\s+faktury|typ\s+dokumentu|e-faktur",)),
    ("integration", None, (r"(?i)integracja\s+z|integracja\s+KSeF",)),
    ("warning", "Ostrzeżenie", (r"(?i)\buwaga\b|ostrzeż", r"(?i)nie może|wymaga|limit")),
    ("calculation_rule", "Reguła obliczeniowa", (r"[A-Z0-9_]+\s*=\s*.+",)),
)
#: Adjectives that are no states, and headings and columns that name nothing (fixed values).
WEAK_STATES = ("aktywny", "nieaktywny", "nowy", "stary", "dobry", "zły")
GENERIC_LABELS = ("uwagi", "opis", "wstęp", "informacje", "zakres", "cel", "podsumowanie")
GENERIC_COLUMNS = ("lp", "nazwa", "opis", "uwagi", "wartość", "kod", "typ")


def _out(rows: DataFrame, kind: Column | str, label: Column, statement: Column, steps: Column | None = None, name: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("section_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.substring(label, 1, 120).alias("label"), F.substring(statement, 1, 800).alias("statement"), (F.lit(0) if steps is None else steps).cast("int").alias("steps"), (none if name is None else name).alias("name"))


def extracted(sections: DataFrame) -> DataFrame:
    """section_id, kind, label, statement, steps, name: candidates that the rules find in sections (section_id, title, text).

    Lines of a list are process steps; two of them or more make a procedure, whose statement is all of them in order, and, in a
    section that is titled a process and names what goes in and what comes out, a business process. A test case is named as
    one or has input, steps and an expected result. All else comes from LINE_RULES, MATCH_RULES and TEXT_RULES; the same
    candidate of a section comes once. Each section is read in one pass; only its lists of lines are grouped.
    """
    text = F.coalesce("text", F.lit(""))
    lines = sections.select("section_id", F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    step = lines.where(F.col("line").rlike(STEP))
    found = [_out(step, "process_step", F.trim(F.regexp_replace("line", STEP, "")), F.trim("line"), F.lit(1))]
    for kind, pattern in LINE_RULES:
        hit = lines.where(F.col("line").rlike(pattern))
        groups = [F.regexp_extract("line", pattern, 1)] + ([F.regexp_extract("line", pattern, 2)] if kind == "action" else [])
        label = F.trim(F.concat_ws(" ", *(F.trim(g) for g in groups)))
        found.append(_out(hit, kind, label, F.trim("line"), name=F.lower(groups[0]) if kind == "action" else None))
    for kind, name, pattern, groups in MATCH_RULES:
        parts = [F.regexp_extract_all(text, F.lit(pattern), g) for g in (0, *groups)]
        rows = sections.select("section_id", F.explode(F.arrays_zip(*(p.alias(f"g{i}") for i, p in enumerate(parts)))).alias("m"))
        last = F.trim(F.col(f"m.g{len(groups)}"))
        label = last if len(groups) == 1 else F.concat(F.trim("m.g1"), F.lit(" → "), last)
        if kind == "state_transition":
            rows, label = rows.where(~F.lower(last).isin(*WEAK_STATES)), label if len(groups) == 2 else F.concat(F.lit("→ "), last)
        if kind == "business_concept":
            rows = rows.where(~F.lower(last).isin(*GENERIC_LABELS))
        found.append(_out(rows, kind, label if name is None or kind != "technical_relation" else F.concat(F.lit(f"{name}: "), last), F.trim("m.g0"), name=F.lit(name)))
    for kind, label, patterns in TEXT_RULES:
        hit = sections.where(reduce(lambda a, b: a & b, (text.rlike(p) for p in patterns)))
        found.append(_out(hit, kind, F.lit(label) if label else F.coalesce("title", F.lit("Integracja")), text))
    inputs, expected = text.rlike(r"(?i)dane wejściowe|warunki wstępne|konfiguracja parametru"), text.rlike(r"(?i)oczekiwany wynik")
    named = text.rlike(r"(?i)przypadek testowy|test case|scenariusz testowy")
    tests = sections.where(named | (inputs & expected & text.rlike(r"(?m)" + STEP + r"|(?i:kroki)")))
    found.append(_out(tests, "test_case", F.lit("Przypadek testowy"), text, name=F.when(inputs | expected, "parts")))
    folded = step.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("line")))).alias("l"), F.count("*").alias("n")).where("n >= 2")
    lists = folded.join(sections, "section_id")
    said = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    found.append(_out(lists, "procedure", F.coalesce("title", F.lit("Procedura")), said, F.col("n")))
    process = F.coalesce(F.col("title").rlike(r"(?i)proces\b"), F.lit(False)) | F.split(text, "\n")[0].rlike(r"(?i)proces\b")
    whole = lists.where(process & text.rlike(r"(?i)wejście\s*:|warunek\s*:") & text.rlike(r"(?i)wynik procesu|stan końcowy|wynik\s*:"))
    found.append(_out(whole, "business_process", F.coalesce("title", F.lit("Proces biznesowy")), text, F.col("n"), F.lit("parts")))
    return reduce(DataFrame.unionByName, found).distinct()


#: Gates (fixed codes): kind, code, what becomes of a candidate that it holds for; the first that holds decides.
Gate = tuple[str, str, str, Callable[[Column, Column, Column, Column], Column]]
GATES: tuple[Gate, ...] = (
    ("business_concept", "generic_heading_as_business_concept", "reject", lambda label, stmt, steps, name: F.lower(label).isin(*GENERIC_LABELS)),
    ("business_concept", "unsupported_noun_as_business_concept", "reject", lambda label, stmt, steps, name: (F.length(label) < 3) | label.rlike(r"(?i)^(i|oraz|the|a|an)$")),
    ("business_concept", "business_concept_weak_context", "downgrade", lambda label, stmt, steps, name: ~stmt.rlike(r"(?i)\b(oznacza|rozumie\s+się|jest)\b") & (F.length(F.trim(stmt)) < 20)),
    ("parameter", "generic_table_column_as_parameter", "reject", lambda label, stmt, steps, name: F.lower(label).isin(*GENERIC_COLUMNS)),
    ("parameter", "parameter_missing_config_evidence", "reject", lambda label, stmt, steps, name: ~stmt.rlike(r"(?i)\bparametr") & ~stmt.rlike(r"\b[A-Z][A-Z0-9_]{2,}\b") & ~stmt.rlike(r"\b\d{4,6}\b|[:=]")),
    ("status", "adjective_promoted_to_status", "reject", lambda label, stmt, steps, name: F.lower(label).isin(*WEAK_STATES)),
    ("status", "status_missing_process_context", "reject", lambda label, stmt, steps, name: ~stmt.rlike(r"(?i)\b(status|stan)\b")),
    ("calculation_rule", "calculation_rule_missing_formula", "reject", lambda label, stmt, steps, name: ~stmt.contains("=")),
    ("temporal_rule", "temporal_rule_missing_date", "reject", lambda label, stmt, steps, name: ~stmt.rlike(r"\d{1,4}")),
    ("process_step", "process_step_missing_order", "downgrade", lambda label, stmt, steps, name: (steps == 0) & ~stmt.rlike(STEP)),
    ("procedure", "procedure_missing_steps", "reject", lambda label, stmt, steps, name: (steps < 2) & ~stmt.rlike(r"(?i)procedur|sposób postępowania|wykonanie|kroki")),
    ("business_process", "business_process_missing_structure", "reject", lambda label, stmt, steps, name: name.isNull() & ~stmt.rlike(r"(?i)wejście|wynik procesu|warunek:")),
    ("action", "action_missing_verb", "reject", lambda label, stmt, steps, name: name.isNull() & ~stmt.rlike(r"(?i)\b(wybierz|otwórz|dodaj|zatwierdź|oblicz|wygeneruj|zarejestruj)\b")),
    ("state_transition", "state_transition_missing_states", "reject", lambda label, stmt, steps, name: ~label.contains("→") & ~stmt.rlike(r"(?i)zmienia\s+się\s+na|z\s+.+\s+do\s+")),
    ("validation_rule", "validation_rule_missing_constraint", "reject", lambda label, stmt, steps, name: ~stmt.rlike(r"(?i)\b(nie można|musi|wymagane|dopuszczalne tylko|nie może przekraczać)\b")),
    ("test_case", "test_case_missing_structure", "reject", lambda label, stmt, steps, name: name.isNull() & ~stmt.rlike(r"(?i)dane wejściowe|oczekiwany wynik|przypadek testowy")),
    ("technical_relation", "technical_relation_missing_link", "reject", lambda label, stmt, steps, name: name.isNull() & ~stmt.rlike(r"(?i)korzysta z|mapowane na|zawiera kolumn|rejestrowany w|odwołuje się")),
)
#: Reasons of a rejection by code; any other one lacks what its kind asks for (fixed values).
REASONS = {
    "generic_heading_as_business_concept": "generic_heading",
    "generic_table_column_as_parameter": "generic_table_column",
    "adjective_promoted_to_status": "weak_status_evidence",
    "status_missing_process_context": "weak_status_evidence",
    "parameter_missing_config_evidence": "weak_parameter_evidence",
    "unsupported_noun_as_business_concept": "weak_business_concept_evidence",
    "business_concept_weak_context": "weak_business_concept_evidence",
    "missing_evidence": "missing_source_evidence",
}


def gated(candidates: DataFrame) -> DataFrame:
    """candidates (kind, label, statement, steps, name, evidence: how many places back it) with outcome (accept, downgrade,
    reject), code and, for a rejected one, reason. Without evidence everything is rejected; kinds without gates pass."""
    label, stmt = F.trim("label"), F.coalesce("statement", F.lit(""))
    code = outcome = F.lit(None).cast("string")
    for kind, name, action, holds in reversed(GATES):
        hit = (F.col("kind") == kind) & holds(label, stmt, F.col("steps"), F.col("name"))
        code, outcome = F.when(hit, name).otherwise(code), F.when(hit, action).otherwise(outcome)
    bare = F.coalesce("evidence", F.lit(0)) == 0
    code, outcome = F.when(bare, "missing_evidence").otherwise(code), F.when(bare, "reject").otherwise(F.coalesce(outcome, F.lit("accept")))
    reasons = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    out = candidates.withColumn("outcome", outcome).withColumn("code", code)
    return out.withColumn("reason", F.when(F.col("outcome") == "reject", F.coalesce(reasons[F.col("code")], F.lit("missing_kind_specific_evidence"))))


def subject_key(label: Column) -> Column:
    """A label as candidates are compared by: folded, signs as single spaces."""
    return F.trim(F.regexp_replace(fx.folded(label), r"[^a-z0-9]+", " "))
