"""Column builders for statute text: tokens, citations, labels, paragraph patterns. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_HEADING_CHARS = 70
SCHEDULE = "SCHEDULE"
EXCLUDED_BANNERS = ("RELATED PROVISIONS", "AMENDMENTS NOT IN FORCE")

# The forms of provisions. ``(?U)`` makes \d and \s cover all scripts.
SECTION_WITH_SUB = r"(?U)^(\d+(?:\.\d+)?)\s*\((\d+)\)\s+\S"
SECTION = r"(?U)^(\d+(?:\.\d+)?)\s+[A-Z(]"
SUBSECTION = r"(?U)^\((\d+)\)\s+\S"
ITEM = r"(?U)^\(([a-z]+(?:\.\d+)?)\)\s+\S"
HISTORY = r"(?U)^(R\.S\.|S\.C\.|\d{4}), "
PART = r"(?U)^PART\s+([IVXLC]+)"
REPEALED = r"(?U)^(?:\([^)]+\)|\d+(?:\.\d+)?).{0,40}?\[Repealed"
DEFINITION = r"^([A-Za-z][^.]{0,60}?)\s+(means|includes)\b"
OPENS_DEFINITIONS = r"\bIn this (Act|Part|section|subsection)\b|\bfollowing definitions apply\b"
ITEM_MARKER = r"\([a-z]+(?:\.\d+)?\)\s"
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"
CITATION_QUERY = r"(?iU)\b(?:sub)?section\s+(\d+(?:\.\d+)?)(?:\s*\((\d+)\))?|\bs\.\s*(\d+(?:\.\d+)?)"
CITED = r"(?U)\bs\.\s*(\d+(?:\.\d+)?)(?:\s*\((\d+)\))?"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with hyphen compounds kept; null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def provision_label(section: Column, subsection: Column) -> Column:
    return F.concat(F.lit("s. "), section, F.when(F.coalesce(subsection, F.lit("")) != "", F.concat(F.lit("("), subsection, F.lit(")"))).otherwise(""))


def citation(section: Column, subsection: Column, part: Column) -> Column:
    """The label under which a chunk is cited."""
    none = F.coalesce(section, F.lit("")) == ""
    schedule = F.when(none, F.lit("Schedule")).otherwise(F.concat(F.lit("Schedule, item "), section))
    return F.when(part.eqNullSafe(SCHEDULE), schedule).when(none, F.lit("(uncited)")).otherwise(provision_label(section, subsection))


def indexed_text(section: Column, subsection: Column, part: Column, heading: Column, text: Column) -> Column:
    """What the keyword index sees of a chunk: citation, heading, text."""
    return F.concat_ws(" ", citation(section, subsection, part), F.nullif(heading, F.lit("")), text)


def subsection_order(subsection: Column) -> Column:
    """0 for none, the number, 999 for what is no number."""
    return F.when(F.coalesce(subsection, F.lit("")) == "", 0).otherwise(F.coalesce(subsection.try_cast("int"), F.lit(999))).cast("int")


def is_heading(text: Column) -> Column:
    """A short line that ends like no sentence and begins like no provision; the empty text is one."""
    provision = text.rlike(SECTION_WITH_SUB) | text.rlike(SECTION) | text.rlike(SUBSECTION) | text.rlike(ITEM) | text.rlike(HISTORY)
    return (F.length(text) <= MAX_HEADING_CHARS) & ~text.rlike(r"[.;:!?,]\z") & ~provision


def paragraph_kind(text: Column, in_definitions: Column) -> Column:
    """The first that holds, in the order in which the chunker asks."""
    banner = F.upper(stripped(text))
    return (
        F.when(banner.isin(*EXCLUDED_BANNERS), "EXCLUDED").when(banner == SCHEDULE, "SCHEDULE").when(text.rlike(HISTORY) | text.rlike(REPEALED), "SKIP")
        .when(text.rlike(PART), "PART").when(text.rlike(SECTION_WITH_SUB), "SECTION_SUB").when(text.rlike(SECTION), "SECTION").when(text.rlike(SUBSECTION), "SUBSECTION")
        .when(in_definitions & text.rlike(DEFINITION), "DEFINITION").when(is_heading(text), "HEADING").otherwise("BODY")
    )


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def queried_section(question: Column) -> Column:
    """The section that a question names first, or null."""
    return F.coalesce(_group(question, CITATION_QUERY, 1), _group(question, CITATION_QUERY, 3))


def queried_subsection(question: Column) -> Column:
    """The subsection named with it; the short form ``s. N(M)`` names none."""
    return _group(question, CITATION_QUERY, 2)


def cited_provisions(answer: Column) -> Column:
    """Distinct (section, subsection) cited as ``s. N`` or ``s. N(M)``; a missing subsection is null."""
    found = F.arrays_zip(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)).alias("section"), F.regexp_extract_all(answer, F.lit(CITED), F.lit(2)).alias("subsection"))
    pairs = F.transform(found, lambda x: F.struct(x["section"].alias("section"), F.nullif(x["subsection"], F.lit("")).alias("subsection")))
    return F.array_distinct(pairs)


def value_key(*columns: str) -> Column:
    """Identity of a row by value: equal rows share it, nulls count as values."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns)), 256)


def target_label(citation_col: Column, term: Column) -> Column:
    return F.concat(citation_col, F.when(term.isNotNull(), F.concat(F.lit(" ["), term, F.lit("]"))).otherwise(""))
