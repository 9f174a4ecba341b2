"""Audit of answers: whether every citation stands in what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T

STATUSES = ("grounded", "cross_referenced", "unsupported")


def extract_citations(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, section, subsection): the distinct provisions every answer cites."""
    return answers.select(*keys, F.explode(T.cited_provisions(F.col(text))).alias("c")).select(*keys, "c.section", "c.subsection")


def audit_citations(cited: DataFrame, retrieved: DataFrame, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """(keys, label, status) of every citation.

    ``retrieved`` has (scope, section, subsection, text); ``scope`` are the keys, or those of them that tell what was retrieved. Grounded: the section was retrieved, and the subsection where one
    is cited. A held section without the cited subsection is unsupported. A section that wasn't retrieved but is mentioned
    in a retrieved text as a word of its own is a cross-reference.
    """
    scope = scope or keys
    held = retrieved.filter("section is not null").select(*scope, "section", F.coalesce("subsection", F.lit("")).alias("subsection")).distinct()
    sections = held.select(*scope, "section").distinct().withColumn("held", F.lit(True))
    exact = held.withColumn("exact", F.lit(True))
    known = cited.join(sections, [*scope, "section"], "left").join(exact, [*scope, "section", "subsection"], "left")
    absent = known.filter("held is null").select(*scope, "section").distinct()
    # the numbers that stand as words in the texts, those with a decimal part too, once for each scope
    numbers = F.array_union(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (r"\b(\d+)\b", r"(?=\b(\d+\.\d+)\b)")))
    words = retrieved.select(*scope, F.explode(numbers).alias("section")).distinct()
    mentioned = absent.join(words, [*scope, "section"]).withColumn("mentioned", F.lit(True))
    rows = known.join(mentioned, [*scope, "section"], "left")
    whole = F.col("held").isNotNull() & (F.col("subsection").isNull() | F.col("exact").isNotNull())
    status = F.when(whole, "grounded").when(F.col("held").isNotNull(), "unsupported").when(F.col("mentioned"), "cross_referenced").otherwise("unsupported")
    return rows.select(*keys, T.provision_label(F.col("section"), F.col("subsection")).alias("label"), status.alias("status"))


def audit_lists(audited: DataFrame, keys: list[str]) -> DataFrame:
    """One row per answer: its labels by status, in order of their strings, joined by commas (null where there is none)."""
    labels = lambda s: F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("label")))), ", "), F.lit(""))
    return audited.groupBy(*keys).agg(*(labels(s).alias(s) for s in STATUSES))


def warnings(lists: DataFrame) -> DataFrame:
    """Adds ``warning`` and ``note``, null where the audit gives no cause."""
    return lists.withColumns({
        "warning": F.concat(F.lit("WARNING: not in the retrieved provisions: "), F.col("unsupported")),
        "note": F.concat(F.lit("Note: mentioned but not retrieved: "), F.col("cross_referenced")),
    })


def build_context(retrieved: DataFrame, keys: list[str], order: str = "rk") -> DataFrame:
    """(keys, context): the retrieved texts under their citations, best first."""
    block = F.concat(F.lit("["), F.col("citation"), F.lit("]\n"), F.col("text"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct(order, block.alias("block")))), lambda x: x["block"])
    return retrieved.groupBy(*keys).agg(F.array_join(blocks, "\n\n").alias("context"))


def refusal_report(declined: DataFrame, audited: DataFrame, keys: list[str], answerable: str = "answerable") -> DataFrame:
    """One row for answerable questions and one for the others: (answerable, n, declined, false_declines, unsupported,
    cross_referenced), the last two as numbers of answers with such a citation. ``declined`` has (keys, answerable, declined)."""
    flag = lambda s: F.max(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    per_answer = audited.groupBy(*keys).agg(flag("unsupported"), flag("cross_referenced"))
    rows = declined.join(per_answer, keys, "left").groupBy(answerable)
    false = F.count_if(F.col("declined") & F.col(answerable)).alias("false_declines")
    return rows.agg(F.count("*").alias("n"), F.count_if("declined").alias("declined"), false, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unsupported", "cross_referenced")))


def refusals(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, declined): an answer that cites nothing declines."""
    return answers.select(*keys, (F.size(F.coalesce(T.cited_provisions(F.col(text)), F.array())) == 0).alias("declined"))
