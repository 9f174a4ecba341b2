"""Two-column layout of positioned lines: margins, columns, reading order. One document is one key; all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CONCENTRATION, TOLERANCE, MIN_SEPARATION = 0.15, 2.0, 0.15
#: Statuses of documents that can't be measured at all.
UNMEASURED = ("no page size", "no positions")


def threshold(left: Column, right: Column) -> Column:
    return (left + right) / 2


def detect_layout(lines: DataFrame, pages: DataFrame, concentration: float = MIN_CONCENTRATION, tolerance: float = TOLERANCE, separation: float = MIN_SEPARATION) -> DataFrame:
    """(doc_id, left_margin, right_margin, n_lines, status): the commonest rounded x0 of each half of the page.

    ``pages`` has (doc_id, page_width). Among equally common positions the one that comes first in the document wins.
    ``status`` is ``ok`` or says why the document has no two columns, so that one document fails no batch; every document
    of ``lines`` has a row.
    """
    at = lines.join(pages.select("doc_id", "page_width").filter("page_width > 0"), "doc_id", "left").select("doc_id", "seq", "page_width", F.bround("x0").alias("x"))
    counts = at.groupBy("doc_id", "page_width", "x").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    middle = F.col("page_width") / 2
    half = F.when(F.col("x") < middle, "left").when(F.col("x") >= middle, "right")
    margins = counts.groupBy("doc_id", "page_width").agg(
        F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("n_lines"), best_of("left", half).alias("left_margin"), best_of("right", half).alias("right_margin"),
        F.collect_list(F.struct("x", "n")).alias("positions"),  # rounded positions: at most the page width
    )
    near = lambda m: F.aggregate(
        F.filter("positions", lambda p: F.abs(p["x"] - F.col(m)) <= tolerance), F.lit(0).cast("long"), lambda s, p: s + p["n"]
    )
    least = concentration * F.col("n_lines")
    status = (
        F.when(F.col("page_width").isNull(), "no page size")
        .when(F.col("n_lines") == 0, "no positions")
        .when(F.col("left_margin").isNull() | F.col("right_margin").isNull(), "one half is empty")
        .when((near("left_margin") < least) | (near("right_margin") < least), "a margin is not a column")
        .when((F.col("right_margin") - F.col("left_margin")) / F.col("page_width") < separation, "the margins are indent levels")
        .otherwise("ok")
    )
    return margins.select("doc_id", "left_margin", "right_margin", "n_lines", status.alias("status"))


def best_of(side: str, half: Column) -> Column:
    """The commonest position of one half; ties go to the one met first."""
    return F.max_by("x", F.when(half == side, F.struct(F.col("n"), -F.col("first"))))


def assign_columns(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """The lines of documents with two columns, with ``side``: left of the threshold, or right from it on."""
    rule = F.when(F.col("x0") < threshold(F.col("left_margin"), F.col("right_margin")), "left").otherwise("right")
    ok = layout.filter("status = 'ok'").select("doc_id", "left_margin", "right_margin")
    return lines.join(ok, "doc_id").withColumn("side", rule).drop("left_margin", "right_margin")


def reading_order(sided: DataFrame) -> DataFrame:
    """Adds ``place`` within each document and side: by page, y0, x0, then extraction order."""
    return sided.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("page", "y0", "x0", "seq")))


def column_text(ordered: DataFrame) -> DataFrame:
    """(doc_id, side, text): the lines of each column joined in reading order."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    return ordered.groupBy("doc_id", "side").agg(text.alias("text"))
