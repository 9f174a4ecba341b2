"""From paragraphs to citable chunks. The state that a reader would carry along is windows over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

MAX_CHUNK_CHARS = 1200
STARTS = ("SECTION_SUB", "SECTION", "SUBSECTION")
CLOSES = ("PART", "SCHEDULE", "EXCLUDED")


def merge_page_breaks(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs cut by a page break joined; the joined one keeps the page of its first part.

    A paragraph joins the one before if that one ends no sentence, this one starts in lower case and is no item or
    subsection, and its page follows the page the joined paragraph has kept. As a page is kept, a third page never joins.
    """
    order = Window.partitionBy("doc_id").orderBy("para_seq")
    fits = ~F.lag("text").over(order).rlike(r"[.;:!?]\z") & F.col("text").rlike(r"^\p{Ll}") & ~F.col("text").rlike(T.ITEM) & ~F.col("text").rlike(T.SUBSECTION)
    step = F.coalesce(F.col("page") - F.lag("page").over(order), F.lit(-1))
    rows = paragraphs.withColumns({"fits": F.coalesce(fits, F.lit(False)), "step": step})
    # whether a paragraph was joined decides about the next one: a step of no page keeps that bit, a step of one flips it
    rows = rows.withColumn("run", F.sum(F.when(F.col("fits") & F.col("step").isin(0, 1), 0).otherwise(1)).over(order))
    run = Window.partitionBy("doc_id", "run").orderBy("para_seq")
    within = F.when(F.row_number().over(run) == 1, 0).otherwise(F.col("step"))
    rows = rows.withColumn("within", within).withColumn("joined", F.sum("within").over(run) % 2 == 1)
    rows = rows.withColumn("part", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_seq", "text"))), lambda x: x["text"]), " ")
    first = F.min(F.struct("para_seq", "page", "block"))
    merged = rows.groupBy("doc_id", "part").agg(first.alias("f"), texts.alias("text"))
    return merged.select("doc_id", "f.para_seq", "f.page", "f.block", "text")


def _carried(value: Column, order, upto: int = 0) -> Column:
    """The last value set at or before a row; values are structs, so that a set null carries as well."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, upto))


def classify(paragraphs: DataFrame) -> DataFrame:
    """Adds kind, section, subsection, part, pending heading and whether the paragraph stands within definitions."""
    order = Window.partitionBy("doc_id").orderBy("para_seq")
    text, kind = F.col("text"), F.col("kind")
    # a definition differs from the other kinds only within definitions, and never changes whether it stands within them
    rows = paragraphs.withColumn("kind", T.paragraph_kind(text, F.lit(False)))
    end = F.max((kind == "EXCLUDED").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).filter("end = 0").drop("end")
    starts = kind.isin(*STARTS)
    rows = rows.withColumn("in_definitions", F.coalesce(_carried(F.when(starts, text.rlike(T.OPENS_DEFINITIONS)), order, -1), F.lit(False)))
    rows = rows.withColumn("kind", T.paragraph_kind(text, F.col("in_definitions")))
    group = lambda p, n: F.regexp_extract(text, p, n)
    none = F.lit(None).cast("string")
    section = F.when(kind == "SECTION_SUB", F.struct(group(T.SECTION_WITH_SUB, 1).alias("v"))).when(kind == "SECTION", F.struct(group(T.SECTION, 1).alias("v"))).when(kind == "SCHEDULE", F.struct(none.alias("v")))
    subsection = (
        F.when(kind == "SECTION_SUB", F.struct(group(T.SECTION_WITH_SUB, 2).alias("v"))).when(kind == "SUBSECTION", F.struct(group(T.SUBSECTION, 1).alias("v")))
        .when(kind.isin("SECTION", "SCHEDULE"), F.struct(none.alias("v")))
    )
    part = F.when(kind == "PART", F.struct(group(T.PART, 1).alias("v"))).when(kind == "SCHEDULE", F.struct(F.lit(T.SCHEDULE).alias("v")))
    heading = F.when(kind == "HEADING", F.struct(text.alias("v"))).when(kind.isin(*STARTS, "PART", "SCHEDULE"), F.struct(none.alias("v")))
    rows = rows.withColumns({
        "section": _carried(section, order)["v"], "subsection": _carried(subsection, order)["v"], "part": _carried(part, order)["v"],
        "pending": _carried(heading, order, -1)["v"],
    })
    defined = F.when(kind == "DEFINITION", T.stripped(group(T.DEFINITION, 1)))
    return rows.withColumn("heading", F.when(kind.isin(*STARTS), F.col("pending")).otherwise(defined)).drop("pending")


def split_items(text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Array of pieces: a text over ``limit`` is cut before its lettered items, packed up to the limit; each piece repeats the stem."""
    mark = F.regexp_replace(text, rf"(?U)({T.ITEM_MARKER})", "\u0001$1")
    parts = F.split(mark, "\u0001")
    stem = T.stripped(F.element_at(parts, 1))
    items = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(2))), T.stripped), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.length(stem).alias("n"))

    def pack(acc: Column, item: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["n"] + F.length(item) > limit)
        piece = F.concat_ws(" ", F.array(stem), acc["open"])
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(piece))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(item)).otherwise(F.concat(acc["open"], F.array(item))).alias("open"),
            F.when(full, F.length(stem) + F.length(item)).otherwise(acc["n"] + F.length(item)).alias("n"),
        )

    pieces = F.aggregate(items, start, pack, lambda acc: F.concat(acc["done"], F.array(F.concat_ws(" ", F.array(stem), acc["open"]))))
    return F.when((F.length(text) <= limit) | (F.size(items) == 0), F.array(text)).otherwise(pieces)


def chunk_paragraphs(paragraphs: DataFrame, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk_seq, text, section, subsection, heading, part, pages, citation) of paragraphs with page breaks merged."""
    order = Window.partitionBy("doc_id").orderBy("para_seq")
    rows = classify(merge_page_breaks(paragraphs))
    opens, closes = F.col("kind").isin(*STARTS, "DEFINITION"), F.col("kind").isin(*CLOSES)
    rows = rows.withColumn("boundary", F.sum(F.when(opens | closes, 1).otherwise(0)).over(order))
    rows = rows.withColumn("open", _carried(F.when(opens, F.lit(True)).when(closes, F.lit(False)), order))
    body = rows.filter(F.col("open") & (opens | (F.col("kind") == "BODY")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_seq", "text"))), lambda x: x["text"]), " ")
    first = F.min_by(F.struct("section", "subsection", "heading", "part"), "para_seq")
    chunks = body.groupBy("doc_id", "boundary").agg(first.alias("m"), T.stripped(texts).alias("whole"), F.sort_array(F.collect_set("page")).alias("pages"))
    pieces = chunks.select("doc_id", "boundary", "m.*", "pages", F.posexplode(split_items(F.col("whole"), limit)).alias("piece_no", "piece"))
    heading = F.coalesce("heading", F.lit(""))
    text = F.when((heading != "") & ~F.startswith("piece", heading), F.concat(heading, F.lit("\n"), F.col("piece"))).otherwise(F.col("piece"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("boundary", "piece_no")) - 1
    label = T.citation(F.col("section"), F.col("subsection"), F.col("part"))
    return pieces.select("doc_id", number.cast("long").alias("chunk_seq"), text.alias("text"), "section", "subsection", "heading", "part", "pages", label.alias("citation"))
