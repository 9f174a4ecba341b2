"""From lines to clean paragraphs: hyphen vocabulary, running headers, front matter, joined lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import stripped

REPEAT_SHARE, MAX_BLOCK_GAP, MARGIN_BAND, MAX_MARGIN_LINES = 0.30, 20.0, 0.15, 8
TOC_NUMBER_SHARE, TOC_SEARCH_FRACTION = 0.15, 0.20
COMPOUND = r"\b([a-z]+-[a-z]+)\b"
NUMBER_ONLY = r"(?U)^\d+(\.\d+)?$"
NO_PAGE_SIZE, INTO_BODY, NOTHING_LEFT = "no page size", "margin block runs into the body", "nothing left"


def hyphen_vocabulary(lines: DataFrame) -> DataFrame:
    """(doc_id, term): the distinct hyphen compounds of each document."""
    return lines.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(COMPOUND), F.lit(1))).alias("term")).distinct()


def repeated_texts(lines: DataFrame, share: float = REPEAT_SHARE) -> DataFrame:
    """(doc_id, text, n_pages, doc_pages): texts on at least ``share`` of the pages of their document."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("doc_pages"))
    texts = lines.select("doc_id", "text", "page").distinct().groupBy("doc_id", "text").agg(F.count("*").alias("n_pages"))
    return texts.join(pages, "doc_id").filter(F.col("n_pages") >= share * F.col("doc_pages"))


def mark_headers(lines: DataFrame, pages: DataFrame, share: float = REPEAT_SHARE, gap: float = MAX_BLOCK_GAP, band: float = MARGIN_BAND) -> DataFrame:
    """Adds ``is_header``: a repeated text in the margin band and every line that stands within ``gap`` of the run it is in.

    Growing a block from a seed line in both directions is the same as taking the whole island of lines without a larger
    gap that holds a seed. ``is_header`` is null in documents without a page height, where no margin is known.
    """
    height = pages.select("doc_id", "page_height").filter("page_height > 0")
    repeated = repeated_texts(lines, share).select("doc_id", "text", F.lit(True).alias("repeated"))
    # all windows and groups from here on are within a document: one shuffle serves them all
    rows = lines.join(height, "doc_id", "left").join(repeated, ["doc_id", "text"], "left").repartition("doc_id")
    margin = (F.col("y0") < band * F.col("page_height")) | (F.col("y0") > (1 - band) * F.col("page_height"))
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "seq")
    starts = F.when(F.col("y0") - F.lag("y0").over(order) > gap, 1).otherwise(0)
    rows = rows.withColumns({"seed": F.coalesce(F.col("repeated"), F.lit(False)) & margin, "starts": starts})
    rows = rows.withColumn("island", F.sum("starts").over(order))
    seeded = F.max(F.col("seed").cast("int")).over(Window.partitionBy("doc_id", "page", "island"))
    is_header = F.when(F.col("page_height").isNotNull(), F.coalesce(seeded, F.lit(0)) == 1)
    return rows.withColumn("is_header", is_header).select(*lines.columns, "is_header")


def header_status(marked: DataFrame, most: int = MAX_MARGIN_LINES) -> DataFrame:
    """Adds ``status``: a page that would lose more than ``most`` lines marks its document, as does a missing page size."""
    per_page = F.sum(F.col("is_header").cast("int")).over(Window.partitionBy("doc_id", "page"))
    lost = F.max("dropped").over(Window.partitionBy("doc_id"))
    status = F.when(F.col("is_header").isNull(), NO_PAGE_SIZE).when(lost > most, INTO_BODY).otherwise("ok")
    return marked.withColumn("dropped", per_page).withColumn("status", status).drop("dropped")


def strip_headers(marked: DataFrame, most: int = MAX_MARGIN_LINES) -> DataFrame:
    """The lines with ``status``; headers are removed only from documents whose status is ok, the others keep every line."""
    return header_status(marked, most).filter("status <> 'ok' OR NOT is_header").drop("is_header")


def front_matter(lines: DataFrame, number_share: float = TOC_NUMBER_SHARE, fraction: float = TOC_SEARCH_FRACTION) -> DataFrame:
    """(doc_id, last_page): the last page of the table of contents; it and all pages before it are front matter."""
    per_page = lines.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if(stripped(F.col("text")).rlike(NUMBER_ONLY)).alias("numbers"))
    document = Window.partitionBy("doc_id")
    limit = F.min("page").over(document) + F.greatest(F.lit(1), (fraction * F.count("*").over(document)).cast("int"))
    contents = per_page.withColumn("limit", limit).filter((F.col("page") < F.col("limit")) & (F.col("numbers") >= number_share * F.col("n")))
    return contents.groupBy("doc_id").agg(F.max("page").alias("last_page"))


def joined_lines(texts: str, vocabulary: str) -> Column:
    """The lines of column ``texts`` joined into one text: a word cut by a hyphen loses it, unless the vocabulary has the compound."""
    t = r"regexp_replace(coalesce(x, ''), r'(?U)^\s+|\s+$', '')"
    compound = rf"lower(concat(regexp_extract(acc, r'(\S*)\z', 1), element_at(split({t}, ' '), 1)))"
    return F.expr(
        f"aggregate({texts}, '', (acc, x) -> CASE WHEN {t} = '' THEN acc WHEN acc = '' THEN {t} "
        rf"WHEN endswith(acc, '-') AND {t} rlike r'^\p{{Ll}}' THEN CASE WHEN array_contains({vocabulary}, {compound}) "
        f"THEN concat(acc, {t}) ELSE concat(substring(acc, 1, length(acc) - 1), {t}) END ELSE concat(acc, ' ', {t}) END)"
    )


def to_paragraphs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, para_seq, page, block, text, status) of the lines of one column: headers and front matter dropped, blocks joined.

    ``lines`` has (doc_id, seq, page, block, x0, y0, text). A document without a page size, whose headers run into the body
    or of which nothing would be left keeps all its lines, and its ``status`` says why; nothing is dropped silently.
    """
    judged = header_status(mark_headers(lines, pages))
    contents = front_matter(judged.filter("status = 'ok' AND NOT is_header"))
    falls = (F.col("status") == "ok") & (F.col("is_header") | F.coalesce(F.col("page") <= F.col("last_page"), F.lit(False)))
    rows = judged.join(contents, "doc_id", "left").withColumn("falls", falls)
    rows = rows.withColumn("status", F.when(F.bool_and("falls").over(Window.partitionBy("doc_id")), NOTHING_LEFT).otherwise(F.col("status")))
    body = rows.filter((F.col("status") != "ok") | ~F.col("falls"))
    vocabulary = hyphen_vocabulary(lines).groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("vocabulary"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "seq", "text"))), lambda x: x["text"])
    blocks = body.groupBy("doc_id", "page", "block", "status").agg(ordered.alias("texts")).join(vocabulary, "doc_id", "left")
    none = F.array().cast("array<string>")
    joined = joined_lines("texts", "vocabulary").alias("text")
    blocks = blocks.withColumn("vocabulary", F.coalesce("vocabulary", none)).select("doc_id", "page", "block", joined, "status").filter("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1
    return blocks.withColumn("para_seq", number.cast("long")).select("doc_id", "para_seq", "page", "block", "text", "status")
