"""The whole way: lines to an index, questions to audited answers, cases to a summary. Many questions are one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark import providers
from lexspark.functions import text as T
from lexspark.operators import bm25, chunking, cleanup, evaluation, fusion, grounding, layout, vector
from lexspark.session import written
from lexspark.sources import tables


def column_paragraphs(lines: DataFrame, pages: DataFrame, side: str = "left") -> tuple[DataFrame, DataFrame]:
    """Paragraphs of one column of two-column documents, and (doc_id, status) of every document of ``lines``."""
    found = written(layout.detect_layout(lines, pages), "layout")
    sided = layout.assign_columns(lines, found).filter(F.col("side") == side)
    paragraphs = written(cleanup.to_paragraphs(sided, pages), "column-paragraphs")
    own = paragraphs.groupBy("doc_id").agg(F.first("status").alias("own"))
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce("own", F.lit(cleanup.NOTHING_LEFT)))
    return paragraphs.drop("status"), found.join(own, "doc_id", "left").select("doc_id", status.alias("status"))


def with_status(rows: DataFrame, status: DataFrame) -> DataFrame:
    """``rows`` with the status of their documents; a document without rows has one of nulls, so that none is lost silently."""
    marked = status.join(rows.withColumn("has_row", F.lit(True)), "doc_id", "left")
    lost = F.col("has_row").isNull() & (F.col("status") == "ok")
    return marked.select(*rows.columns, F.when(lost, cleanup.NOTHING_LEFT).otherwise(F.col("status")).alias("status"))


def build_chunks(lines: DataFrame, pages: DataFrame, side: str = "left") -> DataFrame:
    """Citable chunks of one column of two-column documents, with ``status``; the row of a document without chunks has none."""
    paragraphs, status = column_paragraphs(lines, pages, side)
    return with_status(chunking.chunk_paragraphs(paragraphs), status)


def with_text(chunks: DataFrame) -> DataFrame:
    """Chunks with their value key, citation and the text that the keyword index sees; equal chunks are one."""
    chunks = chunks.filter("chunk_seq IS NOT NULL") if "status" in chunks.columns else chunks  # rows that only hold a status
    c = [F.col(x) for x in ("section", "subsection", "part")]
    values = ["text", "section", "subsection", "heading", "part", "pages"]
    rows = chunks.withColumn("chunk_key", T.value_key(*values)).dropDuplicates(["chunk_key"])
    return rows.withColumns({"citation": T.citation(*c), "indexed": T.indexed_text(*c, F.col("heading"), F.col("text"))})


def retrieve(questions: DataFrame, keyed: DataFrame, semantic: DataFrame | None, query_key: str, k: int = 5, depth: int = fusion.CANDIDATE_DEPTH, structured: bool = True) -> DataFrame:
    """Hybrid retrieval of ``with_text`` chunks: (query_key, chunk_key, source, rk).

    ``semantic`` is a ranking (query_key, chunk_key, rank) of the injected vector retriever, or None.
    """
    found = bm25.search_texts(questions, keyed, query_key, ["chunk_key"], depth, text="indexed")
    ranking = found.select(query_key, F.lit(1).alias("ranking_no"), F.col("rk").alias("rank"), "chunk_key")
    if semantic is not None:
        near = semantic.filter(F.col("rank") <= depth).select(query_key, F.lit(0).alias("ranking_no"), "rank", "chunk_key")
        ranking = near.unionByName(ranking)
    fused = fusion.reciprocal_rank_fusion(ranking, query_key, "chunk_key")
    parsed = fusion.parse_citation_queries(questions, query_key)
    first = fusion.structured_lookup(parsed if structured else parsed.limit(0), keyed, query_key, ["chunk_key"], k)
    return fusion.hybrid(first, fused, query_key, "chunk_key", k)


def answer(questions: DataFrame, keyed: DataFrame, retrieved: DataFrame, generate: Callable[[DataFrame], DataFrame], query_key: str) -> DataFrame:
    """Contexts, prompts, answers of the injected ``generate`` (query_key, prompt -> query_key, text), and their audit."""
    full = retrieved.join(keyed, "chunk_key")
    answers = generate(providers.prompts(grounding.build_context(full, [query_key]), questions, query_key))
    audited = grounding.audit_citations(grounding.extract_citations(answers, [query_key]), full, [query_key])
    return answers.join(grounding.warnings(grounding.audit_lists(audited, [query_key])), query_key, "left")


def evaluate(cases: DataFrame, expected: DataFrame, retrieved: DataFrame, k_values: tuple[int, ...] = evaluation.K_VALUES) -> DataFrame:
    """Summary of a retriever's (case_id, rk, citation, heading) against the expectations of the cases."""
    return evaluation.summarise(evaluation.case_metrics(cases, evaluation.expectation_ranks(expected, retrieved), k_values), k_values)


def nearest_chunks(questions: DataFrame, keyed: DataFrame, query_key: str, k: int = fusion.CANDIDATE_DEPTH) -> DataFrame:
    """Ranking (query_key, chunk_key, rank) of chunks (chunk_key, embedding) for questions (query_key, embedding)."""
    near = vector.nearest(vector.unit_vectors(questions, query_key, "embedding"), vector.unit_vectors(keyed, "chunk_key", "embedding"), query_key, "chunk_key", k)
    return near.select(query_key, "chunk_key", F.col("rk").alias("rank"))


def cached_nearest_chunks(questions: DataFrame, keyed: DataFrame, cache: DataFrame, model: str, query_key: str, k: int = fusion.CANDIDATE_DEPTH) -> DataFrame:
    """The same with the vectors of the questions from the cache; raises KeyError if any has none."""
    return nearest_chunks(tables.cached_vectors(questions, cache, model), keyed, query_key, k)
