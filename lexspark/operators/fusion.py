"""Rank fusion, structured lookup by citation, and the hybrid retriever over many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

RRF_K, CANDIDATE_DEPTH = 60, 100


def reciprocal_rank_fusion(rankings: DataFrame, query_key: str, key: str, k: int = RRF_K, decimals: int = 12) -> DataFrame:
    """(query_key, key, rrf, rk) of (query_key, ranking_no, rank, key): every appearance adds 1 / (k + rank).

    Equal scores go by first appearance: the lower ranking, then the lower rank.
    """
    fused = rankings.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), decimals).alias("rrf"), F.min(F.struct("ranking_no", "rank")).alias("first"))
    order = Window.partitionBy(query_key).orderBy(F.desc("rrf"), "first", key)
    return fused.withColumn("rk", F.row_number().over(order)).drop("first")


def parse_citation_queries(questions: DataFrame, query_key: str, question: str = "question") -> DataFrame:
    """(query_key, section, subsection) of the questions that name a provision."""
    q = F.col(question)
    return questions.select(query_key, T.queried_section(q).alias("section"), T.queried_subsection(q).alias("subsection")).filter("section is not null")


def structured_lookup(parsed: DataFrame, chunks: DataFrame, query_key: str, keys: list[str], k: int | None = None) -> DataFrame:
    """(query_key, keys, rk): the chunks of the section a question names, the named subsection first, no schedule items.

    A chunk without part is no schedule item, hence the null-safe comparison. With ``k`` only the first k come out, and a
    section brings no more than its k first chunks and the k first of the named subsection to a question.
    """
    held = chunks.filter(~F.col("part").eqNullSafe(T.SCHEDULE)).select("section", "subsection", *keys)
    asked = parsed.withColumnRenamed("subsection", "named")
    hits = asked.join(held, "section") if k is None else _first_of_sections(asked, held, query_key, keys, k)
    mine = F.when(F.col("named").isNull() | F.col("subsection").eqNullSafe(F.col("named")), 0).otherwise(1)
    order = Window.partitionBy(query_key).orderBy(mine, T.subsection_order(F.col("subsection")), *keys)
    ranked = hits.select(query_key, *keys, F.row_number().over(order).alias("rk"))
    return ranked if k is None else ranked.filter(F.col("rk") <= k)


def _first_of_sections(asked: DataFrame, held: DataFrame, query_key: str, keys: list[str], k: int) -> DataFrame:
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(T.subsection_order(F.col("subsection")), *keys))
    general = held.withColumn("place", first("section")).filter(F.col("place") <= k).drop("place")
    exact = held.withColumn("place", first("section", "subsection")).filter(F.col("place") <= k).drop("place")
    same = [F.col("a.section") == F.col("e.section"), F.col("a.named") == F.col("e.subsection")]
    named = asked.alias("a").join(exact.alias("e"), same).select("a.*", "e.subsection", *(F.col(f"e.{x}") for x in keys))
    columns = [query_key, "section", "named", "subsection", *keys]
    return asked.join(general, "section").select(columns).unionByName(named.select(columns)).distinct()


def hybrid(structured: DataFrame, fused: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """The structured hits, then the fused ranking, each chunk value once: (query_key, key, source, rk) of the first ``k``."""
    both = structured.select(query_key, key, F.lit(0).alias("src"), F.col("rk").alias("place")).unionByName(fused.select(query_key, key, F.lit(1).alias("src"), F.col("rk").alias("place")))
    first = both.groupBy(query_key, key).agg(F.min(F.struct("src", "place")).alias("f"))
    ranked = first.withColumn("rk", F.row_number().over(Window.partitionBy(query_key).orderBy("f", key))).filter(F.col("rk") <= k)
    return ranked.select(query_key, key, F.when(F.col("f.src") == 0, "structured").otherwise("fusion").alias("source"), "rk")
