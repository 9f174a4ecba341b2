"""Reading and writing: parsed files, evaluation sets, the chunk index and the cache of query vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "citation STRING, term STRING"
EVAL_SCHEMA = f"cases ARRAY<STRUCT<question: STRING, category: STRING, expected: ARRAY<STRUCT<citation: STRING, term: STRING, any_of: ARRAY<STRUCT<{TARGET.replace(' STRING', ': STRING')}>>>>>>"
NEGATIVE_SCHEMA = "cases ARRAY<STRUCT<question: STRING, difficulty: STRING, why: STRING>>"
LINE_SCHEMA = "path string, seq long, page int, block int, x0 double, y0 double, x1 double, text string, page_width double, page_height double"


def read_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(doc_id, path, …) of the positioned lines of binary files.

    ``parser`` gives (page, block, x0, y0, x1, text), or those with (page_width, page_height), of one file's bytes in order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, i, *line[:5], line[5].strip(), *(line[6:8] or (None, None))) for i, line in enumerate(parser(bytes(content))) if line[5].strip()]
                yield pd.DataFrame(rows, columns=["path", "seq", "page", "block", "x0", "y0", "x1", "text", "page_width", "page_height"])

    return files.mapInPandas(parse, LINE_SCHEMA).withColumn("doc_id", F.xxhash64("path"))


def page_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, page_width, page_height) of parsed lines, as layout and cleanup want them."""
    return lines.groupBy("doc_id").agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, question, category, expected) of a JSON evaluation set; the id is the position in the file."""
    cases = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)
    return cases.select(F.posexplode("cases").alias("case_id", "c")).select(F.col("case_id").cast("long"), "c.*")


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    cases = spark.read.schema(NEGATIVE_SCHEMA).option("multiLine", True).json(path)
    return cases.select(F.posexplode("cases").alias("case_id", "c")).select(F.col("case_id").cast("long"), "c.*")


def fingerprint(chunks: DataFrame, model: str, keys: list[str], values: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row (fingerprint): changes with the model and with any key or value of any row, or their number.

    The hash of a row holds its place (the keys), so that sums of row hashes tell orders apart and need no gathering.
    """
    row = F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in (*keys, *values))), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = chunks.select(row.alias("h")).agg(F.count("*").alias("n"), F.coalesce(part(1), F.lit("0")).alias("a"), F.coalesce(part(13), F.lit("0")).alias("b"))
    return sums.select(F.sha2(F.concat_ws("|", F.lit(model), F.col("n").cast("string"), "a", "b"), 256).alias("fingerprint"))


def save_index(chunks: DataFrame, path: str, model: str, keys: list[str]) -> str:
    """Write chunks (with their vectors) under their fingerprint; an index of other content is another folder."""
    mark = fingerprint(chunks, model, keys).first()["fingerprint"]
    chunks.write.mode("overwrite").parquet(f"{path}/{mark}")
    return mark


def load_index(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """The index with that fingerprint, or None if there is none."""
    where = f"{path}/{mark}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(where)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(where) if there else None


def missing_questions(questions: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The questions without a vector of the model; repeated questions stay repeated."""
    mine = cache.filter((F.col("model") == model) & F.col("embedding").isNotNull()).select("question").distinct()
    return questions.join(mine, "question", "left_anti")


def cached_vectors(questions: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(…, embedding) of all questions; raises KeyError if any has none."""
    if example := missing_questions(questions, cache, model).select("question").first():
        raise KeyError(f"no vector of {model} for {example[0]!r}")
    mine = cache.filter(F.col("model") == model).groupBy("question").agg(F.max("embedding").alias("embedding"))
    return questions.join(mine, "question")


def warm_query_cache(questions: DataFrame, cache: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame], path: str) -> str | None:
    """Embed the missing questions and write their vectors to a new part below ``path``, beside the others; returns the part.

    Nothing is embedded or written where none is missing; the result is then None. ``query_cache`` reads all parts.
    """
    missing = missing_questions(questions.select("question").distinct(), cache, model)
    if missing.isEmpty():
        return None
    where = f"{path}/part={uuid.uuid4().hex}"
    embed(missing).select(F.lit(model).alias("model"), "question", "embedding").write.parquet(where)
    return where


def query_cache(spark: SparkSession, path: str) -> DataFrame:
    """(model, question, embedding) of all parts below ``path``."""
    return spark.read.option("basePath", path).parquet(f"{path}/part=*").select("model", "question", "embedding")


def embedded_index(chunks: DataFrame, path: str, model: str, keys: list[str], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunks with their vectors: read where an index of this content is held, else embedded and saved."""
    mark = fingerprint(chunks, model, keys).first()["fingerprint"]
    held = load_index(chunks.sparkSession, path, mark)
    if held is None:
        embed(chunks).write.mode("overwrite").parquet(f"{path}/{mark}")
        held = load_index(chunks.sparkSession, path, mark)
    return held
