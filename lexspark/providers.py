"""Boundaries to models: embedders and generators are injected; deterministic local ones stand in for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import TOKEN, tokenize

BATCH = 100


def hashing_embedder(dimensions: int = 128) -> Callable[[list[str]], np.ndarray]:
    """Sums of token hashes: the same text has the same vector, texts that share words are near."""
    import re

    token = re.compile(TOKEN)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in token.findall((t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def counting_embedder(text: Column, dimensions: int = 64) -> Column:
    """Counts of tokens by first letter, last letter and length: a stand-in that needs no Python and that SQL can express."""
    place = lambda t: F.pmod(F.ascii(t) * 31 + F.ascii(F.right(t, F.lit(1))) * 7 + F.length(t), F.lit(dimensions))
    places = F.transform(tokenize(text), place)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return F.aggregate(places, zeros, lambda counts, p: F.transform(counts, lambda n, i: F.when(i == p, n + F.lit(1.0).cast("float")).otherwise(n)))


def embed_column(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = BATCH, name: str = "embedding") -> DataFrame:
    """Adds the vectors of ``text``; ``embed`` sees at most ``batch`` texts a call, and vectors stay with their rows."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            parts = [embed(s.iloc[i : i + batch].tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([v.tolist() for p in parts for v in p], index=s.index)

    return rows.withColumn(name, vectors(F.col(text)))


SYSTEM_PROMPT = (
    "Answer questions about a statute only from the excerpts given. Name the provision behind every statement by its label, "
    "such as s. 122(1). Say so if the excerpts hold no answer. What you write is information, not legal advice."
)


def prompts(contexts: DataFrame, questions: DataFrame, query_key: str) -> DataFrame:
    """(query_key, prompt) for an injected generator."""
    text = F.concat(F.lit(SYSTEM_PROMPT + "\n\nExcerpts:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(contexts, query_key).select(query_key, text.alias("prompt"))
