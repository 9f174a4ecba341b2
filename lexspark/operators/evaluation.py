"""Retrieval quality: ranks of expectations, hit and coverage at k, reciprocal rank, by category and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

K_VALUES = (1, 3, 5)


def expectation_ranks(expected: DataFrame, retrieved: DataFrame, case_key: str = "case_id") -> DataFrame:
    """(case_key, exp_no, rank): the earliest rank at which any target of an expectation was retrieved, or null.

    ``expected`` has a row per target (case_key, exp_no, citation, term); ``retrieved`` has (case_key, rk, citation, heading).
    A target with a term wants a chunk under that heading.
    """
    r = retrieved.select(F.col(case_key).alias("r_case"), "rk", F.col("citation").alias("r_citation"), F.col("heading").alias("r_heading"))
    match = (F.col(case_key) == F.col("r_case")) & (F.col("citation") == F.col("r_citation")) & (F.col("term").isNull() | F.col("r_heading").eqNullSafe(F.col("term")))
    return expected.join(r, match, "left").groupBy(case_key, "exp_no").agg(F.min("rk").alias("rank"))


def case_metrics(cases: DataFrame, ranks: DataFrame, k_values: tuple[int, ...] = K_VALUES, case_key: str = "case_id") -> DataFrame:
    """Adds first_rank, hit@k, coverage@k and reciprocal rank to every case; a case without expectations scores 0."""
    found = ranks.groupBy(case_key).agg(F.min("rank").alias("first_rank"), *(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"coverage{k}") for k in k_values))
    rows = cases.join(found, case_key, "left")
    hits = {f"hit{k}": F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0) for k in k_values}
    cover = {f"coverage{k}": F.coalesce(f"coverage{k}", F.lit(0.0)) for k in k_values}
    return rows.withColumns(hits | cover | {"rr": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))})


def summarise(metrics: DataFrame, k_values: tuple[int, ...] = K_VALUES, category: str = "category", decimals: int = 9) -> DataFrame:
    """Means over cases, per category and overall (``is_total`` = 1)."""
    means = [F.round(F.avg(f"{m}{k}"), decimals).alias(f"{m}{k}") for m in ("hit", "coverage") for k in k_values]
    rolled = metrics.rollup(category).agg(F.grouping(category).cast("int").alias("is_total"), F.count("*").alias("n"), *means, F.round(F.avg("rr"), decimals).alias("mrr"))
    return rolled.filter("n > 0")


def misses(metrics: DataFrame, retrieved: DataFrame, k: int = max(K_VALUES), shown: int = 3, case_key: str = "case_id") -> DataFrame:
    """The cases that hit nothing in the first ``k``, with what they got instead: (case_key, rk, citation, label)."""
    label = F.coalesce(F.nullif("heading", F.lit("")), F.substring("text", 1, 40))
    got = retrieved.filter(F.col("rk") <= shown).select(case_key, "rk", "citation", label.alias("label"))
    return metrics.filter(F.col(f"hit{k}") == 0).select(case_key).join(got, case_key, "left")


def support_distribution(scores: DataFrame, group: str = "grp", score: str = "support") -> DataFrame:
    """(group, n, min_s, upper_median_s, max_s); the upper median is an order statistic, no interpolation."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(score))
    n = F.count("*").over(Window.partitionBy(group))
    rows = scores.select(group, score, place.alias("place"), n.alias("n"))
    middle = F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col(score)))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(score).alias("min_s"), middle.alias("upper_median_s"), F.max(score).alias("max_s"))


def separation(distribution: DataFrame, answerable: str, negative: str, group: str = "grp") -> DataFrame:
    """One row (gap): the least support of the answerable group less the greatest of the other."""
    return distribution.agg((F.min(F.when(F.col(group) == answerable, F.col("min_s"))) - F.max(F.when(F.col(group) == negative, F.col("max_s")))).alias("gap"))


def report(summary: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> str:
    """The summary as fixed-width text; one row per category comes to the driver."""
    head = f"{'category':<16}{'n':>6}" + "".join(f"{f'hit@{k}':>9}" for k in k_values) + f"{'MRR':>8}"
    rows = summary.orderBy("is_total", summary.columns[0]).collect()
    body = [f"{'OVERALL' if r['is_total'] else str(r[0]):<16}{r['n']:>6}" + "".join(f"{r[f'hit{k}']:>9.2f}" for k in k_values) + f"{r['mrr']:>8.2f}" for r in rows]
    return "\n".join([head, "-" * len(head), *body])


def flatten_expectations(cases: DataFrame, case_key: str = "case_id") -> DataFrame:
    """(case_key, exp_no, target_no, citation, term) of cases whose ``expected`` is an array of targets or of ``any_of`` alternatives."""
    rows = cases.select(case_key, F.posexplode("expected").alias("exp_no", "e"))
    single = F.array(F.struct(F.col("e.citation").alias("citation"), F.col("e.term").alias("term")))
    return rows.select(case_key, "exp_no", F.posexplode(F.coalesce("e.any_of", single)).alias("target_no", "t")).select(case_key, "exp_no", "target_no", "t.citation", "t.term")


def shared_values(one: DataFrame, other: DataFrame, column: str = "question") -> DataFrame:
    """(column): the values in both sets, each once; answerable questions and negatives should share none."""
    return one.select(column).intersect(other.select(column))


def describe_expectations(flat: DataFrame, case_key: str = "case_id") -> DataFrame:
    """(case_key, exp_no, wanted): the alternatives of every expectation joined by ``or``."""
    target = F.struct("target_no", T.target_label(F.col("citation"), F.col("term")).alias("label"))
    labels = F.transform(F.sort_array(F.collect_list(target)), lambda x: x["label"])
    return flat.groupBy(case_key, "exp_no").agg(F.array_join(labels, " or ").alias("wanted"))


def miss_report(metrics: DataFrame, retrieved: DataFrame, flat: DataFrame, k: int = max(K_VALUES), case_key: str = "case_id") -> DataFrame:
    """The misses with what was wanted: (case_key, wanted, rk, citation, label); expectations in their order, joined by ``; ``."""
    wanted = F.transform(F.sort_array(F.collect_list(F.struct("exp_no", "wanted"))), lambda x: x["wanted"])
    by_case = describe_expectations(flat, case_key).groupBy(case_key).agg(F.array_join(wanted, "; ").alias("wanted"))
    return misses(metrics, retrieved, k, case_key=case_key).join(by_case, case_key, "left").select(case_key, "wanted", "rk", "citation", "label")
