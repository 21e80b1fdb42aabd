"""Matching items to profiles: reasons, constraints, retrieval, fusion, history, assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import clamped, cosine
from .ranking import top_of_each

SATISFIED, NOT_SATISFIED, UNKNOWN = "SATISFIED", "NOT_SATISFIED", "UNKNOWN"
#: Profiles that are scored in one pass over the items.
MOST_PROFILES = 10_000


@dataclass(frozen=True)
class Fusion:
    keyword: float = 0.5
    semantic: float = 0.5
    least: float = 0.0
    most: int = 50

    def __post_init__(self) -> None:
        if abs(self.keyword + self.semantic - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that excludes the row, null if none does; null rules don't."""
    out = None
    for code, excludes in rules:
        hit = F.coalesce(excludes, F.lit(False))
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out


def tri_state(known: Column, holds: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), UNKNOWN).when(holds, SATISFIED).otherwise(NOT_SATISFIED)


def overridden(matched: Column, checks: Column) -> Column:
    """matched, unless a check of the map isn't satisfied."""
    return matched & F.forall(F.map_values(checks), lambda c: c != NOT_SATISFIED)


def nearest(items: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """id and score of the k items with the largest cosine; exact, in one pass."""
    q = F.array(*map(F.lit, query))
    scored = items.where(F.col(vector).isNotNull()).select(id_col, clamped(cosine(F.col(vector), q)).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def fused(keyword: DataFrame, semantic: DataFrame, id_col: str, f: Fusion = Fusion()) -> DataFrame:
    """Both lists of hits (id, score) as one, best first; a missing score counts 0."""
    k = keyword.select(id_col, F.col("score").alias("keyword_score"))
    s = semantic.select(id_col, F.col("score").alias("semantic_score"))
    both = k.join(s, id_col, "full_outer").fillna(0.0, ["keyword_score", "semantic_score"])
    score = F.col("keyword_score") * f.keyword + F.col("semantic_score") * f.semantic
    kept = both.withColumn("score", score).where(F.col("score") >= f.least)
    return kept.orderBy(F.col("score").desc(), id_col).limit(f.most)


def without_history(candidates: DataFrame, history: DataFrame, on: str) -> DataFrame:
    """Candidates that were never recommended; deleted recommendations count as well."""
    return candidates.join(history.select(on).distinct(), on, "left_anti")


def nearest_per_profile(profiles: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k nearest items (id, vec) of each profile (profile, query), scored blockwise.

    Profiles are a stated set of queries, sent to every task; more than MOST_PROFILES of them are
    refused: give them in parts. Spark keeps k rows a profile in each partition before it shuffles.
    """
    if profiles.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"at most {MOST_PROFILES} profiles at a time")
    pairs = items.join(F.broadcast(profiles))
    scored = pairs.select("profile", "id", clamped(cosine(F.col("vec"), F.col("query"))).alias("score"))
    return top_of_each(scored, ["profile"], [F.col("score").desc(), F.col("id")], k)


def key_set_errors(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that aren't in both sets exactly once: key, problem (missing, unknown, duplicate)."""
    e = expected.select(key).distinct().withColumn("want", F.lit(1))
    g = given.groupBy(key).agg(F.count("*").alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return e.join(g, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def assembled(candidates: DataFrame, assessments: DataFrame, items: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The `most` best matched candidates with their assessment and current facts, numbered from 1 by score.

    Only those are numbered, after Spark has kept the best of each partition.
    """
    matched = candidates.join(assessments.where("matched"), key)
    best = matched.orderBy(F.col("score").desc(), key).limit(most)
    numbered = best.withColumn("position", F.row_number().over(W.orderBy(F.col("score").desc(), key)))
    return numbered.join(items, key)
