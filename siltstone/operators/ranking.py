"""Ranking of content and sites: one per domain, the first of a group, chains of filters and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.functions.urls import domain


def best_per_domain(df: DataFrame, url: str, score: str, key: str) -> DataFrame:
    """Of each domain's rows the highest score, the first key on ties: by an aggregate, for hot domains."""
    order = F.struct((-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("s"), F.col(key).alias("k"))
    best = df.groupBy(domain(F.col(url)).alias("__d")).agg(F.min_by(F.struct(*df.columns), order).alias("r"))
    return best.select("r.*")


def top_per_group(df: DataFrame, group: str, scores_: Sequence[str], key: str, n: int) -> DataFrame:
    """Adds `place`, and keeps the first n of each group."""
    order = [*[F.desc_nulls_last(s) for s in scores_], F.col(key)]
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def limited(df: DataFrame, group: str, order: list[Column], n: int = 50) -> DataFrame:
    """The first n rows of each group, with the number there were and whether rows were left out.

    Counts are an aggregate of their own, so that only the first n of a group need meet in one task.
    """
    counts = df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("original_count"))
    first = df.withColumn("__p", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__p") <= n)
    out = first.join(counts, F.col(group).eqNullSafe(F.col("__group"))).drop("__group", "__p")
    return out.withColumn("limited", F.col("original_count") > n)


def final_ranking(df: DataFrame, key: str, quality: str, relevance: str, least: float) -> DataFrame:
    """Rows of `least` quality, by quality and three tenths of relevance."""
    score = F.least(F.lit(1.0), F.col(quality) + F.lit(0.3) * F.coalesce(F.col(relevance), F.lit(0.0)))
    return df.where(F.col(quality) >= least).withColumn("rank_score", score).orderBy(F.desc("rank_score"), F.desc(quality), key)


def by_combined(content: DataFrame, category: str, key: str = "_id") -> DataFrame:
    """Rows by their combined score."""
    score = scores.combined(F.col("content_quality_score"), F.col("relevance_score"), F.col("content_type"), F.lit(category))
    return content.withColumn("combined_score", score).orderBy(F.desc("combined_score"), key)


def all_results(*methods: DataFrame) -> DataFrame:
    """O3: results of several ways of discovery in one table; columns that some lack are null."""
    out = methods[0]
    for df in methods[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def post_scrape(content: DataFrame, category: str, key: str = "_id") -> DataFrame:
    """Irrelevant rows go, one row per domain stays, ranked by its combined score, and the final filter."""
    title = F.col("title") if "title" in content.columns else F.lit(None).cast("string")
    description = F.col("description") if "description" in content.columns else F.lit(None).cast("string")
    out = content.where(~scores.irrelevant(F.col("url"), title, description, F.col("content"), F.lit(category)))
    out = best_per_domain(out, "url", "content_quality_score", key)
    out = by_combined(out, category, key)
    out = out.where(scores.passes_final_filter(F.col("content_size_bytes"), F.col("content_quality_score"), F.col("relevance_score")))
    return out.orderBy(F.desc("combined_score"), key)


def discovery(sites: DataFrame, category: str, key: str = "page_id", least: float = 0.3, most: int = 20) -> DataFrame:
    """One site per domain, ranked, from a least score on."""
    best = best_per_domain(sites, "url", "relevance_score", key)
    ranked = best.withColumn("rank_score", scores.site_rank(F.col("relevance_score"), F.col("category") == category, F.col("confidence")))
    return ranked.where(F.col("rank_score") >= least).orderBy(F.desc("rank_score"), key).limit(most)


def candidate_domains(queries: DataFrame, category: str = "category") -> DataFrame:
    """The known domains of each query's category; the list of domains is a constant."""
    known = F.create_map(*[x for k, v in scores.DOMAINS.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    return queries.withColumn("domain", F.explode(F.try_element_at(known, F.col(category))))
