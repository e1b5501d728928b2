"""From scraped content to ranked, processed content: each stage can be switched off."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import scores
from siltstone.functions import text as tx
from siltstone.operators import dedup, ranking
from siltstone.sources.tables import written


@dataclass(frozen=True)
class PipelineConfig:
    """Which stages run, and their limits.

    `insights` and `summary` are scorers that add the column of their name; without one insights are null and the summary
    is what stands for it. Where a scorer fails on a row it leaves its error as text in `insights_error` or `summary_error`.
    """

    duplicates: bool = True
    cleaning: bool = True
    structured: bool = True
    insights: Callable[[DataFrame], DataFrame] | None = None
    summary: Callable[[DataFrame], DataFrame] | None = None
    query: str = "general"
    similar: float = 0.8
    least_quality: float = 0.4

    def __post_init__(self):
        if not 0 < self.similar <= 1 or not 0 <= self.least_quality <= 1:
            raise ValueError("similar and least_quality lie between 0 and 1, and similar is not 0")


#: Stages whose errors a row keeps, in the order in which they run.
SCORED = ("insights", "summary")
#: Errors with these words lose the row, fixed values; others leave a fallback of it.
CRITICAL = ("AI Analysis failed", "timeout")


def processed_rows(content: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """X1 before the gate: best versions, cleaned, with insights, summary, patterns, quality, and their errors.

    A stage that is off leaves a default: no duplicates, the text as it is, no insights, a fallback of the summary, no
    patterns. A row on which a stage failed keeps its first error in `processing_errors`, its text as it is, a fallback
    summary, no insights and patterns, and half its quality; `critical` says that it is lost for the result.
    """
    out, quality = content, F.col("content_quality_score")
    if config.duplicates:
        found = dedup.duplicate_analysis(content, similar=config.similar)
        found = found.where("id = best_id").select(F.col("id").alias("_id"), "group_size", F.col("confidence").alias("duplicate_confidence"))
        out = out.join(found, "_id")
    else:
        out = out.withColumns({"group_size": F.lit(1).cast("long"), "duplicate_confidence": F.lit(0.0)})
    out = out.withColumn("cleaned_content", tx.clean_text(F.coalesce("content", F.lit(""))) if config.cleaning else F.coalesce("content", F.lit("")))
    out = out.withColumns(tx.quality_metrics(F.col("cleaned_content")))
    out = config.insights(out) if config.insights else out.withColumn("insights", F.lit(None).cast("string"))
    fallback = mo.fallback_summary(F.lit(config.query))
    out = config.summary(out) if config.summary else out.withColumn("summary", fallback)
    no_patterns = F.create_map().cast("map<string,array<string>>")
    out = out.withColumn("key_value_pairs", tx.patterns(F.col("cleaned_content")) if config.structured else no_patterns)
    errors = [F.struct(F.lit(s).alias("stage"), F.col(f"{s}_error").alias("error")) for s in SCORED if f"{s}_error" in out.columns]
    error = F.get(F.filter(F.array(*errors), lambda e: e["error"].isNotNull()), F.lit(0)) if errors else F.lit(None).cast("struct<stage:string,error:string>")
    out = out.withColumn("__error", error)
    failed = F.col("__error").isNotNull()
    own = tx.cleaning_quality(F.coalesce(quality, F.lit(0.5)), F.col("readability"), F.col("information_density"), F.col("coherence"))
    none = F.lit(None).cast("double")
    scored = scores.pipeline_quality(F.coalesce(quality, F.lit(0.5)), own, none, none, none, tx.pattern_confidences(F.col("key_value_pairs")))
    said = F.lower("__error.error")
    critical = F.coalesce(F.greatest(*[F.contains(said, F.lit(c.lower())) if c == "timeout" else F.contains("__error.error", F.lit(c)) for c in CRITICAL]), F.lit(False))
    out = out.withColumns({"enhanced_quality_score": F.when(failed, F.coalesce(quality, F.lit(0.0)) * 0.5).otherwise(scored), "critical": critical})
    out = out.withColumns({
        "processing_errors": F.array_compact(F.array("__error")), "cleaned_content": F.when(failed, F.coalesce("content", F.lit(""))).otherwise(F.col("cleaned_content")),
        "summary": F.when(failed | F.col("summary").isNull(), fallback).otherwise(F.col("summary")), "insights": F.when(~failed, F.col("insights")), "key_value_pairs": F.when(failed, no_patterns).otherwise(F.col("key_value_pairs")),
    })
    # written, so that the gate's condition does not carry all of the cleaning down to the scan
    return written(out.drop("__error", *[f"{s}_error" for s in SCORED]), "processed")


def error_rows(rows: DataFrame, key: str = "_id") -> DataFrame:
    """(key, stage, error, critical): a row for each failed stage of processed rows."""
    return rows.select(key, F.explode("processing_errors").alias("e"), "critical").select(key, "e.stage", "e.error", "critical")


def process(content: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Processed rows without critical errors, gated and ranked."""
    return ranking.final_ranking(processed_rows(content, config).where("not critical"), "_id", "enhanced_quality_score", "relevance_score", config.least_quality)


def stage_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in and out, and duplicates found."""
    a = before.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("k"))
    b = after.agg(F.count(F.lit(1)).alias("successful"), F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("duplicates"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k").withColumn("failed", F.col("total") - F.col("successful") - F.col("duplicates"))
