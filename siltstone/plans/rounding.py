"""Columns of doubles that both engines round to six places: sums and averages depend on the order of the rows."""

from __future__ import annotations

DIGITS = 6
COLUMNS = {
    "query_statistics": "average_execution_time total_execution_time average_quality_score",
    "popular_queries": "avg_quality avg_execution_time",
    "content_stats": "average_processing_time average_quality_score average_relevance_score",
    "processing_analytics": "average_duration total_duration average_quality_score",
    "usage_statistics": "total_processing_time average_quality_score",
    "popular_sessions": "avg_quality total_time",
    "session_quality": "average_quality",
    "session_close": "duration_seconds average_query_time",
    "session_counters": "total_processing_time average_quality_score",
    "hourly_rollup": "average_quality_score",
    "daily_rollup": "average_quality_score",
    "weekly_report": "average_quality",
    "monthly_report": "average_quality",
    "system_metrics": "value",
    "table_profile": "average_size",
    "endpoint_metrics": "total_ms average_ms least_ms most_ms",
    "histogram": "total_seconds le",
    "percentiles_nearest": "p50 p95 p99",
    "percentiles_linear": "p50 p90 p95 p99",
    "loadtest_summary": "success_rate least_ms most_ms average_ms p50 p95 cache_hit_rate throttled_rate",
    "cache_efficiency": "hit_ms miss_ms hit_rate speed_up",
    "rate_limit_behaviour": "block_rate",
    "memory_growth": "start_mb end_mb peak_mb least_mb average_mb growth_per_request",
    "pool_utilisation": "average_percent most_percent",
    "stage_status": "least most mean median p95 limit",
    "response_metrics": "success_rate execution_ms items_per_second",
    "overall_status": "total",
    "stage_shares": "percent_of_total",
    "success_summary": "success_rate",
    "polite_schedule": "start wait",
    "degradation": "first_half second_half change_percent",
    "leak_lag": "before",
    "baseline_compare": "baseline current change_percent",
    "stage_compare": "baseline current difference change_percent",
    "version_metrics": "success_rate mean_time mean_confidence",
    "version_summary": "success_rate mean_time",
    "matched_versions": "score",
    "error_patterns": "overall_success_rate",
    "title_relevance": "title_score snippet_score",
    "result_relevance": "url_score title_score snippet_score overall",
    "insight_scores": "insight structured confidence relevance summary",
    "cut_summaries": "confidence",
    "fallback_records": "confidence quality",
    "validated_records": "score a b",
    "batch_scores": "score",
    "metric_gauges": "value",
    "appended_queries": "execution_time",
    "load_test_requests": "duration_ms",
    "near_duplicates": "jaccard length_score",
    "near_pairs": "jaccard length_score",
    "duplicate_components": "confidence",
    "best_version": "content_quality_score",
    "best_versions": "score",
    "quality_range": "content_quality_score",
    "quality_metrics": "readability information_density coherence",
    "categorize": "confidence",
    "domain_relevance": "relevance",
    "combined_rank": "score",
    "scrape_quality": "score",
    "top_per_domain": "content_quality_score",
    "top_per_query": "relevance_score content_quality_score",
    "post_scrape_chain": "combined_score",
    "discovery_chain": "rank_score",
    "hash_only": "confidence",
    "similar_content": "score",
    "update_status": "execution_time quality_score",
    "site_lists": "relevance_score",
    "stream_hourly": "value",
    "stream_endpoints": "seconds least most",
}
