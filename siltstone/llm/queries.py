"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, language, mixing, packing, periodic, pii, quality_rules, simhash, spelling, token_counts, toxicity, url_filter, warc
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _of(query: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: query(*[table(spark, sf_dir, name) for name in names])


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _of(quality_rules.op1_query, "documents", "labels"),
        "op2_best_fit_packing": _of(packing.op2_query, "documents"),
        "op3_exact_dedup": _of(exact_dedup.op3_query, "documents"),
        "op4_curriculum_mix": _of(mixing.op4_query, "documents"),
        "op5_toxicity": _of(toxicity.op5_query, "documents", "labels"),
        "op6_token_counts": _of(token_counts.op6_query, "documents"),
        "op7_simhash": _of(simhash.op7_query, "documents"),
        "op8_language": _of(language.op8_query, "documents"),
        "op9_pii": _of(pii.op9_query, "documents"),
        "op10_url_filter": _of(url_filter.op10_query, "pages"),
        "url_filter_given_list": _of(url_filter.given_list_query, "pages"),
        "op11_warc": _of(warc.op11_query, "pages"),
        "op12_spelling_variants": _of(spelling.op12_query, "documents"),
        "op13_periodic_runs": _of(periodic.op13_query, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op10_url_filter": url_filter.OP10_SQL, "url_filter_given_list": url_filter.GIVEN_LIST_SQL, "op11_warc": warc.OP11_SQL}
