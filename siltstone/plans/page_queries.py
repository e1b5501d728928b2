"""Queries over raw pages, model output, the pipeline and streams, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import model_output as mo
from siltstone.functions import urls
from siltstone.functions.scores import DOMAINS
from siltstone.operators import logs, ranking
from siltstone.operators.stored import size_guard
from siltstone.plans import pipeline
from siltstone.sources import adapters as ad
from siltstone.sources import html
from siltstone.sources.tables import fresh, table
from siltstone.streaming import streams


def extracted(spark, sf_dir):
    good, _ = stored_pages(spark, sf_dir)
    return html.extracted(good)


def stored_pages(spark, sf_dir):
    return size_guard(table(spark, sf_dir, "pages"))


def robots_texts(spark, sf_dir):
    """A robots file for each host of pages: its rules depend on the pages that it has."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("host"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("de", "fr", "es", "en")]), (F.min("page_id") % 4 + 1).cast("int"))
    head = F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /")
    return p.groupBy("host").agg(F.concat(head, lang, F.lit("/\nDisallow:\nAllow: /en/\nCrawl-delay: 2\nSitemap: https://x/map.xml")).alias("robots"))


def robots_checked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.robots_allowed(p, urls.robots_rules(robots_texts(spark, sf_dir))).select("page_id", "allowed")


def failing(spark, sf_dir):
    """Processed rows of all content, with scorers that fail on some."""
    from_model = lambda df: df.withColumns({"insights": F.lit("found"), "insights_error": F.when(F.col("_id") % 7 == 0, "AI Analysis failed: no answer").when(F.col("_id") % 5 == 0, "no JSON")})
    summed = lambda df: df.withColumns({"summary": mo.fallback_summary(F.col("content_type")), "summary_error": F.when(F.col("_id") % 3 == 0, "Timeout after 60 s")})
    config = pipeline.PipelineConfig(duplicates=False, cleaning=False, structured=False, insights=from_model, summary=summed, query="pages")
    return pipeline.processed_rows(ad.content_t(spark, sf_dir), config)


def responses(spark, sf_dir):
    """Raw model answers: JSON of documents in a fence, bare, with text around it, cut off, and none."""
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.substr("text", F.lit(1), F.lit(40)).alias("summary")))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
    cut = F.substr(body, F.lit(1), F.lit(12))
    raw = F.when(F.col("doc_id") % 5 == 0, fenced).when(F.col("doc_id") % 5 == 1, body).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("So: "), body, F.lit(" {"))).when(F.col("doc_id") % 5 == 3, cut).otherwise(F.lit("no answer"))
    return d.select("doc_id", raw.alias("raw"))


def parsed_responses(spark, sf_dir):
    out = mo.parse_objects(responses(spark, sf_dir), "raw", "id bigint, title string, summary string")
    return out.select("doc_id", F.col("parsed.id").alias("parsed_id"), F.col("parsed.title").alias("title"), F.col("error.error_type").alias("error_type"))


def site_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    score = (F.col("doc_id") % 7).cast("double") / F.lit(5.0)
    one = F.struct(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org")).alias("url"), F.col("lang").alias("title"), score.alias("relevance_score"))
    bad = F.struct(F.lit("").alias("url"), F.lit("x").alias("title"), F.lit(0.9).alias("relevance_score"))
    bare = F.to_json(F.array(one, bad))
    wrapped = F.to_json(F.struct(F.array(one, bad).alias("results")))
    raw = F.when(F.col("doc_id") % 3 == 0, bare).when(F.col("doc_id") % 3 == 1, wrapped).otherwise(F.concat(F.lit("```json\n"), wrapped, F.lit("\n```")))
    return mo.sites(d.select("doc_id", raw.alias("raw")), "raw", "doc_id").select("doc_id", "url", "title", "relevance_score")


def answers(spark, sf_dir):
    """M13 over content: the first sentence is its summary, the next four its key points; every eighth row names a product."""
    c = ad.content_t(spark, sf_dir)
    said = F.filter(F.transform(F.split("content", r"\."), lambda x: F.trim(x)), lambda s: F.length(s) > 3)
    text = lambda c, on: F.when(on, c)
    product = F.struct(F.col("content_type").alias("name"), F.lit("product").alias("type"), text(F.lit("TCK"), F.col("_id") % 16 == 0).alias("ticker"), F.lit("0.5%").alias("expense_ratio"), F.lit(None).cast("string").alias("minimum_investment"), F.lit("low").alias("risk_level"))
    fund = F.struct(F.concat(F.lit("Fund "), (F.col("_id") % 5).cast("string")).alias("name"), F.lit("FND").alias("ticker"), F.lit(None).cast("string").alias("expense_ratio"), F.lit("100").alias("minimum_investment"))
    rows = c.withColumn("said", said).select(
        "query_id", F.col("_id").alias("key"), F.col("relevance_score").alias("relevance"), F.col("content_quality_score").alias("quality"), "url", F.get("said", 0).alias("summary"), F.slice("said", 2, 4).alias("key_points"),
        F.when(F.col("_id") % 8 == 0, F.array(product)).alias("entities"), F.when(F.col("_id") % 9 == 0, F.array(fund)).alias("funds"), F.slice("said", 6, 2).alias("advice"),
    )
    joined = lambda c: F.array_join(c, "|").alias(c)
    return mo.answers(rows).select("query_id", "confidence", joined("sources"), joined("findings"), joined("recommendations"), "direct_answer")


def prompt_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mo.prompts(d, "Summarise [{lang}]: {text}", {"lang": 5, "text": 3500}).select("doc_id", F.md5("prompt").alias("prompt_md5"))


def gathered(stream, mode: str = "append"):
    """What a stream over all files that are there gives, through Parquet in the shared folder; in complete mode the last batch."""
    path = fresh(stream.sparkSession, "stream")

    def save(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'last' if mode == 'complete' else f'batch-{number}'}")

    query = stream.writeStream.foreachBatch(save).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def blocked_requests(spark, sf_dir):
    """ST2 by flag: one row per event, so the stream goes to Parquet in the shared folder, and is counted from there.

    All files make one micro-batch: part files come in no order of time, and rows behind the watermark would be lost.
    """
    limited = gathered(streams.rate_limited(streams.event_stream(spark, sf_dir, None), 3, 3600, 86_400, whole=True))
    return limited.groupBy("blocked").agg(F.count(F.lit(1)).alias("requests"))


def events(spark, sf_dir):
    return streams.event_stream(spark, sf_dir)


QUERIES = {
    "page_content": lambda s, d: extracted(s, d).select("page_id", "method", "fallback_used", F.length("content").alias("chars"), F.md5("content").alias("content_md5"), "content_quality_score"),
    "page_metadata": lambda s, d: extracted(s, d).select("page_id", "title", "description", "author", F.array_join("keywords", ",").alias("keywords"), "content_type", "publish_date"),
    "page_links": lambda s, d: extracted(s, d).select("page_id", F.inline("links")),
    "page_images": lambda s, d: extracted(s, d).select("page_id", F.inline("images")),
    "link_graph": lambda s, d: extracted(s, d).select(urls.domain(F.col("url")).alias("source"), F.explode("links").alias("l")).groupBy("source", urls.domain(F.col("l.url")).alias("target"), F.col("l.kind").alias("kind")).agg(F.count(F.lit(1)).alias("links")),
    "page_errors": lambda s, d: stored_pages(s, d)[1],
    "robots_rules": lambda s, d: urls.robots_rules(robots_texts(s, d)),
    "robots_allowed": robots_checked,
    "candidate_domains": lambda s, d: ranking.candidate_domains(ad.queries_t(s, d).where("status = 'failed'").select("_id", "category")),
    "parsed_responses": parsed_responses,
    "response_errors": lambda s, d: mo.error_counts(mo.parse_objects(responses(s, d), "raw", "id bigint, title string, summary string")),
    "site_lists": site_lists,
    "answer_synthesis": answers,
    "prompt_rendering": prompt_rows,
    "weighted_choice": lambda s, d: logs.weighted_choice(ad.queries_t(s, d).select("_id"), s.createDataFrame([("a", 1.0), ("b", 3.0)], "version_id string, weight double"), "_id").groupBy("version_id").agg(F.count(F.lit(1)).alias("rows")),
    "processed_ranking": lambda s, d: pipeline.process(ad.content_t(s, d)).select("_id", "group_size", "enhanced_quality_score", "rank_score", F.md5("cleaned_content").alias("cleaned_md5")),
    "processing_errors": lambda s, d: pipeline.error_rows(failing(s, d)),
    "processing_fallbacks": lambda s, d: failing(s, d).where("size(processing_errors) > 0 and not critical").select("_id", "enhanced_quality_score", F.md5("cleaned_content").alias("content_md5"), F.col("summary.executive_summary").alias("summary"), F.col("insights").isNull().alias("without_insights")),
    "pipeline_stats": lambda s, d: pipeline.stage_counts(ad.content_t(s, d), pipeline.process(ad.content_t(s, d))),
    "stream_hourly": lambda s, d: gathered(streams.hourly(events(s, d)), "complete").select("period_start", "events", "errors", F.round("value", 4).alias("value")),
    "stream_endpoints": lambda s, d: gathered(streams.endpoint_metrics(events(s, d)), "complete").select("event_type", "requests", F.round("seconds", 3).alias("seconds"), "least", "most", "le_3"),
    "stream_rate_limit": blocked_requests,
}

_LANG = "case min(page_id) % 4 when 0 then 'de' when 1 then 'fr' when 2 then 'es' else 'en' end"
_HOST = "lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"

SQL = {
    "page_errors": "select page_id, url, 'content_too_large' as error_type, octet_length(encode(html)) as size, false as retryable from pages where octet_length(encode(html)) > 10485760",
    "robots_rules": f"""with h as (select {_HOST} as host, {_LANG} as lang from pages group by 1)
        select host, 'other' as agent, 'disallow' as kind, '/' as value from h union all select host, '*', 'disallow', '/' || lang || '/' from h union all select host, '*', 'allow', '/en/' from h
        union all select host, '*', 'crawl-delay', '2' from h union all select host, '*', 'sitemap', 'https://x/map.xml' from h""",
    "robots_allowed": f"""with h as (select {_HOST} as host, {_LANG} as lang from pages group by 1)
        select page_id, not starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '/' || lang || '/') as allowed from pages join h on {_HOST} = h.host""",
    "candidate_domains": f"with {ad.QUERIES_SQL}, d(category, domain) as (values "
    + ", ".join(f"('{k}', '{x}')" for k, v in DOMAINS.items() for x in v)
    + ") select _id, q.category, domain from queries_t q join d on q.category = d.category where status = 'failed'",
    "parsed_responses": """select doc_id, case when doc_id % 5 < 3 then doc_id end as parsed_id, case when doc_id % 5 < 3 then lang end as title, case when doc_id % 5 >= 3 then 'no_json' end as error_type from documents""",
    "response_errors": "select 'no_json' as error_type, count(*) as count from documents where doc_id % 5 >= 3",
    "site_lists": "select doc_id, 'https://' || source || '.example.org' as url, lang as title, least(1.0::double, cast(doc_id % 7 as double) / 5.0::double) as relevance_score from documents",
    "prompt_rendering": "select doc_id, md5('Summarise [' || left(lang, 5) || ']: ' || left(text, 3500)) as prompt_md5 from documents",
    "stream_hourly": "select date_trunc('hour', ts)::timestamp as period_start, count(*) as events, count(*) filter (event_type = 'error') as errors, round(sum(value), 4) as value from events group by 1",
    "stream_endpoints": """select event_type, count(*) as requests, round(sum(value / 10.0::double), 3) as seconds, min(value / 10.0::double) as least, max(value / 10.0::double) as most, count(*) filter (value / 10.0::double <= 2.5) as le_3 from events group by 1""",
    "stream_rate_limit": f"""with {ad.REQUESTS_SQL}, c as (select count(*) over (partition by client order by epoch_us(ts) range between 3599999999 preceding and current row)
        - (count(*) over (partition by client, ts) - row_number() over (partition by client, ts order by event_id)) as n from requests_t) select n > 3 as blocked, count(*) as requests from c group by 1""",
}
SQL["processing_errors"] = """select doc_id as _id, case when doc_id % 7 = 0 or doc_id % 5 = 0 then 'insights' else 'summary' end as stage,
    case when doc_id % 7 = 0 then 'AI Analysis failed: no answer' when doc_id % 5 = 0 then 'no JSON' else 'Timeout after 60 s' end as error, doc_id % 7 = 0 or doc_id % 5 <> 0 as critical from documents where doc_id % 7 = 0 or doc_id % 5 = 0 or doc_id % 3 = 0"""
SQL["processing_fallbacks"] = f"""with {ad.CONTENT_SQL} select _id, coalesce(content_quality_score, 0.0::double) * 0.5::double as enhanced_quality_score, md5(coalesce(content, '')) as content_md5, 'Content related to pages' as summary, true as without_insights
    from content_t where _id % 5 = 0 and _id % 7 <> 0"""
