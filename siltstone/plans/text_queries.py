"""Queries over documents, pages and what users ask, with their SQL where RE2 can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import requests as rq
from siltstone.functions import scores as sc
from siltstone.functions import text as tx
from siltstone.functions import urls
from siltstone.operators import aggregates, dedup, logs, maintenance, near, ranking, searching, stored
from siltstone.sources import adapters as ad
from siltstone.sources.tables import fresh, table, written


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


def patterns_found(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", tx.patterns(F.col("text")).alias("p"))
    return p.select("doc_id", *[F.coalesce(F.array_join(F.try_element_at("p", F.lit(k)), "|"), F.lit("")).alias(k) for k in ("prices", "percentages", "phone_numbers")], F.size(F.map_keys(tx.pattern_confidences(F.col("p")))).alias("kinds"))


def cleaned(spark, sf_dir):
    """Cleaned text as length and hash, with its counts and scores."""
    d = docs(spark, sf_dir)
    d = d.withColumn("base", tx.without_boilerplate(F.col("text")))
    out = d.withColumns({"clean": tx.clean_rest(F.col("base")), **tx.bracket_counts(F.col("base"))})
    out = out.withColumns(tx.structure(F.col("clean"))).withColumns(tx.quality_metrics(F.col("clean")))
    quality = tx.cleaning_quality(F.lit(0.5), F.col("readability"), F.col("information_density"), F.col("coherence"))
    return out.select("doc_id", F.length("clean").alias("cleaned_chars"), F.md5("clean").alias("cleaned_md5"), *[f"{k}_removed" for k in tx.BRACKETS], "paragraphs", "sentences", "words", quality.alias("enhanced_quality"))


def ranked_documents(spark, sf_dir):
    """The flagship: documents cleaned and scored, one best version of equal texts, the twenty best."""
    c = ad.content_t(spark, sf_dir).select("_id", "url", F.col("content").alias("raw"), "content_quality_score", "relevance_score")
    c = c.withColumn("content", tx.clean_text(F.col("raw"), sentences=False))
    m = tx.quality_metrics(F.col("content"))
    quality = tx.cleaning_quality(F.coalesce("content_quality_score", F.lit(0.5)), m["readability"], m["information_density"], m["coherence"])
    c = c.select("_id", "relevance_score", quality.alias("quality"), tx.text_fingerprint(F.col("content")).alias("fp"))
    best = c.groupBy("fp").agg(F.max_by(F.struct("_id", "quality", "relevance_score"), F.struct("quality", -F.col("_id"))).alias("b"), F.count(F.lit(1)).alias("copies"))
    rows = best.select("b._id", "b.quality", "b.relevance_score", "copies")
    return ranking.final_ranking(rows, "_id", "quality", "relevance_score", 0.3).limit(20)


QUERIES = {
    "ranked_documents": ranked_documents,
    "content_by_domain": lambda s, d: stored.by_domain(ad.content_t(s, d), "SRC1.example").select("_id", "url"),
    "quality_range": lambda s, d: stored.by_quality(ad.content_t(s, d), 0.5, 0.95).select("_id", "content_quality_score"),
    "processing_errors": lambda s, d: stored.with_errors(ad.processed_t(s, d), ["original_content_id", "query_id", F.array_join("processing_errors", ",").alias("errors"), "processing_timestamp", "processing_version"]),
    "queries_by_category": lambda s, d: stored.newest(ad.queries_t(s, d).where("category = 'ai_tools'"), "created_at", "_id", 20).select("_id", "query_text", "created_at"),
    "recent_queries": lambda s, d: stored.newest(ad.queries_t(s, d), "created_at", "_id", 20, 10).select("_id", "query_text", "created_at"),
    "query_page": lambda s, d: stored.page(ad.queries_t(s, d).where("status = 'failed'").select("_id", "query_text"), [F.col("_id")], 3, 25),
    "query_search": lambda s, d: stored.search(ad.queries_t(s, d), ["error", "purchase"], ["query_text", "category"], "2024-01-05", "2024-01-20", "created_at", F.col("execution_time") > 100).select("_id", "query_text"),
    "content_search": lambda s, d: stored.search(ad.content_t(s, d), ["license", "stupid"], ["title", "content"], where=F.col("content_type") == "article").select("_id", "url"),
    "content_id": lambda s, d: pages(s, d).select("page_id", tx.content_id(F.col("url"), F.lit(None).cast("string")).alias("content_id"), tx.content_id(F.col("url"), F.col("page_id").cast("string")).alias("titled_id")),
    "content_hash": lambda s, d: docs(s, d).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash")),
    "text_fingerprint": lambda s, d: docs(s, d).select("doc_id", tx.text_fingerprint(F.col("text")).alias("fingerprint")),
    "structure_features": lambda s, d: docs(s, d).select("doc_id", *[c.cast("long").alias(k) for k, c in tx.structure(F.col("text")).items()]),
    "quality_metrics": lambda s, d: docs(s, d).select("doc_id", *[c.alias(k) for k, c in tx.quality_metrics(F.col("text")).items()]),
    "extracted_patterns": patterns_found,
    "ad_removal": lambda s, d: docs(s, d).select("doc_id", F.md5(tx.remove_ads(F.concat(F.col("text"), F.lit(" Click HERE to Subscribe, sponsored")))).alias("without_ads")),
    "repeated_lines": lambda s, d: docs(s, d).select("doc_id", F.length(tx.drop_repeated_lines(F.col("text"))).cast("long").alias("chars")),
    "truncate": lambda s, d: docs(s, d).select("doc_id", F.length(tx.truncate(F.col("text"), 2000)).cast("long").alias("chars"), F.octet_length(tx.truncate_bytes(F.col("text"), 2000)).cast("long").alias("bytes")),
    "clean_text": cleaned,
    "sentence_dedup": lambda s, d: docs(s, d).select("doc_id", F.length(tx.dedup_sentences(F.col("text"))).alias("chars"), F.size(tx.split_sentences(F.col("text"))).alias("sentences"), tx.removed_repeats(F.col("text")).alias("removed")),
    "language_votes": lambda s, d: docs(s, d).select("doc_id", tx.language_votes(F.col("text")).alias("language")),
    "sanitize_query": lambda s, d: ad.user_queries_t(s, d).select("conv_id", "turn", rq.sanitise(F.concat(F.lit("<b>é</b> "), F.col("raw_query"), F.lit("  \t^^ end\n"))).alias("clean"), rq.reject_reason(F.substr("raw_query", F.lit(1), F.col("turn") + 1)).alias("reason")),
    "url_fingerprint": lambda s, d: pages(s, d).select("page_id", urls.fingerprint(F.col("url")).alias("fingerprint"), urls.domain(F.col("url")).alias("domain"), urls.normalise(F.col("url")).alias("normalised")),
    "url_list_validation": lambda s, d: urls.validate_lists(pages(s, d).withColumn("request", F.col("page_id") % 4), "request", "url", "page_id").select("page_id", "reason"),
    "categorize": lambda s, d: rq.categorise(ad.user_queries_t(s, d).withColumn("q", F.concat_ws(" ", F.col("raw_query"), F.when(F.col("conv_id") % 3 == 0, "AI model training"), F.when(F.col("conv_id") % 4 == 1, "low risk mutual fund"))), "q").select("conv_id", "turn", "category", "confidence", "needs_review"),
    "parsed_queries": lambda s, d: rq.parsed_queries(ad.user_queries_t(s, d), "raw_query").select("conv_id", "turn", "reject_reason", F.col("base_result.category").alias("category"), F.col("base_result.confidence_score").alias("confidence"), "attributes.ai_tools.tool_type", "attributes.mutual_funds.investment_type", F.array_join("suggestions", "|").alias("tips")),
    "domain_relevance": lambda s, d: ranked_sites(s, d).select("page_id", "relevance"),
    "title_relevance": lambda s, d: title_scores(s, d),
    "combined_rank": lambda s, d: ad.content_t(s, d).select("_id", sc.combined(F.col("content_quality_score"), F.col("relevance_score"), F.col("content_type"), F.lit("general")).alias("score")),
    "scrape_quality": lambda s, d: ad.content_t(s, d).select("_id", sc.scrape_quality(F.col("content_quality_score"), F.col("relevance_score"), F.col("content_type") == "article", F.when(F.col("_id") % 2 == 0, "llm_generated").otherwise("rule_based"), F.col("content_size_bytes")).alias("score")),
    "final_filter": lambda s, d: ad.content_t(s, d).where(sc.passes_final_filter(F.col("content_size_bytes"), F.col("content_quality_score"), F.col("relevance_score"))).select("_id"),
    "irrelevant_content": lambda s, d: ad.content_t(s, d).where(sc.irrelevant(F.col("url"), F.lit("Programming index"), F.lit(None).cast("string"), F.col("content"), F.when(F.col("_id") % 2 == 0, "mutual_funds").otherwise("general"))).select("_id"),
    "row_violations": lambda s, d: stored.violations(ad.content_t(s, d).withColumn("relevance_score", F.col("relevance_score") * 1.5), stored.content_rules()).select("_id", F.array_join("violations", ",").alias("violations")).where("violations != ''"),
    "top_per_domain": lambda s, d: ranking.best_per_domain(ad.content_t(s, d).select("_id", "url", "content_quality_score"), "url", "content_quality_score", "_id"),
    "top_per_query": lambda s, d: ranking.top_per_group(ad.content_t(s, d).select("_id", "query_id", "relevance_score", "content_quality_score"), "query_id", ["relevance_score", "content_quality_score"], "_id", 3),
    "post_scrape_chain": lambda s, d: ranking.post_scrape(ad.content_t(s, d), "general").select("_id", "combined_score"),
    "discovery_chain": lambda s, d: ranking.discovery(sites(s, d), "ai_tools").select("page_id", "domain", "rank_score"),
    "exact_duplicates": lambda s, d: dedup.groups(docs(s, d).select(F.col("doc_id").alias("id"), tx.text_fingerprint(F.col("text")).alias("fp")), "fp"),
    "url_duplicates": lambda s, d: dedup.groups(pages(s, d).select(F.col("page_id").alias("id"), urls.fingerprint(F.regexp_replace("url", r"/\d+", "/")).alias("fp")), "fp"),
    "hash_only": lambda s, d: dedup.hash_only(ad.content_t(s, d).select("_id", "content")),
    "pattern_duplicates": lambda s, d: dedup.pattern_only(dedup.fingerprints(ad.content_t(s, d))).select("id", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"), "best_id", "confidence"),
    "session_queries": lambda s, d: stored.newest(stored.lookup(ad.queries_t(s, d), user_id=7, status="processing"), "created_at", "_id", 50).select("_id", "session_id", "created_at"),
    "quality_gate": lambda s, d: stored.quality_gate(ad.content_t(s, d)).select("_id", "content_quality_score"),
    "fetch_stats": lambda s, d: logs.fetch_stats(ad.requests_t(s, d), "path", 2.0),
    "near_duplicates": lambda s, d: near_pairs(s, d),
    "near_pairs": lambda s, d: near_pairs(s, d),
    "near_classes": lambda s, d: near_classes(s, d),
    "stored_update": lambda s, d: updated_table(s, d),
    "stored_retention": lambda s, d: retained_table(s, d),
    "stored_archive": lambda s, d: archived_table(s, d),
    "search_any": lambda s, d: found(s, d, "worthless track thing"),
    "search_phrase": lambda s, d: found(s, d, '"of the" thing'),
    "search_excluded": lambda s, d: found(s, d, 'thing -worthless -"of the"'),
    "search_stems": lambda s, d: found(s, d, "contacts calling worthlessed"),
    "candidate_pairs": lambda s, d: dedup.near_candidates(written(dedup.fingerprints(ad.texts_t(s, d)), "prints")),
    "structure_fingerprints": lambda s, d: dedup.fingerprints(ad.texts_t(s, d)).select("id", "structure_fp", "length", "words"),
    "duplicate_components": lambda s, d: dedup.duplicate_analysis(ad.content_t(s, d)),
    "best_version": lambda s, d: dedup.best_versions(ad.content_t(s, d)).select("_id", "content_quality_score"),
    "content_mapping": lambda s, d: mapping(s, d),
    "query_results": lambda s, d: stored.query_results(ad.queries_t(s, d).select("_id", "session_id", "query_text"), ad.content_t(s, d), ad.processed_t(s, d), ad.sessions_t(s, d)),
    "save_content": lambda s, d: saved(s, d),
    "duplicate_groups": lambda s, d: aggregates.duplicate_groups(duplicates(s, d)),
    "duplicate_members": lambda s, d: aggregates.duplicate_members(duplicates(s, d)),
    "cross_search": lambda s, d: stored.cross_search({"query": stored.search(ad.queries_t(s, d), ["view"], ["query_text"]).select("_id"), "content": stored.search(ad.content_t(s, d), ["license"], ["content"]).select("_id")}),
    "similar_content": lambda s, d: similar_rows(s, d),
    "update_status": lambda s, d: updated(s, d),
    "retention_queries": lambda s, d: stored.retained(ad.queries_t(s, d), "created_at", "2024-02-10", 30, F.col("status").isin("completed", "failed")).select("_id", "deleted"),
    "retention_content": lambda s, d: stored.retained(ad.content_t(s, d).withColumn("duplicate_of", F.when(F.col("_id") % 5 == 0, F.col("_id") - 1)), "timestamp", "2024-01-01 10:00:00", 0, F.col("duplicate_of").isNotNull()).select("_id", "deleted"),
    "retention_counts": lambda s, d: stored.retention_counts({"queries": stored.retained(ad.queries_t(s, d), "created_at", "2024-02-10", 30), "sessions": stored.retained(ad.sessions_t(s, d), "start_time", "2024-02-10", 20)}),
    "archive_split": lambda s, d: archive(s, d),
    "cache_latest": lambda s, d: stored.latest_by_key(ad.queries_t(s, d).withColumn("expires_at", F.col("created_at") + F.expr("interval 7 days")).select("query_text", "_id", "created_at", "expires_at"), "query_text", "created_at", "2024-01-30").select("query_text", "_id"),
}


def sites(spark, sf_dir):
    """Discovery results: pages with a score, a category and a method."""
    p = pages(spark, sf_dir)
    return p.select("page_id", "url", urls.domain(F.col("url")).alias("domain"), ((F.col("page_id") * 7 % 90).cast("double") / F.lit(100.0)).alias("relevance_score"), ((F.col("page_id") % 10).cast("double") / F.lit(10.0)).alias("confidence"), F.when(F.col("page_id") % 2 == 0, "ai_tools").otherwise("general").alias("category"))


def ranked_sites(spark, sf_dir):
    p = sites(spark, sf_dir)
    known = F.when(F.col("page_id") % 3 == 0, "github.com").when(F.col("page_id") % 3 == 1, "vanguard.com").otherwise(F.col("domain"))
    return p.withColumn("relevance", sc.domain_relevance(known, F.col("category"), ["vanguard.com"]))


def title_scores(spark, sf_dir):
    """User queries against their own beginnings as titles and contents."""
    q = ad.user_queries_t(spark, sf_dir)
    category = F.when(F.col("conv_id") % 2 == 0, "ai_tools").otherwise("mutual_funds")
    title = F.substr("raw_query", F.lit(1), F.lit(20))
    return q.select("conv_id", "turn", sc.title_relevance(title, F.col("raw_query"), category).alias("title_score"), sc.snippet_relevance(F.substr("raw_query", F.lit(1), F.lit(60)), F.col("raw_query"), category).alias("snippet_score"))


def stored_queries(spark, sf_dir):
    path = fresh(spark, "queries")
    maintenance.store(ad.queries_t(spark, sf_dir).select("_id", "status", "execution_time", "created_at", F.to_date("created_at").alias("day")), path, "day")
    return path


def updated_table(spark, sf_dir):
    """P9 as a write, done twice: changes of the first days, two for each key."""
    path, q = stored_queries(spark, sf_dir), ad.queries_t(spark, sf_dir)
    few = q.where("_id % 50 = 0 and created_at < timestamp '2024-01-10'").select("_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    changes = few.select("_id", "n", F.when(F.col("n") == 2, "cancelled").otherwise("pending").alias("status"), F.when(F.col("_id") % 100 == 0, F.col("n") * F.lit(1.5)).alias("execution_time"))
    for _ in range(2):
        maintenance.update_stored(spark, path, "day", stored.valid_status(changes)[0], "_id", ["status", "execution_time"], "n")
    return spark.read.parquet(path).select("_id", "status", "execution_time")


def retained_table(spark, sf_dir):
    """R1 as a write, done twice."""
    path = stored_queries(spark, sf_dir)
    for _ in range(2):
        maintenance.retain_stored(spark, path, "day", "created_at", "2024-02-10 12:00:00", 30, F.col("status").isin("completed", "failed"))
    return spark.read.parquet(path).select("_id", "status", "created_at")


def archived_table(spark, sf_dir):
    """S9 as a write, to an archive and then a later time of day."""
    path, archive = stored_queries(spark, sf_dir), fresh(spark, "archive")
    for as_of in ("2024-02-10 12:00:00", "2024-02-10 12:00:00", "2024-02-10 18:00:00"):
        maintenance.archive_stored(spark, path, archive, "day", "created_at", as_of, 30, "_id")
    parts = [spark.read.parquet(p).select("_id", "created_at", F.lit(name).alias("part")) for p, name in ((path, "live"), (archive, "archive"))]
    return parts[0].unionByName(parts[1])


def found(spark, sf_dir, text):
    """P11 over all content: postings are stored, and searched."""
    path = fresh(spark, "postings")
    searching.save_postings(searching.postings(ad.texts_t(spark, sf_dir), "_id", ["content"]), path)
    return searching.search_postings(spark, path, text).withColumnRenamed("id", "_id")


def near_classes(spark, sf_dir):
    """D5 as classes, with one representative for each text."""
    c = ad.texts_t(spark, sf_dir)
    return near.near_classes(c, written(dedup.text_prints(c), "prints")).select("id", "text_id", "class_id")


def near_pairs(spark, sf_dir):
    """D5 as all pairs, by the exact join."""
    c = ad.texts_t(spark, sf_dir)
    return dedup.near_pairs(c, written(dedup.text_prints(c), "prints")).select("id_a", "id_b", "jaccard", "length_score")


def mapping(spark, sf_dir):
    """Two thirds of processed rows know their content, of the others half have its URL, and half one that nothing has."""
    c = ad.content_t(spark, sf_dir).withColumn("duplicate_of", F.when(F.col("_id") % 5 == 0, F.col("_id") - 1))
    i = F.col("original_content_id")
    p = ad.processed_t(spark, sf_dir).join(c.select(F.col("_id").alias("__c"), "url"), i == F.col("__c")).drop("__c")
    p = p.withColumn("original_url", F.when(i % 6 == 3, F.col("url")).otherwise(F.concat(F.lit("https://nowhere/"), i.cast("string")))).drop("url")
    p = p.withColumn("original_content_id", F.when(i % 3 > 0, i))
    return stored.resolved(p, c).select("query_id", "original_url", "content_id", "unresolved")


def saved(spark, sf_dir):
    c = ad.content_t(spark, sf_dir).select("_id", "content")
    old = c.where("_id % 2 = 0").select("_id", tx.content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))
    return stored.save_content(c.where("_id % 2 = 1"), old).select("_id", "content_hash", "duplicate_of")


def duplicates(spark, sf_dir):
    """All content, with what saving it names as duplicates."""
    c = ad.content_t(spark, sf_dir).select("_id", "url", "title", "timestamp", "content")
    none = spark.createDataFrame([], "_id bigint, content_hash string")
    return written(stored.save_content(c, none).drop("content", "content_hash"), "saved")


def similar_rows(spark, sf_dir):
    """J5 for every twentieth id, against all rows."""
    c = ad.texts_t(spark, sf_dir)
    found = dedup.similar_content(c, c.where("_id % 20 = 0").select(F.col("_id").alias("id")), 0.3)
    return found.join(c.select(F.col("_id").alias("member"), "url"), "member").select(F.col("id").alias("content_id"), "place", "member", "score", "url")


def updated(spark, sf_dir):
    q = ad.queries_t(spark, sf_dir)
    changes = q.where("_id % 50 = 0").select("_id", F.when(F.col("_id") % 100 == 0, "completed").otherwise("unheard").alias("status"), F.lit(1.5).alias("execution_time"), F.lit(None).cast("double").alias("quality_score"))
    good, _ = stored.valid_status(changes)
    return stored.update(q, good, "_id", ["status", "execution_time", "quality_score"]).select("_id", "status", "execution_time", "quality_score")


def archive(spark, sf_dir):
    p = ad.processed_t(spark, sf_dir).select("original_content_id", "query_id", "processing_timestamp")
    old = p.where("original_content_id % 3 = 0").withColumn("query_id", F.lit(-1).cast("long"))
    live, moved = stored.archived(p, old, "processing_timestamp", "2024-01-01 08:00:00", 0, "original_content_id")
    return live.withColumn("part", F.lit("live")).unionByName(moved.withColumn("part", F.lit("archive")))


_W = r"[\p{L}\p{N}_]"
_LINES = r"list_transform(str_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))"
_STRUCT = f"""s as (select doc_id, text, len(list_filter(str_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) as paragraphs,
  len(list_filter(str_split(text, '.'), lambda p: regexp_matches(p, '\\S'))) as sentences, len(regexp_extract_all(text, '\\S+')) as words,
  len(list_filter({_LINES}, lambda x: x <> '' and (x like '%:' or (len(regexp_extract_all(x, '\\S+')) <= 8 and upper(x) = x and lower(x) <> x)))) as headings,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(?:[\\-*•]|\\d+\\.)\\s+'))) as list_items from documents)"""
_ADS = "text || ' Click HERE to Subscribe, sponsored'"
for _p in tx.ADS:
    _ADS = f"regexp_replace({_ADS}, '{_p}', '', 'gi')"
_HALF = lambda c: f"case when {c} is null or {c} = 0 then 0.5::double else {c} end"
_COMBINED = f"""({_HALF("content_quality_score")}) * 0.3::double + ({_HALF("relevance_score")}) * 0.4::double +
  (case content_type when 'article' then 0.8::double when 'documentation' then 0.7::double else 0.5::double end) * 0.2::double + (case when content_type = 'general' then 0.9::double else 0.5::double end) * 0.1::double"""
_FINAL = "content_size_bytes >= 500 and not coalesce(content_quality_score <> 0 and content_quality_score < 0.3::double, false) and not coalesce(relevance_score <> 0 and relevance_score < 0.2::double, false)"
_SITES = """sites as (select page_id, url, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as domain, cast(page_id * 7 % 90 as double) / 100.0::double as relevance_score,
  cast(page_id % 10 as double) / 10.0::double as confidence, case when page_id % 2 = 0 then 'ai_tools' else 'general' end as category from pages)"""
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_any = lambda c, xs: "(" + " or ".join(f"contains({c}, '{x}')" for x in xs) + ")"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_HASH = r"sha256(regexp_replace(lower(" + _TRIM.format("coalesce(content, '')") + r"), '\s+', ' ', 'g'))"
_PRINT = f"md5({_TRIM.format(f'''regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g')''')})"


def _keyword_score(category: str) -> str:
    hit = lambda k: f"case when regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') then 1 else 0 end"
    n, heavy = (" + ".join(hit(k) for k in ks) for ks in (rq.KEYWORDS[category], rq.PRIORITY[category]))
    return f"case when ({n}) > 0 then least(0.95::double, least(0.9::double, ({n}) / {float(max(len(rq.KEYWORDS[category]), 10))}::double * 2.0::double + 0.3::double) + 0.2::double * ({heavy})) end"


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts)


SQL = {
    "content_by_domain": f"{_with(ad.CONTENT_SQL)} select _id, url from content_t where lower(url) like '%src1.example%'",
    "quality_range": f"{_with(ad.CONTENT_SQL)} select _id, content_quality_score from content_t where content_quality_score between 0.5::double and 0.95::double",
    "processing_errors": f"{_with(ad.PROCESSED_SQL)} select original_content_id, query_id, array_to_string(processing_errors, ',') as errors, processing_timestamp, processing_version from processed_t where len(processing_errors) > 0",
    "queries_by_category": f"{_with(ad.QUERIES_SQL)} select _id, query_text, created_at from queries_t where category = 'ai_tools' order by created_at desc, _id limit 20",
    "recent_queries": f"{_with(ad.QUERIES_SQL)} select _id, query_text, created_at from queries_t order by created_at desc, _id limit 20 offset 10",
    "query_page": f"""{_with(ad.QUERIES_SQL)}, f as (select _id, query_text from queries_t where status = 'failed'), n as (select count(*)::int as total from f)
        select _id, query_text, total, ceil(total / 25.0)::int as total_pages, 3 < ceil(total / 25.0) as has_next, true as has_previous from f, n order by _id limit 25 offset 50""",
    "query_search": f"""{_with(ad.QUERIES_SQL)} select _id, query_text from queries_t where list_has_any(regexp_split_to_array(lower(query_text || ' ' || category), '[^\\p{{L}}\\p{{N}}]+'), ['error', 'purchase'])
        and created_at >= timestamp '2024-01-05' and created_at <= timestamp '2024-01-20' and execution_time > 100""",
    "content_search": f"{_with(ad.CONTENT_SQL)} select _id, url from content_t where list_has_any(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), ['license', 'stupid']) and content_type = 'article'",
    "content_id": "select page_id, md5(url || '|no-title') as content_id, md5(url || '|' || cast(page_id as varchar)) as titled_id from pages",
    "content_hash": f"{_with(ad.CONTENT_SQL)} select _id as doc_id, {_HASH} as content_hash from content_t",
    "text_fingerprint": f"select doc_id, case when coalesce(text, '') = '' then '' else {_PRINT} end as fingerprint from documents",
    "structure_features": f"{_with(_STRUCT)} select doc_id, paragraphs, sentences, words, headings, list_items, greatest(1, words // 200) as reading_minutes from s",
    "quality_metrics": f"""{_with(_STRUCT)}, m as (select *, len(regexp_extract_all(replace(text, '.', ' '), '\\S+')) / sentences::double as mean, len(list_distinct(regexp_extract_all(lower(text), '\\S+'))) as different from s)
        select doc_id, case when sentences > 0 then greatest(0.0::double, least(1.0::double, 1.0::double - (mean - 10.0::double) / 30.0::double)) else 0.0::double end as readability,
        case when sentences > 0 then different / greatest(1, words)::double else 0.0::double end as information_density,
        case when sentences > 0 then least(1.0::double, paragraphs / greatest(1.0::double, sentences / 3.0::double)) else 0.0::double end as coherence from m""",
    "ad_removal": f"select doc_id, md5({_ADS}) as without_ads from documents",
    "repeated_lines": """with l as (select doc_id, str_split(text, chr(10)) as v from documents) select doc_id, length(array_to_string(list_filter(v, lambda x, i: i = 1 or x <> v[i - 1]), chr(10))) as chars from l""",
    "truncate": """select doc_id, case when octet_length(encode(text)) > 2000 then least(length(text), 500) + length('... [Content truncated]') else length(text) end as chars,
        case when octet_length(encode(text)) > 2000 then (select max(n) from (select unnest(list_transform(range(0, 1001), lambda k: case when octet_length(encode(left(text, k))) <= 1000 then octet_length(encode(left(text, k))) else 0 end)) as n)) else octet_length(encode(text)) end as bytes from documents""",
    "url_list_validation": """select page_id, case when row_number() over (partition by page_id % 4 order by page_id) > 50 then 'too_many' when url is null or trim(url) = '' then 'blank' when not regexp_matches(url, '(?i)^https?://') then 'scheme'
        when regexp_extract(url, '//([^/?#]*)', 1) = '' then 'host' end as reason from pages""",
    "categorize": f"""{_with(ad.USER_QUERIES_SQL)}, q as (select conv_id, turn, lower(concat_ws(' ', raw_query, case when conv_id % 3 = 0 then 'AI model training' end, case when conv_id % 4 = 1 then 'low risk mutual fund' end)) as t from user_queries_t),
        s as (select conv_id, turn, {_keyword_score("ai_tools")} as ai, {_keyword_score("mutual_funds")} as mf from q),
        b as (select *, greatest(ai, mf) as best from s), c as (select conv_id, turn, case when best is null then 'general' when ai >= coalesce(mf, 0.0::double) then 'ai_tools' else 'mutual_funds' end as category,
        case when best is null then 0.4::double when best < 0.6::double then least(0.8::double, best + 0.2::double) else best end as confidence from b) select *, confidence < 0.7::double as needs_review from c""",
    "domain_relevance": f"""{_with(_SITES)}, k as (select page_id, category, case page_id % 3 when 0 then 'github.com' when 1 then 'vanguard.com' else domain end as d from sites)
        select page_id, least(1.0::double, 0.5::double + case when d = 'vanguard.com' then 0.2::double else 0.0::double end +
        case when (category = 'ai_tools' and d in ({_list(sc.DOMAINS["ai_tools"])})) or (category = 'general' and d in ({_list(sc.DOMAINS["general"])})) then 0.2::double else 0.0::double end +
        case when d in ({_list(sc.AUTHORITIES)}) then 0.1::double else 0.0::double end) as relevance from k""",
    "combined_rank": f"{_with(ad.CONTENT_SQL)} select _id, {_COMBINED} as score from content_t",
    "scrape_quality": f"""{_with(ad.CONTENT_SQL)} select _id, least(1.0::double, greatest(0.0::double, ({_HALF("content_quality_score")}) + 0.2::double * relevance_score + case when content_type = 'article' then 0.1::double else 0.0::double end +
        case when _id % 2 = 0 then 0.05::double else 0.03::double end + case when content_size_bytes > 5000 then 0.05::double when content_size_bytes > 2000 then 0.03::double else 0.0::double end)) as score from content_t""",
    "final_filter": f"{_with(ad.CONTENT_SQL)} select _id from content_t where {_FINAL}",
    "irrelevant_content": f"{_with(ad.CONTENT_SQL)} select _id from content_t where _id % 2 = 1 or ({_any('lower(left(content, 500))', sc.IRRELEVANT)} and not {_any('lower(left(content, 500))', sc.RELEVANT_FUNDS)})",
    "row_violations": f"""{_with(ad.CONTENT_SQL)}, v as (select _id, concat_ws(',', case when not regexp_matches(content, '\\S') then 'blank content' end, case when content_size_bytes > 104857600 then 'content too large' end,
        case when content_quality_score not between 0 and 1 then 'quality out of range' end, case when relevance_score * 1.5::double not between 0 and 1 then 'relevance out of range' end, case when processing_time < 0 then 'negative time' end) as violations from content_t)
        select * from v where violations <> ''""",
    "top_per_domain": f"""{_with(ad.CONTENT_SQL)}, d as (select _id, url, content_quality_score, row_number() over (partition by lower(regexp_extract(url, '//([^/?#]*)', 1)) order by content_quality_score desc nulls last, _id) as r from content_t)
        select _id, url, content_quality_score from d where r = 1""",
    "top_per_query": f"""{_with(ad.CONTENT_SQL)}, d as (select _id, query_id, relevance_score, content_quality_score, row_number() over (partition by query_id order by relevance_score desc nulls last, content_quality_score desc nulls last, _id) as place from content_t)
        select * from d where place <= 3""",
    "post_scrape_chain": f"""{_with(ad.CONTENT_SQL)}, d as (select *, row_number() over (partition by lower(regexp_extract(url, '//([^/?#]*)', 1)) order by content_quality_score desc nulls last, _id) as r from content_t)
        select _id, {_COMBINED} as combined_score from d where r = 1 and {_FINAL}""",
    "discovery_chain": f"""{_with(_SITES)}, d as (select *, row_number() over (partition by domain order by relevance_score desc, page_id) as r from sites),
        s as (select page_id, domain, least(1.0::double, least(1.0::double, relevance_score + case when category = 'ai_tools' then 0.1::double else 0.0::double end) + 0.05::double * confidence) as rank_score from d where r = 1)
        select * from s where rank_score >= 0.3::double order by rank_score desc, page_id limit 20""",
    "exact_duplicates": f"with p as (select doc_id, {_PRINT} as fp from documents) select fp, count(*) as copies, min(doc_id) as first_id from p group by fp having count(*) > 1",
    "hash_only": f"""{_with(ad.CONTENT_SQL)} select _id as id, min(_id) over (partition by content) as kept_id, count(*) over (partition by content) as copies, _id <> min(_id) over (partition by content) as duplicate,
        case when count(*) over (partition by content) > 1 then 0.95::double else 1.0::double end as confidence from content_t""",
    "pattern_duplicates": f"""with p as (select doc_id, case when coalesce(text, '') = '' then '' else {_PRINT} end as fp from documents), g as (select *, count(*) over (partition by fp) as n, min(doc_id) over (partition by fp) as first from p)
        select doc_id as id, cast(first as varchar) as duplicates, doc_id as best_id, 1.0::double as confidence from g where n > 1""",
    "session_queries": f"{_with(ad.QUERIES_SQL)} select _id, session_id, created_at from queries_t where user_id = 7 and status = 'processing' order by created_at desc, _id limit 50",
    "quality_gate": f"{_with(ad.CONTENT_SQL)} select _id, content_quality_score from content_t where content_quality_score >= 0.4::double",
    "fetch_stats": f"{_with(ad.REQUESTS_SQL)} select path, count(*) as fetches, max(ts) as last_fetch, 2.0::double as delay from requests_t group by path",
    "content_mapping": f"""{_with(ad.CONTENT_SQL)} select query_id, case when _id % 6 = 3 then url else 'https://nowhere/' || cast(_id as varchar) end as original_url,
        case when _id % 3 > 0 then _id when _id % 6 = 3 then case when _id % 5 = 0 then _id - 1 else _id end end as content_id, _id % 6 = 0 as unresolved from content_t""",
    "query_results": f"""with {ad.SESSIONS_SQL}, {ad.PROCESSED_SQL}, c as (select query_id, count(*) as content_count, string_agg(cast(_id as varchar), ',' order by timestamp desc, _id) as content_ids from (
        select *, row_number() over (partition by query_id order by timestamp desc, _id) as p from content_t) where p <= 50 group by query_id), n as (select query_id, count(*) as n from content_t group by query_id)
        select q._id, q.session_id, q.query_text, c.content_ids, coalesce(n.n, 0) as content_count, c.content_ids as processed_ids, coalesce(n.n, 0) as processed_count, s.query_count as session_queries
        from queries_t q left join c on q._id = c.query_id left join n on q._id = n.query_id left join sessions_t s on q.session_id = s.session_id""",
    "save_content": f"""{_with(ad.CONTENT_SQL)}, h as (select _id, {_HASH} as content_hash from content_t), o as (select content_hash, min(_id) as old from h where _id % 2 = 0 group by 1),
        n as (select *, min(_id) over (partition by content_hash) as first from h where _id % 2 = 1)
        select _id, n.content_hash, coalesce(old, case when _id <> first then first end) as duplicate_of from n left join o on n.content_hash = o.content_hash""",
    "cross_search": f"""with {ad.QUERIES_SQL}, {ad.CONTENT_SQL} select _id, 'query' as kind from queries_t where list_contains(regexp_split_to_array(lower(query_text), '[^\\p{{L}}\\p{{N}}]+'), 'view')
        union all select _id, 'content' from content_t where list_contains(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), 'license')""",
    "update_status": f"{_with(ad.QUERIES_SQL)} select _id, case when _id % 100 = 0 then 'completed' else status end as status, case when _id % 100 = 0 then 1.5::double else execution_time end as execution_time, quality_score from queries_t",
    "retention_queries": f"{_with(ad.QUERIES_SQL)} select _id, created_at < timestamp '2024-02-10' - interval 30 day and status in ('completed', 'failed') as deleted from queries_t",
    "retention_content": f"{_with(ad.CONTENT_SQL)} select _id, timestamp < timestamp '2024-01-01 10:00:00' and _id % 5 = 0 as deleted from content_t",
    "retention_counts": f"""{_with(ad.SESSIONS_SQL)} select 'queries' as "table", count(*) filter (created_at < timestamp '2024-02-10' - interval 30 day) as deleted, count(*) filter (created_at >= timestamp '2024-02-10' - interval 30 day) as kept from queries_t
        union all select 'sessions', count(*) filter (start_time < timestamp '2024-02-10' - interval 20 day), count(*) filter (start_time >= timestamp '2024-02-10' - interval 20 day) from sessions_t""",
    "archive_split": f"""{_with(ad.PROCESSED_SQL)} select original_content_id, query_id, processing_timestamp, 'live' as part from processed_t where processing_timestamp >= timestamp '2024-01-01 08:00:00'
        union all select original_content_id, query_id, processing_timestamp, 'archive' from processed_t where processing_timestamp < timestamp '2024-01-01 08:00:00'
        union all select original_content_id, -1, processing_timestamp, 'archive' from processed_t where processing_timestamp >= timestamp '2024-01-01 08:00:00' and original_content_id % 3 = 0""",
    "cache_latest": f"""{_with(ad.QUERIES_SQL)}, l as (select query_text, arg_max(_id, created_at) as _id, max(created_at) as created_at from queries_t group by query_text)
        select query_text, _id from l where created_at + interval 7 day > timestamp '2024-01-30'""",
}

_MEMBERS = f"""{_with(ad.CONTENT_SQL)}, h as (select _id, url, title, timestamp, {_HASH} as content_hash from content_t), d as (select *, min(_id) over (partition by content_hash) as duplicate_of from h),
    m as (select * from d where _id <> duplicate_of), g as (select duplicate_of, count(*) as duplicate_count, min(_id) as first_id, max(_id) as last_id, min(timestamp) as first_seen from m group by 1 order by 2 desc, 1 limit 20)"""
SQL["duplicate_groups"] = f"{_MEMBERS} select * from g"
SQL["duplicate_members"] = f"{_MEMBERS} select duplicate_of, _id as member, url, title, timestamp, duplicate_count, first_id, last_id, first_seen from m join g using (duplicate_of)"
_NEAR = f"""p as (select doc_id, case when coalesce(text, '') = '' then '' else {_PRINT} end as fp from documents), r as (select min(doc_id) as id from p group by fp),
    d as (select id, length(coalesce(text, '')) as chars, regexp_extract_all(lower(coalesce(text, '')), '\\S+') as t from r join documents on id = doc_id), i as (select id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) as k from d),
    s as (select distinct id, array_to_string(list_slice(t, k, k + 4), ' ') as g from i), n as (select id, count(*) as n from s group by id),
    c as (select a.id as id_a, b.id as id_b, count(*) as common from s a join s b on a.g = b.g and a.id < b.id group by all),
    near as (select id_a, id_b, common / (x.n + y.n - common)::double as jaccard, 1.0::double - abs(da.chars - db.chars) / greatest(1, da.chars, db.chars)::double as length_score
    from c join n x on x.id = id_a join n y on y.id = id_b join d da on da.id = id_a join d db on db.id = id_b where common / (x.n + y.n - common)::double >= 0.8)"""
SQL["near_duplicates"] = SQL["near_pairs"] = f"with {_NEAR} select * from near"
SQL["near_classes"] = f"""with recursive {_NEAR}, both_ways as (select id_a as a, id_b as b from near union all select id_b, id_a from near),
    reach(id, other) as (select id, id from r union select reach.id, b from reach join both_ways on other = a), parts as (select id, min(other) as class_id from reach group by id),
    copies as (select doc_id as id, min(doc_id) over (partition by fp) as text_id from p) select copies.id, text_id, class_id from copies join parts on parts.id = text_id"""
_FEW = "_id % 50 = 0 and created_at < timestamp '2024-01-10'"
SQL["stored_update"] = f"{_with(ad.QUERIES_SQL)} select _id, case when {_FEW} then 'cancelled' else status end as status, case when {_FEW} and _id % 100 = 0 then 3.0::double else execution_time end as execution_time from queries_t"
SQL["stored_retention"] = f"{_with(ad.QUERIES_SQL)} select _id, status, created_at from queries_t where not (created_at < timestamp '2024-01-11 12:00:00' and status in ('completed', 'failed'))"
SQL["stored_archive"] = f"{_with(ad.QUERIES_SQL)} select _id, created_at, case when created_at < timestamp '2024-01-11 18:00:00' then 'archive' else 'live' end as part from queries_t"
_STEM = "regexp_replace(regexp_replace(regexp_replace({}, '^(.{{2,}})ies$', '\\1y'), '^(.{{2,}}[^sui])s$', '\\1'), '^(.{{3,}})(ing|ed)$', '\\1')"
_WORDS = f"""w as (select doc_id as _id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ws from documents),
    x as (select _id, list_distinct(list_transform(ws, lambda x: {_STEM.format("x")})) as stems, contains(' ' || array_to_string(ws, ' ') || ' ', ' of the ') as said from w)"""
_matched = lambda *ws: f"len(list_intersect(stems, [{', '.join(_STEM.format(repr(w)) for w in ws)}]))"
SQL["search_any"] = f"with {_WORDS} select _id, {_matched('worthless', 'track', 'thing')} as matched from x where matched > 0"
SQL["search_phrase"] = f"with {_WORDS} select _id, {_matched('thing')} + 1 as matched from x where said"
SQL["search_excluded"] = f"with {_WORDS} select _id, 1 as matched from x where {_matched('thing')} > 0 and {_matched('worthless')} = 0 and not said"
SQL["search_stems"] = f"with {_WORDS} select _id, {_matched('contacts', 'calling', 'worthlessed')} as matched from x where matched > 0"
_SHAPES = f"""f as (select doc_id as id, case when coalesce(text, '') = '' then '' else {_PRINT} end as fp, coalesce(text, '') as text from documents),
    c as (select id, fp, length(text) as length, len(list_filter(str_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S'))) as paragraphs, len(list_filter(str_split(text, '.'), lambda x: regexp_matches(x, '\\S'))) as sentences,
      len(regexp_extract_all(text, '\\S+')) as words from f),
    shapes as (select id, fp, length, words, md5('p' || paragraphs || '_s' || sentences || '_w' || words) as structure_fp from c)"""
SQL["structure_fingerprints"] = f"with {_SHAPES} select id, structure_fp, length, words from shapes"
SQL["candidate_pairs"] = f"""with {_SHAPES}, t as (select * from shapes where id in (select min(id) from shapes group by fp))
    select a.id as id_a, b.id as id_b, greatest(a.length, b.length) as longer, abs(a.length - b.length) as difference from t a join t b using (structure_fp)
    where a.id < b.id and abs(a.length - b.length) <= 0.2 * greatest(a.length, b.length) and abs(a.words - b.words) <= 0.25 * greatest(a.words, b.words)"""
# no two rows of content have a URL in common
_COMPONENTS = f"""{_NEAR}, copies as (select doc_id as id, min(doc_id) over (partition by fp) as first_id from p),
    edges as (select first_id as a, id as b, 1.0::double as score from copies where id <> first_id union all select id_a, id_b, length_score from near), both_ways as (select a, b, score from edges union all select b, a, score from edges),
    reach(id, other) as (select doc_id, doc_id from documents union select r.id, w.b from reach r join both_ways w on r.other = w.a),
    parts as (select id, min(other) as component from reach group by id), sure as (select a as id, max(score) as confidence from both_ways group by a),
    sized as (select parts.id, component, count(*) over (partition by component) as group_size,
      first_value(parts.id) over (partition by component order by coalesce(0.4::double + 0.5::double * cast(l.quality as double), -1.0) desc, parts.id) as best_id from parts left join labels l on l.doc_id = parts.id)"""
SQL["duplicate_components"] = f"""with recursive {_COMPONENTS} select sized.id, component, group_size, best_id, coalesce(confidence, 0.0::double) as confidence, case when group_size > 1 then 'Keep ' || best_id || ', remove others' end as advice
    from sized left join sure on sized.id = sure.id"""
SQL["best_version"] = f"with recursive {_COMPONENTS} select id as _id, 0.4::double + 0.5::double * cast(quality as double) as content_quality_score from sized left join labels on doc_id = id where id = best_id"
SQL["similar_content"] = f"""with {ad.CONTENT_SQL}, {_NEAR}, copies as (select doc_id as id, min(doc_id) over (partition by fp) as first_id from p),
    links as (select distinct first_id as f, first_id as t, 1.0::double as score from copies union all select id_a, id_b, length_score from near union all select id_b, id_a, length_score from near),
    found as (select c.id as content_id, m.id as member, l.score, row_number() over (partition by c.id order by l.score desc, m.id) as place from copies c join links l on l.f = c.first_id join copies m on m.first_id = l.t
      where c.id % 20 = 0 and c.id <> m.id and l.score >= 0.3)
    select content_id, place, member, score, url from found join content_t on _id = member where place <= 10"""
SQL["title_relevance"] = f"""{_with(ad.USER_QUERIES_SQL)}, l as (select conv_id, turn, lower(left(raw_query, 20)) as title, lower(left(raw_query, 60)) as body, list_filter(regexp_split_to_array(lower(raw_query), '\\s+'), lambda w: length(w) > 2) as terms,
    case when conv_id % 2 = 0 then [{_list(sc.RESULT_WORDS["ai_tools"])}] else [{_list(sc.RESULT_WORDS["mutual_funds"])}] end as own from user_queries_t),
    n as (select conv_id, turn, len(list_filter(list_concat(list_distinct(terms), own), lambda w: contains(title, w))) as t, coalesce(list_sum(list_transform(list_concat(terms, own), lambda w: (length(body) - length(replace(body, w, ''))) // length(w))), 0) as k,
    len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) as words from l)
    select conv_id, turn, case when t >= 3 then 0.9::double when t = 2 then 0.7::double when t = 1 then 0.5::double else 0.3::double end as title_score,
    case when k / words::double > 0.1 or k >= 5 then 0.8::double when k / words::double > 0.05 or k >= 3 then 0.6::double when k / words::double > 0.02 or k >= 1 then 0.4::double else 0.2::double end as snippet_score from n"""
