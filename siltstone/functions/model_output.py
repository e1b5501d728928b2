"""Tables of model prompts and answers: rendering, JSON out of raw text, scores, fallbacks, answers from the best results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.scores import clamp

SITE = "array<struct<url:string,title:string,description:string,relevance_score:double>>"
# What answers are read off and made of.
ANSWERING = ["fund", "ticker", "vfiax", "fxai", "recommend", "best"]
SPECIFIC = ["fund", "ticker", "expense", "minimum", "%"]
SPECIFIC_ADVICE = [*SPECIFIC, "vfiax", "fxai"]
RECOMMENDED_KINDS = ["mutual_fund", "product", "ai_tool"]
OFF_TOPIC = ["irrelevant", "does not contain", "cannot provide", "not relevant"]
OFF_TOPIC_PAGE = [*OFF_TOPIC, "donation request"]
OFF_TOPIC_SUMMARY = [*OFF_TOPIC_PAGE, "not about", "unrelated"]
KEY_ADVICE = "Here are the key recommendations: "
NOTHING_RELEVANT = (
    "I couldn't find relevant content to answer your query. The sources I checked don't contain information about your specific question. "
    "Please try rephrasing your query or checking different sources."
)
# End of the fixed values.
ENTITY = "array<struct<name:string,type:string,ticker:string,expense_ratio:string,minimum_investment:string,risk_level:string>>"
FUND = "array<struct<name:string,ticker:string,expense_ratio:string,minimum_investment:string>>"


def prompts(rows: DataFrame, template: str, fields: dict[str, int]) -> DataFrame:
    """M1: adds `prompt`: the template with `{name}` replaced by the field's first characters; null fields are empty."""
    out = F.lit(template)
    for name, most in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.substr(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(1), F.lit(most)))
    return rows.withColumn("prompt", out)


def balanced(text: str | None) -> str | None:
    """The first object in braces that close, strings left out of the count; null without one.

    A brace that never closes is passed over. One scan remembers the open braces, and the first of those that close is
    the answer, so that work grows with the text alone.
    """
    opened: list[int] = []
    found: tuple[int, int] | None = None
    quoted = skip = False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"' and opened:
            quoted = not quoted
        elif quoted:
            continue
        elif c == "{":
            opened.append(i)
        elif c == "}" and opened:
            start = opened.pop()
            if not opened:
                return text[start : i + 1]
            if found is None or start < found[0]:
                found = (start, i + 1)
    return text[found[0] : found[1]] if found else None


def balanced_json(raw: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(balanced)

    return F.pandas_udf(run, "string")(raw)


def json_of(raw: Column) -> Column:
    """M2: a fenced block, else balanced braces, else all."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1), F.lit(""))
    # a function in Python, only for texts without a fence
    return F.coalesce(fenced, balanced_json(F.when(fenced.isNull() & raw.contains("{"), raw)), raw)


def braces(raw: Column, most: int) -> Column:
    """M3: from the first `{` to the last `}`; null if there is none or it is longer than `most`."""
    first, last = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    found = F.when((first > 0) & raw.contains("}") & (last > first), F.substr(raw, first, last - first + 1))
    return F.when(F.length(found) <= most, found)


def parse_objects(rows: DataFrame, raw: str, schema: str, most: int = 10_000) -> DataFrame:
    """Adds `parsed`, null where the text holds no JSON of the schema, and `error`."""
    body = F.when(F.length(raw) <= most, json_of(F.col(raw)))
    out = rows.withColumn("__j", body)
    out = out.withColumn("parsed", F.when(F.try_parse_json("__j").isNotNull(), F.from_json("__j", schema, {"mode": "PERMISSIVE"})))
    why = F.when(F.length(raw) > most, "too_long").when(F.col("parsed").isNull(), "no_json")
    error = F.when(why.isNotNull(), F.struct(why.alias("error_type"), F.substr(F.col(raw), F.lit(1), F.lit(200)).alias("raw_start")))
    return out.withColumn("error", error).drop("__j")


def error_class(message: Column) -> Column:
    """Authentication, quota, connection or other, in lower case throughout."""
    low = F.lower(message)
    return F.when(low.contains("api key"), "auth").when(low.contains("quota"), "quota").when(low.contains("network") | low.contains("connection"), "connection").otherwise("other")


def error_counts(parsed: DataFrame) -> DataFrame:
    """M14."""
    return parsed.where(F.col("error").isNotNull()).groupBy(F.col("error.error_type").alias("error_type")).agg(F.count(F.lit(1)).alias("count"))


def sites(rows: DataFrame, raw: str, key: str) -> DataFrame:
    """M4: a row for each site of a list, bare or under one of four names; scores clamped, rows without a URL dropped."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.lit("")), F.col(raw))
    parse = lambda c: F.from_json(c, SITE)
    lists = [parse(F.when(body.startswith("["), body)), *[parse(F.get_json_object(F.when(F.trim(body).startswith("{"), body), f"$.{n}")) for n in ("sites", "results", "data", "websites")], parse(F.regexp_extract(raw, r"(?s)(\[.*\])", 1))]
    found = rows.select(key, F.explode(F.coalesce(*lists)).alias("s"))
    return found.where(F.coalesce("s.url", F.lit("")) != "").select(key, "s.url", "s.title", clamp(F.coalesce("s.relevance_score", F.lit(0.5))).alias("relevance_score"))


def required(rows: DataFrame, defaults: dict[str, object], scores: tuple[str, ...] = ()) -> DataFrame:
    """Nulls take their defaults, scores come between 0 and 1."""
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out.withColumns({c: clamp(F.coalesce(F.col(c).cast("double"), F.lit(0.5))) for c in scores})


def valid_structures(rows: DataFrame, confidences: str, categories: str) -> DataFrame:
    """Confidences out of range are 0.5, blank categories go."""
    fixed = F.transform_values(confidences, lambda _, v: F.when(v.between(0.0, 1.0), v).otherwise(F.lit(0.5)))
    return rows.withColumns({confidences: fixed, categories: F.filter(categories, lambda c: F.trim(c) != "")})


def focused(rows: DataFrame, focus: str, categories: str = "categories") -> DataFrame:
    """The focus comes first among the categories."""
    return rows.withColumn(categories, F.concat(F.array(F.lit(focus)), F.col(categories)))


def insight_confidence(filled: Column, fields: int, quality: Column, theme_matches: Column) -> Column:
    """M5: completeness, mean quality, and 0.1 if a theme has a term of the query."""
    return clamp(F.lit(0.5) + F.lit(0.2) * filled / F.lit(float(fields)) + F.lit(0.2) * F.coalesce(quality, F.lit(0.0)) + F.least(F.lit(0.1), F.lit(0.1) * theme_matches))


def insight_relevance(matches: Column, same_category: Column, quality: Column) -> Column:
    """M6."""
    return clamp(F.lit(0.5) + F.least(F.lit(0.2) * matches, F.lit(0.3)) + F.when(same_category, 0.1).otherwise(0.0) + F.lit(0.1) * F.coalesce(quality, F.lit(0.0)))


def summary_confidence(filled: Column, fields: int, text: Column, points: Column) -> Column:
    """M7."""
    n = F.length(text)
    return clamp(F.lit(0.5) + F.lit(0.2) * filled / F.lit(float(fields)) + F.when(n > 50, 0.1).otherwise(0.0) + F.when(n > 100, 0.1).otherwise(0.0) + F.least(F.lit(0.05) * points, F.lit(0.2)))


def cut_summary(text: Column, confidence: Column, most: int) -> Column:
    """M8: a text that is too long is cut to `most` characters, dots included, and is less sure."""
    long = F.length(text) > most
    cut = F.concat(F.substr(text, F.lit(1), F.lit(most - 3)), F.lit("..."))
    return F.struct(F.when(long, cut).otherwise(text).alias("text"), F.when(long, F.greatest(F.lit(0.1), F.lit(0.8) * confidence)).otherwise(confidence).alias("confidence"), F.when(long, F.lit(most)).otherwise(F.length(text)).alias("original_length"))


def salvaged_lines(text: Column, most: int = 5) -> Column:
    """M9: lines of some length, without list marks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 10), 1, most)


def fallback_insights(query: Column, category: Column) -> Column:
    """What stands for insights: of middling scores, to be looked at by hand."""
    half = F.lit(0.5)
    return F.struct(
        F.array(F.concat(F.lit("Content related to "), query)).alias("themes"), half.alias("relevance_score"), F.create_map(F.lit("readability"), half, F.lit("information_density"), half, F.lit("coherence"), half).alias("quality_metrics"),
        F.array(F.lit("Analysis failed, manual review recommended")).alias("recommendations"), half.alias("information_accuracy"), half.alias("source_reliability"),
        F.lit(0.3).alias("confidence_score"), F.array().cast("array<string>").alias("key_entities"), F.array(category).alias("categories"),
    )


def fallback_summary(query: Column) -> Column:
    """What stands for a summary."""
    return F.struct(
        F.concat(F.lit("Content related to "), query).alias("executive_summary"), F.array(F.concat(F.lit("Content covers "), query, F.lit(" topics"))).alias("key_points"),
        F.concat(F.lit("This content appears to be related to "), query, F.lit(".")).alias("detailed_summary"), F.array(query).alias("main_topics"), F.lit("neutral").alias("sentiment"), F.lit(0.3).alias("confidence_score"),
    )


def fallback_structured(category: Column) -> Column:
    """What stands for structured data."""
    return F.struct(
        F.array().cast(ENTITY).alias("entities"), F.create_map(F.lit("extraction_failed"), F.lit(True)).alias("key_value_pairs"), F.array(category).alias("categories"),
        F.create_map(F.lit("extraction_failed"), F.lit(0.1)).alias("confidence_scores"),
    )


def fallback_record(query: Column, category: Column, content: Column, quality: Column, error: Column) -> Column:
    """What stands for a whole processed row: its text as it is, fallbacks of all parts, half the quality, the error."""
    return F.struct(
        content.alias("cleaned_content"), fallback_summary(query).alias("summary"), fallback_structured(category).alias("structured_data"), fallback_insights(query, category).alias("ai_insights"),
        (F.coalesce(quality, F.lit(0.0)) * F.lit(0.5)).alias("enhanced_quality_score"), F.array(error).alias("processing_errors"),
    )


def fallback_analysis(content_id: Column, error: Column) -> Column:
    """The duplicate analysis of a row that could not be analysed: none found, sure of nothing."""
    return F.struct(
        content_id.alias("content_id"), F.lit(False).alias("has_duplicates"), F.lit(0.0).alias("duplicate_confidence"), F.array().cast("array<array<string>>").alias("duplicate_groups"),
        F.create_map().cast("map<string,double>").alias("similarity_scores"),
        F.create_map(F.lit("analysis_method"), F.lit("fallback"), F.lit("error"), error, F.lit("confidence_reason"), F.lit("Fallback due to processing error")).alias("processing_metadata"),
    )


def scored_batches(rows: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's scorer over batches of rows."""
    return rows.mapInPandas(scorer, schema)


def _says(text: Column, phrases: list[str]) -> Column:
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    return hit


def _details(head: Column, parts: list[Column]) -> Column:
    """A name with the parts that are there behind a dash."""
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.concat(head, F.lit(" - "), F.array_join(found, ", "))).otherwise(head)


def _led(lead: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value))


def entity_line(e: Column) -> Column:
    """An entity of a kind that can be recommended, with what is known of it; else null."""
    ticker = F.when(F.coalesce(e["ticker"], F.lit("")) != "", F.concat(F.lit("("), e["ticker"], F.lit(")")))
    line = _details(e["name"], [ticker, _led("Expense: ", e["expense_ratio"]), _led("Min: ", e["minimum_investment"]), _led("Risk: ", e["risk_level"])])
    return F.when(e["type"].isin(RECOMMENDED_KINDS) & (F.coalesce(e["name"], F.lit("")) != ""), line)


def fund_line(f: Column) -> Column:
    """A recommended fund; null without a name."""
    head = F.concat(f["name"], F.coalesce(F.concat(_led(" (", f["ticker"]), F.lit(")")), F.lit("")))
    return F.when(F.coalesce(f["name"], F.lit("")) != "", _details(head, [_led("Expense: ", f["expense_ratio"]), _led("Min: ", f["minimum_investment"])]))


def answers(results: DataFrame, query: str = "query_id", most: int = 5) -> DataFrame:
    """An answer per query: direct_answer, recommendations, findings, sources and confidence.

    `results` has query, key, relevance, quality, url, summary, key_points, entities (ENTITY), funds (FUND) and advice
    (array of texts); all but query and key may be null. The `most` best by relevance and quality are read: key points
    and advice with a digit or a word of SPECIFIC are recommendations and others findings, entities and funds are
    recommendations; each counts once, in the order of its result; those that are off the topic go, five of each stay.
    Confidence is the mean relevance of the first three relevant results, 0.1 without any. The longest summary that has
    a word of ANSWERING answers, else the first relevant one, the first recommendations, or the first finding.
    """
    by = [F.desc(F.coalesce("relevance", F.lit(0.0))), F.desc(F.coalesce("quality", F.lit(0.0))), "key"]
    top = results.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*by))).where(F.col("place") <= most)
    relevant = results.where((F.col("relevance") > 0.5) & F.col("summary").isNotNull() & ~_says(F.col("summary"), OFF_TOPIC_SUMMARY))
    relevant = relevant.withColumn("r", F.row_number().over(W.partitionBy(query).orderBy(*by))).where("r <= 3")
    relevant = relevant.groupBy(query).agg(F.avg("relevance").alias("confidence"), F.max(F.when(F.col("r") == 1, F.col("summary"))).alias("relevant_summary"))

    none = F.array().cast("array<string>")
    item = lambda text, kind, lot: F.struct(text.alias("text"), kind.alias("kind"), F.lit(lot).alias("lot"))
    long = lambda xs: F.filter(F.coalesce(F.col(xs), none), lambda x: F.length(x) > 10)
    digits = lambda x: x.rlike(r"(?U)\p{Nd}")
    kind = lambda x, words: F.when(digits(x) | _says(x, words), "advice").otherwise("finding")
    lines = lambda name, schema, line: F.filter(F.transform(F.coalesce(F.col(name), F.array().cast(schema)), line), lambda x: x.isNotNull())
    items = F.concat(
        F.transform(long("key_points"), lambda x: item(x, kind(x, SPECIFIC), 1)), F.transform(lines("entities", ENTITY, entity_line), lambda x: item(x, F.lit("advice"), 2)),
        F.transform(lines("funds", FUND, fund_line), lambda x: item(x, F.lit("advice"), 3)), F.transform(long("advice"), lambda x: item(x, kind(x, SPECIFIC_ADVICE), 4)),
    )
    said = top.select(query, "place", F.posexplode(items).alias("pos", "i")).select(query, "i.*", F.struct("place", "i.lot", "pos").alias("at"))
    # advice that a result repeats from a recommendation before it is no finding
    before = F.min(F.when(F.col("kind") == "advice", F.col("at"))).over(W.partitionBy(query, "text"))
    said = said.withColumn("before", before).where(~((F.col("kind") == "finding") & (F.col("lot") == 4) & F.coalesce(F.col("before") < F.col("at"), F.lit(False))))
    first = said.groupBy(query, "text", "kind").agg(F.min("at").alias("at")).withColumn("good", ~_says(F.col("text"), OFF_TOPIC))
    place = lambda *keys: F.row_number().over(W.partitionBy(query, "kind", *keys).orderBy("at", "text"))
    first = first.withColumns({"n": place(), "m": place("good")}).where((F.col("n") <= 3) | (F.col("good") & (F.col("m") <= 5)))
    listed = lambda which, by: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(by, "text")))), lambda x: x["text"])
    advice = F.col("kind") == "advice"
    lists = first.groupBy(query).agg(
        listed(advice & F.col("good") & (F.col("m") <= 5), "m").alias("recommendations"), listed(~advice & F.col("good") & (F.col("m") <= 5), "m").alias("findings"),
        listed(advice & (F.col("n") <= 3), "n").alias("first_advice"), F.max(F.when(~advice & (F.col("n") == 1), F.col("text"))).alias("first_finding"),
    )

    summary, chars = F.col("summary"), F.length("summary")
    answering = _says(summary, ANSWERING) & (chars > 20)
    three = F.col("place") <= 3
    urls = F.transform(F.array_sort(F.collect_list(F.when(F.col("url") != "", F.struct("place", "url")))), lambda x: x["url"])
    heads = top.groupBy(query).agg(
        F.slice(F.array_distinct(urls), 1, 3).alias("sources"), F.max_by(F.when(answering, summary), F.when(answering, F.struct(chars, -F.col("place")))).alias("answering"),
        F.min(F.when(three, _says(summary, OFF_TOPIC_PAGE))).alias("all_off_topic"), F.min_by(F.when(three & (chars > 0), summary), F.when(three & (chars > 0), F.col("place"))).alias("any_summary"),
    )
    out = heads.join(lists, query, "left").join(relevant, query, "left")
    advised = F.when(F.size("first_advice") > 0, F.concat(F.lit(KEY_ADVICE), F.array_join("first_advice", ", ")))
    rest = F.when(F.col("all_off_topic"), NOTHING_RELEVANT).otherwise(F.coalesce("any_summary", F.lit("")))
    direct = F.coalesce("answering", "relevant_summary", F.when(F.col("confidence").isNotNull(), ""), advised, "first_finding", rest)
    out = out.withColumns({"direct_answer": direct, "recommendations": F.coalesce("recommendations", none), "findings": F.coalesce("findings", none), "confidence": F.coalesce("confidence", F.lit(0.1))})
    return out.select(query, "direct_answer", "recommendations", "findings", "sources", "confidence")
