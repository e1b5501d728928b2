"""User queries as columns: sanitising, validation, keyword categories, fallback attributes, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip

# Keywords of the two categories, those that weigh more, and patterns of harmful queries.
KEYWORDS = {
    "ai_tools": [
        "ai", "artificial intelligence", "machine learning", "ml", "neural network", "deep learning", "nlp", "computer vision", "image generation", "text generation",
        "code generation", "chatbot", "automation", "algorithm", "model", "training", "inference", "prediction", "classification", "regression", "clustering",
    ],
    "mutual_funds": [
        "mutual fund", "mutual funds", "investment", "invest", "finance", "financial", "money", "portfolio", "asset", "assets", "equity", "equities", "debt",
        "hybrid", "sector", "index", "etf", "etfs", "dividend", "dividends", "capital gains", "risk", "return", "returns", "volatility", "diversification",
        "financial planning", "retirement", "tax saving", "wealth creation", "investing", "investor", "investors", "fund", "funds", "stocks", "bonds", "securities",
        "vanguard", "fidelity", "schwab", "morningstar", "expense ratio", "nav", "net asset value", "beginner", "beginners", "low risk", "high risk",
    ],
}
PRIORITY = {"ai_tools": ["ai", "artificial intelligence", "machine learning", "ml"], "mutual_funds": ["mutual fund", "mutual funds", "investment", "finance"]}
HARMFUL = (r"(?i)<script[^>]*>.*?</script>", r"(?i)javascript:", r"(?i)data:text/html", r"(?i)vbscript:")
KEPT_CHARS = r"\w\s\-.,!?:;()\[\]{}@#$%&*+=|\\/\"'`~"
# End of the fixed values.

REVIEW_BELOW = 0.7


def sanitise(text: Column) -> Column:
    """Without NUL, tags and characters that are not kept; single spaces."""
    out = F.regexp_replace(F.translate(text, "\x00", ""), "<[^>]+>", "")
    return strip(F.regexp_replace(F.regexp_replace(out, f"(?U)[^{KEPT_CHARS}]", ""), r"(?U)\s+", " "))


def reject_reason(text: Column, most: int = 1000) -> Column:
    """Why a query text is rejected; null if it is not."""
    stripped = strip(F.coalesce(text, F.lit("")))
    harmful = sanitise(stripped).rlike("|".join(f"(?:{p})" for p in HARMFUL))
    return F.when(stripped == "", "empty").when(F.length(stripped) < 3, "too_short").when(F.length(stripped) > most, "too_long").when(harmful, "harmful")


def keyword_text(text: Column) -> Column:
    """Lower-case text in which each word stands between single spaces, and all that is neither word nor space is a word of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)[^\w ]", " \n "), F.lit(" "))


def keyword_hits(text: Column, words: Column, keywords: list[str]) -> Column:
    """Which keywords come in a text as whole words; `text` from `keyword_text`, `words` its words.

    Single words are looked up together; keywords of several words, with one space between, are parts of the text.
    """
    single = F.array_intersect(words, F.array(*[F.lit(k) for k in keywords if " " not in k]))
    phrases = [F.when(text.contains(f" {k} "), F.lit(k)) for k in keywords if " " in k]
    return F.concat(single, F.array_compact(F.array(*phrases))) if phrases else single


def _score(found: Column, category: str) -> Column:
    """Confidence of one category out of its keywords that were found; null without one."""
    n = F.size(found)
    heavy = F.size(F.array_intersect(found, F.array(*map(F.lit, PRIORITY[category]))))
    base = F.least(F.lit(0.9), n / F.lit(float(max(len(KEYWORDS[category]), 10))) * F.lit(2.0) + F.lit(0.3))
    return F.when(n > 0, F.least(F.lit(0.95), base + F.lit(0.2) * heavy))


def categorise(df: DataFrame, query: str, entities: str | None = None) -> DataFrame:
    """Adds category, confidence and needs_review. A tie goes to ai_tools; null texts are general."""
    text = F.lower(F.coalesce(query, F.lit("")) if isinstance(query, str) else query)
    if entities is not None:
        text = F.concat(text, F.lit(" "), F.lower(F.array_join(F.coalesce(entities, F.array()), " ")))
    df = df.withColumn("__text", keyword_text(text)).withColumn("__words", F.split("__text", " "))
    found = lambda category: keyword_hits(F.col("__text"), F.col("__words"), KEYWORDS[category])
    df = df.withColumns({"__ai": found("ai_tools"), "__mf": found("mutual_funds")})
    df = df.withColumns({"__ai": _score(F.col("__ai"), "ai_tools"), "__mf": _score(F.col("__mf"), "mutual_funds")})
    best = F.greatest("__ai", "__mf")
    category = F.when(best.isNull(), "general").when(F.col("__ai") >= F.coalesce("__mf", F.lit(0.0)), "ai_tools").otherwise("mutual_funds")
    confidence = F.when(best.isNull(), 0.4).when(best < 0.6, F.least(F.lit(0.8), best + F.lit(0.2))).otherwise(best)
    df = df.withColumns({"category": category, "confidence": confidence}).drop("__text", "__words", "__ai", "__mf")
    return df.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)


# Parts of words that name a category, values of attributes that a text does not give, and tips.
AI_PARTS = ("ai", "artificial intelligence", "tool", "generation")
FUND_PARTS = ("mutual fund", "investment", "finance", "money")
TOOL_DEFAULTS = {"use_case": "general purpose", "budget_range": "medium", "technical_expertise": "beginner"}
FUND_DEFAULTS = {"risk_level": "medium", "time_horizon": "long-term", "amount_range": "medium", "investment_goal": "wealth creation"}
UNSURE_TIP = "Consider providing more specific details for better results"
TIPS = {
    "ai_tools": ["Specify your budget range for more targeted recommendations", "Mention your technical expertise level"],
    "mutual_funds": ["Consider your risk tolerance and investment timeline", "Specify your investment amount range"],
}
LAST_TIP = "Ask follow-up questions for more detailed information"
REPHRASE_TIP = "Please try rephrasing your query"
# End of the fixed values.


def _has(text: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | text.contains(p)
    return hit


def fallback_domain(text: Column) -> Column:
    """A category from parts of words alone."""
    low = F.lower(text)
    return F.when(_has(low, *AI_PARTS), "ai_tools").when(_has(low, *FUND_PARTS), "mutual_funds").otherwise("general")


def fallback_attributes(text: Column, category: Column) -> Column:
    """What is read off the text where nothing else gives it: a struct for each category, null for the others."""
    low = F.lower(text)
    tool = F.when(_has(low, "image", "logo"), "image generation").when(_has(low, "text", "writing"), "text generation").when(_has(low, "code", "programming"), "code generation").otherwise("general")
    fund = F.when(_has(low, "debt", "bond"), "debt").when(_has(low, "hybrid", "balanced"), "hybrid").otherwise("equity")
    given = lambda values: [F.lit(v).alias(k) for k, v in values.items()]
    none = F.array().cast("array<string>")
    tools = F.struct(tool.alias("tool_type"), none.alias("features_required"), *given(TOOL_DEFAULTS))
    funds = F.struct(fund.alias("investment_type"), *given(FUND_DEFAULTS))
    general = F.struct(F.lit("query_processing").alias("intent"), none.alias("entities"), F.lit("").alias("context"), F.lit("general").alias("category"))
    return F.struct(*[F.when(category == k, v).alias(k) for k, v in (("ai_tools", tools), ("mutual_funds", funds), ("general", general))])


def suggestions(category: Column, confidence: Column) -> Column:
    """A tip for unsure queries, two for each of the special categories, and one for all."""
    tips = [F.when(confidence < REVIEW_BELOW, UNSURE_TIP), *[F.when(category == k, t) for k, own in TIPS.items() for t in own], F.lit(LAST_TIP)]
    return F.filter(F.array(*tips), lambda t: t.isNotNull())


def parsed_queries(df: DataFrame, query: str) -> DataFrame:
    """Validated, categorised and assembled; rejected texts come out with the reason, unknown and sure of nothing."""
    out = df.withColumn("reject_reason", reject_reason(F.col(query)))
    out = categorise(out.withColumn("query_text", F.when(F.col("reject_reason").isNull(), sanitise(F.col(query)))), "query_text")
    good = F.col("reject_reason").isNull()
    base = lambda text, confidence, category: F.struct(text.alias("query_text"), confidence.alias("confidence_score"), category.alias("category"))
    failed = F.array(F.concat(F.lit("Processing failed: "), F.col("reject_reason")), F.lit(REPHRASE_TIP))
    return out.withColumns({
        "base_result": F.when(good, base(F.col("query_text"), F.col("confidence"), F.col("category"))).otherwise(base(F.col(query), F.lit(0.0), F.lit("unknown"))),
        "attributes": F.when(good, fallback_attributes(F.col("query_text"), F.col("category"))),
        "suggestions": F.when(good, suggestions(F.col("category"), F.col("confidence"))).otherwise(failed),
    })
