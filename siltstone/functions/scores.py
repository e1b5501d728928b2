"""Scores as columns: scraping, cleaning, combined ranks, relevance of domains, titles, snippets, urls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains by category, and those that count as authorities.
FRIENDLY = ["httpbin.org", "example.com", "httpstat.us", "jsonplaceholder.typicode.com"]
DOMAINS = {
    "ai_tools": ["producthunt.com", "github.com", "alternativeto.net", "saashub.com", "g2.com", "capterra.com", "techcrunch.com", "venturebeat.com", *FRIENDLY],
    "mutual_funds": [
        "morningstar.com", "vanguard.com", "investor.vanguard.com", "fidelity.com", "schwab.com", "tdameritrade.com", "etrade.com", "yahoo.com/finance",
        "marketwatch.com", "investopedia.com", "nerdwallet.com", "bankrate.com", "thebalance.com", "forbes.com/investing", "bloomberg.com", "reuters.com/finance",
    ],
    "general": ["wikipedia.org", "reddit.com", "stackoverflow.com", "quora.com", "medium.com", "dev.to", "hashnode.dev", "substack.com", *FRIENDLY],
    "documentation": [*FRIENDLY, "docs.python.org", "developer.mozilla.org", "www.w3.org"],
    "tutorial": [*FRIENDLY, "www.w3schools.com", "www.tutorialspoint.com"],
}
AUTHORITIES = ["github.com", "producthunt.com", "stackoverflow.com", "wikipedia.org", "morningstar.com", "vanguard.com", "fidelity.com"]
IRRELEVANT = ["donation", "donate", "fundraising", "support us", "please give", "loading...", "test api", "fake data", "jsonplaceholder", "developer community", "software development", "programming"]
IRRELEVANT_URLS = ["donate", "fundraising", "jsonplaceholder"]
RELEVANT_FUNDS = ["mutual fund", "investment", "finance", "portfolio", "expense ratio", "vanguard", "fidelity", "schwab", "morningstar", "investopedia", "fund", "etf", "index", "diversification", "risk", "return"]
# End of the fixed values.


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def or_half(c: Column) -> Column:
    """The score; 0.5 for null and for 0."""
    return F.when(c.isNull() | (c == 0), 0.5).otherwise(c)


def scrape_quality(quality: Column, relevance: Column, same_category: Column, method: Column, size: Column) -> Column:
    """T15."""
    by_method = F.when(method == "llm_generated", 0.05).when(method == "rule_based", 0.03).otherwise(0.0)
    by_size = F.when(size > 5000, 0.05).when(size > 2000, 0.03).otherwise(0.0)
    return clamp(or_half(quality) + F.lit(0.2) * relevance + F.when(same_category, 0.1).otherwise(0.0) + by_method + by_size)


def combined(quality: Column, relevance: Column, content_type: Column, category: Column) -> Column:
    """T17."""
    kind = F.when(content_type == "article", 0.8).when(content_type == "documentation", 0.7).otherwise(0.5)
    match = F.when(content_type == category, 0.9).otherwise(0.5)
    return or_half(quality) * F.lit(0.3) + or_half(relevance) * F.lit(0.4) + kind * F.lit(0.2) + match * F.lit(0.1)


def pipeline_quality(original: Column, cleaning: Column, accuracy: Column, reliability: Column, summary: Column, extraction: Column) -> Column:
    """`extraction` is a map of confidences; parts that are null add nothing."""
    n = F.size(F.map_values(extraction))
    mean = F.when(n > 0, F.aggregate(F.map_values(extraction), F.lit(0.0), lambda a, x: a + x) / n)
    part = lambda w, c: F.coalesce(F.lit(w) * c, F.lit(0.0))
    return clamp(original + part(0.2, cleaning) + part(0.15, accuracy + reliability) + part(0.1, summary) + part(0.1, mean))


def passes_final_filter(size: Column, quality: Column, relevance: Column) -> Column:
    """A score that is null or 0 passes."""
    low = lambda c, least: F.coalesce((c != 0) & (c < least), F.lit(False))
    return (size >= 500) & ~low(quality, 0.3) & ~low(relevance, 0.2)


def _any_of(text: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def irrelevant(url: Column, title: Column, description: Column, content: Column, category: Column) -> Column:
    """By URL, title, first 500 characters and description, with words that excuse texts on funds."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    funds = category == "mutual_funds"
    excused = lambda c: funds & _any_of(c, RELEVANT_FUNDS)
    t, p, d = low(title), low(F.substr(content, F.lit(1), F.lit(500))), low(description)
    by_title = _any_of(t, IRRELEVANT) & ~excused(t)
    return _any_of(low(url), IRRELEVANT_URLS) | by_title | (funds & _any_of(p, IRRELEVANT) & ~excused(p)) | (funds & _any_of(d, IRRELEVANT) & ~excused(d))


def domain_relevance(domain: Column, category: Column, trusted: Sequence[str] = (), custom: dict[str, list[str]] | None = None) -> Column:
    """The category's own list may be added to."""
    own = F.lit(False)
    for name, domains in DOMAINS.items():
        own = own | ((category == name) & domain.isin([*domains, *(custom or {}).get(name, [])]))
    gain = lambda c, by: F.when(c, F.lit(by)).otherwise(0.0)
    return clamp(F.lit(0.5) + gain(domain.isin(list(trusted)) if trusted else F.lit(False), 0.2) + gain(own, 0.2) + gain(domain.isin(AUTHORITIES), 0.1))


def site_rank(relevance: Column, same_category: Column, confidence: Column) -> Column:
    """W2."""
    first = F.least(F.lit(1.0), relevance + F.when(same_category, 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), first + F.lit(0.05) * confidence)


# What the relevance of a result to its category is read off, by category: domains, parts of domains, words.
RESULT_DOMAINS = {
    "ai_tools": ["github.com", "huggingface.co", "openai.com", "anthropic.com", "replicate.com", "stability.ai", "cohere.com", "together.ai", "perplexity.ai", "claude.ai", "chatgpt.com", "bard.google.com"],
    "mutual_funds": ["morningstar.com", "moneycontrol.com", "valueresearchonline.com", "etmoney.com", "groww.in", "zerodha.com", "paytmmoney.com", "vanguard.com", "fidelity.com", "schwab.com", "blackrock.com"],
}
RESULT_HINTS = {"ai_tools": ["ai", "ml", "tech", "dev", "code"], "mutual_funds": ["finance", "money", "invest", "fund", "bank"]}
RESULT_WORDS = {
    "ai_tools": ["ai", "agent", "model", "llm", "neural", "machine learning", "deep learning", "nlp", "generative", "transformer", "gpt", "claude", "coding", "development", "programming", "software"],
    "mutual_funds": ["fund", "nav", "return", "equity", "debt", "sip", "mutual", "investment", "portfolio", "expense ratio", "aum", "scheme", "retirement", "planning", "index", "etf"],
}
# End of the fixed values.
SNIPPET_CHARS = 500


def query_terms(query: Column) -> Column:
    """Words of a query of over two characters, in lower case, as often as they come."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 2)


def _own_words(category: Column) -> Column:
    """The words of a category, none for others."""
    out = F.array().cast("array<string>")
    for name, own in RESULT_WORDS.items():
        out = F.when(category == name, F.array(*map(F.lit, own))).otherwise(out)
    return out


def title_relevance(title: Column, query: Column, category: Column) -> Column:
    """By how many different terms of the query and words of the category the title has in it; 0 for no title."""
    low = F.lower(title)
    inside = lambda words: F.size(F.filter(words, lambda w: F.contains(low, w)))
    n = inside(F.array_distinct(query_terms(query))) + inside(_own_words(category))
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).when(n >= 3, 0.9).when(n == 2, 0.7).when(n == 1, 0.5).otherwise(0.3)


def snippet_relevance(content: Column, query: Column, category: Column, most: int = SNIPPET_CHARS) -> Column:
    """By how often terms and words of the category stand in the first `most` characters, in all and to a word."""
    text = F.lower(F.substr(F.coalesce(content, F.lit("")), F.lit(1), F.lit(most)))
    # an empty term can not come: query_terms and the words of categories are longer
    times = lambda w: ((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("int")
    n = F.aggregate(F.concat(query_terms(query), _own_words(category)), F.lit(0), lambda a, w: a + times(w))
    words = F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))
    density = n / words
    return F.when(words == 0, 0.0).when((density > 0.1) | (n >= 5), 0.8).when((density > 0.05) | (n >= 3), 0.6).when((density > 0.02) | (n >= 1), 0.4).otherwise(0.2)


def url_relevance(domain: Column, category: Column) -> Column:
    """A known domain without `www.`, one that holds or is held by a known one, one with a hint; 0.5 for general queries."""
    host = F.regexp_replace(F.lower(domain), r"^www\.", "")
    out = F.lit(0.5)
    for name, known in RESULT_DOMAINS.items():
        near = _any_of(host, known)
        for d in known:
            near = near | F.contains(F.lit(d), host)
        out = F.when(category == name, F.when(host.isin(known), 0.9).when(near, 0.8).when(_any_of(host, RESULT_HINTS[name]), 0.6).otherwise(0.3)).otherwise(out)
    return out


def overall_relevance(url: Column, title: Column, snippet: Column) -> Column:
    """T30."""
    return F.lit(0.3) * url + F.lit(0.3) * title + F.lit(0.4) * snippet


def relevance_issues(url: Column, title: Column, snippet: Column) -> Column:
    """The parts that score under 0.5, with their scores."""
    low = lambda name, c: F.when(c < 0.5, F.concat(F.lit(f"Low {name} relevance: "), F.format_number(c, 2)))
    return F.array_compact(F.array(low("URL", url), low("title", title), low("content", snippet)))


def extraction_quality(content: Column, title: Column, description: Column, author: Column, date: Column) -> Column:
    """H12."""
    n = F.length(content)
    has = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 0.1).otherwise(0.0)
    size = F.when(n > 1000, 0.2).when(n > 500, 0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + size + has(title) + has(description) + has(author) + has(date) + F.when(content.contains("\n\n"), 0.1).otherwise(0.0))


def insight_quality(themes: Column, query: Column, confidence: Column, relevance: Column, recommendations: Column) -> Column:
    """Mean of four bands: themes with a word of the query, confidence, relevance, number of recommendations."""
    terms = F.array_remove(F.split(F.lower(query), r"\s+"), "")
    matched = F.exists(themes, lambda t: F.exists(terms, lambda w: F.contains(F.lower(t), w)))
    band = lambda c: F.when(F.coalesce(c, F.lit(0.0)) >= 0.7, 0.9).when(F.coalesce(c, F.lit(0.0)) >= 0.5, 0.6).otherwise(0.3)
    n, m = F.coalesce(F.size(themes), F.lit(0)), F.coalesce(F.size(recommendations), F.lit(0))
    by_theme = F.when(n <= 0, 0.0).when(matched, 0.8).otherwise(0.4)
    by_advice = F.when(m <= 0, 0.0).when(m >= 2, 0.8).otherwise(0.5)
    return (by_theme + band(confidence) + band(relevance) + by_advice) / F.lit(4.0)


#: Kinds of entity that fit a category.
ENTITY_KINDS = {"ai_tools": ["product", "company", "tool", "model", "technology"], "mutual_funds": ["fund", "company", "scheme", "investment", "financial"]}


def structured_quality(kinds: Column, pairs: Column, category: Column) -> Column:
    """Four parts for the number of entities, three for key-value pairs, three for entities that fit the category."""
    n, k = F.size(kinds), F.size(pairs)
    fits = F.lit(False)
    for name, own in ENTITY_KINDS.items():
        fits = fits | ((category == name) & F.exists(kinds, lambda x: F.lower(x).isin(own)))  # noqa: B023
    return F.when(n >= 3, 0.4).when(n >= 1, 0.2).otherwise(0.0) + F.when(k >= 3, 0.3).when(k >= 1, 0.15).otherwise(0.0) + F.when(fits, 0.3).when(n > 0, 0.1).otherwise(0.0)
