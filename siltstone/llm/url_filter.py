"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower
from siltstone.operators.bloom import bloom_blocks, with_maybe
from siltstone.sources.tables import written

Rule = tuple[str, str, str]
#: (action, host, path)
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that mark a host of the list, as parts of a label between dots and hyphens.
LISTED_TERMS = ("casino", "bets", "pills", "adult")
#: A list of up to so many URLs is broadcast for the exact join (some 20 MB); a longer one meets the possible hits by a shuffle.
BROADCAST_LISTED = 200_000
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_path_query(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL; empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path, F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Host without `www.` or `m.`, path without its last slashes, query without tracking parameters, in order."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""), tail)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else null. Rules are a parameter: some hundreds at most."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule, canonical, listed and verdict.

    `listed` has a column canonical; nulls and repeats in it have no effect. A rule's verdict stands; else listed URLs
    are blocked and the others allowed. The Bloom filter, broadcast with a bounded number of rows, lets most rows past
    the join; possible hits are joined by the canonical URL itself, so that no false positive stays. Null URLs and such
    without `://` are not listed, and have an empty host and path. Each row of `pages` comes out once, repeats too; no
    rows: none. Columns of `pages` with the names of added ones are replaced.
    """
    known = written(listed.select(F.col("canonical").alias("__listed")).where("__listed is not null and __listed != ''").distinct(), "listed")
    count = known.count()
    table, blocks = bloom_blocks(known, "__listed", count)
    host, path, query = host_path_query(F.col(url_col))
    out = pages.withColumns({"__host": host, "__path": path, "__query": query})
    rule, action = matching_rule(F.col("__host"), F.col("__path"), rules)
    out = out.withColumns({"canonical": canonical_url(F.col("__host"), F.col("__path"), F.col("__query")), "rule": rule, "__action": action})
    out = out.withColumns({"host": F.col("__host"), "path": F.col("__path")}).drop("__host", "__path", "__query")
    out = with_maybe(out, F.col("canonical"), table, blocks)
    if count <= BROADCAST_LISTED:
        out = out.withColumn("__key", F.when(F.col("__maybe"), F.col("canonical"))).join(F.broadcast(known), F.col("__key") == F.col("__listed"), "left")
        out = out.withColumn("listed", F.col("__listed").isNotNull()).drop("__key", "__listed")
    else:  # rows that are not listed for sure keep out of the shuffle, at the price of a second scan
        hits = out.where("__maybe").join(known, F.col("canonical") == F.col("__listed"), "left").withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
        out = out.where("not __maybe").withColumn("listed", F.lit(False)).unionByName(hits)
    verdict = F.coalesce(F.col("__action"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("__action", "__maybe")


def listed_of(pages: DataFrame, terms: Sequence[str] = LISTED_TERMS, url_col: str = "url") -> DataFrame:
    """The list: canonical URLs of the pages whose host has one of `terms` in it."""
    host, path, query = host_path_query(F.col(url_col))
    urls = pages.select(host.alias("host"), path.alias("path"), query.alias("query"))
    return urls.where(F.col("host").rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")).select(canonical_url(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))


def op10_query(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Verdicts by the rules and a list of canonical URLs; without one, the list is the pages of hosts with a listed term."""
    thin = pages.select("page_id", "url")
    return filter_urls(thin, listed_of(thin) if listed is None else listed).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def given_list_query(pages: DataFrame) -> DataFrame:
    """Verdicts by a list that no pattern restates: the canonical URLs of every twentieth page, against all pages."""
    host, path, query = host_path_query(F.col("url"))
    listed = pages.where("page_id % 20 = 0").select(canonical_url(host, path, query).alias("canonical"))
    return op10_query(pages, listed)


OP10_SQL = rf"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from parts
), canon as (
  select *, list_sort(list_filter(str_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))) as kept from split
), named as (
  select page_id, host, path, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') ||
    case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from canon
), known as (
  select distinct canonical from named where canonical <> '' and regexp_matches(host, '(^|[.-])({"|".join(LISTED_TERMS)})([.-]|$)')
), ruled as (
  select n.*, k.canonical is not null as listed, case
    when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
    when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
    when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
    when (host = 'org' or host like '%.org') and path like '/%' then 'org/' end as rule
  from named n left join known k on n.canonical = k.canonical
)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
  when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict, canonical, listed from ruled
"""
_BY_TERMS = f"regexp_matches(host, '(^|[.-])({'|'.join(LISTED_TERMS)})([.-]|$)')"
GIVEN_LIST_SQL = OP10_SQL.replace(_BY_TERMS, "page_id % 20 = 0")
