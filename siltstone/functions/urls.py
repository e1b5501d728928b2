"""URLs: normalising, domains, fingerprints, validation, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Query parameters that do not tell pages apart.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid",
    "affiliate", "partner", "campaign", "tracking", "click", "redirect",
)
# End of the fixed values.


def netloc(url: Column) -> Column:
    """What stands between `//` and the next `/`, `?` or `#`; empty if there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """With its port."""
    return F.lower(netloc(url))


def normalise(url: Column) -> Column:
    """With a scheme; null unless http or https, with a dot in the host."""
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(full.rlike("(?i)^https?://") & netloc(full).contains("."), full)


def fingerprint(url: Column) -> Column:
    """T4: lower case without scheme, `www.`, tracking and blank parameters, last slashes and fragment.

    Values of a repeated parameter come together, as in a parsed query.
    """
    low = F.regexp_replace(F.lower(url), "#.*$", "")
    host = F.regexp_replace(netloc(low), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?]*)?([^?]*)", 1), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(low, r"\?(.*)$", 1), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.split(p, "=", 2)[0].isin(*TRACKING))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.split(p, "=", 2)[0]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: F.split(p, "=", 2)[0] == k)))
    # one way of quoting: as decoded and encoded again
    quoted = F.transform(grouped, lambda p: F.concat_ws("=", F.transform(F.split(p, "=", 2), lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x)))))
    query = F.array_join(quoted, "&")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def validate_lists(urls: DataFrame, request: str, url: str, position: str, most: int = 50) -> DataFrame:
    """Adds `reason`: why a URL of a request's list is rejected, null if it is not. Positions of a request differ.

    The last position that is within the limit is all that is kept of a request.
    """
    place = F.row_number().over(W.partitionBy(request).orderBy(position))
    within = urls.select(request, position).withColumn("__place", place).where(F.col("__place") <= most)
    last = within.groupBy(F.col(request).alias("__request")).agg(F.max(position).alias("__last"))
    u = F.trim(F.col(url))
    why = F.when(F.col(position) > F.col("__last"), "too_many").when(u.isNull() | (u == ""), "blank").when(~u.rlike("(?i)^https?://"), "scheme").when(netloc(u) == "", "host")
    return urls.join(last, F.col(request).eqNullSafe(F.col("__request")), "left").withColumn("reason", why).drop("__request", "__last")


def robots_rules(files: DataFrame, host: str = "host", text: str = "robots") -> DataFrame:
    """(host, agent, kind, value): rules, crawl delays and sitemaps out of robots texts.

    A file is read in its order: lines of rules belong to the agents named just before; of several blocks for an agent
    the last one counts; an empty rule is none.
    """
    lines = files.select(host, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    parts = lines.where(F.col("line").contains(":")).select(host, "pos", F.lower(F.trim(F.split("line", ":", 2)[0])).alias("kind"), F.trim(F.split("line", ":", 2)[1]).alias("value"))
    order = W.partitionBy(host).orderBy("pos")
    is_agent = F.col("kind") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    blocks = parts.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    agents = blocks.where(is_agent).groupBy(host, F.lower("value").alias("agent")).agg(F.max("block").alias("block"))
    rules = blocks.where(F.col("kind").isin("allow", "disallow", "crawl-delay") & (F.col("value") != ""))
    maps = parts.where(F.col("kind") == "sitemap").select(host, F.lit("*").alias("agent"), "kind", "value")
    return rules.join(agents, [host, "block"]).select(host, "agent", "kind", "value").unionByName(maps).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", host: str = "host", agent: str = "*") -> DataFrame:
    """Adds `allowed`: no disallow rule of the host for the agent begins the path.

    A path is expanded to its beginnings of the lengths that rules of its host have, and these meet the rules by host
    and beginning, so that a host of any number of rules has none gathered but their different lengths.
    """
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    own = rules.where((F.col("kind") == "disallow") & (F.col("agent") == agent)).select(F.col(host).alias("__h"), F.col("value").alias("__begin")).distinct()
    lengths = own.groupBy("__h").agg(F.collect_set(F.length("__begin")).alias("__lengths"))
    named = urls.withColumns({"__h": domain(F.col(url)), "__path": path})
    begins = F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length("__path")), lambda n: F.left("__path", n))).alias("__begin")
    blocked = named.select("__h", "__path").distinct().join(lengths, "__h").select("__h", "__path", begins).join(own, ["__h", "__begin"], "left_semi").select("__h", "__path").distinct()
    out = named.join(blocked.withColumn("__blocked", F.lit(True)), ["__h", "__path"], "left")
    return out.select(*urls.columns, F.col("__blocked").isNull().alias("allowed"))
