"""Quality rules, native: counts that fail plainly bad texts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to BUCKETS buckets. One multinomial is counted over all documents, the other over
trusted ones; the score of a document is the mean of log(p_trusted / p_raw) over its n-grams, and one threshold holds
for all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACES, text_or_empty, words_of
from siltstone.sources.tables import written

BUCKETS = 1 << 16
#: n-grams of the raw distribution that are mixed into the trusted one.
PRIOR = 100_000.0
#: Documents whose mean log ratio lies under it are dropped.
THRESHOLD = -0.1
#: Repeated windows of a text that are looked up in its windows one by one.
FEW = 32
#: The trusted side is learned from so many labelled documents at most, those with the least hashes of their ids.
TRUSTED_ROWS = 20_000


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and __grams (see `with_grams`).

    Null and blank texts have no words and fail. Work in a row is n log n in its words: windows are hashed to 64 bits
    and sorted, equal neighbours are the repeated ones. Places of up to FEW of these are looked up one by one; where
    there are more, windows are sorted with their places.
    """
    text = text_or_empty(text_col)
    docs = docs.withColumns({
        "__words": words_of(F.col(text_col)),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
    })
    docs = docs.withColumns({
        "__h1": F.transform("__words", lambda w: F.xxhash64(w)),
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__words", "__lines")
    docs = docs.withColumn("__h2", _pairs())
    docs = docs.withColumns({"__h3": F.zip_with(_ahead("__h2", 0, 1), _ahead("__h1", 2, 2), lambda a, b: F.xxhash64(a, b)), "__grams": F.concat("__h1", "__h2")}).drop("__h1", "__h2")
    docs = docs.withColumn("__sorted", F.sort_array("__h3"))
    twins = F.zip_with("__sorted", _ahead("__sorted", 1, 1), lambda x, y: F.when(x == y, x))
    docs = docs.withColumn("__often", F.array_distinct(F.filter(twins, lambda x: x.isNotNull()))).drop("__sorted")
    few = F.filter(F.transform("__h3", lambda h, i: F.when(F.array_contains("__often", h), i)), lambda i: i.isNotNull())
    windows = F.array_sort(F.transform("__h3", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    docs = docs.withColumn("__windows", F.when(F.size("__often") > FEW, windows).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    twins = F.zip_with("__windows", _ahead("__windows", 1, 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["at"], y["at"])))
    many = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull()))))
    none = F.array().cast("array<int>")
    docs = docs.withColumn("__places", F.when(F.size("__often") == 0, none).when(F.size("__often") <= FEW, few).otherwise(many)).drop("__windows", "__often", "__h3")
    steps = F.zip_with("__places", _ahead("__places", 1, 1), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    docs = docs.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda acc, n: acc + n)).drop("__places")
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ahead(array: str, start: int, less: int) -> Column:
    """The array from `start` on, `less` elements shorter."""
    return F.slice(array, F.lit(start + 1), F.greatest(F.lit(0), F.size(array) - less))


def _pairs() -> Column:
    return F.zip_with(_ahead("__h1", 0, 1), _ahead("__h1", 1, 1), lambda a, b: F.xxhash64(a, b))


def with_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __grams: hashes of the words and of the pairs of neighbours."""
    docs = docs.withColumn("__h1", F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)))
    return docs.withColumn("__grams", F.concat("__h1", _pairs())).drop("__h1")


def bucket_of(gram: Column, buckets: int) -> Column:
    return gram.bitwiseAND(F.lit(buckets - 1)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, ratio): log(p_trusted / p_raw) of every bucket, as a written table of `buckets` rows.

    `trusted` has a column of ids, of at most TRUSTED_ROWS different ones: it is broadcast.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).distinct().withColumn("__trusted", F.lit(1))
    counted = with_grams(docs.select(id_col, text_col), text_col).select(id_col, "__grams").join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left")
    counted = counted.select(F.explode("__grams").alias("__g"), F.coalesce("__trusted", F.lit(0)).alias("__t")).select(bucket_of(F.col("__g"), buckets).alias("bucket"), "__t").groupBy("bucket").agg(F.count(F.lit(1)).alias("__raw"), F.sum("__t").alias("__good"))
    spark = docs.sparkSession
    counted = written(counted, "buckets")
    n_raw, n_good = counted.agg(F.coalesce(F.sum("__raw"), F.lit(0)), F.coalesce(F.sum("__good"), F.lit(0))).first()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counted), "bucket", "left").fillna(0, ["__raw", "__good"])
    p_raw = (F.col("__raw") + 0.5) / (float(n_raw) + 0.5 * buckets)
    return written(every.select("bucket", F.log((F.col("__good") + F.lit(prior) * p_raw) / F.lit(float(n_good) + prior) / p_raw).alias("ratio")), "ratios")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good, `rows` at most: the sample that the trusted side is learned from."""
    good = labels.where("quality = 1").select(id_col).distinct()
    return good.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """`docs` with the counts of `base_counts`, `ratio` (mean log ratio, 0.0 without words) and `kept`.

    kept: not base_failed, and ratio >= threshold. Without trusted documents all ratios are about 0, and the base rules
    decide alone. Rows with the same or a null id are judged one by one; no rows: none. Columns of `docs` with the
    names of added ones are replaced.
    """
    table = log_ratios(docs, trusted, id_col, text_col, buckets, prior)
    # `buckets` numbers, as one constant of the plan: inside a lambda Spark takes no subquery, and as a column each row would hold a copy
    values = dict(table.collect())
    ratios = F.split(F.lit(",".join(f"{values[b]:.6g}" for b in range(buckets))), ",").cast("array<double>")
    out = base_counts(docs, text_col)
    total = F.aggregate("__grams", F.lit(0.0), lambda acc, g: acc + F.get(ratios, bucket_of(g, buckets)))
    out = out.withColumn("ratio", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).drop("__grams")


def op1_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality_rules(docs.select("doc_id", "text"), trusted_ids(labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
