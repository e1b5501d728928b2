"""Texts that are searched only where a cheap test says that a pattern may be in them: the same as searching all."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import functions as F

from siltstone.functions import text as tx

BITS = [
    "coo\u212aie policy", "term\u017f of service", "Privacy Pol\u0130cy", "pr\u0131vacy policy", "Cookie Policy", "privacy ", "policy", "\u00a9 2020 x. ", "Powered By me. ", "<a", "b>", "[x", "y]", "{", "}",
    "\n", "\n \n", "\n\n\n", " ", "  ", "\t", "\u00a0", "\u0085", "\u3000", "\r\n", "\r", "\x1c", "A b.", "Dr", "ed", " Z! A", "\u00df", "word", ". ",
]


def plain(c):
    """Every pattern searched in every text."""
    out = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?Ud)\n\s*\n\s*\n+", "\n\n")
    return reduce(lambda c, p: F.regexp_replace(c, f"(?iuUd){p}", ""), tx.BOILERPLATE, out)


def test_gated_searches_remove_what_searches_of_all_texts_remove(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))) for i in range(3000)] + [(3000, ""), (3001, None)]
    d, x = spark.createDataFrame(rows, "id long, x string"), F.col("x")
    pairs = {"base": (tx.without_boilerplate(x), plain(x)), "strip": (tx.strip(x), F.regexp_replace(x, r"(?Ud)^\s+|\s+$", ""))}
    rest = x
    for name, pattern in tx.BRACKETS.items():
        pairs[name] = (tx.bracket_counts(x)[f"{name}_removed"], F.regexp_count(rest, F.lit(f"(?Ud){pattern}")))
        rest = F.regexp_replace(rest, f"(?Ud){pattern}", "")
    for name, (got, want) in pairs.items():
        assert d.where(~got.eqNullSafe(want)).count() == 0, name


def test_cleaning_names_each_pattern_once(spark):
    """Each step is computed once; before, the plan had the same pattern three times."""
    d = spark.createDataFrame([("x",)], "x string")
    plan = d.select(tx.clean_text(F.col("x")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iuUd)all rights reserved") == 1
