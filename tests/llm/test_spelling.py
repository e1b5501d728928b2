from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from siltstone.llm import spelling as s
from siltstone.sources.tables import table

LETTERS = "abcdeé"


def lower(w: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def brute_counts(rows: list[tuple], slips: int = 97, length: int = 5, count: int = 3) -> dict[str, int]:
    out: Counter[str] = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if slips and i is not None and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= count}


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_pairs(words: list[str]) -> set[tuple[str, str]]:
    """All pairs of near words: of words that are equal without one of their code points, those that are near."""
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    return {(a, b) for g in holes.values() for a in g for b in g if a < b and near(a, b)}


def brute(counts: dict[str, int]) -> set[tuple]:
    by = defaultdict(list)
    for a, b in brute_pairs(list(counts)):
        by[a].append(b)
        by[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(by[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(by[w]), counts[form[w]] if form[w] else None))
    return out


def edited(draw: random.Random, w: str) -> str:
    i = draw.randrange(len(w) + 1)
    return draw.choice([w[:i] + draw.choice(LETTERS) + w[i:], w[:i] + w[i + 1 :], w[:i] + draw.choice(LETTERS) + w[i + 1 :]])


def some_words(draw: random.Random, count: int) -> list[str]:
    words = {"".join(draw.choice(LETTERS) for _ in range(draw.choice([5, 5, 6, 8, 12, 30, 70]))) for _ in range(count)}
    words |= {edited(draw, w) for w in sorted(words)}
    return sorted(w for w in words if len(w) >= 5)


def test_all_near_words_at_every_size_of_the_dictionary(spark):
    words = some_words(random.Random(7), 700)
    want = brute_pairs(words)
    assert len(want) > 400
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    # no gram is frequent; the usual bound; nearly all are, so that grams are as long as can be
    for least, most in ((10**9, 1), (500, 20_000), (20, 10**9), (0, 10**9)):
        pairs = s.near_words(df, least, most).collect()
        assert len(pairs) == len(want) and {tuple(sorted((r["a"], r["b"]))) for r in pairs} == want
        assert all(words[r["n_a"]] == r["a"] and words[r["n_b"]] == r["b"] for r in pairs)


def test_an_edit_changes_no_more_grams_than_the_bound():
    draw = random.Random(3)
    words = some_words(draw, 300)
    counts = Counter(x[i : i + q] for w in words for x in [s.BEGIN + w + s.END] for q in range(2, 6) for i in range(len(x) - q + 1))
    for least in (1, 5, 30):
        frequent = {g: c for g, c in counts.items() if c > least}
        for w in words:
            mine, bound = s.grams(w, frequent), s.affected(s.grams(w, frequent))
            assert bound < len(mine)
            other = edited(draw, w)
            theirs = Counter(g for _, g in s.grams(other, frequent))
            assert sum((Counter(g for _, g in mine) - theirs).values()) <= bound


def test_the_dictionary_is_bounded(spark):
    words = some_words(random.Random(1), 500)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    frequent = s.frequent_grams(df, 0, 40)
    assert frequent and all(v <= 40 for v in Counter(map(len, frequent)).values())


def test_forms_and_roots(spark):
    counts = {"house": 100, "houses": 40, "housse": 40, "hous": 9, "housed": 20, "chouse": 3, "hoouses": 3, "mouse": 100, "other": 7}
    out = s.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    want = brute({w: n for w, n in counts.items() if w != "hous"}) | {("hous", None, "hous", 9, 0, None)}
    assert {tuple(r) for r in out.collect()} == want
    assert ("hoouses", "houses", "house", 3, 1, 40) in want


def test_odd_rows(spark):
    rows = [(1, "Aåäö× ÀÉÎÕÜ àéîõü words words WORDS"), (1, "Aåäö× ÀÉÎÕÜ àéîõü words words WORDS"), (None, "words wordz aåäö× words ÀÉÎÕÜ " * 200), (2, None), (3, ""), (4, "x" * 2000 + " " + "x" * 1999 + " worĀds")]
    docs = spark.createDataFrame([(*r, 1) for r in rows * 3], "doc_id long, text string, word int")
    counts = brute_counts(rows * 3, slips=3)
    assert {tuple(r) for r in s.word_counts(docs, slips=3).collect()} == set(counts.items())
    assert {tuple(r) for r in s.variant_groups(s.word_counts(docs)).collect()} == brute(brute_counts(rows * 3, slips=0))
    assert s.op12_query(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute(brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert {tuple(r) for r in s.op12_query(docs).collect()} == want
    assert sum(r[1] is not None for r in want) > 50


def test_very_long_words(spark):
    long = "xy" * 60_000
    df = spark.createDataFrame([(long, 9), (long[1:], 4), (long + "z", 3)], "word string, n long")
    want = {(long, None, long, 9, 2, None), (long[1:], long, long, 4, 1, 9), (long + "z", long, long, 3, 1, 9)}
    assert {tuple(r) for r in s.variant_groups(df).collect()} == want
