from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language, packing, token_counts, toxicity
from siltstone.llm.common import id_remainder
from siltstone.sources.tables import table

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", " ", "  ", "\n", "b c", "é", "<|endoftext|>", "\t", "▁", "日本", "1 2", "\x1c", "\u3000", "'s", "!", "The", "😀", "\x85", ".", ",", "x,", "ab.", "\n\n", "\r"]


def texts(n: int) -> list[str]:
    draw = random.Random(3)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def test_encoder_gives_the_tokenizer_s_ids(spark, sf_dir):
    draw = random.Random(7)
    strange = ["".join(chr(draw.choice([draw.randrange(0x20, 0x250), draw.randrange(0x250, 0xD800), draw.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(2000)]
    given = [r[0] for r in table(spark, sf_dir, "documents").select("text").collect()] + texts(4000) + strange + [" " * 3000, "a" + "\t" * 1500 + "b", "x" * 20000, "é" * 3000]
    for part in (packing.PART, 5):
        e = packing.Encoder(BPE, part)
        assert e.fast is not None
        assert [e.encode(t) for t in given] == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(given, add_special_tokens=False)]
    slow = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert slow.fast is None and slow.encode("Some words") == np.array(slow.tokenizer.encode("Some words", add_special_tokens=False).ids, "<u4").tobytes()


def test_plan_fills_sequences_without_gaps():
    draw = random.Random(4)
    counts = Counter(draw.choice([1, 3, 500, 1024, 2047, 2048, draw.randint(1, 2048)]) for _ in range(5000))
    plan = packing.plan(counts)
    rooms: dict[int, list] = {}
    for length, _, n, first, offset in plan.tolist():
        for k in range(n):
            rooms.setdefault(first + k, []).append((offset, length))
    for slots in rooms.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(len(x) for x in rooms.values()) == 5000
    assert len(rooms) <= 1.02 * sum(k * n for k, n in counts.items()) / 2048 + 2


def test_packing_is_an_exact_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, "long " * 5000)], "doc_id long, text string"))
    packed = packing.pack_documents(docs, BPE, with_ids=True).cache()
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences_of(packed).collect()}
    assert all(len(x) <= 2048 for x in sequences.values())
    own: dict[int, list] = {}
    for r in packed.orderBy("doc_id", "piece").collect():
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert r["start"] == len(own.setdefault(r["doc_id"], []))
        assert r["piece"] == 0 or r["length"] == 2048
        own[r["doc_id"]] += r["ids"]
    tokenizer = packing.encoder(BPE).tokenizer
    assert own == {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 8)], "doc_id long, text string, length int")
    rows = packing.op2_query(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert sorted(r["offset"] for r in rows)[0] == 0 and len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 3


def test_spliced_counts_are_the_library_s():
    model = token_counts.processor(PIECE)
    for t in [*texts(400), " " * 100, "x" * 300, "a b " * 200]:
        for chunk, overlap in ((16, 4), (40, 8), (300, 20)):
            got = token_counts.count_spliced(t, lambda s: token_counts.begins(PIECE, s), chunk, overlap)
            assert got == len(model.encode(t)) or (got is None and "▁" in t)


def test_spliced_counts_with_bytes_before_a_long_run():
    model = token_counts.processor(PIECE)
    given = ["ab " * 10866 + "ab ① " + "x" * 80000, "ab " * 10866 + "ab 힣 " + "中文" * 40000, "中" * 32600 + "① " + "y" * 60000, "a▁b " * 20000]
    draw = random.Random(11)
    for _ in range(60):
        given.append("".join(draw.choice(["ab ", "① ", " 힣", "𒀀 ", "😀", "x" * draw.randint(1, 300), "中文" * draw.randint(1, 100)]) for _ in range(draw.randint(5, 60))))
    for t in given:
        for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), *([(64, 8), (17, 3)] if len(t) < 20000 else [])):
            got = token_counts.count_spliced(t, lambda s: token_counts.begins(PIECE, s), chunk, overlap)
            assert got == (None if "▁" in t else len(model.encode(t)))


def test_token_counts_of_null_and_huge(spark):
    """Marks in a text make it one that is encoded whole; repeated rows are counted each; other columns have no effect."""
    rows = [(1, None), (2, ""), (3, "word " * 20000), (4, "x" * 40000), (5, "a▁b " * 20000), (6, "ab " * 10866 + "ab ① " + "x" * 80000), (6, "w"), (6, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit("y")})
    got = sorted((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in token_counts.op6_query(docs).collect())
    assert got == sorted((i, len(token_counts.processor(PIECE).encode(t or "")), len((t or "").encode())) for i, t in rows)
    assert token_counts.op6_query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_is_right_on_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    out = language.op8_query(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "12 !", "x"), (3, "the", "x")], "doc_id long, text string, score string")
    profiles = language.learn_profiles(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, profiles).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert got[3][0] != "und"
    assert [r["doc_id"] for r in language.accepted(odd, profiles).collect()] == [3]
    assert language.accepted(odd, profiles).columns == odd.columns


def place(text: str, profiles: dict, size: int) -> tuple[str, float]:
    """By brute force: all n-grams of the runs of letters, ranked, against each language's ranks."""
    runs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    found: Counter = Counter()
    for w in runs:
        m = f"_{w}_"
        found.update(m[i:j] for i in range(len(m)) for j in range(i + 1, min(i + 4, len(m) + 1)) if m[i:j] != "_")
    own = sorted(found, key=lambda g: (-found[g], g))[:size]
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(ranks[g] - i) if g in ranks else size for i, g in enumerate(own)) for lang, ranks in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


def test_nearest_profile_matches_brute_force(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs) | {"aa": {"a": 0, "b": 1}, "ab": {"b": 0, "a": 1}}
    draw = random.Random(5)
    given = [r[0] for r in docs.select("text").collect() if r[0]] + ["", "12 ½ ² ① !", "a½b x²", "ab ba", "a", "x" * 5000, "é" * 100 + " ß", "_a_ b_c", "İstanbul Ǆ", "a\u0301b"]
    given += ["".join(draw.choice(["a", "b", " ", "é", "²", "日", "本", "ж", "_", "1"]) for _ in range(draw.randint(0, 200))) for _ in range(300)]
    for size, block in ((300, language.BLOCK), (300, 7), (5, 2)):
        monkeypatch.setattr(language, "BLOCK", block)
        own = language.Nearest(profiles, size)
        for t in given if block > 7 else given[-400:]:
            lang, score = own.nearest(t)
            assert (lang, pytest.approx(score)) == place(t, profiles, size)
    assert [language.gram_of(language.number_of(g)) for g in ("a", "_b", "日本語", "😀_")] == ["a", "_b", "日本語", "😀_"]
    assert language.Nearest({}).nearest("word") == ("und", 0.0) and language.Nearest({"xx": {}}).nearest("word") == ("xx", 0.0)


def test_language_of_clashing_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "x"), (1, "the cat", "en", "x"), (None, "der Hund", "de", "y"), (2, "²", None, "z")], "doc_id long, text string, lang string, lang_pred string")
    out = language.op8_query(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out.collect())[-1] == (2, "und") and out.count() == 4
    assert language.op8_query(docs.limit(0)).count() == 0


def test_grammar_reads_clauses():
    model = toxicity.Model(words={"idiot": 2.0}, stems={"stup": 3.0, "gra": 1.0}, repeated=frozenset({"gra"}))
    found = lambda text: {k for k, v in zip(toxicity.FEATURES, toxicity.Scorer(model).features(text), strict=True) if v and k != "density"}
    assert found("What a idiot.") == {"insult:plain"}
    assert found("You are an idiot.") == {"insult:targeted"}
    assert found("That is not idiot talk.") == {"insult:negated"}
    # a negation nearer than the reporting verb goes before it
    assert found("A witness said nothing of that idiot here.") == {"insult:negated"}
    assert found("A man wrote of that big bad idiot.") == {"insult:reported"}
    assert found("A man wrote. That idiot.") == {"insult:plain"}
    assert found("Such stupidity!") == {"insult:plain"}
    # a threat is told when it meets its target
    assert found("I will kill you.") == {"threat:targeted"}
    assert found("I will not kill you.") == {"threat:negated"}
    assert found("They said I will kill you.") == {"threat:reported"}
    assert found("Plain words. You said it.") == set()
    assert found("Gravel here.") == set() and found("Gravel here. A grape.") == {"insult:plain"}
    assert toxicity.Scorer(model).score("idiot idiot") > toxicity.Scorer(model).score("")


def meaning(symbols: list[int]) -> list[str]:
    """What a clause holds, word by word, by looking back from each."""
    out = []
    for i, s in enumerate(symbols):
        back = lambda kind: kind in symbols[max(0, i - toxicity.REACH) : i]  # noqa: B023, E731
        last = next((x for x in reversed(symbols[max(0, i - toxicity.REACH) : i]) if x in (toxicity.THREAT, toxicity.TARGET)), None)
        kind = "insult" if s == toxicity.INSULT else "threat" if s in (toxicity.THREAT, toxicity.TARGET) and last is not None and last != s else ""
        how = "negated" if back(toxicity.NEGATION) else "reported" if toxicity.REPORT in symbols[:i] else "targeted" if kind == "threat" or back(toxicity.TARGET) else "plain"
        out += [f"{kind}:{how}"] if kind else []
    return out


def test_product_of_transducers_matches_looking_back():
    draw, grammar = random.Random(9), toxicity.Grammar()
    for _ in range(5000):
        clause = [draw.choice([0, 0, 0, 1, 2, 3, 4, 5]) for _ in range(draw.randint(0, 12))]
        assert [k for k, _ in grammar.matches([(s, 1.0) for s in clause])] == meaning(clause)


def test_toxicity_on_held_out_documents(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity.op5_query(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rates = {(r["lang"], r["toxic"]): (r["rate"], r["n"]) for r in out.groupBy("lang", "toxic").agg(F.avg("predicted").alias("rate"), F.count(F.lit(1)).alias("n")).collect()}
    for (_, toxic), (rate, n) in rates.items():
        assert rate < 0.01 if not toxic else n < 10 or rate >= 0.9
    caught = [(rate * n, n) for (_, toxic), (rate, n) in rates.items() if toxic]
    assert sum(k for k, _ in caught) >= 0.9 * sum(n for _, n in caught)


def test_toxicity_of_odd_rows(spark):
    """Repeated rows come out as often, other columns have no effect, very long texts are read to the end."""
    model = toxicity.Model(words={"idiot": 5.0}, stems={"stup": 3.0})
    rows = [(1, "word " * 200_000 + "You idiot. Idiot!", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z")]
    out = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["doc_id"] != 1}) == 1
    assert max(out, key=lambda r: r["score"])["doc_id"] == 1


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.op5_query(docs, labels).collect()} == {0}
    assert toxicity.op5_query(docs.limit(0), labels).count() == 0
    assert docs.select(id_remainder("doc_id", 3)).count() == 2


def test_fit_separates():
    x = np.array([[0.0], [0.1], [1.0], [1.2]])
    bias, (w,) = toxicity.fit(x, np.array([0.0, 0, 1, 1]))
    assert w > 0 > bias
    assert pytest.approx(0.5, abs=0.25) == -bias / w
