from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from siltstone.llm import pii
from siltstone.sources.tables import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = ["a", "b9", "@", ".", "..", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "  ", "_", "(724) 555-3457", "x.y", "é", "😀", "\x01", "\x02", "\n", ".com", "1.2.3.4", "01.1.1.1", "%", "+1"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text: str | None) -> tuple:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [
        ("email", [m.span() for m in EMAIL.finditer(text)]),
        ("ip", [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]),
        ("card", [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]),
        ("phone", [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]),
    ]
    spans = ",".join(f"{k}:{a}:{b}" for k, xs in found for a, b in xs)
    return tuple(len(x) for _, x in found), hashlib.sha256(spans.encode()).hexdigest()


def test_base_spans_match_brute_force(spark, sf_dir):
    draw = random.Random(5)
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30)))) for i in range(1500)]
    rows += [(-1, None), (-2, ""), (-3, "1 " * 2000), (-4, "a." * 5000 + "@b" + ".c" * 5000), (-5, "+" + "1" * 2000), (-6, "9" * 2000), (-7, "a@b.c_d@e.f")]
    out = pii.op9_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: ((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) for r in out}
    assert got == {i: brute(t) for i, t in rows}


def test_added_kinds_need_their_proof(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE88 3704 0044 0532 0130 00."), (3, "my ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "BE68 5390 0754 7034 BANK OF X"), (6, "123-45-6789 is my social security number"), (7, "NO93 8601 1117 947, GB82WEST12345698765432"), (8, "ZZ68 5390 0754 7034")]
    got = {r["doc_id"]: r["spans"] for r in pii.op9_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:7:18", 4: "", 5: "iban:0:19", 6: "ssn:0:11", 7: "iban:0:18,iban:20:42", 8: ""}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x@y.zz", 1)], "doc_id long, text string, pii_email int")
    assert pii.find_pii(df).select(F.size("pii_email")).first()[0] == 1
    assert pii.find_pii(df.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    """One page of 30,000 addresses is no hurdle; repeated rows are judged each."""
    text = " ".join(f"a{i}@b{i % 7}.org" for i in range(30_000))
    rows = [(1, text), (1, text), (2, "1.2.3.4 " * 3000)]
    out = pii.op9_query(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_email", "n_ip", "base_sha256").collect()
    want = {i: brute(t) for i, t in rows}
    assert sorted(r["doc_id"] for r in out) == [1, 1, 2]
    assert all(((r["n_email"], r["n_ip"]), r["base_sha256"]) == (want[r["doc_id"]][0][:2], want[r["doc_id"]][1]) for r in out)
