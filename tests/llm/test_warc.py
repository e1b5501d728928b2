from __future__ import annotations

import base64
import glob
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import warc as w
from siltstone.sources.tables import fresh, table


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, block: bytes, content: str = "text/plain", more: str = "") -> bytes:
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


FAKE = record("response", "fake", b"fake payload").decode()
NASTY = [
    "", "a", "\n", "\r\n\r\n", "WARC/1.1\r\n", "\nWARC/", "\r\n\r\nWARC/1.1\r\n\r\n", FAKE, "x\r\n\r\n" + FAKE, "\n" + FAKE * 3, FAKE[:-30] + "\nWARC/\nWARC/", "é" * 50 + "\n" + FAKE + "ü",
    "\n" + FAKE.replace("Content-Length: 12", "Content-Length: 100000"), "\n" + FAKE.replace("Content-Length: 12", "Content-Length: 0"), "\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 5, "long " * 300 + "\n" + FAKE + "long " * 400,
]


@pytest.fixture(params=[None, 1000])
def split_size(request, spark):
    """Files are split in places of all kinds."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def brute_read(data: bytes) -> list[tuple[str, bytes]]:
    """From the start of a file, record after record."""
    out, at = [], 0
    while data.startswith(b"WARC/", at):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = {k.lower(): v for k, v in (line.split(b": ", 1) for line in head.split(b"\r\n")[1:])}
        begin = at + len(head) + 4
        block = data[begin : begin + int(fields[b"content-length"])]
        if b"application/http" in fields[b"content-type"]:
            block = block.partition(b"\r\n\r\n")[2]
        out.append((fields[b"warc-record-id"].decode(), block))
        at = begin + int(fields[b"content-length"]) + 4
    return out


def records_in(folder: str) -> list[tuple[str, bytes]]:
    return sorted(r for f in glob.glob(folder.removeprefix("file://") + "/part-*") for r in brute_read(open(f, "rb").read()))


def read(spark, path: str) -> list[tuple[str, bytes]]:
    return sorted((r["record_id"], bytes(r["payload"])) for r in w.read_warc(spark, path).collect())


def brute_pages(rows: list[tuple], least: int = 0) -> list[tuple]:
    """(page_id, bytes, digest, type, refers_to); rows with equal ids and payloads take either part."""
    top, taken, out = {}, set(), []
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            top[h or ""] = max(top.get(h or "", (False, 0)), (i is not None, i or 0))
    for i, _, h in rows:
        p = (h or "").encode()
        first = (h or "") not in top or (i is not None, i or 0) == top[h or ""] and (h or "") not in taken
        if first and (h or "") in top:
            taken.add(h or "")
        out.append((i, len(p), b32(p), "response" if first else "revisit", None if first else (top[h or ""][1] if top[h or ""][0] else None)))
    return sorted(out, key=str)


def test_digest(spark):
    rows = [(x.encode(),) for x in NASTY]
    assert [r[0] for r in spark.createDataFrame(rows, "p binary").select(w.digest(F.col("p"))).collect()] == [b32(x) for (x,) in rows]


def test_pages_come_back_from_any_splits(spark, split_size):
    draw = random.Random(4)
    rows = [(k, f"https://a.example/{k}", h) for k, h in enumerate([*NASTY, NASTY[7], None])]
    rows += [(100 + k, None, "".join(draw.choice(["\r", "\n", "WARC/", "1.1\r\n", "Content-Length: 3\r\n", "\r\n\r\n", "y"]) for _ in range(draw.randrange(40)))) for k in range(25)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int").repartition(3)
    path = fresh(spark, "warc")
    w.write_warc(pages, path)
    want = records_in(path)
    assert len(want) == len(rows) and read(spark, path) == want
    seen = [tuple(r) for r in w.op11_query(pages).collect()]
    assert sorted(seen, key=str) == brute_pages(rows)


def test_archives_of_others(spark, split_size, tmp_path):
    draw = random.Random(6)
    whole = b"".join(record("resource", f"r{k}", draw.randbytes(draw.choice([0, 1, 50, 700])) + draw.choice([b"", b"\r\n\r\n" + record("response", "fake", b"no"), b"\n\xff\xfeWARC/1.0"])) for k in range(40))
    http = record("response", "h", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore", "application/http; msgtype=response", "WARC-Target-URI: https://x.example/\r\n")
    files = {
        "a.warc": whole, "b.warc": http + whole, "c.warc": b"", "d.warc": b"no archive\n" + http, "e.warc": b"\n" + http,
        "cut.warc": record("resource", "kept", b"1") + record("resource", "cut", b"2" * 500)[:-100] + b"\n" + record("resource", "in the cut", b"3"),
        "wrong.warc": record("resource", "wrong", b"4" * 40).replace(b": 40", b": 39") + record("resource", "after", b"5"),
        "open.warc": record("resource", "open", b"6")[:-4],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    cut = files["cut.warc"].partition(b"222")
    want = brute_read(whole) * 2 + [("<h>", b"body\r\n\r\nmore"), ("<kept>", b"1"), ("<cut>", (cut[1] + cut[2])[:500]), ("<wrong>", b"4" * 39), ("<open>", b"6")]
    assert len(want) == 85 and read(spark, str(tmp_path)) == sorted(want)
    h = w.read_warc(spark, str(tmp_path)).where("record_id = '<h>'").first()
    assert (h["type"], h["target_uri"], h["refers_to"], h["payload_digest"]) == ("response", "https://x.example/", None, None)


def test_a_file_that_ends_early_ends_its_chain(spark, tmp_path):
    data = record("resource", "a", b"1") + record("resource", "b", b"2" * 500)
    (tmp_path / "x.warc").write_bytes(data[:-200])
    assert read(spark, str(tmp_path)) == [("<a>", b"1")]


def test_odd_rows(spark):
    rows = [(1, "u\r\nWARC-Type: evil", "A"), (1, "u\r\nWARC-Type: evil", "A"), (1, "v", "A"), (None, None, "A"), (None, None, None), (None, "x", ""), (2, "y", ""), (2, "y", ""), (3, None, "B" * 200_000), (4, None, "B" * 200_000), (5, "z", "C")]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in w.op11_query(pages).collect()), key=str) == brute_pages(rows * 2)
    path = fresh(spark, "warc")
    w.write_warc(pages, path, least_bytes=2)
    thin = w.read_warc(spark, path, lambda r: r.select("type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), w.digest(F.col("payload")).alias("payload_digest")))
    assert sorted((tuple(r) for r in w.page_records(thin).collect()), key=str) == brute_pages(rows * 2, 2)
    assert w.op11_query(pages.limit(0)).count() == 0


def test_query_matches_sql(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    rows = duck.execute(w.OP11_SQL).fetchall()
    assert sorted(tuple(r) for r in w.op11_query(pages).collect()) == sorted(rows)
    brute = brute_pages([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert sorted(rows, key=str) == brute
    assert pages.sparkSession.conf.get("spark.sql.files.minPartitionNum", None) is None
