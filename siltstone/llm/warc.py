"""WARC archives: pages written as records, and records read back from archives that several tasks share.

Archives are written by Spark's text writer: a record is a row, and the rows end in the two empty lines that close a record.

They are read in pieces, from one magic to the next: Spark's text reader splits files at the newline and magic that come
before a record. A payload may hold the same bytes, so a piece is only a candidate. A task knows its candidates' places
from the start of its split, and where the length in each header says that the successor begins; it follows these chains
to where they leave the split. What is left for all splits are few places, from which pointer jumping, on doubled steps,
finds those that the start of the file reaches. Each split then follows its chain from the one place where it is entered;
all candidates beside the chain lie in payloads, and go back to the record that holds them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.bloom import excluding, including
from siltstone.sources.tables import dropped, fresh, written

MAGIC = b"WARC/"
#: What Spark splits archives at. Its first byte comes in it once, so that no match can begin inside another.
BOUNDARY = b"\n" + MAGIC
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary"

_VERSION = re.compile(rb"\d+\.\d+\r\n")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)")


def digest(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: each five hexadecimal digits are four of base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(text: Column) -> Column:
    """Line ends would end a header field."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str, record_id: Column, date: str, url: Column, payload_digest: Column, size: Column, payload: Column | None = None, refers_to: Column | None = None) -> Column:
    """The record as text, without the empty lines at its end. The HTTP head is what a server may have sent."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    fields = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), _one_line(url)), F.concat(F.lit("WARC-Payload-Digest: sha1:"), payload_digest)]
    if refers_to is not None:
        fields += [F.concat(F.lit("WARC-Refers-To: "), refers_to), F.lit(f"WARC-Profile: {REVISIT}")]
    length = F.octet_length(http) + (size if payload is not None else F.lit(0))
    head = F.concat_ws("\r\n", *fields, F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length))
    return F.concat(head, F.lit("\r\n\r\n"), http, *([payload] if payload is not None else []))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """A record per page in uncompressed archives in the folder `path`.

    Of pages with equal payloads of `least_bytes` bytes or more, that with the largest id, a number, is the response (of
    several, that of the largest url, one of them) and the others revisit it; smaller payloads are all responses. Null
    html is an empty payload, null urls give no target, null ids are the smallest. No rows: a folder without records.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"), F.col(id_col).cast("long").alias("__n"))
    rows = rows.withColumn("__sha", F.unhex(F.sha2(F.encode("__html", "utf-8"), 256)))
    size = F.octet_length("__html").cast("long")
    record_id = F.concat(F.lit("<urn:siltstone:page:"), F.coalesce("__id", F.lit("")), F.lit(":"), F.col("__digest"))
    keys = ["__n", "__url", "__sha"]
    thin = written(rows.select("__id", *keys, size.alias("__size"), digest(F.col("__html")).alias("__digest")).withColumn("__row", F.monotonically_increasing_id()), "thin")
    tops = thin.where(F.col("__size") >= least_bytes).groupBy("__sha").agg(F.max(F.struct("__n", "__url", "__row")).alias("__top"), F.count(F.lit(1)).alias("__c"))
    tops = written(tops.where("__c > 1").drop("__c"), "tops")
    others = written(thin.join(tops, "__sha").where("__row != __top.__row"), "others")
    target = F.concat(F.lit("<urn:siltstone:page:"), F.coalesce(F.col("__top.__n").cast("string"), F.lit("")), F.lit(":"), F.col("__digest"), F.lit(">"))
    revisits = others.select(_record("revisit", F.concat(record_id, F.lit(":"), F.col("__row"), F.lit(">")), date, F.col("__url"), F.col("__digest"), F.col("__size"), refers_to=target).alias("value"))
    # responses: rows whose key no revisit has, and one for each key that the response shares with revisits
    named = {k: F.col(k) for k in keys}
    same = written(others.where(F.col("__n").eqNullSafe(F.col("__top.__n")) & F.col("__url").eqNullSafe(F.col("__top.__url"))).select(*keys).distinct(), "same")
    responses = excluding(rows, named, written(others.select(*keys).distinct(), "gone"))
    if not same.isEmpty():
        responses = responses.unionByName(including(rows, named, same).dropDuplicates(keys))
    responses = responses.withColumn("__digest", digest(F.col("__html"))).withColumn("__size", size)
    responses = responses.select(_record("response", F.concat(record_id, F.lit(">")), date, F.col("__url"), F.col("__digest"), F.col("__size"), payload=F.col("__html")).alias("value"))
    responses.unionByName(revisits).write.option("lineSep", "\r\n\r\n").text(path)


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike inside, even if executors come or go meanwhile."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, size of the file, start of the split), in order within a split."""
    raw = spark.read.option("lineSep", BOUNDARY.decode()).text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, int, bytes]]:
    """(file, its size, split, piece in the split, its place in the split, piece)."""
    now, k, at = None, 0, 0
    for b in batches:
        for value, file, size, block in zip(b.column(0), *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if (file, block) != now:
                now, k, at = (file, block), 0, 0
            value = value.as_py()
            yield file, size, block, k, at, value
            k, at = k + 1, at + len(value) + len(BOUNDARY)


def _head(piece: bytes) -> tuple[bytes, int, int] | None:
    """(header, its length with the empty line, length of the block) of a piece without its magic; None if it is no record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 and piece.endswith(b"\r\n\r"):  # the block begins with a magic, and the piece ends in the empty line
        end = len(piece) - 3
    if end < 0 or not _VERSION.match(piece):
        return None
    found = _LENGTH.search(piece, 0, end)
    return (piece[:end], end + 4, int(found[1])) if found else None


def _candidates(pieces: DataFrame) -> DataFrame:
    """A row per piece, by places in its split: start (of its magic), next (its successor's, null if it is no record), leaves (where the chain from it leaves the split), alone (no other piece is in it), total (bytes of the split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            total = rows[-1][7]
            leaves: dict[int, int] = {}
            for _, _, _, _, start, after, _, _ in reversed(rows):
                if after is not None:
                    leaves[start] = leaves.get(after, after)
            columns = [*zip(*rows, strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(columns[:7], types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([leaves.get(s) for s in columns[4]], pa.int64()), pa.array([total] * len(rows), pa.int64())], names)

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []
        for file, size, block, k, at, piece in _by_split(batches):
            if rows and (rows[0][0], rows[0][2]) != (file, block):
                yield out(rows)
                rows = []
            first = block == 0 and k == 0
            start = at if first else at - len(MAGIC)
            own = piece[len(MAGIC) :] if first and piece.startswith(MAGIC) else b"" if first else piece
            head = _head(own)
            after = start + len(MAGIC) + head[1] + head[2] + 4 if head else None
            # the next piece's magic begins a byte after the end of this one
            rows.append((file, size, block, k, start, after, head is not None and after <= at + len(piece) + 1, at + len(piece) + len(BOUNDARY)))
        if rows:
            yield out(rows)

    names = ["file", "file_size", "block", "k", "start", "next", "alone", "leaves", "total"]
    return pieces.mapInArrow(run, "file string, file_size bigint, block bigint, k bigint, start bigint, next bigint, alone boolean, leaves bigint, total bigint")


def _placed(candidates: DataFrame) -> DataFrame:
    """Candidates by places in their file; those whose block goes beyond the end of the file are none."""
    splits = candidates.groupBy("file", "block").agg(F.max("total").alias("total"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = candidates.drop("total").join(bases, ["file", "block"])
    out = out.withColumns({c: F.col(c) + F.col("base") for c in ("start", "next", "leaves")}).drop("base")
    whole = F.col("next") - 4 <= F.col("file_size")
    return out.withColumns({c: F.when(whole, F.col(c)) for c in ("next", "leaves")}).withColumn("alone", F.col("alone") & F.coalesce(whole, F.lit(False)))


def _entered(placed: DataFrame) -> DataFrame:
    """(file, start): where the chain from the start of the file enters a split, by pointer jumping on doubled steps."""
    records = placed.where(F.col("next").isNotNull())
    targets = records.select("file", F.col("leaves").alias("start")).distinct()
    steps = written(records.join(targets, ["file", "start"], "left_semi").unionByName(records.where("start = 0")).select("file", "start", "leaves").distinct(), "steps")
    places = steps.select("file", "start")
    reached, count = written(places.where("start = 0"), "reached"), -1
    while (now := reached.count()) != count:
        count = now
        step = steps.select("file", F.col("start"), F.col("leaves").alias("to"))
        more = reached.join(step, ["file", "start"]).select("file", F.col("to").alias("start")).join(places, ["file", "start"], "left_semi")
        after = written(reached.unionByName(more).distinct(), "reached")
        dropped(reached)
        reached = after
        further = step.select("file", F.col("start").alias("to"), F.col("to").alias("leaves"))
        steps = written(step.join(further, ["file", "to"]).select("file", "start", "leaves"), "steps")
    return reached


def _walked(split: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a split with their owners: the chain's record in which they lie; null before the chain enters and where it has ended."""
    split = split.sort_values("k")
    place, own, owners = split["entry"].iloc[0], None, []
    for start, after in zip(split["start"], split["next"], strict=True):
        if start == place and after == after:
            own, place = start, after
        owners.append(own if own is not None and start < place else None)
    return split.assign(owner=pd.array(owners, "Int64"))[["file", "block", "k", "start", "next", "alone", "owner"]]


def boundaries(pieces: DataFrame) -> DataFrame:
    """(file, block, k, start, alone, owner): each piece, with the start of the record that it is of, null if of none.

    A record is reached from the start of its file over the lengths in headers. Where one says that the next begins at a
    place without a magic, the chain ends, and what follows is of no record; nor is a block that the file cuts.
    """
    placed = written(_placed(written(_candidates(pieces), "candidates")), "placed")
    entered = _entered(placed)
    entries = placed.join(entered, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"))
    split = placed.select("file", "block", "k", "start", "next", "alone").join(entries, ["file", "block"], "left")
    walked = written(split.groupBy("file", "block").applyInPandas(_walked, "file string, block bigint, k bigint, start bigint, next bigint, alone boolean, owner bigint"), "walked")
    last = walked.groupBy("file", "block").agg(F.max_by(F.struct("start", "next"), F.when(F.col("owner") == F.col("start"), F.col("start"))).alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    came = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("came"))
    out = walked.join(came, ["file", "block"])
    own = F.coalesce("owner", F.when(F.col("start") < F.col("came.next"), F.col("came.start")))
    return out.select("file", "block", "k", "start", "alone", own.alias("owner"))


def _parsed(record: bytes) -> tuple | None:
    """The fields of RECORD, of a record without its magic."""
    if (found := _head(record)) is None:
        return None
    head, at, length = found
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    block = record[at : at + length]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return (*(fields.get(x) for x in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")), block)


def _columns(parsed: list[tuple | None]) -> list[pa.Array]:
    return [pa.array([p[i] if p else None for p in parsed], pa.binary() if i == 5 else pa.string()) for i in range(6)]


def _whole_records(pieces: DataFrame, raw: bool) -> DataFrame:
    """(file, block, k) of each piece with the fields of the record that it would be alone, or with the piece as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            keys = [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]]
            if raw:
                return pa.RecordBatch.from_arrays([*keys, pa.array([r[3] for r in rows], pa.binary())], ["file", "block", "k", "piece"])
            return pa.RecordBatch.from_arrays([*keys, *_columns([_parsed(r[3]) for r in rows])], ["file", "block", "k", *names])

        rows, size = [], 0
        for file, _, block, k, _, piece in _by_split(batches):
            rows.append((file, block, k, piece[len(MAGIC) :] if block == 0 and k == 0 else piece))
            size += len(piece)
            if size > 1 << 22:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    names = [x.split()[0] for x in RECORD.split(", ")]
    return pieces.mapInArrow(run, "file string, block bigint, k bigint, " + ("piece binary" if raw else RECORD))


def _joined_records(pieces: DataFrame, members: DataFrame) -> DataFrame:
    """Records of several pieces, of (file, block, k, owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.column(0):
                yield pa.RecordBatch.from_arrays(_columns([_parsed(BOUNDARY.join(x["piece"] for x in row.as_py()))]), names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    found = including(_whole_records(pieces, raw=True), {c: F.col(c) for c in ("file", "block", "k")}, members).join(members, ["file", "block", "k"])
    return found.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "k", "piece"))).alias("p")).select("p").mapInArrow(run, RECORD)


def read_warc(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame] = lambda records: records) -> DataFrame:
    """The records of the uncompressed archives at `path`, as a written table of what `keep` makes of them.

    Columns: type, record_id, target_uri, refers_to, payload_digest (as the headers have them, null where they don't) and
    payload: the body of an HTTP response, or the whole block. Archives are UTF-8 or any other bytes. An empty archive
    has no records; one that doesn't begin with a record has none that can be reached.
    """
    keys = ["file", "block", "k"]
    with _same_splits(spark):
        pieces = _pieces(spark, path)
        members = written(boundaries(pieces), "members")
        alone = F.col("alone") & F.coalesce(F.col("owner") == F.col("start"), F.lit(False))
        others = written(members.where(~alone).select(*keys, "owner"), "others")
        records = _whole_records(pieces, raw=False)
        if others.isEmpty():
            return written(keep(records.drop(*keys)), "records")
        # candidates in payloads go back to the records that hold them
        joined = _joined_records(pieces, written(others.where(F.col("owner").isNotNull()), "inner"))
        return written(keep(excluding(records, {c: F.col(c) for c in keys}, others).drop(*keys).unionByName(joined)), "records")


def page_of(record_id: Column) -> Column:
    """The id of the page that `write_warc` has put into a record's id."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:siltstone:page:(-?\d*):", 1), F.lit("")).cast("long")


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, a page, of records that `write_warc` has written.

    `records` has type, record_id, refers_to, payload_bytes and payload_digest, those of what was read; a revisit gets
    these of the response to which it refers, null if that is missing.
    """
    responses = records.where("type = 'response'")
    known = written(responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")), "known")
    revisits = records.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(known, "refers_to", "left")
    both = responses.withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)
    return both.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


def op11_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    seen = read_warc(spark, path, lambda r: r.select("type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), digest(F.col("payload")).alias("payload_digest")))
    return page_records(seen)


OP11_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages),
d as (select page_id, html, top, translate(array_to_string([to_base(('0x' || substr(h, 1 + 5 * i, 5))::bigint, 32, 4) for i in range(8)], ''),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as digest from p)
select page_id, strlen(html) as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to from d
"""
