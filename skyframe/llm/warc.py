"""Operator 4, WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: Spark's text writer puts the record separator after each record, so its files are plain WARC 1.1
files on any store. A response record's block is an HTTP message whose entity body is the payload; every record has
an id, a date and a length. A payload that repeats is stored once, with the smallest id; other records with
the same SHA-1 revisit it, and name its record, URI and date.

Reading: Spark's text reader, with the start of a record's first line as separator, cuts the files into pieces in
parallel, also inside large files. Each piece is a candidate record, of any 1.x version, with its header names in any
case, in any order, and folded or not; they say where its successor must start. A magic line inside a
payload makes a false candidate too. The candidate offsets follow from
the lengths of the pieces before. Pointer jumping from each file's start then keeps only the records that
a chain of successors reaches, in a number of rounds logarithmic in the records of a file. A record
whose payload holds the magic line is put together from its pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import new_path, written

VERSION = "WARC/1.1\r\n"
MAGIC = "WARC/1."
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS_PER_FILE = 20_000
BROADCAST_ROWS = 200_000
# The names of header fields, as they are compared.
FIELDS = ("warc-type", "warc-payload-digest", "x-page-id", "x-payload-length", "x-refers-to-page-id", "content-length", "content-type", "content-encoding", "transfer-encoding")


def header_fields(head: bytes) -> dict[str, str]:
    """The fields of header lines by name in lower case, the first of each name; a line that starts with white space goes on with the one before."""
    found: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def payload_at(block: bytes, content_type: str) -> int:
    """Where the payload starts in a block: after the header of an HTTP response, else at its start."""
    if content_type.lower().replace(" ", "").startswith("application/http") and block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        return end + 4 if end >= 0 else 0
    return 0


_VERSION = re.compile(rb"[0-9]\r?\n")  # after the magic


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE, date: str | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> None:
    """A record per row of pages under path: response with its payload, or revisit if a smaller id has the same payload.

    A null payload is empty, a null url is left out, and so is a null id (the record then is a response).
    Rows that share the smallest id and the payload are all responses. Ids are written percent-encoded, so that they
    may hold anything; rows that repeat an id and its payload have one record id. Other columns are not written. `date` is the records' WARC-Date (now, if None).
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    of_this_write = uuid.uuid4().hex

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array([sha1_base32(x.encode()) for x in batch.column("html").to_pylist()], pa.string())], names=["id", "url", "digest"])

    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", " ").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first")
    repeats = own.select("id", "url", "html").mapInArrow(digest, f"id {kind}, url string, digest string").groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.id").alias("first"), F.col("first.url").alias("first_url"))
    repeats = written(repeats, "repeats")
    if repeats.count() <= broadcast_rows:
        repeats = F.broadcast(repeats)  # else both sides are shuffled, and a hot payload can be split

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sha1_base32(x.encode()) for x in html], pa.string()), pa.array([len(x.encode()) for x in html], pa.int64())], names=[*batch.schema.names, "digest", "bytes"])

    full = own.mapInArrow(with_digest, f"id {kind}, url string, html string, digest string, bytes long").join(repeats, "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    # an id of its own for every record with an id: the first's follows from the id alone, so that revisits can name it
    urn = lambda *parts: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.lit(of_this_write), *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    page = lambda c: F.when(F.col(c).isNotNull(), F.url_encode(F.col(c).cast("string")))
    record = F.when(F.col("id").isNotNull(), urn(page("id"), F.col("digest"))).otherwise(urn(F.uuid()))
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(revisit, "").otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(VERSION),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        line("WARC-Record-ID", record),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, urn(page("first"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Page-Id", page("id")),
        line("X-Payload-Length", F.col("bytes")),
        line("X-Refers-To-Page-Id", F.when(revisit, page("first"))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    full.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the files between magic lines, as (file, split, bytes), in file order inside a split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("piece"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece's headers claim. If it holds the whole record, a stored payload's digest and length are taken here."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    number = lambda x: int(x) if x and x.isascii() and x.isdigit() and len(x) < 19 else None
    for batch in batches:
        rows = []
        for piece in batch.column("piece").to_pylist():
            head = piece.find(b"\r\n\r\n")
            fields = header_fields(piece[:head]) if head >= 0 and _VERSION.match(piece) else {}
            size = number(fields.get("content-length"))
            if size is None:
                rows.append((len(piece), None, None, None, None, None, None, None, None, False))
                continue
            kind, about = (fields.get("warc-type") or "").lower(), fields.get("content-type", "")
            whole = len(piece) == head + 4 + size + 4
            digest, claimed = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, number(fields.get("x-payload-length"))
            if whole and kind != "revisit":
                block = piece[head + 4 : head + 4 + size]
                payload = block[payload_at(block, about) :]
                digest, claimed = sha1_base32(payload), len(payload)
            page = lambda name: unquote_plus(fields[name]) if name in fields else None  # noqa: B023, E731
            rows.append((len(piece), head + 4, size, kind, digest, page("x-page-id"), page("x-refers-to-page-id"), claimed, about, whole))
        columns = list(zip(*rows)) or [()] * 10
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), batch.column("seq"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["file", "split", "seq", "len", "head", "size", "type", "digest", "page", "refers", "bytes", "about", "whole"])


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, split, run, at, next) on the chain of successors from each file's offset 0.

    A run is a row of neighbours each of which is the successor of the one before, so whatever enters a
    run leaves it at its end: pointers jump from run to run, and twice as far each round.
    """
    leave = F.max("next").over(Window.partitionBy("file", "split", "run"))
    nodes = written(candidates.select("file", "split", "run", "at", leave.alias("next")), "nodes")
    jump = nodes.select("file", "at", "next")
    entered = jump.filter("at = 0").select("file", "at")
    for _ in range(64):
        new = entered.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        entered = written(entered.union(new).distinct(), "entered")
        following = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(following, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")
        if jump.isEmpty():
            break
    entries = nodes.join(entered, ["file", "at"]).groupBy("file", "split", "run").agg(F.min("at").alias("entry"))
    return nodes.join(entries, ["file", "split", "run"]).filter("at >= entry").select("file", "at")


def _placed(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """pieces with `at`, the offset of the magic line before them (negative for what precedes the first)."""
    inside = F.sum(F.col("len") + len(MAGIC)).over(Window.partitionBy("file", "split").orderBy("seq")) - F.col("len")
    return pieces.withColumn("inside", inside).join(starts, ["file", "split"]).withColumn("at", F.col("base") + F.col("inside") - 2 * len(MAGIC)).drop("inside", "base")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that a file's chain reaches: page, type, digest, bytes and refers, from its headers and payload.

    Of a response, digest and bytes are those of the stored payload; of a revisit, those its headers
    give for the full payload. A file that doesn't start with a record gives no rows.
    """
    parsed = "file string, split long, seq long, len long, head long, size long, type string, digest string, page string, refers string, bytes long, about string, whole boolean"
    pieces = written(_pieces(spark, path).mapInArrow(_parse, parsed), "pieces")
    splits = pieces.groupBy("file", "split").agg(F.sum(F.col("len") + len(MAGIC)).alias("n"))
    starts = written(splits.select("file", "split", (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("base")), "splits")
    placed = _placed(pieces, starts).withColumn("next", F.col("at") + len(MAGIC) + F.col("head") + F.col("size") + len(END))
    order = Window.partitionBy("file", "split").orderBy("seq")
    alone = F.coalesce(F.lag("next").over(order) != F.col("at"), F.lit(True)).cast("int")
    placed = written(placed.withColumn("alone", alone).withColumn("run", F.sum("alone").over(order)).drop("alone"), "candidates")
    on_chain = reachable(placed.filter("next is not null and at >= 0"))
    records = written(placed.join(on_chain, ["file", "at"]), "records")
    out = ["page", "type", "digest", "bytes", "refers"]
    broken = records.filter("not whole").select("file", F.col("at").alias("from"), F.col("next").alias("until"), "head", "size", "about", *out)
    if broken.isEmpty():
        return records.filter("whole").select(out)
    return records.filter("whole").select(out).unionByName(_rebuilt(broken, _pieces(spark, path), starts).select(out))


def _rebuilt(broken: DataFrame, raw: DataFrame, starts: DataFrame) -> DataFrame:
    """broken, the records that hold the magic line in their payload, with digest and bytes from their pieces, which are read again."""
    raw = raw.join(broken.select("file").distinct(), "file", "left_semi").withColumn("len", F.octet_length("piece").cast("long"))
    own = _placed(raw, starts).select("file", "at", F.lit(None).cast("long").alias("until"), "piece")
    marks = broken.select("file", F.col("from").alias("at"), "until", F.lit(None).cast("binary").alias("piece"))
    order = Window.partitionBy("file").orderBy("at", F.col("piece").isNotNull())
    held = own.unionByName(marks).withColumn("mark", F.last(F.when(F.col("until").isNotNull(), F.struct(F.col("at").alias("from"), "until")), ignorenulls=True).over(order))
    inside = held.filter("piece is not null and at < mark.until").groupBy("file", F.col("mark.from").alias("from")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block = MAGIC.encode().join(x["piece"] for x in r["parts"])[r["head"] : r["head"] + r["size"]]
                data = block[payload_at(block, r["about"]) :]
                rows.append((r["page"], r["type"], sha1_base32(data), len(data), r["refers"]) if r["type"] != "revisit" else (r["page"], r["type"], r["digest"], r["bytes"], r["refers"]))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["page", "type", "digest", "bytes", "refers"])

    return broken.join(inside, ["file", "from"]).mapInArrow(run, "page string, type string, digest string, bytes long, refers string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write pages as WARC files and read them back: id, payload_bytes, payload_digest, record_type and refers_to per record.

    Nulls and repeated rows: see write_archives. No rows give no files and no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, path).select(
        F.col("page").cast(kind).alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to")
    )
