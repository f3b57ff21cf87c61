"""WARC archives of captures and their index, merged from sorted runs.

Writing: one gzip member per record. Of equal payloads the capture with the smallest id is a response record,
the others are revisit records without payload. Reading parses the members again and verifies the digests.

Index: each archive's captures are sorted by URL key, time and id, which makes a run, and the runs are written to
the shared folder. They are cut by key ranges of about `per_range` captures, however many there are, and a loser
tree merges the pieces of each range, which stay Arrow data until it takes a row from them; ranges in turn give one
global order.

Files go through Spark alone, so any store that Spark knows will do. Spark's text writer ends each row with a
separator; a gzip member of a record under 16 MiB ends with a zero byte (the top byte of its size), so that byte
is left to the separator, and an empty member follows a larger record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, scratch, table

CHUNK = 4 << 20  # compressed bytes in a row of an archive
CHUNKS = 16  # rows in a file
SLICE = 1 << 14
EMPTY = gzip.compress(b"", mtime=0)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and sorted query, lower case; "" for null; an odd URL stands for itself."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def _line(value: str) -> str:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page: str | None, url: str | None, date: str | None, payload: bytes, revisit: bool, refers_to: str | None) -> bytes:
    """A WARC record: response with HTTP head and payload, or revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>"]
    if date is not None:
        head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    out = gzip.compress(data, compresslevel=4, mtime=0)
    return out if out[-1] == 0 else out + EMPTY


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive, each with its offset and length in it; payload digests of responses are verified."""
    at = 0
    while at < len(archive):
        # fed in slices: what a member leaves unused is copied
        inflate, start, parts = zlib.decompressobj(31), at, []
        while not inflate.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(archive[at : at + SLICE]))
            at = min(at + SLICE, len(archive))
        at -= len(inflate.unused_data)
        data = b"".join(parts)
        if not data:
            continue
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
        found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != found):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        ident = lambda name: (fields[name][1:-1].removeprefix("urn:x-page:") or None) if name in fields else None
        yield {"page": ident("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date"), "type": fields["WARC-Type"], "refers_to": ident("WARC-Refers-To"), "bytes": size, "digest": found, "payload": payload, "offset": start, "length": at - start}


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> None:
    """Write a record per row of `pages` to archives under `path`.

    A null payload counts as empty. Of equal payloads those with the smallest id are responses (several only if
    rows repeat that id), others revisits of it; null ids count after all others, and where a group has null ids
    only, all are responses. A null URL or time leaves its header out. Other columns are not read. Who is first is
    told by digests alone; where copies are few that table is broadcast (Spark checks its size) and payloads are not
    shuffled, else adaptive execution splits a payload that very many rows have.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"), (F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None).cast("string")).alias("date"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = cut(rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "first")
    told = rows.join(first, "key", "left")
    told = told.withColumn("revisit", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    told = told.select(F.col("id").cast("string").alias("id"), "url", "date", "payload", "revisit", F.when(F.col("revisit"), F.col("first").cast("string")).alias("refers_to"))

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in (0, 1, 2, 4, 5)]
            for i, payload in enumerate(batch.column(3)):
                page, url, date, revisit, refers_to = (c[i].as_py() for c in columns)
                held.append(member(record(page, url, date, payload.as_py(), revisit, refers_to)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    archive = told.mapInArrow(run, "value binary")
    archive.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS).text(path)


CAPTURE = "urlkey string, date string, page string, archive string, offset bigint, length bigint, type string, refers_to string, bytes bigint, digest string, url string"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _order(c: tuple) -> tuple:
    """URL key, time, id (numbers by value, null first), place in the archive."""
    page = c[2]
    return c[0], c[1] or "", (len(page), page) if page is not None else (0, ""), c[3], c[4]


def _batches(rows: Iterable[tuple], size: int = 4096):
    import pyarrow as pa

    kinds = [pa.int64() if " bigint" in c else pa.string() for c in CAPTURE.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=NAMES)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def runs(spark, path: str) -> DataFrame:
    """The captures in the archives under `path`, sorted within each archive: a null URL sorts as the empty key, a null
    time before all others. Records that repeat are captures each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                short = name.rpartition("/")[2]
                captures = [(url_key(r["url"]), r["date"], r["page"], short, r["offset"], r["length"], r["type"], r["refers_to"], r["bytes"], r["digest"], r["url"]) for r in parse(content.as_py())]
                yield from _batches(sorted(captures, key=_order))

    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, so each next row takes one
    match per level on the way up."""

    def __init__(self, sources: list[Iterator], key):
        self.key, self.sources, self.k = key, sources, len(sources)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * self.k  # by inner node; node 0 holds the winner
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # first to come here waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][2]
            self.heads[winner] = self._pull(winner)
            self._play(winner)


def _rows(parts: list) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time."""
    for part in parts:
        for at in range(0, part.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in part.slice(at, 1024).columns), strict=True)


def natural_runs(batches: Iterable, key) -> list[list]:
    """Batches that hold pieces of sorted runs one after another, as sorted runs, each a list of slices: a new run begins
    where the archive changes or the order breaks."""
    out: list[list] = []
    last = None
    for batch in batches:
        begun = 0
        for i, row in enumerate(_rows([batch])):
            now = (row[3], key(row))
            if last is None or now[0] != last[0] or now[1] < last[1]:
                if i > begun:
                    out[-1].append(batch.slice(begun, i - begun))
                begun = i
                out.append([])
            last = now
        if batch.num_rows > begun:
            out[-1].append(batch.slice(begun))
    return out


def merged(captures: DataFrame, per_range: int = 200_000) -> DataFrame:
    """All captures in global order of URL key, time and id: sorted runs are dealt by key range and merged in
    each range by a loser tree. A URL with very many captures spreads over ranges by time and id. Equal rows all stay;
    an empty table gives no rows. `captures` is read twice, so it should be a table."""
    ranges = max(1, -(-captures.count() // per_range))
    spread = captures.repartitionByRange(ranges, "urlkey", "date", F.length("page"), "page", "archive", "offset")

    def run(batches):
        yield from _batches(LoserTree([_rows(r) for r in natural_runs(batches, _order)], _order))

    return spread.mapInArrow(run, CAPTURE)


def index(spark, path: str, per_range: int = 200_000) -> DataFrame:
    """The capture history of the archives under `path`: see merged(). Archives without records give no rows."""
    return merged(cut(runs(spark, path), "runs"), per_range)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """`pages` has no capture times; each page gets a made-up one, page_id seconds into 2024."""
    pages = table(spark, sf_dir, "pages").withColumn("captured", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id)"))
    path = scratch(spark, "archives")
    write(pages, path, time_col="captured")
    found = index(spark, path)
    return found.select(F.col("page").cast("bigint").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"), F.col("date").alias("captured"))


OP1_SQL = """
with payloads as (select page_id, coalesce(html, '') as payload from pages),
hashed as (select page_id, strlen(payload) as size, sha1(payload) as hex, min(page_id) over (partition by payload) as first from payloads),
digits as (  -- base32: 32 groups of five bits, each within two hex digits
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((((instr('0123456789abcdef', substr(hex, 1 + i * 5 // 4, 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex || '0', 2 + i * 5 // 4, 1)) - 1) >> (3 - i * 5 % 4)) & 31), 1), '' order by i) as digest
  from hashed, (select cast(unnest(range(0, 32)) as integer) as i) group by page_id)
select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to,
       strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') as captured
from hashed join digits using (page_id)
"""
