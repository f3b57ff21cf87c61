"""Secret scans with recursive decoding.

A text is scanned for three kinds of secret, and so is every layer that decoding it gives: percent escapes,
Unicode escapes, base64 runs (wrapped ones too), and gzip or zlib streams inside those. Every layer, texts and
decoded bytes alike, is an item of one worklist and is decoded in turn until nothing new appears; an item whose
content was seen before is not taken again, so cycles end. Every span is mapped back to the code points of the
text it came from.

No layer is left out for what it holds: bytes that are not UTF-8 are read as Latin-1, and UTF-16 text within
them once more by itself. A run under 16 base64 characters holds no 12 bytes, which the shortest secret has.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts

# The patterns of the kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so short ones need no dropping
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
NAMES = tuple(w.decode() for w in WORDS)

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\[uUx]([0-9A-Fa-f]+)")
# an escape of the escape sign, nested any number of times
NESTED = re.compile(r"%(?:25){2,}|\\(?:u005[cC]){2,}|\\(?:x5[cC]){2,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# runs that go on in the next line, as wrapped base64 does
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"[^A-Za-z0-9+/_-]+")
#: Bytes of runs that base64, access and hex secrets are made of.
PLAIN = bytes(97 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))
LONG = b"a" * 16
PACKED = ("H4sI", "eJ", "eA", "eF", "eN")  # how base64 of gzip and zlib streams begins
GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
ZLIB = (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
WIDE = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){12,}|(?:\x00[\x09\x0a\x0d\x20-\x7e]){12,}")

SLICE = 1 << 18  # compressed bytes fed at a time
#: An inflated stream of up to this size is one item; a longer one is taken in windows of it, so that a bomb costs
#: time in proportion to what it holds but no more memory. Windows overlap by the second figure.
WHOLE, OVERLAP = 1 << 26, 1 << 20
#: From this depth on a nest of one escape sign's escapes is unwrapped at once, so that its cost does not grow with the square.
ONE_BY_ONE = 8
#: Where nests of mixed kinds, and streams that inflate to ever other streams, end.
DEPTH = 256


@dataclass
class Layer:
    """A decoded text. `cuts` holds where its pieces begin and `olds` the parent's (start, end) of each piece, end -1
    for a piece that stands there unchanged; an opaque layer, whose characters have no place of their own, maps to
    one span of the root."""

    text: str
    via: str = ""
    parent: Layer | None = None
    cuts: list[int] = field(default_factory=list)
    olds: list[tuple[int, int]] = field(default_factory=list)
    span: tuple[int, int] | None = None
    depth: int = 0

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The root's code points from which these came."""
        layer: Layer | None = self
        while layer is not None:
            if layer.span is not None:
                return layer.span
            if layer.parent is None:
                break
            a, b = bisect.bisect_right(layer.cuts, start) - 1, bisect.bisect_right(layer.cuts, end - 1) - 1
            x, y = layer.olds[a], layer.olds[b]
            start, end = x[0] if x[1] >= 0 else x[0] + start - layer.cuts[a], y[1] if y[1] >= 0 else y[0] + end - layer.cuts[b]
            layer = layer.parent
        return start, end


@dataclass
class Blob:
    """Decoded bytes, which all map to one span of the root."""

    data: bytes
    via: str
    span: tuple[int, int]
    depth: int


def _named(low: str | bytes) -> bool:
    return any(w in low for w in (NAMES if isinstance(low, str) else WORDS))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in a text as it is: leftmost, not overlapping, per kind."""
    out: list[tuple[str, int, int]] = []
    if _named(text.lower()):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _rewritten(layer: Layer, pattern: re.Pattern, decode, via: str) -> Iterator[Layer]:
    """The layer with every match replaced by what it decodes to, or nothing if none decodes."""
    at, size, parts, cuts, olds = 0, 0, [], [], []

    def add(text: str, start: int, end: int) -> None:
        nonlocal size
        if text:
            parts.append(text)
            cuts.append(size)
            olds.append((start, end))
            size += len(text)

    changed = False
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        changed = True
        add(layer.text[at : m.start()], at, -1)
        add(new, *m.span())
        at = m.end()
    if changed:
        add(layer.text[at:], at, -1)
        yield Layer("".join(parts), f"{layer.via}/{via}", layer, cuts, olds, layer.span, layer.depth + 1)


def _from_url(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _from_escapes(run: str) -> str | None:
    try:
        return "".join(chr(int(m[1] or m[2], 16)) for m in ONE_ESCAPE.finditer(run)).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def _inflated(data: bytes, at: int, wbits: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, place in the input after them) of a stream that begins at `at`, a gzip file's later members too; a
    broken stream ends where it breaks."""
    stream = zlib.decompressobj(wbits)
    try:
        while at < len(data):
            part = data[at : at + SLICE]
            at += len(part)
            while part and not stream.eof:
                out = stream.decompress(part, WHOLE >> 4)
                part = stream.unconsumed_tail
                if out:
                    yield out, at - len(part)
            if stream.eof:
                at -= len(stream.unused_data)
                yield b"", at
                if wbits != 31 or not GZIP.match(data, at):
                    return
                stream = zlib.decompressobj(wbits)
        while more := stream.decompress(stream.unconsumed_tail, WHOLE >> 4):
            yield more, at
    except zlib.error:
        return


def _windows(stream: Iterator[tuple[bytes, int]], ended: list[int]) -> Iterator[bytes]:
    """The stream as one piece of bytes, or in overlapping windows if it is long; `ended` gets where it ends."""
    held: list[bytes] = []
    size = 0
    for out, at in stream:
        ended[0] = at
        held.append(out)
        size += len(out)
        if size >= WHOLE:
            whole = b"".join(held)
            yield whole
            held, size = [whole[-OVERLAP:]], OVERLAP
    if size and (size != OVERLAP or len(held) > 1 or not held[0]):
        yield b"".join(held)


def _unpacked(blob: Blob) -> Iterator[Blob]:
    """What the gzip streams in a blob, and a zlib stream at its start, inflate to."""
    at = 0
    while m := GZIP.search(blob.data, at):
        ended = [m.start() + 1]
        for data in _windows(_inflated(blob.data, m.start(), 31), ended):
            yield Blob(data, f"{blob.via}/gzip", blob.span, blob.depth + 1)
        at = max(ended[0], m.start() + 1)
    if blob.data.startswith(ZLIB):
        for data in _windows(_inflated(blob.data, 0, 15), [0]):
            yield Blob(data, f"{blob.via}/zlib", blob.span, blob.depth + 1)


def _telling(data: bytes) -> bool:
    """Whether bytes can hold a secret or a further layer."""
    return b"%" in data or b"\\" in data or b"\n" in data or LONG in data.translate(PLAIN) or _named(data.lower())


def _read(blob: Blob) -> Iterator[Layer]:
    """A blob as text: UTF-8 or else Latin-1, and the UTF-16 runs in it."""
    if _telling(blob.data):
        try:
            text, via = blob.data.decode(), blob.via
        except UnicodeDecodeError:
            text, via = blob.data.decode("latin-1"), blob.via
        yield Layer(text, via, span=blob.span, depth=blob.depth + 1)
    if b"\0" in blob.data and (wide := [m[0].replace(b"\0", b"") for m in WIDE.finditer(blob.data)]):
        yield Layer(b"\n".join(wide).decode("latin-1"), f"{blob.via}/utf-16", span=blob.span, depth=blob.depth + 1)


def _from_base64(layer: Layer) -> Iterator[Blob]:
    """The bytes of base64 runs, in one line or wrapped, read from each of the four places where a quantum may begin:
    what stands before the base64 may be of its characters too."""
    runs = [(m[0], m.span(), False) for m in RUN.finditer(layer.text)]
    if "\n" in layer.text:
        runs += [(m[0], m.span(), True) for m in WRAPPED.finditer(layer.text)]
    for run, span, wrapped in runs:
        starts = {0, 1, 2, 3}
        if wrapped:
            lines = BREAK.split(run.rstrip("="))
            body, at = "".join(lines), 0
            for line in lines:
                if line.startswith(PACKED):
                    starts.add(at)
                at += len(line)
        else:
            body = run.rstrip("=")
        body = body.replace("-", "+").replace("_", "/")
        for start in sorted(starts):
            n = len(body) - start
            n -= n % 4 == 1
            if n >= 16:
                data = base64.b64decode(body[start : start + n] + "=" * (-n % 4))
                yield Blob(data, f"{layer.via}/base64", layer.place(*span), layer.depth + 1)


def decoded(item: Layer | Blob) -> Iterator[Layer | Blob]:
    """The items one step below."""
    if item.depth >= DEPTH:
        return
    if isinstance(item, Blob):
        yield from _unpacked(item)
        yield from _read(item)
        return
    if item.depth >= ONE_BY_ONE and (whole := list(_rewritten(item, NESTED, lambda m: m[:1], "nested"))):
        yield from whole
        return
    if "%" in item.text:
        yield from _rewritten(item, URL, _from_url, "url")
    if "\\" in item.text:
        yield from _rewritten(item, ESCAPE, _from_escapes, "unicode")
    yield from _from_base64(item)


def scan(data: bytes | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, via) of all secrets of a text, by start, kind and end; via is "" for those that stand
    in the text itself, else the decoders' path. A span found in several ways is given once, the plainest."""
    if not data:
        return []
    if not _telling(data):
        return []
    found: dict[tuple[str, int, int], str] = {}
    seen: set[bytes] = set()
    work: deque[Layer | Blob] = deque([Layer(data.decode("utf-8", "replace"))])
    while work:
        item = work.popleft()
        if isinstance(item, Layer):
            content = item.text.encode("utf-8", "surrogatepass")
            # the same text at other places of the root is another item, and so is one that maps otherwise
            where = item.span if item.span is not None else (item.olds[:64], len(item.olds))
        else:
            content, where = item.data, item.span
        key = hashlib.blake2b(content, digest_size=16, key=hashlib.blake2b(repr((isinstance(item, Blob), where)).encode(), digest_size=16).digest()).digest()
        if key in seen:
            continue
        seen.add(key)
        if isinstance(item, Layer):
            for kind, start, end in base_spans(item.text):
                found.setdefault((kind, *item.place(start, end)), item.via.lstrip("/"))
        work.extend(decoded(item))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(k, a, b, via) for (k, a, b), via in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, spans (kind, start, end, via). Null and empty texts have none. Repeated
    rows are scanned each; other columns are not read; an empty table gives no rows."""

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())])
        for batch in batches:
            got = [[dict(zip(("kind", "start", "end", "via"), s, strict=True)) for s in scan(t)] for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(span))], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,via:string>>")


def op7_secrets_of(documents: DataFrame) -> DataFrame:
    found = find(documents)
    base = F.filter("spans", lambda s: s["via"] == "")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return op7_secrets_of(table(spark, sf_dir, "documents"))
