"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts are folded (lower case, ASCII punctuation and white space to single spaces). An item of m characters may
appear, as a whole whatever its length, with at most k = `edits` * m errors; by the q-gram lemma it then shares at
least m - q + 1 - k * q q-grams with the document inside a band of 2k + 1 diagonals. Shared q-grams are counted in
bands of twice that width that overlap by half, so each such band lies wholly in one; bands that reach the bound
are aligned, cell by cell of the band alone, and the document is contaminated if the edit distance is within the
budget. An item shorter than a q-gram is found unchanged, between word borders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts, utf8

CLEAN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
CHUNK = 1 << 20
TABLE_BITS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def fold(text: bytes | None) -> str:
    return " ".join((text or b"").decode("utf-8", "replace").lower().encode().translate(CLEAN).decode("utf-8", "replace").split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram that begins at each character, by doubling."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    power, have, out, width = chars.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1), 1, None, 0
    base = np.full(1, BASE)
    n, rest = len(chars) - q + 1, q
    while rest:
        if rest & 1:
            part = power[width : width + n]
            out = part.copy() if out is None else out * base + part
            width += have
        rest >>= 1
        if rest:
            power = power[:-have] * (base + np.uint64(2)) + power[have:]
            base = base * BASE
            have *= 2
    return out ^ (out >> np.uint64(29))


@dataclass
class Items:
    """A block of benchmark items and their q-grams."""

    q: int
    ids: list
    chars: list[np.ndarray]
    texts: list[str]
    budget: np.ndarray  # k of each item
    bound: np.ndarray  # shared q-grams that the lemma asks for
    grams: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # where each hash's postings begin
    owner: np.ndarray  # postings: item and place of each q-gram
    place: np.ndarray
    filled: np.ndarray  # which buckets of a hash table are in use
    window: int = 1  # some window of so many characters in any occurrence begins at least `dense` q-grams of items
    dense: int = 1
    reach: int = 1  # the most characters that an occurrence spans
    short: object = None  # an automaton of the items shorter than q, if there are any


def items(rows: list[tuple], q: int = 10, edits: float = 0.08) -> Items:
    """Items (id, text), folded. Where k would make the lemma's bound useless (under 2q characters or so), k is
    lowered until the bound is 1. Null texts, and those that fold to nothing, match nothing."""
    ids, chars, short = [], [], []
    for item, text in rows:
        folded = fold(text.encode() if isinstance(text, str) else text)
        if len(folded) >= q:
            ids.append(item)
            chars.append(codes(folded))
        elif folded:
            short.append((item, folded))
    length = np.array([len(c) for c in chars], np.int64)
    budget = np.minimum((length * edits + 1e-9).astype(np.int64), np.maximum(0, (length - q) // q)) if len(length) else length
    hashes = [gram_hashes(c, q) for c in chars]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(chars)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    every, owner, place = every[order], owner[order], place[order]
    grams, first = np.unique(every, return_index=True)
    filled = np.zeros(1 << TABLE_BITS, bool)
    filled[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    bound, span = length - q + 1 - budget * q, length + budget
    window = int(span.min()) if len(span) else 1
    # an occurrence lies in ceil(span / window) windows, so one of them holds that share of its q-grams
    dense = int((-(-bound // -(-span // window))).min()) if len(span) else 1
    made = Items(q, ids, chars, [c.tobytes().decode("utf-32-le") for c in chars], budget, bound, grams, np.append(first, len(every)), owner, place, filled, window, dense, int(span.max(initial=1)))
    if short:
        import ahocorasick

        made.short = ahocorasick.Automaton()
        for folded in {f for _, f in short}:
            made.short.add_word(f" {folded} ", (len(folded), [i for i, f in short if f == folded]))
        made.short.make_automaton()
    return made


def near_dense(found: Items, spots: np.ndarray) -> np.ndarray:
    """Which of the ascending places `spots` of item q-grams can lie in an occurrence: those within reach of a
    window that begins `dense` of them."""
    i = np.arange(max(len(spots) - found.dense + 1, 0))
    tight = spots[i + found.dense - 1] - spots[i] < found.window
    a, b = spots[i[tight]] - found.reach, spots[i[tight] + found.dense - 1] + found.reach
    marks = np.zeros(len(spots) + 1, np.int64)
    np.add.at(marks, np.searchsorted(spots, a, side="left"), 1)
    np.add.at(marks, np.searchsorted(spots, b, side="right"), -1)
    return np.cumsum(marks[:-1]) > 0


def distance(item: np.ndarray, text: np.ndarray, k: int, first: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole item in the text within k edits, among alignments on the
    `width` diagonals (place in the text less place in the item) from `first` on; None if there is none.

    A row per character of the item, a cell per diagonal of the band. Of equally good places the first to end.
    """
    m, n, far = len(item), len(text), 1 << 30
    steps = np.arange(width)
    # what stands in the text under each cell of each row; a code that no character has beyond its ends
    under = np.full(m + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, -first), min(m + width, n - first)
    if a < b:
        under[a:b] = text[first + a : first + b]
    row, start = np.where((first + steps >= 0) & (first + steps <= n), 0, far), first + steps
    big = 4 * width + 8
    for i, c in enumerate(item, 1):
        swap = row + (under[i - 1 : i - 1 + width] != c)
        drop = np.append(row[1:] + 1, far)
        best = np.minimum(swap, drop)
        origin = np.where(swap <= drop, start, np.append(start[1:], 0))
        best[: max(0, min(width, -(i + first)))] = far
        best[max(0, n - i - first + 1) :] = far
        # characters more: a running minimum of best less place
        source = np.minimum.accumulate((best - steps) * big + steps) % big
        row, start = best[source] + (steps - source), origin[source]
        row[max(0, n - i - first + 1) :] = far
        if row.min() > k:
            return None
    end = int(row.argmin())
    return int(row[end]), int(start[end]), m + first + end


def matches(found: Items, text: str) -> Iterator[tuple[int, int, int, int]]:
    """(item's number, edits, start, end) of the items that occur in a run of folded characters (texts parted by
    newlines). Shared q-grams count for the text they stand in, and a band ends with it. A band that holds the
    item unchanged needs no alignment."""
    chars = codes(text)
    hashes = gram_hashes(chars, found.q)
    if not len(found.grams) or not len(hashes):
        return
    spots = np.flatnonzero(found.filled[(hashes >> np.uint64(64 - TABLE_BITS)).view(np.int64)])
    at = np.searchsorted(found.grams, hashes[spots])
    at[at == len(found.grams)] = 0
    same = found.grams[at] == hashes[spots]
    spots, at = spots[same], at[same]
    near = near_dense(found, spots)
    spots, at = spots[near], at[near]
    counts = found.first[at + 1] - found.first[at]
    total = int(counts.sum())
    if not total:
        return
    posting = np.repeat(found.first[at] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
    item = found.owner[posting]
    diagonal = np.repeat(spots, counts) - found.place[posting] + len(chars)  # kept positive
    width = 2 * found.budget[item] + 1
    band = diagonal // width
    n_bands = 2 * len(chars) + 2
    borders = np.concatenate(([-1], np.flatnonzero(chars == 10), [len(chars)]))
    n_texts = len(borders) - 1
    within = np.repeat(np.searchsorted(borders, spots) - 1, counts)
    base = (item * n_texts + within) * n_bands + band
    key, hits = np.unique(np.concatenate((base, base - 1)), return_counts=True)
    owner = key // n_bands // n_texts
    enough = hits >= found.bound[owner]
    key = key[enough]
    for s, t, b in zip(owner[enough].tolist(), (key // n_bands % n_texts).tolist(), (key % n_bands).tolist(), strict=True):
        k, size = int(found.budget[s]), len(found.chars[s])
        w = 2 * k + 1
        left, right = int(borders[t]) + 1, int(borders[t + 1])
        first = b * w - len(chars) - k  # the shared q-grams' diagonals and k more on either side
        low, high = max(left, first), min(right, first + 2 * w + 2 * k + size)
        if (same := text.find(found.texts[s], low, high)) >= 0:
            yield s, 0, same, same + size
        elif low < high and (best := distance(found.chars[s], chars[left:right], k, first - left, 2 * w + 2 * k)):
            yield s, best[0], left + best[1], left + best[2]


def scan(found: Items, rows: Iterable[bytes | None]) -> Iterator[dict]:
    """For each text in turn: item id -> (edits, start, end) of its best match, in folded characters.

    Texts are joined into runs of about CHUNK characters, so short ones share numpy calls; a longer text is
    taken in runs that overlap by more than any item can span.
    """
    overlap = found.reach + found.q
    chunk = max(CHUNK, 4 * overlap)

    def run(group: list[str]) -> list[dict]:
        out: list[dict] = [{} for _ in group]
        starts = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
        for s, edits, a, b in matches(found, "\n".join(group)):
            at = int(np.searchsorted(starts, a, side="right")) - 1
            keep(out[at], found.ids[s], (edits, a - int(starts[at]), b - int(starts[at])))
        return out

    def keep(best: dict, item, match: tuple[int, int, int]) -> None:
        if item not in best or match < best[item]:
            best[item] = match

    def whole(text: str, best: dict) -> dict:
        if found.short is not None:
            for last, (size, ids) in found.short.iter(f" {text} "):
                for item in ids:
                    keep(best, item, (0, last - size - 1, last - 1))
        return best

    group: list[str] = []
    size = 0
    for text in rows:
        folded = fold(text)
        if len(folded) > chunk:
            yield from map(whole, group, run(group) if group else [])
            group, size = [], 0
            best: dict = {}
            for a in range(0, len(folded), chunk - overlap):
                for item, (edits, x, y) in run([folded[a : a + chunk]])[0].items():
                    keep(best, item, (edits, a + x, a + y))
            yield whole(folded, best)
            continue
        group.append(folded)
        size += len(folded) + 1
        if size >= chunk:
            yield from map(whole, group, run(group))
            group, size = [], 0
    if group:
        yield from map(whole, group, run(group))


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000, pass_chars: int = 64_000_000) -> Iterator[list[list[tuple]]]:
    """The benchmark as blocks of rows (id, text) of about `block_chars` characters, of which each task indexes one at
    a time, in lists of about `pass_chars`, of which each is broadcast and costs one scan of the documents. Items of
    one id are alternatives."""
    held: list[list[tuple]] = [[]]
    size = total = 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        held[-1].append((row[0], row[1]))
        size, total = size + len(row[1]), total + len(row[1])
        if total >= pass_chars:
            yield held
            held, size, total = [[]], 0, 0
        elif size >= block_chars:
            held.append([])
            size = 0
    if held[0]:
        yield held


class Search:
    """The blocks of one pass; a few stay indexed, more are indexed anew for each batch of texts."""

    def __init__(self, blocks: list[list[tuple]], options: dict):
        self.blocks, self.options = [b for b in blocks if b], options
        self.made = [items(b, **options) for b in self.blocks] if len(blocks) <= 4 else None

    def __call__(self, rows: list[bytes | None]) -> list[dict]:
        out: list[dict] = [{} for _ in rows]
        for found in self.made or (items(b, **self.options) for b in self.blocks):
            for best, more in zip(out, scan(found, rows), strict=True):
                for item, match in more.items():
                    if item not in best or match < best[item]:
                        best[item] = match
        return out


def _taken(batches, column: int, most: int = 1 << 24):
    """Arrow batches in parts whose texts hold about `most` bytes."""
    for batch in batches:
        _, offsets, _ = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, side="right")) - 1)
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = 4_000_000, pass_chars: int = 64_000_000, **options) -> DataFrame:
    """One row per document row and benchmark item found in it: id, item, edits, start, end (folded characters).

    Null and empty texts contain nothing. Repeated rows are reported each; a null id is reported as null. An
    empty benchmark or table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, edits int, start bigint, end bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for blocks in passes(benchmark, item_col, block_chars=block_chars, pass_chars=pass_chars):
        held = docs.sparkSession.sparkContext.broadcast(blocks)  # `pass_chars` characters or so

        def run(batches, held=held):
            import pyarrow as pa

            search = Search(held.value, options)
            for batch in _taken(batches, 1):
                got = [(i, item, *m) for i, best in enumerate(search(list(texts(batch.column(1))))) for item, m in sorted(best.items(), key=lambda x: (x[0] is None, x[0]))]
                if got:
                    at, item, edits, start, end = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, pa.int64() if item_type == "bigint" else None), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["id", "item", "edits", "start", "end"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", block_chars: int = 4_000_000, pass_chars: int = 64_000_000, **options) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, with all columns as they are.

    Null and empty texts contain nothing and stay. Repeated rows share their fate. An empty benchmark leaves all
    rows, an empty table stays empty."""
    at, out = docs.columns.index(text_col), docs
    for blocks in passes(benchmark, item_col, block_chars=block_chars, pass_chars=pass_chars):
        held = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches, held=held):
            import pyarrow as pa

            search = Search(held.value, options)
            for batch in _taken(batches, at):
                yield batch.filter(pa.array([not best for best in search(list(texts(batch.column(at))))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "start", "end")
