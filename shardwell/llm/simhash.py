"""SimHash fingerprints and an exact Hamming self-join by a binary trie.

Fingerprints: words of the text with A-Z lowered, shingles of `width` words, XXH64 with seed 42; a bit is
set if over half of the hashes set it.

Join: two fingerprints that differ in at most `budget` bits agree wholly in one of budget + 1 bit blocks, so
each distinct fingerprint goes to one group per block. Within a task the groups form one sorted array, which
is the binary trie: a node is a range, its children are split by the next bit. Node pairs are walked
together, differing bits accumulate, and a pair is pruned when they exceed the budget or when all leaves below
are linked already. A group larger than `max_group` is dealt into chunks, and each pair of chunks is a task
of its own, so no group has to fit in one task. Only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settings
from .common import Scope, cut, forget, partitions, pieces, texts, utf8
from .components import attach, components

BITS = 64
FRONTIER = 1 << 18


def shingle_hashes(data: bytes | None, width: int = 3) -> Iterator[list[int]]:
    """XXH64 (seed 42) of the shingles of a text, in lists of bounded length; none for a text without words."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    short = True
    for piece in pieces(data or b""):
        words = held + piece.lower().split()
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-width])).tolist() if width < len(words) else [0]
            stops = (ends[width - 1 :] - 1).tolist()
            yield [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
            short, held = False, words[-(width - 1) :] if width > 1 else []
        else:
            held = words
    if short and held:
        yield [xxh64_intdigest(b" ".join(held), 42)]


#: Each byte with its bits spread over the bytes of a word, so that sums of up to 255 words count bits apart.
SPREAD = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes set each of the 64 bits."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        spread = SPREAD[hashes[at : at + 255 * 64].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return total


def majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text (null, empty or without words: 0)."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(data, width):
        n += len(hashes)
        votes += bit_counts(np.array(hashes, np.uint64))
    return majority(votes, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, hash, fp): one row per row of `docs`; hash is the text's xxHash64, fp a signed 64-bit integer."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [fingerprint(t, width) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, fp bigint")


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge labels along links a-b; a label is the smallest row of its class."""
    while a.size:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def trie_links(fps: np.ndarray, starts: np.ndarray, budget: int = 3) -> np.ndarray:
    """For uint64 fingerprints sorted within groups that begin at `starts`: the class of each row, as the smallest row of its group that it reaches by links of at most `budget` differing bits."""
    n = len(fps)
    labels = np.arange(n)
    ends = np.append(starts[1:], n)
    wide = ends - starts > 1
    lo, hi = starts[wide], ends[wide]
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    stack = [(BITS - 1, lo[i : i + FRONTIER], hi[i : i + FRONTIER], lo[i : i + FRONTIER], hi[i : i + FRONTIER], np.zeros(len(lo[i : i + FRONTIER]), np.int8)) for i in range(0, len(lo), FRONTIER)]
    changes = np.zeros(n + 1, np.int64)

    def settled(alo, ahi, blo, bhi):
        return (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (labels[alo] == labels[blo])

    def mark() -> None:
        changes[1:n] = np.cumsum(labels[1:] != labels[:-1])

    mark()
    while stack:
        bit, alo, ahi, blo, bhi, d = stack.pop()
        live = ~settled(alo, ahi, blo, bhi)
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if (done := leaf & live).any():
            near = np.bitwise_count(fps[alo[done]] ^ fps[blo[done]]) <= budget
            if near.any():
                labels = _roots(labels, alo[done][near], blo[done][near])
                mark()
        live &= ~leaf
        alo, ahi, blo, bhi, d = alo[live], ahi[live], blo[live], bhi[live], d[live]
        if not alo.size or bit < 0:
            continue
        same = alo == blo
        am, bm = split(alo, ahi, bit), split(blo, bhi, bit)
        cross = ~same
        more = (d < budget) & cross
        once = (d < budget) & same
        nxt = (
            np.concatenate((alo[more], am[more], alo[once], alo, am)),
            np.concatenate((am[more], ahi[more], am[once], am, ahi)),
            np.concatenate((bm[more], blo[more], am[once], blo, bm)),
            np.concatenate((bhi[more], bm[more], ahi[once], bm, bhi)),
            np.concatenate((d[more] + 1, d[more] + 1, d[once] + 1, d, d)).astype(np.int8),
        )
        alo, ahi, blo, bhi, d = nxt
        full = (alo < ahi) & (blo < bhi) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, d = (x[full] for x in (alo, ahi, blo, bhi, d))
        stack += [(bit - 1, *(x[i : i + FRONTIER] for x in (alo, ahi, blo, bhi, d))) for i in range(0, len(alo), FRONTIER)]
    return labels


def _forest(batches, budget: int, rows_at_once: int = 1 << 20):
    """Arrow batches of (g, fp, t), sorted by the first two -> links (t, a, b) of a spanning forest of each g;
    t is the same all over a g."""
    import pyarrow as pa

    def links(g: np.ndarray, fp: np.ndarray, t: np.ndarray):
        keep = np.concatenate(([True], (g[1:] != g[:-1]) | (fp[1:] != fp[:-1])))
        g, fp, t = g[keep], fp[keep], t[keep]
        unsigned = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        # the JVM sorts signed values: put each group's negative ones last
        order = np.lexsort((unsigned, g))
        g, unsigned = g[order], unsigned[order]
        labels = trie_links(unsigned, starts, budget)
        a = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(t[a]), pa.array(unsigned[a].view(np.int64)), pa.array(unsigned[labels[a]].view(np.int64))], names=["t", "a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        count += batch.num_rows
        if count >= rows_at_once:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            if last:
                yield links(*(x[:last] for x in whole))
                held, count = [tuple(x[last:] for x in whole)], len(whole[0]) - last
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def masks(budget: int = 3, levels: int = 1) -> list[int]:
    """Bit masks of which two fingerprints within the budget share at least one wholly.

    One level cuts the 64 bits into budget + 1 blocks; a second level cuts the rest again, for longer keys.
    """

    def blocks(bits: list[int]) -> list[list[int]]:
        n = budget + 1
        return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]

    out = []
    for one in blocks(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in one]
        out += [one + two for two in blocks(rest)] if levels == 2 else [one]
    return [sum(1 << b for b in m) for m in out]


def links(fps: DataFrame, budget: int = 3, max_group: int = 1024, levels: int | None = None) -> DataFrame:
    """Links (t, a, b) between distinct fingerprints `fps(t, fp)` of the same table t: a spanning forest of each
    group, which joins exactly what the links of at most `budget` bits join.

    Groups go by masks of one level, or of two from 2^26 fingerprints on, where groups of one level would
    hold over a thousand each; the links are the same.
    """
    levels = levels or (1 if fps.count() < 1 << 26 else 2)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(budget, levels)]
    keyed = fps.select("t", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("mask", "key"))
    hot = keyed.groupBy("t", "mask", "key").count().filter(F.col("count") > max_group).select("t", "mask", "key", F.ceil(F.col("count") / max_group).cast("int").alias("chunks"))
    # one level has 2^16 keys a mask at most
    dealt = keyed.join(F.broadcast(hot) if levels == 1 else hot, ["t", "mask", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.filter("chunks = 1 or own <> other").select(F.xxhash64("t", "mask", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp", "t")
    spark = fps.sparkSession
    return dealt.repartition(partitions(spark), "g").sortWithinPartitions("g", "fp").mapInArrow(lambda batches: _forest(batches, budget), "t int, a bigint, b bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_group: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root, component) of the fingerprints whose component has more
    than one row; root is the component's smallest fingerprint, component its smallest id."""
    rows = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    found = links(nodes.select(F.lit(0).alias("t"), "fp"), budget, max_group)
    roots = components(found.select("a", "b"))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    linked = cut(linked, "roots")
    of_root = cut(linked.groupBy("root").agg(F.min("rep").alias("component"), F.sum("n").alias("n")).filter("n > 1").drop("n"), "components")
    joined = attach(linked.select("root", "fp"), "root", of_root)
    return rows, cut(joined.select("fp", "root", "component"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: id, fp (signed 64 bits), component (smallest id reachable by links).

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows each get a row. A
    null id is passed over when the smallest id is taken; a component of null ids only has a null component.
    An empty table gives an empty result; other columns are not read.
    """
    rows, found = classes(docs, id_col, text_col, **options)
    return rows.join(found, "fp", "left").select("id", "fp", F.coalesce("component", "id").alias("component"))


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; one fixed value for a text without words."""
    parts = [np.array(h, np.uint64) for h in shingle_hashes(data, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


NONE = np.zeros(0, np.uint64)
FEW, MANY = 512, 4096  # buckets of the parity bits; the many are for sets of over FEW


def parity(hashes: np.ndarray, buckets: int) -> bytes:
    """For each bucket, by the hashes' last bits, whether it holds an odd number of them."""
    return np.packbits(np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).tobytes()


def prefixes(docs: DataFrame, width: int, similarity: float, late: np.ndarray = NONE, marked: bool = False) -> DataFrame:
    """(token, node): of each row of `docs(node, text)` the first tokens of its shingle set, in order of hash with the
    ascending hashes `late` after all others. With `marked` also fp, n and bits, in a row of its own without a token for
    each row of `docs`: see marks().

    Two sets of at least that Jaccard similarity have a token in common among the first n - ceil(similarity * n) + 1
    of each, in any one order of all tokens.
    """

    def run(batches):
        import pyarrow as pa

        empty = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        names = ["token", "node", "fp", "n", "bits", "more"] if marked else ["token", "node"]
        for batch in batches:
            tokens, fps, sizes, bits, more = [], [], [], [], []
            for text in texts(batch.column(1)):
                h = shingle_set(text, width)
                if marked:
                    fps.append(majority(bit_counts(h), len(h)))
                    sizes.append(len(h))
                    bits.append(parity(h, FEW))
                    more.append(parity(h, MANY) if len(h) > FEW else None)
                most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate((h[~last], h[last]))
                tokens.append(h[:most])
            if not tokens:
                continue
            if marked:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fps), pa.int64()), batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(more, pa.binary())], names=names)
            counts = np.array([len(t) for t in tokens])
            node = np.repeat(batch.column(0).to_numpy(), counts)
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node), *(empty(len(node)) if marked else [])], names=names)
            yield from (out.slice(i, 1 << 17) for i in range(0, out.num_rows, 1 << 17))

    return docs.select("node", "text").mapInArrow(run, "token bigint, node bigint" + (", fp bigint, n int, bits binary, more binary" if marked else ""))


def marks(looked: DataFrame) -> DataFrame:
    """(node, fp, n, bits, more) of the marked prefixes, each node once: the fingerprint of the set of its shingles, the
    set's size, and its parity bits, for large sets in more buckets too. Two sets differ in at least as many shingles as
    parity bits, so the bits rule pairs out without a miss."""
    return looked.filter("token is null").select("node", "fp", "n", "bits", "more").dropDuplicates(["node"])


def by_trie(told: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b): pairs of nodes that the trie self-join of their fingerprints joins, and of nodes of one fingerprint;
    as many pairs as rows and links of its forest."""
    reps = cut(told.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("m")), "reps")
    found = links(reps.select(F.lit(0).alias("t"), "fp"), budget).select("a", "b").distinct()
    one = attach(found, "a", reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")))
    both = attach(one, "b", reps.select(F.col("fp").alias("b"), F.col("rep").alias("y"))).select("x", "y")
    same = attach(told.select("fp", "node"), "fp", reps.filter("m > 1").select("fp", "rep")).filter("node <> rep").select("node", "rep")
    return both.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _needed(rows: DataFrame, anchors: int = 2) -> DataFrame:
    """The rows of (token, node, comp) in which every two rows of different components that share a token still do.

    A token whose rows all have the same other token adds no pair. Whether they have is told for the token that
    comes first in some order among those of each node."""
    for turn in range(anchors):
        several = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        rows = attach(rows, "token", cut(several, "several"))
        first = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("token", F.lit(turn)), "token")).alias("f")).select("node", F.col("f.token").alias("f"))
        told = attach(rows, "node", cut(first, "anchors"))
        keep = told.groupBy("token").agg(F.min("f").alias("x"), F.max("f").alias("y")).filter("x <> y or x = token").select("token")
        rows = cut(attach(rows, "token", cut(keep, "needed")), "open")
    return rows


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """(g, side, token, node, comp) from (token, node, comp): groups within which rows of different components meet.

    A token of over `chunk` rows is dealt into chunks: those of its largest component, and those of the rest. Each
    two chunks of the rest make a group, and each of them with each of the largest component (then `side` tells them
    apart); rows of the largest component need not meet each other."""
    each = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    sizes = each.groupBy("token").agg(F.sum("c").alias("total"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1")
    told = attach(rows, "token", cut(sizes, "sizes"))
    chunks = lambda n: F.ceil(n / F.lit(float(chunk))).cast("int")
    told = told.withColumns({"few": chunks(F.col("total") - F.col("most.c")), "many": chunks(F.col("most.c")), "is_most": F.col("comp") == F.col("most.comp")})
    told = told.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_most"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    group = lambda side, x, y: F.struct(F.xxhash64("token", F.lit(side), x, y).alias("g"), side.alias("side"))
    whole, most, rest = F.lit(0), F.lit(1), F.lit(2)
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    mixed = F.lit(-1)
    of_rest = F.transform(F.filter(up_to(F.col("few")), lambda o: (F.col("few") == 1) | (o != F.col("own"))), lambda o: group(whole, F.least("own", o), F.greatest("own", o)))
    of_both = F.transform(up_to(F.col("many")), lambda o: F.struct(F.xxhash64("token", mixed, "own", o).alias("g"), rest.alias("side")))
    of_most = F.transform(up_to(F.col("few")), lambda o: F.struct(F.xxhash64("token", mixed, o, "own").alias("g"), most.alias("side")))
    groups = F.when(F.col("total") <= chunk, F.array(group(whole, whole, whole))).when(F.col("is_most"), of_most).otherwise(F.concat(of_rest, of_both))
    return told.select(F.explode(groups).alias("to"), "token", "node", "comp").select("to.g", "to.side", "token", "node", "comp")


def _binary(column, width: int) -> np.ndarray:
    """A binary Arrow column of values of `width` words each as uint64 rows."""
    data, offsets, _ = utf8(column)
    return np.frombuffer(data, np.uint64, len(column) * width, int(offsets[0])).reshape(len(column), width)


def _optional(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a binary Arrow column of values of `width` words or null: each row's place among the values (-1 for null), and
    the values as uint64 rows."""
    data, offsets, valid = utf8(column)
    values = np.frombuffer(data, np.uint64, int(valid.sum()) * width, int(offsets[0])).reshape(-1, width)
    return np.where(valid, np.cumsum(valid) - 1, -1), values


LEAST = 8


def candidates(rows: DataFrame, told: DataFrame, similarity: float, forest: bool, chunk: int = 1024, rows_at_once: int = 1 << 15) -> DataFrame:
    """(a, b): pairs of nodes of different components that share a token of (token, node, comp) and that size and bits
    allow; with `forest` only as many as join what all of them join, so no more than rows.

    Each row knows the LEAST smallest tokens of its node, so a pair is given by its smallest token alone, but where that
    is not among them."""

    def pairs(part) -> tuple[list, list]:
        side, token, node, comp, n = (part.column(c).to_numpy() for c in ("side", "token", "node", "comp", "n"))
        least = part.column("least").combine_chunks().flatten().to_numpy().reshape(-1, LEAST)
        g, bits = part.column("g").to_numpy(), _binary(part.column("bits").combine_chunks(), FEW // BITS)
        has, more = _optional(part.column("more").combine_chunks(), MANY // BITS)
        _, label = np.unique(comp, return_inverse=True)
        up, at_all = np.arange(label.max() + 1), np.arange(len(g))
        left, right = [], []
        at, k = np.arange(len(g)), 0
        while True:
            k += 1
            at = at[at + k < len(g)]
            at = at[g[at] == g[at + k]]
            if not at.size:
                return left, right
            i = at[(up[label[at]] != up[label[at + k]]) & ((side[at] == 0) | (side[at] != side[at + k]))]
            j = i + k
            ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[ok], j[ok]
            for place, words in ((at_all, bits), (has, more)):
                both = np.flatnonzero((place[i] >= 0) & (place[j] >= 0))
                differ = np.bitwise_count(words[place[i[both]]] ^ words[place[j[both]]]).sum(axis=1, dtype=np.int64)
                ok = np.ones(len(i), bool)
                ok[both] = differ <= (1 - similarity) / (1 + similarity) * (n[i[both]].astype(np.int64) + n[j[both]]) + 1e-9
                i, j = i[ok], j[ok]
            same = (least[i][:, :, None] == least[j][:, None, :]) & (least[i] < token[i][:, None])[:, :, None]
            ok = ~same.any(axis=(1, 2))
            i, j = i[ok], j[ok]
            if not forest:
                left += node[i].tolist()
                right += node[j].tolist()
                continue
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = label[x], label[y]
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                if p != q:
                    up[max(p, q)] = min(p, q)
                    left.append(node[x])
                    right.append(node[y])
            while (stale := up[up] != up).any():
                up[stale] = up[up[stale]]

    def run(batches):
        import pyarrow as pa

        held: list = []
        count = 0

        def out(part):
            left, right = (np.array(x, np.int64) for x in pairs(part))
            for at in range(0, len(left), 1 << 16):
                a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < rows_at_once:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            g = whole.column("g").to_numpy()
            last = int(np.flatnonzero(g == g[-1])[0])
            if last:
                yield from out(whole.slice(0, last))
                held = whole.slice(last).to_batches()
                count -= last
        if count:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    filler = F.array_repeat(F.lit((1 << 63) - 1), LEAST)
    least = rows.groupBy("node").agg(F.slice(F.concat(F.sort_array(F.collect_set("token")), filler), 1, LEAST).alias("least"))
    known = cut(attach(told.select("node", "n", "bits", "more"), "node", least), "known")
    met = attach(_dealt(rows, chunk), "node", known)
    return met.select("g", "side", "token", "node", "comp", "n", "bits", "more", "least").repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint").distinct()


def _similar(pairs: DataFrame, held: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the texts in `held(node, text)` have so similar shingle sets (Jaccard); a pair of which
    a node is missing there is none."""

    def run(batches):
        import pyarrow as pa

        known: dict[int, np.ndarray] = {}

        def tokens(node: int, text: bytes | None) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingle_set(text, width)
            return known[node]

        for batch in batches:
            near = []
            for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), texts(batch.column(3)), strict=True):
                x, y = tokens(a, s), tokens(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    spark = pairs.sparkSession
    # only the texts that pairs ask for move, each once
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    found = cut(attach(held.select("node", "text"), "node", asked).dropDuplicates(["node"]), "texts")
    left = attach(pairs, "a", found.select(F.col("node").alias("a"), F.col("text").alias("s")))
    both = attach(left, "b", found.select(F.col("node").alias("b"), F.col("text").alias("t")))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256"):  # each row holds two whole texts
        return cut(both.select("a", "b", "s", "t").mapInArrow(run, "a bigint, b bigint"), "near")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, common: int = 16, most_late: int = 1 << 15, class_size: int = 1024, turns: int = 1) -> DataFrame:
    """(id, hash) of the rows of `docs` that go: of each component of near copies all but the row with the smallest
    id (null last), then hash. Near copies are rows whose sets of shingles of `width` words have at least that
    Jaccard similarity.

    The trie self-join of the sets' fingerprints gives the first pairs. A Hamming budget that reaches down to the
    similarity would join everything, so the rest come from an exact prefix filter (see prefixes()), which misses no
    pair whatever the edit, among rows that the first pairs leave in different components. Every pair, wherever it
    comes from, is judged by the sets themselves. Tokens that over `common` rows have go last in the order, the
    `most_late` commonest of them; which ones do changes the cost alone. The rest is searched `turns` times by a
    forest of candidates, no more than rows, and then once by all candidates that are left in different components.
    """
    with Scope() as scope:
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text")).withColumn("node", F.xxhash64("id", "hash"))
        spark = docs.sparkSession
        looked = cut(prefixes(rows, width, similarity, marked=True), "looked")
        counts = looked.filter("token is not null").groupBy("token").count().filter(F.col("count") > common)
        late = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("count")).limit(most_late).select("token").collect()], np.int64).view(np.uint64))
        every = cut(marks(looked), "marks")
        forget(spark, looked)
        tokens = cut(prefixes(rows, width, similarity, late), "tokens")
        several = tokens.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("token")
        shared = cut(attach(tokens, "token", cut(several, "several")).distinct(), "shared")
        forget(spark, tokens)
        # a row that shares no token is like no other
        told = cut(attach(every, "node", cut(shared.select("node").distinct(), "nodes")), "told")
        edges = _similar(cut(by_trie(told), "pairs"), rows, width, similarity)
        left = shared
        for turn in range(turns + 1):
            roots = cut(components(edges), "roots")
            left = left.select("token", "node").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("comp"))
            left = left if turn else _needed(left)
            pairs = cut(candidates(left, told, similarity, turn < turns, class_size), "pairs")
            edges = edges.union(_similar(pairs, rows, width, similarity))
        roots = cut(components(edges), "roots")
        own = cut(attach(rows.select("node", "id", "hash"), "node", roots).distinct(), "components")
        first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first"))
        gone = attach(own, "root", cut(first, "first"))
        gone = gone.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash")))).select("id", "hash").distinct()
        return scope.keep(cut(gone, "gone"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that copies() leaves, with all columns as they are.

    Rows equal in id and text share their fate, so exact copies should go first. Null, empty and blank texts
    are copies of each other; an empty table stays empty.
    """
    goes = copies(docs, id_col, text_col, **options)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"))
    left = whole.join(goes, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")), "left_anti")
    return left.select("_row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
