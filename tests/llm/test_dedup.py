"""Exact dedup and SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shardwell.llm import exact, simhash
from shardwell.llm.common import Scope, cut
from shardwell.llm.components import components

TEXTS = ["a b", "a b", None, "", "c", "a b", "Ümlaut", "c ", None, "x" * 50_000]


def brute_groups(ids, texts):
    out = []
    for i, t in zip(ids, texts, strict=True):
        same = [j for j, u in zip(ids, texts, strict=True) if (u or "") == (t or "")]
        known = [j for j in same if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.unhex(F.hex(F.pmod(F.length(t), F.lit(3)))), lambda t: F.unhex(F.lit("00"))])
@pytest.mark.parametrize("ids", [list(range(1, 11)), [5, 5, 1, 2, 3, None, 7, 7, None, 9]])
def test_exact_groups(docs, digest, ids):
    found = exact.exact_groups(docs(TEXTS, ids), digest=digest, salts=3)
    got = sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=repr)
    assert got == brute_groups(ids, TEXTS)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.unhex(F.lit("00"))])
def test_exact_keeps_whole_rows(docs, digest):
    df = docs(TEXTS).repartition(3)
    kept = exact.keep_one(df, digest=digest)
    assert kept.columns == df.columns and kept.schema == df.schema
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert sorted(rows) == [5, 6, 7, 8, 9, 10]
    assert rows[9]["text"] is None and rows[6]["text"] == "a b" and rows[6]["id"] == "x6"


def test_exact_of_an_empty_table(docs):
    assert exact.exact_groups(docs(["a"]).limit(0)).count() == 0
    assert exact.keep_one(docs(["a"]).limit(0)).count() == 0


def test_exact_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact.OP5_SQL})").fetchall())
    got = exact.op5_exact_dedup(spark, "/root/testdata/sf0.01").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b C d", "é È x\x0by\x1cz É", "  lead and trail  ", "a a a a a a"])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(None if text is None else text.encode(), width) == brute_fingerprint(text, width)


def test_fingerprint_of_a_huge_text(monkeypatch):
    words = " ".join(random.Random(1).choices([f"w{i}" for i in range(400)], k=4000))
    whole = simhash.fingerprint(words.encode())
    monkeypatch.setattr(simhash, "pieces", lambda data: __import__("shardwell.llm.common", fromlist=["pieces"]).pieces(data, 100))
    assert simhash.fingerprint(words.encode()) == whole == brute_fingerprint(words)


def brute_components(fps: dict, budget=3):
    ids = list(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= budget:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_trie_links_like_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(10):
        groups = [np.unique(c ^ np.packbits(rng.random((n, 64)) < p, axis=1, bitorder="little").view(np.uint64).ravel()) for c, n, p in ((np.uint64(2**63 + 5), 80, 0.03), (np.uint64(77), 40, 0.1), (np.uint64(0), 1, 0.5))]
        starts = np.cumsum([0, *map(len, groups)])[:-1]
        got = simhash.trie_links(np.concatenate(groups), starts)
        for g, at in zip(groups, starts, strict=True):
            want = brute_components({i: int(v) for i, v in enumerate(g)})
            assert [int(x) - at for x in got[at : at + len(g)]] == [want[i] for i in range(len(g))]


@pytest.mark.parametrize(("max_group", "levels"), [(1024, 1), (4, 1), (4, 2)])
def test_links_and_components_of_hot_groups(spark, max_group, levels):
    rng = np.random.default_rng(9)
    ball = np.packbits(rng.random((150, 64)) < 0.035, axis=1, bitorder="little").view(np.uint64).ravel() ^ np.uint64(0xF0F0F0F0F0F0F0F0)
    fps = sorted({int(v) - (1 << 64) if v >> 63 else int(v) for v in map(int, np.concatenate([ball, rng.integers(0, 2**63, 60, dtype=np.uint64)]))})
    df = spark.createDataFrame([(t, f) for f in fps for t in (0, 1)], "t int, fp bigint")
    both = simhash.links(df, 3, max_group, levels)
    found = {r["node"]: r["root"] for r in components(both.filter("t = 1").select("a", "b")).collect()}
    want = brute_components({f: f & (2**64 - 1) for f in fps})
    assert {f: found.get(f, f) for f in fps} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (101, 100)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | dict.fromkeys((100, 101, 103), 100)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_documents(table):
    docs = table("documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], c) for i, c in brute_components(fps).items()}


def test_near_duplicates_of_odd_rows(docs):
    got = simhash.near_duplicates(docs(["", None, "one", "one", "two words"], [4, None, 9, 9, 1])).collect()
    assert sorted(((r["id"], r["component"]) for r in got), key=repr) == sorted([(4, 4), (None, 4), (9, 9), (9, 9), (1, 1)], key=repr)
    none = simhash.near_duplicates(docs(["a", "a"], [None, None])).collect()
    assert [(r["id"], r["component"]) for r in none] == [(None, None)] * 2
    assert simhash.near_duplicates(docs(["a"]).limit(0)).count() == 0


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_one_of_near_copies_stays(docs):
    df = docs(["p q r s", "P Q R S", None, "", "alone here", "here alone"], [3, 2, 8, 5, 1, 9])
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 9]
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("class_size", [2048, 2])
def test_near_copies_go_and_others_stay(docs, class_size):
    rng = random.Random(12)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 700))] for _ in range(40)]
    texts = []
    for base in bases:
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            words = list(base)
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(b) for b in ([rng.choice(vocabulary) for _ in range(12)] for _ in range(60))]
    texts += [" ".join(rng.sample(bases[0], len(bases[0])))]  # the same words in another order are no copy
    kept = {r["doc_id"] for r in simhash.keep_one(docs(texts), class_size=class_size).collect()}
    rest = [i for i in range(1, len(texts) + 1) if i not in kept]
    assert kept == brute_kept(texts) and len(rest) > 30 and len(texts) in kept


def test_scratch_goes_with_its_scope(spark):
    with Scope() as outer:
        with Scope() as inner:
            a, b = cut(spark.range(3), "a"), cut(spark.range(4), "b")
            inner.keep(b)
        assert b.count() == 4 and list(outer.written) != []
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
            a.collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        b.collect()


def brute_kept(texts, least=0.8):
    up = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    return {i + 1 for i, u in enumerate(up) if u == i}


def test_near_copies_with_a_passage_more_or_less_go(docs):
    rng = random.Random(21)
    words = lambda n: [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]
    texts = []
    for n in (60, 200, 1000):
        for share in (0.82, 0.87, 0.92):
            for _ in range(6):
                base = words(n)
                more = words(int(n / share) - n)
                texts += [" ".join(base), " ".join(base + more if rng.random() < 0.5 else base[: int(n * share) + 1])]
    assert {r["doc_id"] for r in simhash.keep_one(docs(texts)).collect()} == brute_kept(texts)


def test_similarity_is_exact_at_the_threshold(docs):
    rng = random.Random(22)
    texts = []
    for n in (4, 9, 30, 100, 400):
        for share in (0.74, 0.77, 0.79, 0.8, 0.81, 0.83):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]  # n shingles
            texts += [" ".join(base), " ".join(base[: round(n * share) + 4])]
    texts += ["p q r s t u v w x", "p q r s t u v w"]  # 5 shingles and 4 of them: 0.8 exactly
    kept = {r["doc_id"] for r in simhash.keep_one(docs(texts)).collect()}
    assert kept == brute_kept(texts) and len(texts) not in kept


@pytest.mark.parametrize("class_size", [1024, 2])
def test_chains_of_near_copies_leave_the_smallest_id(docs, class_size):
    rng = random.Random(23)
    texts = []
    for _ in range(8):
        b = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        a, c = b[:270], b[40:]  # both like b, not like each other
        texts += [" ".join(a), " ".join(c), " ".join(b)]
    b = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts += [" ".join(b[i : i + 400]) for i in (0, 120, 80, 40, 160, 200)]  # only neighbours by 40 are alike
    assert similarity(texts[0], texts[1]) < 0.8 < similarity(texts[0], texts[2])
    assert {r["doc_id"] for r in simhash.keep_one(docs(texts), class_size=class_size).collect()} == brute_kept(texts)


def test_candidates_like_brute_force(spark):
    rng = random.Random(24)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(base[: rng.randrange(70, 121)]) for _ in range(6)]
    held = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    told = cut(simhash.marks(simhash.prefixes(held, 5, 0.8, marked=True)), "marks")
    tokens = simhash.prefixes(held, 5, 0.8).withColumn("comp", F.when(F.col("node") % 6 < 2, F.lit(0)).otherwise(F.col("node")))
    comp = {i: 0 if i % 6 < 2 else i for i in range(len(texts))}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if comp[i] != comp[j] and similarity(texts[i], texts[j]) >= 0.8}
    for rows in (tokens, simhash._needed(cut(tokens, "tokens"))):
        for chunk in (1024, 2, 3):
            got = simhash._similar(simhash.candidates(rows, told, 0.8, False, chunk, rows_at_once=5), held, 5, 0.8).collect()
            assert want and {(r["a"], r["b"]) for r in got} == want
    forest = simhash.candidates(tokens, told, 0.8, True).collect()
    every = simhash.candidates(tokens, told, 0.8, False).collect()

    def joined(edges):
        up = dict(comp)
        for r in edges:
            x, y = up[r["a"]], up[r["b"]]
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
        return up

    assert joined(forest) == joined(every) and len(forest) < len(every)


def test_trie_pairs_are_those_of_the_join(spark):
    rng = random.Random(25)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join(f"w{rng.randrange(10**6)}" for _ in range(50)), " ".join(base)]
    told = cut(simhash.marks(simhash.prefixes(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 5, 0.8, marked=True)), "marks")
    got = {(r["a"], r["b"]) for r in simhash.by_trie(told).collect()}
    assert (0, 4) in got and {x for p in got for x in p} == {0, 1, 2, 4}
