"""Archives, preference pairs and mixing: round trips, SQL and brute force."""

import base64
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shardwell.llm import chat, mixing, warc
from shardwell.llm.common import scratch


def norm(rows):
    value = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    return norm(df.collect()), norm(con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall())


# ---- archives

PAGES = [
    (5, "http://b.example/x", "same"), (3, "http://A.example:80/y?b=2&a=1", "same"), (9, None, None), (8, "http://c.example/\r\nX-Evil: 1", ""), (4, "not a url", "é\r\n\r\nWARC/1.1"),
    (None, "http://b.example/x", "same"), (3, "http://b.example/z", "same"), (None, "u", "alone"), (7, "http://b.example/x", "y" * 300_000),
]


def captured(spark, pages, **options):
    path = scratch(spark, "test-archives")
    warc.write(pages, path, **options)
    return warc.index(spark, path)


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, payload string").repartition(3)
    got = captured(spark, df).collect()
    want = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        data = (html or "").encode()
        response = first is None or page == first
        want.append((None if page is None else str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else str(first)))
    assert norm((r["page"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in got) == norm(want)
    assert [warc._order(tuple(r)) for r in got] == sorted(warc._order(tuple(r)) for r in got)
    assert {r["urlkey"] for r in got if r["page"] == "3"} == {"example,a)/y?a=1&b=2", "example,b)/z"}


def test_archive_sql(spark, table):
    got, want = against_sql(warc.op1_warc(spark, "/root/testdata/sf0.01"), warc.OP1_SQL, pages=table("pages", "sf0.01"))
    assert got == want


def test_archive_of_the_table(spark, table):
    pages = table("pages")
    rows = {r["page_id"]: r for r in warc.op1_warc(spark, "/root/testdata/sf0.001").collect()}
    for p in pages.collect():
        data = (p["html"] or "").encode()
        assert (rows[p["page_id"]]["payload_bytes"], rows[p["page_id"]]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert len(rows) == pages.count()


def test_archive_of_many_copies_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNKS", 1)
    df = spark.range(400).selectExpr("id as page_id", "concat('http://h.example/', cast(id % 5 as string)) as url", "case when id % 3 = 0 then 'copy' else cast(id as string) end as html").repartition(6)
    got = captured(spark, df).collect()
    assert len(got) == 400 and sum(r["type"] == "revisit" for r in got) == 133 and {r["refers_to"] for r in got} == {None, "0"}
    assert len({r["archive"] for r in got}) > 1
    assert [warc._order(tuple(r)) for r in got] == sorted(warc._order(tuple(r)) for r in got)


def test_ranges_are_sized_by_their_rows(spark):
    path = scratch(spark, "test-ranges")
    df = spark.range(3000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.example/', concat('http://h.example/', cast(id % 50 as string))) as url", "cast(id as string) as html").repartition(5)
    warc.write(df, path)
    found = warc.index(spark, path, per_range=100)
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    sizes = {}
    for r in rows:
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert len(rows) == 3000 and len(sizes) >= 25 and max(sizes.values()) <= 300  # a hot URL is split too
    assert [warc._order(tuple(r)[:-1]) for r in rows] == sorted(warc._order(tuple(r)[:-1]) for r in rows)


def test_natural_runs_stay_arrow_data():
    rows = [("a", None, "1", "x", i, 1, "response", None, 1, "d", "u") for i in range(5)] + [("a", None, "1", "y", 0, 1, "response", None, 1, "d", "u"), ("b", None, "1", "y", 0, 1, "response", None, 1, "d", "u"), ("a", None, "2", "y", 0, 1, "response", None, 1, "d", "u")]
    for size in (1, 3, 100):
        found = warc.natural_runs(warc._batches(rows, size), warc._order)
        assert [[r[:5] for r in warc._rows(run)] for run in found] == [[r[:5] for r in rows[:5]], [r[:5] for r in rows[5:7]], [rows[7][:5]]]


def test_empty_archive(spark):
    assert captured(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_damaged_archives_are_noticed():
    good = warc.member(warc.record("1", "u", None, b"payload", False, None))
    assert [r["payload"] for r in warc.parse(good + good)] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(good[:-9]))
    import gzip

    with pytest.raises(ValueError, match="does not match"):
        list(warc.parse(gzip.compress(gzip.decompress(good).replace(b"payload\r\n", b"PAYLOAD\r\n"))))


def test_large_members_end_with_a_zero():
    for n in (0, 1, 1 << 24, (1 << 24) + 5):
        data = warc.member(warc.record("1", "u", None, b"x" * n, False, None))
        assert data[-1] == 0 and [r["bytes"] for r in warc.parse(data)] == [n]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(30), i, n) for n in range(rng.randrange(25))) for i in range(k)]
    runs = [sorted(r) for r in runs]
    got = list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0]))
    assert [g[0] for g in got] == sorted(x[0] for r in runs for x in r)
    assert got == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))  # ties by run, in the run's order


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.org:443/A/b?z=1&a=2#f") == "org,example)/a/b?a=2&z=1"
    assert warc.url_key("http://h.example:8080") == "example,h:8080)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


# ---- preferences


def test_preferences_sql(spark, table):
    got, want = against_sql(chat.op2_preferences(spark, "/root/testdata/sf0.01"), chat.OP2_SQL, conversations=table("conversations", "sf0.01"))
    assert got == want and len(got) > 50


def brute_preference(a, b):
    turns = lambda t: [(r or "", x or "") for _, r, x in sorted(t, key=lambda t: (t[0] is not None, t[0], t[1] or "", t[2] or ""))]
    a, b = turns(a), turns(b)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda t: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)

    def spans(t):
        out, at = [], 0
        for r, x in t:
            if r == "assistant":
                out.append((at + len(r) + 5, at + len(r) + 5 + len(x) + 7))
            at += len(r) + len(x) + 13
        return out

    return n, show(a[:n]), show(a[n:]), show(b[n:]), spans(a[n:]), spans(b[n:])


def test_preferences_like_brute_force(spark):
    rng = random.Random(2)
    sides = []
    for _ in range(2):
        rows = []
        for c in [None, *range(1, 40)]:
            for t in range(rng.randrange(0, 6)):
                rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["é", "b", None, ""])))
        sides.append(rows)
    schema = "conv_id bigint, turn bigint, role string, text string, id string, a string"
    frames = [spark.createDataFrame([(*r, "x", "y") for r in s], schema) for s in sides]
    got = chat.preferences(*frames).collect()
    lone = norm((r["shared_turns"], r["prompt"], r["chosen"], r["rejected"], len(r["chosen_mask"]), len(r["rejected_mask"])) for r in got if r["id"] is None)
    one = lambda x: f"<|{x[2] or ''}|>\n{x[3] or ''}<|end|>\n"
    want = [(0, "", one(x), "", int(x[2] == "assistant"), 0) for x in sides[0] if x[0] is None] + [(0, "", "", one(x), 0, int(x[2] == "assistant")) for x in sides[1] if x[0] is None]
    assert lone == norm(want)
    for r in (r for r in got if r["id"] is not None):
        mine = [[x[1:] for x in s if x[0] == r["id"]] for s in sides]
        want = brute_preference(*mine)
        masks = [[(s["start"], s["end"]) for s in r[m]] for m in ("chosen_mask", "rejected_mask")]
        assert (r["shared_turns"], r["prompt"], r["chosen"], r["rejected"], *masks) == want
    assert chat.preferences(frames[0].limit(0), frames[1].limit(0)).count() == 0


def test_preferences_sql_with_nulls(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["é", "b", None, "", "c"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.mode("overwrite").parquet(f"{(folder := scratch(spark, 'nulls'))}/conversations.parquet")
    got, want = against_sql(chat.op2_preferences(spark, folder), chat.OP2_SQL, conversations=df)
    assert got == want and len(got) > 20


def test_a_very_long_conversation(spark):
    df = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 200) as text")
    r = chat.preferences(df, df.filter("turn < 2999")).first()
    assert r["shared_turns"] == 2999 and len(r["prompt"]) > 3_000_000 and r["rejected"] == "" and len(r["chosen_mask"]) == 1


def test_masks_cover_what_the_assistant_says(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Good day"), (1, 2, "user", "And?"), (1, 3, "assistant", "More")]
    chosen = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = chat.preferences(chosen, chosen.filter("turn < 3")).first()
    assert r["shared_turns"] == 3 and r["rejected"] == "" and [r["chosen"][s["start"] : s["end"]] for s in r["chosen_mask"]] == ["More<|end|>"]


def test_swapped_of_odd_rows(spark):
    rows = [(1, 0, "assistant", "one"), (0, 0, "assistant", None), (4, 0, "user", "x"), (None, 1, "assistant", "n"), (4, 1, None, None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id bigint, turn bigint, role string, text string, own_id string")
    got = norm(chat.swapped(df).collect())
    assert got == norm([(1, 0, "assistant", ""), (0, 0, "assistant", "one"), (4, 0, "user", "x"), (4, 1, None, None)])


# ---- mixing


def test_mixing_sql(spark, table):
    docs = table("documents", "sf0.01")
    got, want = against_sql(mixing.op6_mixing(spark, "/root/testdata/sf0.01"), mixing.OP6_SQL, documents=docs)
    assert got == want


def test_mixing_of_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "ä", None, "empty"])
        text = None if source == "empty" or rng.random() < 0.05 else " ".join(["w"] * rng.randrange(0, 60)) + rng.choice(["", "\x0b", " "])
        rows.append((rng.choice([i, i, i, None]), text, source))
    rows += [rows[3]] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    passes = mixing.mix(df, slices=8)
    sized = {}
    for r in passes.collect():
        s = sized.setdefault(r["source"], [r["source_size"], r["target"], 0])
        s[2] += r["size"] * r["taken"]
    total = sum(s[0] for s in sized.values())
    largest = 60
    assert abs(sum(s[2] for s in sized.values()) - total) <= largest
    for source, (size, target, taken) in sized.items():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 2 * largest, source
    assert sum(s[1] for s in sized.values()) == pytest.approx(total)
    order = [r["finish"] for r in passes.collect()]
    assert order == sorted(order)
    assert passes.count() == 3 * len(rows)
    again = mixing.mix(df.repartition(7), slices=8)
    assert norm(again.filter("taken").select("id", "source", "size", "pass").collect()) == norm(passes.filter("taken").select("id", "source", "size", "pass").collect())


def test_budget_within_one_slice(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "one") for i in range(300)] + [(900 + i, "w " * 40, "two") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = lambda: norm(mixing.mix(df).filter("taken").select("id", "source", "pass").collect())
    want = taken()
    for slices in (1, 2, 7):
        monkeypatch.setattr(mixing, "SLICES", slices)
        assert taken() == want


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1}, {"a": 1, "b": 1, "c": 10_000, "d": 5}, {"x": 0, "y": 0}, {"one": 7}, {"p": 10, "q": 10, "r": 10, "s": 10, None: 10}])
def test_targets_like_the_rounds(spark, sizes):
    """Sharing by weight, stopping at the cap, sharing the excess again until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        above = {n for n in free if share[n] >= 3 * sizes[n]}
        if not above:
            want |= share
            break
        for n in above:
            want[n] = 3.0 * sizes[n]
            left -= want[n]
        free -= above
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == {n: pytest.approx(v) for n, v in want.items()}


def test_mixed_rows(spark, docs):
    df = docs(["one two", "one two", None, "three", "four five six", "one two"], [1, 1, 2, 3, None, 9], source=["a", "a", "a", "b", None, "b"])
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "mix_pass", "mix_finish"]
    want = norm((r["id"], r["pass"]) for r in mixing.mix(df).filter("taken and size > 0").collect())
    assert norm((r["doc_id"], r["mix_pass"]) for r in out.collect()) == want
    # the same id and text in two sources: each is taken as often as its source's mix says
    twins = spark.createDataFrame([(1, "x y", "b"), (1, "x y", "a"), (2, "p q r s t u", "b")], "doc_id bigint, text string, source string")
    want = norm((r["source"], r["id"], r["pass"]) for r in mixing.mix(twins).filter("taken and size > 0").collect())
    assert norm((r["source"], r["doc_id"], r["mix_pass"]) for r in mixing.mixed(twins).collect()) == want
    finish = [r["mix_finish"] for r in out.collect()]
    assert finish == sorted(finish) and mixing.mixed(df.limit(0)).count() == 0


def test_mixing_of_a_very_long_text(spark):
    rows = [(1, "w " * 400_000, "a"), *[(i, "w " * 100, "b") for i in range(2, 300)]]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, source string, size int, finish string")
    found = {r["id"]: r for r in mixing.mix(df).filter("pass = 0").collect()}
    assert found[1]["size"] == 400_000 and found[2]["size"] == 100 and found[1]["source_size"] == 400_000
    taken = mixing.mix(df).filter("taken").groupBy("source").agg(F.sum("size").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 400_000 for r in taken) and mixing.mix(df.limit(0)).count() == 0
