import random

import xxhash
from pyspark.sql import functions as F

from spanforge.llm import simhash


def slow_fingerprint(text):
    words = bytes(text or "", "utf8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Least member of each one's group, by brute force over all pairs."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in parent}


def test_fingerprints(simple):
    texts = ["a", "A b", "x y z", "the cat sat on the mat " * 9, "ÀB c d", None, " \t", "w\x0bx y"]
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(simple(texts)).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def check_links(spark, values):
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    pairs = simhash.links(df)
    labels = {r["node"]: r["label"] for r in simhash.components(pairs).collect()}
    signed = [simhash._signed(v) for v in values]
    want = groups(signed)
    assert {f: labels.get(f, f) for f in signed} == want


def test_links_by_brute_force(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        values.add(v ^ 1 << r.randrange(64))
        values.add(v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    check_links(spark, values)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", 4)
    r = random.Random(6)
    values, x = {0}, 0
    for _ in range(80):  # a long chain through few segments
        x ^= 1 << r.randrange(40) ^ 1 << r.randrange(40)
        values.add(x)
    values |= {1 << i | 1 << j for i in range(6) for j in range(6)}
    check_links(spark, values)


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_fp = {}
    for r in rows:
        by_fp.setdefault(r["fp"], []).append(r)
    assert all(len({x["component_id"] for x in own}) == 1 for own in by_fp.values())
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}


def test_one_representative_stays(simple):
    docs = simple(["same text here now", "other words entirely different", "same text here now", "Same text  here now"])
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == [0, 1]


def test_each_group_keeps_one_of_its_own_texts(make):
    a, b = "one text of a group of its own", "quite another text that others share"
    row = lambda i, t: (i, t, "en", "s", 1)
    kept = lambda rows: sorted((r["doc_id"] or -1, r["text"]) for r in simhash.representatives(make(rows)).collect())
    assert kept([row(2, b), row(5, b), row(5, a)]) == [(2, b), (5, a)]
    assert kept([row(5, a), row(5, a), row(5, b), row(5, b)]) == [(5, a), (5, b)]
    assert kept([row(None, a), row(None, a), row(7, a), row(None, b)]) == [(-1, b), (7, a)]


def test_a_hot_key_is_split(spark):
    # all share their low segment, so that each of its keys holds all of them
    r = random.Random(8)
    check_links(spark, {r.getrandbits(32) << 32 | 7 for _ in range(300)} | {1 << 40 | 7, 1 << 41 | 7, 1 << 42 | 7 | 8})


def test_empty_and_extra_columns(simple):
    docs = simple(["a b c"]).withColumn("fp", F.lit("mine")).withColumn("label", F.lit(1))
    assert simhash.near_duplicates(docs).count() == 1
    assert simhash.representatives(docs).first()["fp"] == "mine"
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_representatives_keep_columns_of_any_name(simple):
    text = "one two three four five six seven eight nine ten"
    docs = simple([text, text, "quite another text that has nothing in common with the first"]).selectExpr("*", "'mine' AS __h", "doc_id * 10 AS __d", "'row' AS __row", "7 AS fp", "8 AS label")
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["__h"], r["__d"], r["__row"], r["fp"], r["label"]) for r in out.collect()) == [(0, "mine", 0, "row", 7, 8), (2, "mine", 20, "row", 7, 8)]
