import random

from spanforge.llm import decontaminate as D


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        words, hit, found = D.words_of(text), set(), set()
        for name, item in items:
            for p in D.windows(D.words_of(item)):
                for i in range(len(words) - len(p) + 1):
                    if tuple(words[i : i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        found.add(str(name))
        out[doc_id] = (len(words), len(hit), sorted(found))
    return out


def rows_of(found):
    return {r["doc_id"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in found.collect()}


def test_words():
    assert D.words_of("Don't STOP, naïve\x7f2x—y") == [b"don", b"t", b"stop", "naïve".encode(), "2x—y".encode()]


def test_search_by_brute_force(spark, simple, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 25, 2])]
    items += [(20, "w9"), (21, ""), (22, None), (3, "w1 w1 w1"), (23, "w0 w1 " * 8)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 9, 40, 200)] + [items[7][1].upper() + "!", items[4][1] + " w9 " + items[7][1], "w0 w1 " * 30, None]
    docs, bench = simple(texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute(enumerate(texts), items)
    assert rows_of(D.search(docs, bench)) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    monkeypatch.setattr(D, "RUN", 4)
    assert len(list(D.item_blocks(bench))) > 2
    assert rows_of(D.search(docs, bench)) == want
    assert {x["doc_id"] for x in D.clean(docs, bench).collect()} == {i for i, v in want.items() if not v[1]}


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (None, "one")], "item_id long, text string")
    assert D.search(odd, bench).count() == odd.count()
    none = bench.filter("false")
    assert D.search(odd, none).filter("size(items) > 0").count() == 0
    assert D.clean(odd, none).count() == odd.count()
    assert D.search(odd.filter("false"), bench).count() == 0


def test_a_compiled_block_is_bounded():
    import pickle
    import tracemalloc

    r = random.Random(2)
    items = [(i, " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(100))) for i in range(300)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = D.compile_items(items)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 120 * size and len(pickle.dumps(held)) < 20 * size
