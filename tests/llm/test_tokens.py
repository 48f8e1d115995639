import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import packing, repair
from spanforge.llm.tokens import Encoder

from odd_rows import ODD

TEXTS = [t or "" for t in ODD] + ["a\n\nb", "\na", "a\n", "a \nb c", "\x00n a", "don't I'll 's", "İstanbul ẞ", "é á.", "H̱i", "a\xa0b", "x  y", "<|endoftext|> a", "日本 語", "Foo.\nBar baz.\n\nQux", "a\tb  ", "q \x00nab", "ΑΣ ΟΔΟΣ", "3.5 A1b2", "in%%% | a|b || x., 'tis it's, (a) <b> |", "|", "", "...", "a _b_ #c"]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_batches_equal_the_tokenizer(duck, name, spaced):
    texts = TEXTS + [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for as_text in (False, True):
        plain.encode_special_tokens = as_text
        ids, counts = Encoder(public_tokenizers.path(name), spaced, as_text).encode(texts)
        cuts = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for n, e in zip(counts, cuts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_old_pieces_are_looked_up_again(duck):
    texts = [r[0] or "" for r in duck.execute("SELECT text FROM documents").fetchall()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = Encoder(path, True), Encoder(path, True)
    small.cache.limit = small.words.limit = 50
    for t in texts:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()
    assert len(small.words.older) and len(small.words) < len(large.words)


def test_grammar_round_trip():
    r = np.random.default_rng(1)
    ids = np.tile(r.integers(0, 50, 400), 60)
    ids[::7] = 9
    starts = np.unique(np.concatenate([[0], r.integers(1, len(ids), 80)]))
    payload = repair.Shard.pack(ids, starts, 1000)
    s = repair.Shard(payload)
    assert len(s.rules) and len(s.symbols) < 0.8 * len(ids)
    ends = np.append(starts[1:], len(ids))
    for i, (a, b) in enumerate(zip(starts, ends)):
        assert s.document(i).tolist() == ids[a:b].tolist()
        for x, y in ((0, 1), (0, b - a), ((b - a) // 2, (b - a) // 2 + 5), (b - a - 1, b - a)):
            assert s.ids(i, x, min(y, b - a)).tolist() == ids[a + x : a + min(y, b - a)].tolist()
    assert [len(repair.expand(np.array([1000 + i]), s.rules, 1000)) for i in range(len(s.rules))] == s.lengths.tolist()


@pytest.mark.parametrize("ids", [[1], [5, 5], [5] * 999 + [1]])
def test_small_and_uniform_shards(ids):
    s = repair.Shard(repair.Shard.pack(np.array(ids), np.array([0]), 100))
    assert s.document(0).tolist() == ids


def plain_ids(text, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_shards_of_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 500)
    rows = repair.read_documents(repair.write_shards(odd)).collect()
    assert len(rows) == odd.count()
    rows.sort(key=lambda r: r["start"])
    at, last = 0, None
    for r in rows:
        assert r["start"] == at and (r["doc_id"] is None or last is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last
    for r in rows:
        if r["doc_id"] is not None:
            want = plain_ids(ODD[r["doc_id"]], "word_bpe_49k.json")
            assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
    assert repair.read_documents(repair.write_shards(odd.filter("false"))).count() == 0


def check_pieces(rows, window):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append(r)
    for own in held.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    full = [sum(r["length"] for r in held[s]) == window for s in sorted(held)]
    assert all(full[:-1]) and sorted(held) == list(range(len(held)))


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd.withColumn("key", F.lit("mine")).withColumn("queue", F.lit(1)), window=64, unit=16).collect()
    check_pieces(rows, 64)
    copies = defaultdict(list)
    for i, t in [*enumerate(ODD)] * 2 + [(None, "no id at all in this row"), (None, None)]:
        copies[i].append(plain_ids(t, "byte_bpe_50k.json"))
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    assert found.keys() == copies.keys()
    for i, want in copies.items():
        assert sum(r["length"] for r in found[i]) == sum(map(len, want))
        texts = [w for w in want for r in found[i] if r["start"] == 0 and r["doc_tokens"] == len(w)]
        assert texts
        for r in found[i]:
            fits = [w for w in want if len(w) == r["doc_tokens"] and w[r["start"] : r["start"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist()]
            assert fits and r["ids_crc32"] == zlib.crc32(r["ids"])
    bare = packing.pack(odd, window=64, unit=16, with_ids=False)
    assert "ids" not in bare.columns and bare.count() == len(rows)
    assert packing.pack(odd.filter("false")).count() == 0


def round_robin(lengths, quanta, unit):
    """Served (queue, from, to) of deficit round-robin over queues of the given lengths, round by round."""
    at, credit, out, turn = dict.fromkeys(lengths, 0), dict.fromkeys(lengths, 0), [], 0
    while any(at[q] < n for q, n in lengths.items()):
        turn += 1
        for q in sorted(lengths):
            if at[q] >= lengths[q]:
                continue
            credit[q] += quanta[q]
            while credit[q] >= unit and at[q] < lengths[q]:
                end = min(lengths[q], at[q] + unit)
                out.append((q, at[q], end))
                credit[q] -= unit
                at[q] = end
    return out


@pytest.mark.parametrize("weights", [None, {"source:a": 5.0, "source:b": 1.0, "source:c": 0.01, "none": 2.0}])
def test_schedule_is_the_sequential_round_robin(spark, weights):
    r = np.random.default_rng(3)
    docs, before, lengths = [], defaultdict(int), defaultdict(int)
    for k in range(300):
        part, queue, n = k // 100, ["source:a", "source:b", "source:c", "none"][min(3, int(r.integers(0, 10)) // 2)], int(r.integers(1, 90))
        docs.append(((part << 33) + k % 100, queue, n, before[part, queue]))
        before[part, queue] += n
        lengths[queue] += n
    df = spark.createDataFrame(docs, "key long, queue string, n long, before long")
    totals = spark.createDataFrame(list(lengths.items()), "queue string, total long")
    quanta = {x["queue"]: x["quantum"] for x in packing._quanta(totals, 64, 8, 0.7, weights).collect()}
    start, queue_of = {}, {}
    so_far = defaultdict(int)
    for key, queue, n, _ in sorted(docs):
        start[key], queue_of[key] = so_far[queue], queue
        so_far[queue] += n
    place, at = {}, 0
    for q, a, z in round_robin(dict(lengths), quanta, 8):
        for x in range(a, z):
            place[q, x] = at
            at += 1
    rows = packing.schedule(df, 64, 8, 0.7, weights).collect()
    got = {(queue_of[x["key"]], start[x["key"]] + x["at"] + i): x["sequence_id"] * 64 + x["offset"] + i for x in rows for i in range(x["n"])}
    assert got == place and sum(x["n"] for x in rows) == len(place)


def test_windows_keep_the_mixture(make):
    """Production parameters, 20 sources of very different sizes: windows hold the targets of the sources that aren't used up yet."""
    r = np.random.default_rng(5)
    docs = make([(i, "word and more " * int(r.integers(5, 400)), "en", f"s{min(19, int(r.geometric(0.15)))}", 1) for i in range(1500)])
    rows = packing.pack(docs, with_ids=False).collect()
    check_pieces(rows, packing.WINDOW)
    total, by, last = defaultdict(int), defaultdict(lambda: defaultdict(int)), {}
    for x in rows:
        total[x["queue"]] += x["length"]
        by[x["sequence_id"]][x["queue"]] += x["length"]
        last[x["queue"]] = max(last.get(x["queue"], 0), x["sequence_id"])
    assert len(total) > 15 and len({*last.values()}) > 3
    far = []
    for s in sorted(by)[:-1]:
        active = {q: total[q] ** packing.TEMPER for q in total if last[q] > s}
        if active and not any(last[q] == s for q in total):
            far.append(sum(abs(by[s][q] / packing.WINDOW - w / sum(active.values())) for q, w in active.items()) / 2)
    assert len(far) > 50 and np.mean(far) < 0.1


def test_sequences_are_padded(simple):
    seqs = packing.sequences(packing.pack(simple(["a b c d e"] * 9), window=32), 32).collect()
    assert {len(r["ids"]) for r in seqs[:-1]} <= {128}


def test_a_piece_known_from_before_the_trim_is_looked_up_without_a_call(monkeypatch):
    from spanforge.llm import tokens

    coder = tokens.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"), False)
    text = "the cat, a cat\nИ кот ß the"
    coder.cache.limit = coder.words.limit = 1
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.encode([text])[0].tolist() == want
    monkeypatch.setattr(coder, "_simple", None)  # nothing is worked out again
    assert coder.encode([text])[0].tolist() == want
    assert not hasattr(tokens.Recent, "__missing__")


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_a_word_is_held_once_whatever_signs_follow(name, spaced):
    texts = ["so bar, bar! bar? bar bar.\nbar; (x) ... \n... é, é", "bar"]
    coder, plain = Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    for t in texts:
        assert coder.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert sum("bar" in w for w in coder.words) == 1 + spaced and not any("bar" in p for p in coder.cache)
