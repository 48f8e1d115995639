import random

from pyspark.sql import functions as F

from spanforge.llm import unit_dedup as U

LINE = "this line has quite a few more than sixteen words in it for sure and so it counts as one"
OTHER = "another line that also has more words inside than the least that a unit needs here or there"


def test_later_lines_go_with_their_offsets(simple):
    texts = [f"intro\n{LINE}", f"{OTHER}\n{LINE.upper()}\nend", f"x\n  {LINE}  \n{LINE}", "short line\nshort line"]
    rows = {(r["doc_id"], r["start"], r["stop"], r["kept_doc_id"], r["kept_start"]) for r in U.repeats(simple(texts)).collect()}
    assert rows == {(1, len(OTHER) + 1, len(OTHER) + 2 + len(LINE), 0, 6), (2, 2, 7 + len(LINE), 0, 6), (2, 7 + len(LINE), 7 + 2 * len(LINE), 0, 6)}
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in U.clean(simple(texts)).collect()}
    assert kept == {0: (texts[0], len(texts[0])), 1: (f"{OTHER}\nend", len(OTHER) + 4), 2: ("x\n", 2), 3: (texts[3], len(texts[3]))}


def test_short_sentences_and_broken_lines(simple):
    passage = "Of. Is it so. Onon.\nThe. This thing here, and that one there. Hain. One more short one. Then the end of it all. Yes."
    own = lambda n: ". ".join(f"F{n}x{i} w{n}y{i}" for i in range(30)) + ". "
    texts = [own(1) + passage + " " + own(2), own(3) + passage.replace("\n", " ") + "\n" + own(4), own(5) + passage.lower() + " " + own(6)]
    kept = {r["doc_id"]: r["text"] for r in U.clean(simple(texts)).collect()}
    assert kept[0] == texts[0] and all(x in kept[2] for x in (own(5).strip(), own(6).strip()))
    assert all(x not in kept[i] for i in (1, 2) for x in ("This thing", "Hain", "Onon", "short one"))


def test_planted_passages_by_brute_force(simple):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", "", ",", ".", ".\n"]) for _ in range(n))
    passages = [prose(60) for _ in range(6)]
    texts = [f"{prose(40)}. {passages[i % 6]}. {prose(40)}" for i in range(30)]
    kept = {x["doc_id"]: x["text"] for x in U.clean(simple(texts)).collect()}
    assert [kept[i] for i in range(6)] == texts[:6]
    seen = {tuple(p.lower().split()[i : i + 16]) for p in passages for i in range(60)}
    for i in range(6, 30):
        words = kept[i].lower().split()
        assert sum(tuple(words[k : k + 16]) in seen for k in range(len(words))) == 0
        before, behind = texts[i].split(passages[i % 6])
        assert kept[i].startswith(before[:-2]) and kept[i].endswith(behind[2:])


def slow_units(text):
    """start, stop and words of every unit, piece by piece."""
    pieces, a = [], 0
    for i, c in enumerate(text):
        if c == "\n" or c in ".!?,;:" and text[i + 1 : i + 2] in (" ", "\t", "\x0b", "\x0c", "\r"):
            pieces.append((a, i + 1))
            a = i + 1
    pieces.append((a, len(text)))
    words = [(x, y, [w.decode() for w in text[x:y].encode().lower().split()]) for x, y in pieces]
    words = [p for p in words if p[2]]
    for i, (x, _, _) in enumerate(words):
        held = []
        for _, y, w in words[i:]:
            held += w
            if len(held) >= U.MIN_WORDS:
                yield x, y, " ".join(held)
                break


def test_units_by_brute_force():
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice(["ab", "Cé", ".", ",", " ", "\n", "  ", "\t", "x", "; ", " ", "\r\n"]) for _ in range(r.randint(0, 120)))
        starts, stops, digests = U.units_of(text)
        want = list(slow_units(text))
        assert list(zip(starts.tolist(), stops.tolist())) == [(x, y) for x, y, _ in want]
        assert digests == b"".join(U.hashlib.md5(s.encode()).digest() for _, _, s in want)


def test_odd_rows(odd):
    out = U.clean(odd.withColumn("spans", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("high", F.lit(2)))
    assert out.count() == odd.count() and out.columns[-3:] == ["spans", "row", "high"]
    assert U.repeats(odd).filter("doc_id IS NULL").count() == 0
    assert U.clean(odd.filter("false")).count() == 0


def test_repeated_rows_are_one_document(simple):
    docs = simple([LINE])
    assert U.repeats(docs.unionByName(docs)).count() == 0
    both = docs.unionByName(simple([LINE], start=5)).unionByName(simple([LINE], start=5))
    assert [r["doc_id"] for r in U.repeats(both).collect()] == [5]
    assert [r["text"] for r in U.clean(both).filter("doc_id = 5").collect()] == ["", ""]


def test_time_follows_length():
    import time

    def took(n):
        text = "some words of a line, and more. " * n
        t = time.process_time()
        U.units_of(text)
        return time.process_time() - t

    took(2000)
    assert took(40_000) < 4 * max(took(20_000), 0.05)
