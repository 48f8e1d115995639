import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import ner
from spanforge.plans import queries as Q


def by_hand(text, path, labels):
    """The entities of a text by a plain loop: each window alone, the best prediction of each token, then tags in order."""
    e = ner.tokenizer(path).encode(text or "", add_special_tokens=False)
    n, best = len(e.ids), {}
    for x, y in ner.places(n):
        logits = Q.stub_classifier()(np.array([e.ids[x:y]], np.int64), np.ones((1, y - x), np.int64))[0]
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        for i in range(x, y):
            rank = min(i - x if x else 254, y - 1 - i if y < n else 254)
            if i not in best or rank > best[i][0]:
                k = int(p[i - x].argmax())
                best[i] = (rank, labels[k], float(p[i - x, k]))
    out, active = [], None
    for i, (a, b) in enumerate(e.offsets):
        _, tag, score = best[i]
        if a == b:
            continue
        if tag == "O":
            active = None
        elif active and tag[2:] == active[2] and (tag[0] == "I" or a == active[1]):
            active[1] = b
            active[3].append(score)
        else:
            active = [a, b, tag[2:], [score]]
            out.append(active)
    return sorted((a, b, label, round(sum(s) / len(s), 9)) for a, b, label, s in out)


def test_entities_by_a_loop(spark, sf):
    path = Q.tokenizer_path("word_bpe_49k.json")
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text").desc()).limit(6).collect()]
    texts += ["", None, "Иван Петров пришёл", "one two three " * 200, "😀 naïve"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {}
    for r in ner.entities(ner.predict(ner.token_windows(docs, path), Q.stub_classifier, Q.LABELS)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["label"], round(r["score"], 9)))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(texts) if (w := by_hand(t, path, Q.LABELS))}


def test_windows_cover_texts_with_exact_offsets(spark):
    path = Q.tokenizer_path()
    text = "naïve 😀 слова и words " * 120
    rows = ner.token_windows(spark.createDataFrame([(1, text)], "doc_id int, text string"), path).orderBy("window").collect()
    e = ner.tokenizer(path).encode(text, add_special_tokens=False)
    assert [(r["first"], r["last"]) for r in rows] == ner.places(len(e.ids)) and rows[0]["last"] - rows[1]["first"] == 48
    for r in rows:
        assert r["ids"] == e.ids[r["first"] : r["last"]] and list(zip(r["starts"], r["stops"])) == e.offsets[r["first"] : r["last"]]


def test_batches_are_padded_to_their_longest_only(spark):
    seen = []

    def watch(ids, mask):
        seen.append((ids.shape, int(mask.sum())))
        return np.zeros((*ids.shape, 2))

    r = random.Random(1)
    lengths = [r.randint(1, 254) for _ in range(40)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "window": [0] * 40, "first": [0] * 40, "last": lengths, "n_tokens": lengths, "ids": [[1] * n for n in lengths], "starts": [[0] * n for n in lengths], "stops": [[1] * n for n in lengths]})

    class Frame:
        schema = spark.createDataFrame([], "doc_id long").schema

        def mapInArrow(self, f, schema):  # noqa: N802
            return list(f([batch]))

    ner.predict(Frame(), lambda: watch, ["O", "B-PER"])
    longest = sorted(lengths)[7::8]
    assert [s for s, _ in seen] == [(8, n) for n in longest] and sum(n for _, n in seen) == sum(lengths)


@pytest.mark.parametrize("bad", [np.nan, np.inf])
def test_odd_logits_end_the_job(bad):
    with pytest.raises(ValueError, match="finite"):
        ner.probabilities(np.full((1, 2, 3), bad), (1, 2))
    with pytest.raises(ValueError, match="each token"):
        ner.probabilities(np.zeros((1, 1, 3)), (1, 2))


def test_candidates_are_trimmed_and_tested(spark):
    text = "«Иван», клиент и Заёмщик пишет на ivan@x.org Анна Петрова."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    at = lambda s: (text.index(s), text.index(s) + len(s))
    found = [("«Иван», ", "PER", 0.9), ("клиент", "PER", 0.9), (" и ", "PER", 0.9), ("За", "PER", 0.9), ("ivan", "PER", 0.9), ("Анна", "PER", 0.9), ("Петрова", "PER", 0.5), ("пишет", "LOC", 0.9)]
    e = spark.createDataFrame([(1, *at(s), label, score) for s, label, score in found], "doc_id int, start int, stop int, label string, score double")
    spans = spark.createDataFrame([(1, "EMAIL", *at("ivan@x.org")), (1, "FULL_NAME", *at("Анна Петрова"))], "doc_id int, category string, start int, stop int")
    assert [text[r["start"] : r["stop"]] for r in ner.candidates(e, docs, spans).collect()] == ["Иван"]
    free = ner.candidates(e, docs, spans.filter("false"))
    assert sorted(text[r["start"] : r["stop"]] for r in free.collect()) == ["Анна", "Иван"]


def test_rewrite_splits_a_detection(spark):
    from spanforge.operators.detectors import DETECTION

    d = ("ADDRESS", "a", "address", 0.8, 0, 40, [(0, 5), (6, 9), (10, 14)], [])
    other = ("CARD", "c", "card-digits", 0.8, 50, 60, [(50, 60)], [])
    decisions = [("ADDRESS", 6, 9, "public-context", 0.95), ("ADDRESS", 0, 5, "private-model", 0.9), ("ADDRESS", 10, 14, "private-model", 0.7), ("CARD", 50, 60, "public-context", 1.0)]
    df = spark.createDataFrame([([d, other], decisions), ([], [])], f"detections array<{DETECTION}>, decisions array<struct<category:string,start:int,stop:int,reason:string,score:double>>")
    rows = df.select(ner.rewrite(F.col("detections"), F.col("decisions")).alias("x")).collect()
    released, kept, card = rows[0]["x"]
    assert (released["rule_id"], released["start"], released["stop"], released["sensitive"], released["signals"][0]["kind"]) == ("semantic-public-context", 6, 9, [], "negative")
    assert (kept["rule_id"], [tuple(s) for s in kept["sensitive"]], kept["signals"][0]["value"]) == ("semantic-private-context", [(0, 5), (10, 14)], 0.9)
    assert card["rule_id"] == "card-digits" and len(card["sensitive"]) == 1 and rows[1]["x"] == []


def test_what_is_held_at_once_is_bounded(spark, monkeypatch):
    """A batch of many texts or windows is taken in slices; rows are the same."""
    import pyarrow as pa

    class Frame:
        def __init__(self, batches, fields):
            self.batches, self.schema = batches, spark.createDataFrame([], fields).schema

        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            return list(f(iter(self.batches)))

    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": ["one two three " * 100] * 298 + ["", None]})
    made = ner.token_windows(Frame([docs], "doc_id long, text string"), Q.tokenizer_path())
    assert len(made) > 1 and sum(b.num_rows for b in made) == 298 * len(ner.places(len(ner.tokenizer(Q.tokenizer_path()).encode("one two three " * 100).ids)))
    assert max(b.nbytes for b in made) < 16 * ner.GROUP_BYTES
    windows = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    found = ner.predict(Frame([windows], "doc_id long"), Q.stub_classifier, Q.LABELS)
    assert len(found) == -(-windows.num_rows // ner.GROUP_WINDOWS)
    assert sum(b.num_rows for b in found) == len(windows.column("ids").flatten())


ODD = ["", None, " ", "\n", " a", "a\n", "a b\nc", "a  b", "a \nb", "don't, I'm 'sure' x.'s", "é à\xa0b \x85c", "漢字 かな 😀 😀b", "<|endoftext|> a <|endoftext|>", "a\0 b", "12 3.5-x_y\tz", "word" * 40 + " end", "Клиент Иван Петров, тел. 8"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_have_the_tokens_of_whole_texts(name, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ner, "CACHE_PIECES", 50)
    r, path = random.Random(7), Q.tokenizer_path(name)
    signs = ["a", "é", "Ж", "漢", "😀", " ", " ", " ", "\n", "\t", "\xa0", "᠎", "　", "\r", "'", "'s", ",", ".", "-", "1", "½", "word", "I'm "]
    texts = ODD + ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    e = ner.Encoder(path)
    assert e.parted == name.startswith("byte")
    for _ in range(2):  # the second time from what is held
        values, counts = e.encode(pa.array(texts))
        for text, part in zip(texts, np.split(values, np.cumsum(counts)[:-1]), strict=True):
            want = ner.tokenizer(path).encode(text or "", add_special_tokens=False)
            assert part[:, 0].tolist() == want.ids and [tuple(x) for x in part[:, 1:].tolist()] == want.offsets, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_recognized_entities_are_those_of_the_windows_rows(spark, sf, name):
    path = Q.tokenizer_path(name)
    long = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text").desc()).limit(4).collect()]
    docs = spark.createDataFrame(list(enumerate(ODD + long + ["one two three " * n for n in (84, 85, 86, 150, 154)])), "doc_id int, text string").repartition(2)
    rows = lambda df: sorted((r["doc_id"], r["start"], r["stop"], r["label"], round(r["score"], 9)) for r in df.collect())
    got = ner.recognize(docs, path, Q.stub_classifier, Q.LABELS).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    if name.startswith("byte"):  # tokens of one place have no order in entities(); here they keep that of the text
        want = sorted((i, *x) for i, t in enumerate(r["text"] for r in docs.orderBy("doc_id").collect()) for x in by_hand(t, path, Q.LABELS))
    else:
        want = rows(ner.entities(ner.predict(ner.token_windows(docs, path), Q.stub_classifier, Q.LABELS)))
    assert rows(got) == want


def test_entities_are_found_without_a_shuffle(spark, sf, capsys):
    for q in (Q.ner_entities, Q.sem_ner_candidates):
        q(spark, sf).explain()
        plan = capsys.readouterr().out
        assert "MapInArrow" in plan and "Exchange" not in plan


def test_candidates_lie_in_no_full_name(spark, tmp_path):
    """The spans beside which candidates are new are those of all detectors: full names, too, and cards."""
    words = ["Клиент А. Г. Петров", "Клиент А. Д. Орлов", "Клиент А. Е. Иванов", "Cardholder: John Smith", "карта 4276 1890 7414 4957", "обычный текст"]
    texts = [f"{a}. {b}, one two. {c}" for a in words for b in words for c in words]
    texts += ["one two three four five six seven eight nine ten eleven twelve"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spans = Q.span_rows(docs, "full_name").select("doc_id", F.col("start").alias("a"), F.col("stop").alias("b"))
    inside = lambda rows: rows.join(spans, "doc_id").filter("a <= start AND stop <= b").count()
    e = ner.recognize(docs, Q.tokenizer_path(), Q.stub_classifier, Q.LABELS).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    assert inside(ner.candidates(e, docs, Q.span_rows(docs, "email", "phone"))) > 0
    got = Q.sem_ner_candidates(spark, str(tmp_path))
    assert inside(got) == 0 and not got.isEmpty()


def test_spans_in_others(spark):
    from spanforge.functions.spans import touched

    r = random.Random(3)
    rows = [([(a, a + r.randint(1, 9)) for a in (r.randint(0, 40) for _ in range(6))], [(a, a + r.randint(1, 15)) for a in (r.randint(0, 40) for _ in range(4))]) for _ in range(60)] + [([(1, 2)], []), ([], [(1, 2)])]
    df = spark.createDataFrame(rows, "s array<struct<start:int,stop:int>>, o array<struct<start:int,stop:int>>")
    for x in df.select("s", "o", touched(F.col("s"), F.col("o")).alias("t"), touched(F.col("s"), F.col("o"), contained=True).alias("c")).collect():
        assert x["t"] == [any(a < d and c < b for c, d in x["o"]) for a, b in x["s"]]
        assert x["c"] == [any(c <= a and b <= d for c, d in x["o"]) for a, b in x["s"]]
