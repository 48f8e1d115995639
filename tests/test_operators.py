import random
import time

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scalars as S
from spanforge.functions.spans import find
from spanforge.operators import core, joins, lifecycle, models, mutate
from spanforge.streaming.vault import bucket_rate, rolling_rate


def test_derived_key_and_keyed_digest_match_the_standard_library(spark):
    import hashlib
    import hmac

    key = S.derive_key(b"master", b"salt", b"info")
    got = spark.createDataFrame([("текст",)], "t string").select(S.hmac_sha256(key, F.col("t"))).first()[0]
    assert got == hmac.new(key, "текст".encode(), hashlib.sha256).hexdigest()


def test_find_equals_finditer(spark):
    import re

    r = random.Random(3)
    texts = ["".join(r.choice("ab1 😀\n.") for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", find(F.col("t"), ("a+", r"[1 ]*", "b?"), flags="").alias("m"))
    for row in df.collect():
        want = [(m.start(), m.end(), [m.end(1), m.end(2), m.end(3)]) for m in re.finditer(r"(a+)([1 ]*)(b?)", row["t"])]
        assert [(m["start"], m["stop"], m["cuts"]) for m in row["m"]] == want


def test_random_compositions_come_back(spark):
    from spanforge.plans.fixtures import TEXTS

    r = random.Random(42)
    docs = spark.createDataFrame([(i, ", ".join(r.sample(TEXTS, r.randint(1, 4)))) for i in range(50)], "doc_id int, text string")
    out = core.restore(core.mask(core.resolve(core.detect(docs)), b"k"))
    assert out.filter("NOT (restored <=> text)").count() == 0


def test_mutations_move_the_gold(spark):
    docs = spark.createDataFrame([(1, "ab, cd-e f", [(4, 6, "X")]), (2, "no gold", [])], "doc_id int, text string, gold " + mutate.GOLD)
    got = {}
    for r in mutate.mutate_all(docs).filter("doc_id = 1").collect():
        got[r["mutation"]] = [r["text"][g["start"] : g["stop"]] for g in r["gold"]]
    assert got["uppercase"] == ["CD"] and got["lowercase"] == ["cd"] and got["nbsp_spaces"] == ["cd"]
    assert got["bracket_wrap"] == ["[cd"] and got["prefix_suffix"] == ["cd"] and got["repeat_value"] == ["cd", "cd"]
    assert got["chunk_boundary"] == ["\n---\ncd"] and got["emoji_combining"] == ["\U0001f600c\u0301d"] and got["reorder_fields"] == ["cd"]
    assert mutate.mutate_all(docs).filter("doc_id = 2").count() == 10


def test_sentences_keep_abbreviations_and_initials(spark):
    text = "Живёт в г. Пермь. Ул. Мира! А. С. Пушкин;\nконец"
    rows = joins.sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start").collect()
    assert [text[r["start"] : r["stop"]] for r in rows] == ["Живёт в г. Пермь. ", "Ул. Мира! ", "А. С. Пушкин;\n", "конец"]


def test_claims_follow_leases(spark):
    rows = [("a", "k", 1, "w1", 0.0, 10.0), ("a", "k", 2, "w2", 5.0, 10.0), ("a", "k", 3, "w2", 10.0, 10.0), ("a", "k", 4, "w1", 12.0, 10.0)]
    df = spark.createDataFrame(rows, "namespace string, key string, seq long, owner string, at double, lease_seconds double")
    assert [r["granted"] for r in lifecycle.claims(df).orderBy("seq").collect()] == [True, False, True, False]


def test_distinct_pairs_are_scored_once(spark):
    pairs = spark.createDataFrame([(1, "p", "h"), (2, "p", "h"), (3, "q", "h")], "span_id int, premise string, hypothesis string")
    seen = []

    def scorer(distinct):
        seen.append(distinct.count())
        return distinct.select("premise", "hypothesis", F.lit(0.9).alias("entail"), F.lit(0.05).alias("neutral"), F.lit(0.05).alias("contra"))

    assert models.score_pairs(pairs, scorer).count() == 3 and seen == [2]


def test_rolling_rate_counts_each_event_in_every_window(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "view") for i in range(5)]
    events = spark.createDataFrame(rows, "event_id int, t string, event_type string").select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = rolling_rate(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), window="4 seconds")
    q = stream.writeStream.format("memory").queryName("rate_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rate_out").agg(F.sum("n")).first()[0] == 20
    assert bucket_rate(events).count() == 5


def test_a_rejected_write_changes_nothing(spark):
    rows = [("n", "a", 1, 90), ("n", "b", 2, 50), ("n", "c", 3, 10), ("n", "a", 4, 95), ("n", "a", 5, 20), ("n", "d", 6, 70), ("m", "a", 1, 101)]
    df = spark.createDataFrame(rows, "namespace string, key string, seq int, size_bytes int")
    got = {(r["namespace"], r["seq"]): r["accepted"] for r in lifecycle.within_capacity(df, 3, 100).collect()}
    assert got == {("n", 1): True, ("n", 2): False, ("n", 3): True, ("n", 4): False, ("n", 5): True, ("n", 6): True, ("m", 1): False}
    assert lifecycle.within_capacity(df.filter("false"), 3, 100).count() == 0


def test_records_are_worked_on_by_their_owner(spark):
    steps = [
        ("claim", "a", 0, True), ("claim", "a", 1, False), ("commit", "b", 2, False), ("reclaim", "b", 9, False), ("reclaim", "b", 10, True), ("commit", "a", 11, False), ("commit", "b", 12, True),
        ("reclaim", "a", 90, False), ("get", None, 91, True), ("get", None, 112, False), ("claim", "c", 113, True), ("release", "b", 114, False), ("release", "c", 115, True), ("get", None, 116, False),
        ("claim", "d", 117, True), ("delete", None, 118, True), ("delete", None, 119, False),
    ]
    df = spark.createDataFrame([("n", "k", i, a, o, float(t), 10.0, 100.0) for i, (a, o, t, _) in enumerate(steps)], "namespace string, key string, seq int, action string, owner string, at double, lease_seconds double, ttl_seconds double")
    assert [r["done"] for r in lifecycle.records(df).orderBy("seq").collect()] == [s[3] for s in steps]


def test_changed_texts_get_their_tokens_back(spark):
    docs = core.mask(core.resolve(core.detect(spark.createDataFrame([(1, "write to a@b.org now")], "doc_id int, text string"), ("email",))), b"k")
    stored = docs.select(F.lit("n").alias("namespace"), F.col("doc_id").alias("payload_id"), "mapping")
    token = docs.first()["mapping"][0]["token"]
    asked = spark.createDataFrame([("n", 1, f"I wrote to {token}, not ⟦PII:EMAIL:xxxxxxxxxxxxxxxxxxxxxx⟧"), ("n", 2, token)], "namespace string, payload_id int, text string")
    got = {r["payload_id"]: r["restored"] for r in lifecycle.restore_tokens(asked, stored).collect()}
    assert got == {1: "I wrote to a@b.org, not ⟦PII:EMAIL:xxxxxxxxxxxxxxxxxxxxxx⟧", 2: None}


def test_answers_are_guarded(spark):
    docs = core.mask(core.resolve(core.detect(spark.createDataFrame([(1, "a@b.org")], "doc_id int, text string"), ("email",))), b"k").select("doc_id", "mapping")
    token = docs.first()["mapping"][0]["token"]
    out = core.guard_output(docs.withColumn("text", F.lit(f"ask {token} or new@c.org")), b"other", ("email",)).first()
    assert token in out["guarded"] and "new@c.org" not in out["guarded"] and out["guarded"].count("⟦") == 2


def test_logits_have_to_be_finite(spark):
    ok = spark.createDataFrame([([1.0, 2.0],)], "x array<double>").select(models.softmax(F.col("x")).alias("p")).first()["p"]
    assert abs(sum(ok) - 1) < 1e-12
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([1.0, float("inf")],)], "x array<double>").select(models.softmax(F.col("x"))).collect()


def test_running_equals_a_loop(spark):
    from itertools import accumulate

    from spanforge.functions.spans import running

    r = random.Random(5)
    rows = [([r.randrange(100) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 128, 129, 5000)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()
    assert [(x["s"], x["m"]) for x in got] == [(list(accumulate(x["v"])), list(accumulate(x["v"], max))) for x in got]


def test_islands_equal_a_loop(spark):
    r = random.Random(6)
    rows = []
    for i in range(80):
        spans = [(a, a + r.randint(1, 6)) for a in (r.randrange(190) for _ in range(r.choice([0, 1, 2, 40, 90])))]
        rows.append((i, "x" * 200, [("C" + str(k % 3), f"d{k % 4}", "r", 0.5, a, b, [(a, b)], []) for k, (a, b) in enumerate(spans)]))
    from spanforge.operators.detectors import DETECTION

    for row in core.resolve(spark.createDataFrame(rows, f"doc_id int, text string, detections array<{DETECTION}>")).collect():
        want = []
        for a, b, _, c, d in sorted(((d["start"], d["stop"], i, d["category"], d["detector_id"]) for i, d in enumerate(row["detections"])), key=lambda x: (x[0], x[0] - x[1], x[2])):
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], b), want[-1][2], want[-1][3] + ([d] if d not in want[-1][3] else []))
            else:
                want.append((a, b, c, [d]))
        assert [tuple(x) for x in row["resolved"]] == want


def test_pieces_are_cut_like_slices(spark):
    from spanforge.functions.spans import cuts_of

    r = random.Random(7)
    text = "".join(r.choice("aб😀\n") for _ in range(5000))
    at = [(0, 0), (0, 5000), (1023, 1025), (1024, 2048), (5000, 5000), (4096, 4097)] + [tuple(sorted((r.randint(0, 5000), r.randint(0, 5000)))) for _ in range(60)]
    df = spark.createDataFrame([(text, at), ("", [(0, 0)]), (None, [])], "text string, s array<struct<start:int,stop:int>>")
    got = df.select(cuts_of(F.col("text"), F.col("s")).alias("c")).collect()
    assert got[0]["c"] == [text[a:b] for a, b in at] and got[1]["c"] == [""]


def test_time_grows_with_the_text_only(spark):
    """From 20 000 to 80 000 spans in one text, found, resolved and masked; with growing arrays this takes 16 times as long."""
    import time

    took = {}
    for n in (2000, 20000, 80000):
        docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("write to a@b.org, я "), n).alias("text"))
        out = core.mask(core.resolve(core.detect(docs, ("email",))), b"k", action="opaque_token_full")
        began = time.time()
        assert out.select(F.size("mapping")).first()[0] == n
        assert out.select("masked_text").first()[0].endswith(f"write to [REDACTED-{n - 1}], я ")
        took[n] = time.time() - began
    assert took[80000] < 8 * took[20000] + 2


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_a_loop(spark, forward):
    """One key holds most rows, over many blocks of which some hold no right rows; keys and places are null, places tie."""
    r = random.Random(8)
    draw = lambda n: [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(0, 400, 7)]), i) for i in range(n)]
    left, right = draw(150), draw(25)
    a = spark.createDataFrame(left, "k int, at int, row int")
    b = spark.createDataFrame(right, "k int, at int, v int")
    for width in (10, 4096):
        got = {x["row"]: (x["at_found"], x["v"]) for x in joins.as_of(a, b, "k", "at", "v", forward, width).collect()}
        want = {}
        for k, at, row in left:
            fits = [(p, v) for k2, p, v in right if None not in (k, at, p) and k == k2 and (p >= at if forward else p <= at)]
            want[row] = (min if forward else max)(fits) if fits else (None, None)
        assert got == want
    assert joins.as_of(a.filter("false"), b, "k", "at", "v", forward).count() == 0
    assert joins.as_of(a, b.filter("false"), "k", "at", "v", forward).filter("v IS NULL").count() == 150


def test_lookups_take_time_in_proportion(spark):
    """restore and combine: four times the tokens or detections take far less than sixteen times as long."""
    import time

    def took(n):
        docs = spark.createDataFrame([(1, "\n".join(f"m{i}@cd.org" for i in range(n)))], "doc_id int, text string")
        masked = core.mask(core.resolve(core.detect(docs, ("email",))), b"k").select("doc_id", "masked_text", "mapping", "text")
        masked.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir')}/lookups-{n}")
        t = time.time()
        assert core.restore(spark.read.parquet(path)).filter("restored <> text").count() == 0
        restored, t = time.time() - t, time.time()
        found = core.combine(core.detect(docs, ("email", "card")), (core.CombinationRule("r", "EMAIL", "CARD"),))
        assert found.selectExpr("size(filter(detections, x -> size(x.sensitive) > 0)) AS n").first()["n"] == 0
        return restored, time.time() - t

    took(2000)
    small, large = took(20_000), took(80_000)
    assert all(b < 8 * max(a, 0.5) for a, b in zip(small, large)), (small, large)


@pytest.mark.parametrize("width", [10, 4096])
def test_range_joins_by_all_pairs(spark, width):
    """One key holds most rows, over many blocks of which some hold one side only; keys and places are null, spans tie and nest."""
    r = random.Random(11)

    def spans(n):
        out = []
        for i in range(n):
            a = r.choice([None, *range(0, 300, 3)])
            out.append((r.choice([1, 1, 1, 2, None]), r.choice("xy"), a, None if a is None else a + r.randint(1, 40), i))
        return out

    left, right, third = spans(120), spans(30), spans(30)
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, category string, start int, stop int, row int")
    a, b, c = make(left), make(right), make(third)
    known = lambda rows: [x for x in rows if None not in x]
    tests = {
        "near": (lambda **k: joins.near(a, b, 5, 20, width=width, **k), lambda x, y: y[2] - 5 <= x[2] <= y[3] + 20),
        "overlap": (lambda **k: joins.overlapping(a, b, width=width, **k), lambda x, y: x[2] < y[3] and y[2] < x[3]),
        "contain": (lambda **k: joins.overlapping(a, b, contained=True, same_category=True, width=width, **k), lambda x, y: x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3]),
        "unless": (lambda **k: joins.near_unless(a, b, c, 5, 60, width=width, **k), lambda x, y: y[2] - 5 <= x[2] <= y[3] + 60 and not any(z[0] == x[0] and z[2] > y[3] and z[3] <= x[2] for z in known(third))),
    }
    for name, (run, test) in tests.items():
        want = {x[4] for x in known(left) if any(x[0] == y[0] and test(x, y) for y in known(right))}
        out = run()
        assert {x["row"] for x in out.collect()} == want and out.columns == a.columns, name
        assert {x["row"] for x in run(anti=True).collect()} == set(range(120)) - want, name


def test_no_task_of_a_range_join_holds_a_key(spark):
    """A key with all rows: windows are dealt by block, so the largest group any task sorts is a block."""
    e = spark.range(40_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 5).alias("stop"))
    out = joins.near(e, e.filter("start % 7 = 0"), 2, 2, width=1024)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "__block" in plan and out.count() + joins.near(e, e.filter("start % 7 = 0"), 2, 2, anti=True, width=1024).count() == 40_000


def test_only_words_that_read_as_one_name_are_joined(spark):
    text = "Иван Петров Анна Смирнова, дом окно"
    at = lambda *words: [(1, text.index(w), text.index(w) + len(w)) for w in words]
    spans = lambda rows: spark.createDataFrame([(*r, text) for r in rows], "doc_id int, start int, stop int, text string")
    joined = lambda rows: {text[r["start"] : r["stop"]] for r in models.join_names(spans(rows)).collect()}
    assert joined(at("Иван", "Петров")) == {"Иван Петров"}
    assert joined(at("Иван Петров", "Анна Смирнова")) == set()
    assert joined(at("Смирнова", "дом")) == set() and joined(at("дом", "окно")) == set()


def test_sentences_of_a_long_text_take_time_in_proportion(spark):
    """Words before a dot come from the piece before it, not from a walk through the whole text for every sign."""
    one = "Он жил в г. Москве, ул. Мира. Да! A. B\n\nКонец; точка. "

    def took(n):
        best = []
        for _ in range(2):
            began = time.time()
            got = joins.sentences(spark.createDataFrame([(1, one * n)], "doc_id int, text string")).agg(F.count("*"), F.max("stop")).first()
            best.append(time.time() - began)
        assert tuple(got) == (5 * n, len(one) * n)
        return min(best)

    assert took(8000) < 8 * took(2000) + 1


def test_a_row_of_neighbouring_tokens_is_tested_without_backtracking():
    """Of 40 values in a row the text is spoiled at its end: a pattern tried all ways to deal the tokens to the spans."""
    from spanforge.operators.evaluate import accepted

    t = "⟦PII:CARD:a-1⟧"
    spans = [(5 * i, 5 * i + 4) for i in range(40)]
    text, masked = " ".join(["1234"] * 40), " ".join([t] * 40)
    assert accepted(text, spans, masked) and accepted(text, spans, masked + "\n") and accepted(text, spans, masked + " " + t)
    assert not accepted(text, spans, masked + "x") and not accepted(text, spans, masked[len(t) + 1 :]) and not accepted(text, spans, masked.replace(" ", "", 1))
    # by the pattern itself, on short rows of tokens, planted ones too
    import re

    r = random.Random(3)
    for _ in range(3000):
        gaps = ["".join(r.choice(["", " ", "\n", "x", t]) for _ in range(r.randint(0, 2))) for _ in range(r.randint(1, 4))]
        at, spans = 0, []
        for g in gaps[:-1]:
            spans.append((at + len(g), at + len(g) + 2))
            at += len(g) + 2
        text = "12".join(gaps)
        masked = "".join(g + (" " if r.random() < 0.3 else "").join([t] * r.randint(0 if r.random() < 0.1 else 1, 3)) for g in gaps[:-1]) + gaps[-1] + r.choice(["", "", "x", "\n"])
        run = rf"{t}(?:\s*{t})*"
        assert accepted(text, spans, masked) == (re.match("^" + run.join(re.escape(g) for g in gaps) + "$", masked) is not None), (text, spans, masked)


def test_refine_works_a_passage_out_once(spark, sf):
    """Guards and labels at names are read from a table by all that follows; rows are those of the SQL."""
    from spanforge.plans import fixtures
    from spanforge.plans import queries as Q

    out = Q.sem_refine(spark, sf)
    assert "kinds_at" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = fixtures.relation(spark, sf, Q._sem_sql(Q._SEM_ANSWERS, "decision, reason"), "orders").select("doc_id", "decision", "reason")
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_spans_work_the_detectors_out_once(spark, sf, capsys):
    from spanforge.plans import fixtures, queries

    found = queries.span_rows(fixtures.texts(spark, sf), "inn")
    found.explain("extended")
    plan = capsys.readouterr().out.partition("Optimized Logical Plan")[2].partition("Physical Plan")[0]
    assert plan and "RLIKE(CASE" not in plan and "isnotnull(CASE" not in plan


def test_empty_and_null_detections_give_no_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.com and c@d.org"), (2, "nothing"), (3, None), (4, "")], "doc_id int, text string")
    found = core.detect(docs, ("email", "phone"))
    assert [(r["doc_id"], r["start"], r["stop"]) for r in core.spans(found).orderBy("doc_id", "start").collect()] == [(1, 0, 7), (1, 12, 19)]
    assert [tuple(r) for r in core.category_counts(core.resolve(found)).collect()] == [(1, "EMAIL", 2)]


def test_mutations_of_whole_texts_equal_those_by_character(spark):
    texts = ["ΣΑΣ ΣΟΦΟΣ İß ŉ, ﬁ 😀Σ", "", None, "Иван, ab-c, Σ", "one field", "a, b"]
    docs = spark.createDataFrame([(i, t, g) for i, t in enumerate(texts) for g in ([], [(0, 3, "X"), (2, 4, "Y")])], "doc_id int, text string, gold " + mutate.GOLD)
    rows = lambda df: [(r["doc_id"], r["text"], r["gold"]) for r in df.orderBy("doc_id", F.size("gold")).collect()]
    assert rows(mutate.uppercase(docs)) == rows(mutate._rewritten(docs, lambda c, i: F.upper(c)))
    assert rows(mutate.lowercase(docs)) == rows(mutate._rewritten(docs, lambda c, i: F.lower(c)))
    for name in ("bracket_wrap", "emoji_combining", "reorder_fields"):
        for r in mutate.ALL[name](docs).filter("size(gold) = 0").collect():
            want = texts[r["doc_id"]]
            assert r["text"] == want or name == "reorder_fields" and sorted(r["text"].split(", ")) == sorted(want.split(", "))


def test_mutations_read_stored_labelled_texts(spark, sf, capsys):
    from spanforge.plans import queries

    queries.lab_action_a(spark, sf).explain("extended")
    assert "Join" not in capsys.readouterr().out.partition("Optimized Logical Plan")[2]


def test_spans_are_joined_with_their_sentences(spark, tmp_path):
    """By a loop: sentences by Python's own expression, and for each span the last one that starts at or before it; a sentence without spans stays."""
    import bisect
    import random
    import re

    from spanforge.operators import joins
    from spanforge.plans import queries

    def cut(text):
        at = [0]
        for m in re.finditer(r"[.!?;]\s+|\n+", text):
            word = re.search(r"([А-ЯЁа-яёA-Za-z]+)$", text[max(0, m.start() - 12) : m.start()]) if m.group().startswith(".") else None
            if not (word and (len(word.group()) == 1 or word.group().lower() in joins.ABBREVIATIONS)):
                at.append(m.end())
        return [(a, b) for a, b in zip(at, [*at[1:], len(text)]) if a < b]

    r = random.Random(11)
    words = ["Иван", "г", "a@b.org", "c.d@e.com", ". ", "! ", "; ", "\n", "\n\n", ".\x1c", "? ", " ", "x", "+7 912 345-67-89", "Адрес: г. Пермь, ул. Мира, дом 3", "😀"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(80)] + ["", None, "\n", "a@b.org", ("a@b.org. " * 700)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = {}
    for x in queries.span_rows(spark.read.parquet(f"{tmp_path}/documents.parquet"), *[c.lower() for c in queries.semantic.ELIGIBLE]).collect():
        spans.setdefault(x["doc_id"], []).append((x["category"], x["start"], x["stop"]))
    want = []
    for i, t in enumerate(texts):
        own = cut(t or "")
        starts = [a for a, _ in own]
        at = [max(0, bisect.bisect_right(starts, s[1]) - 1) for s in spans.get(i, [])]
        want += [(i, *own[k], *s) for k, s in zip(at, spans.get(i, []))] + [(i, *b, None, None, None) for k, b in enumerate(own) if k not in at]
    got = [tuple(x) for x in queries.join_sentence(spark, str(tmp_path)).collect()]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key) and len({x[3] for x in got}) > 2
