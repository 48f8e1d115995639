import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spanforge.llm import quality_rules as Q


def brute(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    cover = {k for i, w in enumerate(wins) if n[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in Q.SYMBOLS), len(lines) - len(set(lines)), len(cover)


def test_metrics_by_brute_force(simple):
    from odd_rows import ODD

    r = random.Random(2)
    texts = list(ODD) + [" ".join(r.choice("abc") for _ in range(n)) for n in (7, 8, 9, 16, 17, 100)] + ["x|y # <b>\n" * 5, "a b c d e f g h a b c d e f g h i", "\n \n a \n a \n"]
    rows = {x["doc_id"]: x for x in Q.metrics(simple(texts)).collect()}
    for i, t in enumerate(texts):
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == brute(t), t


def test_binomial_tail(spark):
    cases = [(100, 0, 0.05), (100, 3, 0.05), (1000, 30, 0.05), (50, 10, 0.05), (20000, 900, 0.05)]
    for n, k, a in cases:
        want = 1.0 if k >= n * a else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log(1 - a)) for i in range(k + 1))
        got = spark.range(1).select(Q.binomial_tail(F.lit(n), F.lit(k), a)).first()[0]
        assert abs(got - want) <= 1e-9 * max(1, want)


def test_cutoffs_reject_junk_and_keep_clean(spark, make):
    clean, junk = "the quick brown fox jumps over some lazy dogs while %d people look on and wonder about it all day %d", "a | b # c | d & e | f * g | h < i > j | k | l | m | n %d %d | o | p | q | r | s"
    rows = [(i, (junk if i % 5 == 0 else clean) % (i, i + 1), "en", "s", 1) for i in range(4000)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    assert {r["certified_by"] for r in Q.judge(docs, labels).select("certified_by").distinct().collect()} == {"stratum"}
    out = Q.judge(docs, labels)
    kept = {r["doc_id"] for r in out.filter("kept").select("doc_id").collect()}
    assert kept == {i for i in range(4000) if i % 5}
    assert Q.keep(docs, labels).count() == len(kept)
    # labels that call the junk good allow no cutoff on symbols
    assert Q.judge(docs, labels.withColumn("quality", F.lit(1))).filter("NOT kept AND NOT base_failed").count() == 0


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert Q.judge(odd, labels).count() == odd.count()
    assert Q.keep(odd.withColumn("n_words", F.lit("mine")), labels).columns[-1] == "n_words"
    assert Q.judge(odd.filter("false"), labels.filter("false")).count() == 0


def test_small_strata_get_cutoffs_together(spark, make):
    clean, junk = "the quick brown fox jumps over some lazy dogs while %d people look on and wonder about it all day %d", "a | b # c | d & e | f * g | h < i > j | k | l | m | n %d %d | o | p | q | r | s"
    # 320 good rows of en, 100 each of de and fr: too few for four rules apart, or for one language
    rows = [(i, (junk if i % 5 == 0 else clean) % (i, i + 1), "en" if i < 400 else "de" if i < 525 else "fr", "s", 1) for i in range(650)]
    docs = make(rows)
    label = lambda good: spark.createDataFrame([(i, int(bool(good(i))), 0) for i in range(650)], "doc_id long, quality int, toxic int")
    ids = lambda labels: {r["doc_id"] for r in Q.keep(docs, labels).collect()}
    assert ids(label(lambda i: i % 5)) == {i for i in range(650) if i % 5}
    # a stratum with rows enough whose labels call the junk good takes no setting of a coarser one; nor do small ones, as the whole isn't safe
    assert ids(label(lambda i: i % 5 or i < 400)) == set(range(650))
    # too few rows for the whole
    few = label(lambda i: i % 5).filter("doc_id < 350")
    assert ids(few) == set(range(650))


def test_query_and_stage_with_certified_cutoffs(spark, make, tmp_path):
    """Tables that certify cutoffs of strata, of a language and of the whole go through the query, its SQL and the pipeline's first stage."""
    import duckdb

    import corpus_pipeline
    from compare import same
    from spanforge.llm import oracles

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    rows, labels = [], []
    for i in range(2600):
        lang = "en" if i < 1500 else "de" if i < 2150 else "fr" if i < 2300 else r.choice(["es", "xx", None])
        n, bad = (60, 200, 600)[i % 3 if lang != "de" else 0], i % 10 == 0
        words = [word() + (r.choice("|#$%&") * 3 if bad and k % 2 else "|" if r.random() < 0.02 else "") for k in range(n)]
        lines = [" ".join(words[k : k + 10]) for k in range(0, n, 10)]
        rows.append((i, "\n".join(lines + lines[:1] * (i % 4)), lang, "s", 1))
        if i % 7:
            labels.append((i, int(not bad), 0))
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = Q.op9_quality_rules(spark, str(tmp_path))
    same(out, duck, oracles.OP9)
    held = {(x["kept"], x["base_failed"], x["certified_by"]) for x in out.collect()}
    assert {x[2] for x in held} >= {"stratum", "language", "all", None} and (False, False, "stratum") in held
    kept = {x["doc_id"] for x in out.filter("kept").collect()}
    stage = corpus_pipeline.quality_stage(spark, make(rows), str(tmp_path))
    assert {x["doc_id"] for x in stage.collect()} == kept
