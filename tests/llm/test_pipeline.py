import pytest

import corpus_pipeline as P
from compare import same
from spanforge.llm import decontaminate, queries, simhash
from test_quality_rules import brute
from test_simhash import groups, slow_fingerprint


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(P.STAGES)
    kept = stages["quality_rules"](spark, docs, sf)
    assert sorted(kept.columns) == sorted(docs.columns)
    # this table has too few labels to certify a cutoff, so the base rules decide
    base = {i for i, t in texts.items() for m in [brute(t)] if m[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r["doc_id"] for r in kept.collect()} == base
    fps = {i: simhash._signed(slow_fingerprint(texts[i])) for i in base}
    label = groups(set(fps.values()))
    least = {}
    for i in sorted(base):
        least.setdefault(label[fps[i]], i)
    near = stages["simhash_near_dedup"](spark, kept, sf)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(least.values())
    cut = stages["substring_dedup"](spark, near, sf)
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(after) == set(least.values()) and all(len(t) <= len(texts[i]) for i, t in after.items())
    items = [p for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for p in decontaminate.windows(decontaminate.words_of(r["text"]))]
    joined = {i: b" " + b" ".join(decontaminate.words_of(t)) + b" " for i, t in after.items()}
    clean = {i for i, t in joined.items() if not any(b" " + b" ".join(p) + b" " in t for p in items)}
    assert {r["doc_id"] for r in stages["decontamination"](spark, cut, sf).collect()} == clean


def test_run_packs_what_is_left(spark, sf):
    rows = P.run(spark, sf)
    assert rows.count() > 0 and "ids" not in rows.columns


def test_empty_and_odd_documents(spark, sf, odd):
    for docs in (odd, odd.filter("false")):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf)
        docs.count()
