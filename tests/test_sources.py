import json

import pytest

from spanforge import sources
from spanforge.functions import scalars as S


def test_requests_have_a_fixed_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"payload": "a@b.org", "payload_id": "1", "other": 3}\n')
    row = sources.requests(spark, str(tmp_path / "r.json")).first()
    assert row.asDict() == {"payload": "a@b.org", "payload_id": "1"}
    assert sources.requests(spark, str(tmp_path), stream=True).isStreaming


def test_cases_have_to_be_true_to_their_texts(spark, tmp_path):
    case = {"id": "x", "text": "ab cd", "gold": [{"category": "A", "start": 0, "end": 2, "text": "ab"}, {"category": "B", "start": 3, "end": 5, "text": "cd"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"cases": [case]}))
    assert len(sources.cases(spark, str(path)).first()["gold"]) == 2
    for broken in ({"start": 1, "end": 3, "text": "ab"}, {"start": 1, "end": 2, "text": "b"}):
        case["gold"] = [{"category": "A", "start": 0, "end": 2, "text": "ab"}, {"category": "B", **broken}]
        path.write_text(json.dumps({"cases": [case]}))
        with pytest.raises(Exception, match="gold spans"):
            sources.cases(spark, str(path)).collect()


def test_files_are_verified(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"model")
    path = str(tmp_path / "m.bin")
    assert sources.verify_files(spark, {path: sources.file_sha256(b"model")}).first()["ok"]
    assert not sources.verify_files(spark, {path: sources.file_sha256(b"other")}).first()["ok"]


def test_logs_hold_allowed_fields_only(spark, tmp_path):
    rows = spark.createDataFrame([("mask", "ok", "secret text")], "operation string, status string, text string")
    sources.safe_log(rows, str(tmp_path / "log"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()] == [{"operation": "mask", "status": "ok"}]
    sources.report(rows.drop("text"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_a_bad_policy_version_counts_for_nothing(spark):
    good = {"consumers": {"a": {"namespace": "a"}}}
    v = sources.policy_versions(spark, [("1", good), ("2", {"consumers": {"a": {"namespace": "b", "allow_unmask": True}}})])
    assert [(r["version"], r["current"]) for r in v.orderBy("ord").collect()] == [("1", False), ("2", True)]
    with pytest.raises(TypeError):
        sources.policy_versions(spark, [("1", good), ("2", {"consumers": {"a": {"nonsense": 1}}})])


def test_manifest_version():
    assert sources.manifest_version({}) == "unknown" and sources.manifest_version({"detector_manifest_version": "s-1"}) == "s-1"


def test_scalars(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a b—c", "7707083893", "12345674")], "t string, inn string, card string").select(
        S.norm_text(F.col("t")).alias("n"), S.inn_valid(F.col("inn")).alias("i"), S.luhn(F.col("card")).alias("l"), S.token_estimate(F.col("t")).alias("e"), S.size_estimate(F.col("t")).alias("s")
    ).first()
    assert row.asDict() == {"n": "a b-c", "i": True, "l": True, "e": 2, "s": 8 + 512}
