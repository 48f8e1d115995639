import pytest

import __spark_entry__ as entry
from compare import same
from spanforge.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    same(core.QUERIES[name](spark, sf), duck, core.ORACLES[name])


@pytest.mark.parametrize("name", ["core_mask_tokens", "mask_all_categories"])
def test_masked_texts_come_back(spark, sf, name):
    assert core.QUERIES[name](spark, sf).filter("NOT restored_ok").count() == 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sealed_values_are_bound_to_their_record(spark, sf):
    assert core.QUERIES["aead_roundtrip"](spark, sf).filter("NOT (ok AND bound)").count() == 0


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
