import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SF = "/root/testdata/sf0.001"
QUICK = ["ledger_bank", "row_fingerprint", "ingest_quarantine", "t0_all", "t1_candidates", "t2_pairs", "t3_gates", "sweep_codes", "exception_queue", "score_by_run", "rule_prefix", "provenance_join"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF) is None
