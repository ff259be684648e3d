"""Every registered query on the smallest tables, against its check text where it has one."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# fits many models; covered by test_models on smaller settings. The training-data queries have tests of their own
SLOW = {"M5_max_roi_job", "M8_predict_max_roi", "M9_retrain_all", "pipeline"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW and not (n.startswith("op") and n[2].isdigit())])
def test_query(spark, name):
    tab = QUERIES[name](spark, SF).toArrow()
    if name in CHECKS:
        assert compare.diff(tab, compare.check_rows(SF, CHECKS[name])) is None
    else:
        assert tab.num_rows > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert any(r["ticker"] is None for r in rows) and len(rows) > 1


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
