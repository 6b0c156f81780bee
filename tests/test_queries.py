import pytest

import __spark_entry__ as entry
from quern import plans
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert oracle.spark_rows(plans.QUERIES[name](spark, SF)) == oracle.duck_rows(duck, plans.ORACLES[name])


#: Further tables of the same fits as gbt_loco, task_f_tuned, shap_by_family and dm_boosted_by_fold, whose parts test_learned.py tests.
SAME_FITS = {"gbt_seed_spread", "gbt_tier_summary", "gbt_city_by_tier", "task_n_tuned", "shap_top_features", "dm_boosted_lags"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - SAME_FITS))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
