import pytest
from oracle import SF, compare

from millrace.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fits_have_finite_factors(spark):
    from millrace.plans.training import als_fit, plsi_fit

    for fit in (als_fit, plsi_fit):
        df = fit(spark, SF)
        assert df.count() > 0 and df.where("x IS NULL OR isnan(x)").count() == 0
