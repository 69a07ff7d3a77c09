import pytest
from compare import same

from readloom.plans import registry

ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_both_engines_agree(spark, duck, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).limit(5).toPandas().shape[0] > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
