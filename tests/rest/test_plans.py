"""Every registered query against its SQL."""

import pytest
from compare import assert_same

from corploom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0
