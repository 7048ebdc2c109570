"""Every registered query against its SQL twin, and those without one for rows and a stable schema."""

import pytest

from leafmill.plans.catalog import BOOK as ALL
from leafmill.plans.catalog import TWINS as SQL

from .compare import SF, same


def test_every_twin_has_a_query():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(set(ALL) & set(SQL)))
def test_twin(spark, name):
    same(ALL[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_rows_only(spark, name):
    assert ALL[name](spark, SF).count() > 0
