from pathlib import Path

import pytest

from talklake import plans
from tests.hostile import DATA, hostile, write

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


def test_core_queries_on_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path / "e", lambda df: df.limit(0))
    for name, f in plans.queries().items():
        assert f(spark, sf).count() >= 0, name


def test_core_queries_on_hostile_tables(spark, tmp_path):
    sf = write(spark, tmp_path / "h", hostile)
    for name, f in plans.queries().items():
        try:
            assert f(spark, sf).count() >= 0
        except Exception as e:
            raise AssertionError(name) from e
