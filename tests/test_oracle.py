"""Every engine query against its DuckDB SQL; queries without SQL give rows and the same rows again."""

import pytest

from quarry.plans import catalog

from .compare import assert_same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_is_stable(name, spark, sf_dir):
    one, two = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one == two


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rowid", "score", "fts_score", "vec_score", "like_rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
