"""Every registered query of the library against its SQL, over whole tables."""

import pytest

from conftest import rows_of
from docloom.plans import registered as catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.SQL:
        assert len(found.columns) > 0 and len(found) > 0
        return
    expected = duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def test_entry_registers_everything(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "evidence_id", "score", "rank"]
