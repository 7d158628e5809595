"""Every query of the catalogue: against its SQL, or that it runs and keeps its schema."""

import pytest

import __spark_entry__
from cairn.plans import catalogue
from tests.oracle import MISSING, SF_DIR, assert_same

pytestmark = pytest.mark.skipif(MISSING, reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    assert df.columns and df.count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ranking_has_every_object(spark):
    rows = catalogue.QUERIES["object_ranking"](spark, SF_DIR).collect()
    assert len(rows) == catalogue.QUERIES["object_summary"](spark, SF_DIR).count() > 100
    rows.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows == sorted(rows, key=lambda r: (-r["n_points"], r["cluster_id"]))


def test_synthetic_room_has_the_default_density(spark):
    assert sum(r["n_points"] for r in catalogue.QUERIES["synthetic_room"](spark, SF_DIR).collect()) == 89_000
    assert sum(r["n_points"] for r in catalogue.QUERIES["synthetic_l_room"](spark, SF_DIR).collect()) == 104_000
