import pytest

from tests.oracle import assert_same
from trailstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_whole_outputs_hold_every_event(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    seen = {(r[0], r[1]) for r in events.selectExpr("user_id", "event_id DIV 100").collect()}
    filled = [(r.object_id, r.frame_idx) for r in catalog.QUERIES["outputs_consolidated"](spark, SMALL).collect()]
    assert seen <= set(filled) and len(filled) == len(set(filled))
    merged = {(r.object_id, r.frame_idx) for r in catalog.QUERIES["outputs_merged"](spark, SMALL).collect()}
    assert merged == {(r[0], r[1]) for r in events.selectExpr("user_id", "event_id DIV 2").collect()}


def test_entry_without_text_operators_still_has_these(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).columns[0] == "step_nr"


def test_subsampled_size_is_what_its_branch_promises(spark):
    r = catalog.QUERIES["subsample_size"](spark, SMALL).first()
    points = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert (r.n, r.target) == (points, points // 2)
    assert r.shown == r.target if r.how == "grid" else r.how == "voxels" and abs(r.shown / r.n - 0.5) <= 0.05


def test_estimated_users_are_near_the_count(spark):
    for r in catalog.QUERIES["approx_classes"](spark, SMALL).collect():
        assert abs(r.about - r.users) <= 0.05 * r.users
