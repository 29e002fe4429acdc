"""Derived views: what a query reads once, or in part, is not stored whole."""
import pytest

from gate import views as v
from gate.catalog import QUERIES


@pytest.fixture
def fresh(monkeypatch):
    """As in a session that has stored no view yet."""
    monkeypatch.setattr(v, "_written", {})


@pytest.mark.parametrize("name", ["search_index", "search_index_own_base", "index_snapshot_hash", "quality_filtered"])
def test_read_once_is_not_stored(spark, sf_dir, fresh, name):
    QUERIES[name](spark, sf_dir).collect()
    assert v._written == {}


@pytest.mark.parametrize("name", ["airline_analysis", "fare_summary", "dedup_records", "sink_append_new"])
def test_only_used_columns_are_stored(spark, sf_dir, fresh, name):
    """And the result is that of the whole table, where operators may find columns that they do without otherwise."""
    pruned = sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    (path,) = v._written.values()
    whole = v._observations(spark, sf_dir).columns
    assert set(spark.read.parquet(path).columns) < set(whole)
    v.sparse(spark, sf_dir)
    assert sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) == pruned


@pytest.mark.parametrize("name", ["all_aggregations", "sink_published", "run_analytics"])
def test_result_tables_store_what_they_use(spark, sf_dir, fresh, name):
    test_only_used_columns_are_stored(spark, sf_dir, fresh, name)


def test_computed_equals_stored(spark, sf_dir, fresh):
    for view in (v.sparse, v.dirty, v.landed, v.flattened):
        once = sorted(map(repr, view(spark, sf_dir, once=True).collect()))
        assert once == sorted(map(repr, view(spark, sf_dir).collect())) and once
    assert v.sparse(spark, sf_dir, "route").columns == v.sparse(spark, sf_dir).columns  # stored whole by now


def test_line_items_are_not_sorted(spark, sf_dir, fresh):
    plan = v.options(spark, sf_dir, once=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_documents_are_compressed(spark, sf_dir, fresh):
    names = spark.read.text(v.records_json(spark, sf_dir)).inputFiles()
    assert names and all(name.endswith(".txt.gz") for name in names)
    assert len(QUERIES["src_observation_json"](spark, sf_dir).collect()) == v.dirty(spark, sf_dir, once=True).count()


def test_laid_out_stores_no_second_copy(spark, sf_dir, fresh):
    """The table by month of travel is computed from the driver's tables, without storing all observations beside it."""
    v.laid_out(spark, sf_dir)
    assert [name for _, _, name in v._written] == ["laid_out"]


def test_csv_is_compressed(spark, sf_dir, fresh):
    for path in (v.searches_csv(spark, sf_dir), v.options_csv(spark, sf_dir)):
        names = [f.split("/")[-1] for f in spark.read.text(path).inputFiles()]
        assert names and all(n.endswith(".csv.gz") for n in names)
