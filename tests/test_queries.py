"""Every registered query beside its SQL; those without SQL are tested in test_models.py."""

import pytest
from compare import spark_rows, sql_rows

import __spark_entry__ as entry_module
from vicinage.plans import registry

entry_module.queries()
NAMES = sorted(registry.SQL)
#: Queries without SQL, all of them tested in test_models.py but graph_align, whose operator is tested there.
OTHERS = {"auto_label", "auto_relabel", "bias_variance", "cluster", "cross_val_auc", "estimate_model", "fit_predict", "graph_align", "iterated_max_subarray", "learning_curve", "model_search", "model_selection", "predictive_performance", "regress", "sequence_predict", "stable_match", "truncated_svd", "vector_relabel"}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    assert spark_rows(registry.QUERIES[name](spark, small)) == sql_rows(registry.SQL[name], small)


def test_queries_without_sql_are_known():
    assert set(registry.QUERIES) - set(registry.SQL) == OTHERS


def test_alignment_of_all_names(spark, small):
    """Every name's characters have at most one partner, and no partner is taken twice."""
    rows = registry.QUERIES["graph_align"](spark, small)
    one = rows.groupBy("pair_id", "a_vid").count().filter("count > 1").count() + rows.groupBy("pair_id", "b_vid").count().filter("count > 1").count()
    assert one == 0 and rows.select("pair_id").distinct().count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["graph_id", "feature", "value"]


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
