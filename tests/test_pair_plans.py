"""Plans of the queries over candidate pairs: what grows with the square of the rows is sorted or counted, not broadcast."""

from lumaspan import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()


def test_gate_joins_pairs_once_and_broadcasts_none(spark):
    p = plan(spark, "cheap_gate")
    assert "BroadcastHashJoin" not in p and p.count("SortMergeJoin") == 1


def test_classification_joins_pairs_once_and_broadcasts_none(spark):
    p = plan(spark, "pair_classification")
    assert "BroadcastHashJoin" not in p and p.count("SortMergeJoin") == 1


def test_provenance_merges_by_bits(spark):
    p = plan(spark, "candidate_provenance")
    assert "Join" not in p and "ObjectHashAggregate" not in p and "collect_set" not in p


def test_mutual_neighbours_are_counted_where_they_were_found(spark):
    """No vector is shuffled after the search: the plan reads stored neighbours and counts pairs."""
    p = plan(spark, "cosine_topk_mutual")
    assert "CoGroup" not in p and "Window" not in p and "HashAggregate" in p
