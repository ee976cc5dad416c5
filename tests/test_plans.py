"""Plans that matter at scale: what is read, what is shuffled, and where Python runs."""

import re

import pytest

from velaspan.plans import queries as plans


def plan(spark, data, name):
    return plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if not n.startswith("bootstrap_")))  # whose replicates are products of matrices
def test_core_plans_have_no_python_and_no_product(spark, data, name):
    text = plan(spark, data, name)
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", text)


@pytest.mark.parametrize("name", ["regex_detections", "greedy_resolved_spans", "detections_per_document", "slot_substitution", "scan_messages", "cleaned_text", "literal_references"])
def test_row_operators_do_not_shuffle(spark, data, name):
    assert "Exchange" not in plan(spark, data, name)


@pytest.mark.parametrize("name, rules", [("regex_detections", 4), ("greedy_resolved_spans", 8), ("exact_match_micro", 8)])
def test_patterns_run_once(spark, data, name, rules):
    """A rule's expression names each of its two extractions once; were it copied into a filter, they would be more."""
    text = plan(spark, data, name)
    assert text.count("regexp_extract_all") == 2 * rules and text.count("RLIKE") == rules


def test_neighbours_are_merged_within_the_row(spark, data):
    text = plan(spark, data, "adjacent_merge")
    assert "Exchange" not in text and text.count("regexp_extract_all") == 2


@pytest.mark.parametrize("name", ["expected_detections", "masked_fields"])
def test_slots_are_filled_once(spark, data, name):
    """The split of a template by its slots stands once in the plan, and few input splits are dealt to all cores."""
    text = plan(spark, data, name)
    assert text.count("arrays_zip(regexp_extract_all(") == 1 and "RoundRobinPartitioning(16)" in text


def test_scans_read_what_is_used(spark, data):
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, data, "regex_detections"))
    assert schema == ["doc_id:bigint,text:string"]
    assert all("text" not in s or "doc_id" in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, data, "exact_match_by_type")))
    pending = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, data, "pending_work"))
    assert set(pending) == {"c_custkey:bigint", "o_custkey:bigint,o_orderstatus:string"}
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan(spark, data, "pending_work")
