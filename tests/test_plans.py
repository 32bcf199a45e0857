"""Plans and figures of queries whose tables grow with the input."""

from __future__ import annotations

import pytest

from helixlake.plans import queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["extract_segments", "feature_remap", "region_overlap_join", "dangling_refs", "invalid_segments", "mrna_checks", "translate_region", "genbank_roundtrip"])
def test_no_table_that_grows_is_broadcast(spark, name):
    """The planner takes a derived table for as small as its file; a join must not gather it in the driver."""
    text = plan(queries.QUERIES[name](spark, SMALL))
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_guides_of_a_molecule_stay_in_one_partition(spark):
    """Guides are made where their molecule was dealt to: no guide is broadcast or moved, only narrow rows of molecules."""
    for name, scans in (("guide_off_targets", 2), ("guide_ranking_top20", 3)):
        text = plan(queries.QUERIES[name](spark, SMALL))
        assert "Broadcast" not in text and text.count("Exchange") == scans and text.count("REPARTITION_BY_NUM") == scans


@pytest.mark.parametrize("name", ["pcr_linear", "pcr_circular", "fasta_roundtrip", "feature_remap", "edit_apply"])
def test_a_molecule_is_derived_once(spark, name):
    """Filters and later columns refer to values; the first of the eight digests of a sequence is in the plan once."""
    assert plan(queries.QUERIES[name](spark, SMALL)).count("|0") == 1


def test_ligation_is_dealt_in_blocks(spark):
    """One overhang is one key: its product of vectors and inserts is a grid of blocks."""
    text = plan(queries.QUERIES["ligation_candidates"](spark, SMALL))
    join = next(x for x in text.split("\n") if "SortMergeJoin" in x)
    assert "_block" in join and "_at" in join
