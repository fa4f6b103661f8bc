"""Plans are those we want: shuffles counted, columns pruned, no theta joins."""

import re

import pytest

from tessera import catalog
from tessera.operators import blocks as bl
from tessera.sources import relations

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"(?<!Broadcast)Exchange ", text))


def test_cascade_adds_no_shuffle_to_its_blocks(spark):
    blocks = relations.blocks(spark, SF)
    assert shuffles(plan(blocks)) == shuffles(plan(bl.cascade(bl.candidates(blocks)))) == 1  # frames in order; the block before is in the same task


@pytest.mark.parametrize("name", ["motion_search_argmin", "faded_motion", "dhash_join", "containment_join", "adjacent_activity", "iou_pairs"])
def test_no_theta_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(("name", "columns"), [("plane_build", "user_id,ts,value"), ("block_stats", "vec_id,embedding,label"), ("corpus_rollup", "l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus")])
def test_scans_read_what_is_used(spark, name, columns):
    schema = re.search(r"ReadSchema: struct<(.*)>", plan(catalog.QUERIES[name](spark, SF)))[1]
    read = set(re.findall(r"(\w+):", schema))
    assert read <= set(columns.split(",")) | {"element"}


def test_plane_is_aggregated_before_its_shuffle(spark):
    text = plan(catalog.QUERIES["plane_build"](spark, SF))
    assert "partial_sum" in text and shuffles(text) == 1


def test_rank_limits_before_it_windows(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["topn_configs"](spark, SF))


@pytest.mark.parametrize("name", ["motion_search_argmin", "motion_correlation", "sobel_tag"])
def test_blocks_are_scored_within_rows(spark, name):
    assert shuffles(plan(catalog.QUERIES[name](spark, SF))) == 1  # frames in order


def test_spikes_of_large_groups_are_limited_before_they_meet(spark):
    text = plan(catalog.QUERIES["spike_report"](spark, SF))
    assert "WindowGroupLimit" in text and "partial_stddev_pop" in text
    assert len(re.findall(r"\bWindow \[", text)) == 1


@pytest.mark.parametrize("name", ["projection_segments", "morph_open_close"])
def test_a_frame_is_spread_over_ranges(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert re.search(r"hashpartitioning\(frame#\d+, _range#\d+L", text)


def test_closed_loop_needs_no_python(spark):
    text = plan(catalog.QUERIES["closed_loop_coding"](spark, SF))
    assert "Pandas" not in text and "Arrow" not in text and "Python" not in text


@pytest.mark.parametrize("name", ["motion_mode_decision", "screen_mode_decision", "carried_vectors"])
def test_mode_decision_takes_stacks_of_frames(spark, name):
    """Frames meet the ones before once, blocks aren't dealt out again, and no row is a pixel."""
    text = plan(catalog.QUERIES[name](spark, SF)).split("== Initial Plan ==")[-1]
    assert text.count("lag(px") == 1 and text.count("MapInArrow") == 2
    assert "median" not in text and "facts" not in text
