"""Registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, connect

# a cross-section; check.py runs them all
NAMES = """
p1_species_segment p7_collapse_others p10_malformed_times p15_short_track_gate j3_grid_fill
j5_matrix_profile j6_reference_profile a5_group_statistics a7_describe a10_chunked_mode a14_roc_auc
w1_slice_right w3_slice_right_align w8_interleave t2_top_motifs t4_labels_above_noise m2_with_replacement
m5_split_three_ways m9_triplets f4_fragments f5_clock_to_seconds f17_band_energies l10_predict l12_motif_extraction
l13_pair_stream l15_triplet_fragments s6_consolidate s11_skip_existing r1_arriving_recordings
""".split()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    result = compare(spark, con, name, sf, spark_entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0
