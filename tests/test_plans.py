"""Physical plans: no products of tables, filters and columns reach the scans."""

import io
from contextlib import redirect_stdout

import pytest

from scanloom.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["Q1_search_epochs", "J1_hierarchy_chain", "J10_nearest_sibling", "J11_calibration_scan", "J12_physio_files",
                                  "J13_two_sided_asof", "J14_range_join", "J15_fuzzy_lab_match", "Q4_has_access", "M4_change_access",
                                  "M7_trash_cascade", "T5_voxel_tsnr", "R9_attach_recordings", "W11_forward_fill"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_search_pushes_filters_and_prunes(spark):
    text = plan(QUERIES["Q1_search_epochs"](spark, SF))
    assert "PushedFilters" in text and "GreaterThanOrEqual(o_orderdate" in text or "IsNotNull(o_custkey)" in text
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert not any("l_extendedprice" in s or "o_totalprice" in s or "c_acctbal" in s for s in scans)
