"""Registered queries run their operators with the operators' own sizes."""

import pytest

from cellweave.jobs import queries, workloads
from cellweave.operators import affine, hotspot, scores

SIZES = {"n_iter", "radii", "n_bootstrap", "rmax", "steps"}
CASES = [("g7_shuffle_permutation", hotspot, "g_permutation"), ("g8_resampled_permutation", hotspot, "g_permutation"), ("g10_disc_permutation", hotspot, "g_disc_permutation"), ("g11_radii_mean", hotspot, "g_radii"), ("g11_radii_min", hotspot, "g_radii"), ("g13_h_permutation", hotspot, "h_permutation"), ("c5_bootstrap_share", scores, "bootstrap_share"), ("c6_marker_location", scores, "marker_location"), ("c7_marker_location_job", workloads, "marker_location"), ("t6_affine_medians", affine, "affine_medians"), ("t7_direct_medians", affine, "transform_grid"), ("w2_boundary_what_if_job", workloads, "boundary_what_if")]


class Called(Exception):
    pass


@pytest.mark.parametrize("name, module, operator", CASES)
def test_sizes_are_the_operators_own(spark, monkeypatch, name, module, operator):
    import inspect

    sign = inspect.signature(getattr(module, operator))

    def told(*args, **kwargs):
        raise Called(set(sign.bind(*args, **kwargs).arguments))

    monkeypatch.setattr(module, operator, told)
    with pytest.raises(Called) as e:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not e.value.args[0] & SIZES
